"""Document files as a data source of Spark's: spark.read.format("palimpsest_documents").load(folder).

A partition is a file, so that a large or slow one holds up no other; a file that can't be read is a row with an error, and
the job goes on. Folders are listed and files read by Arrow's file systems, in whichever store their address names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "palimpsest_documents"
#: Kinds by the ends of file names (fixed).
KINDS = {".docx": "docx", ".html": "html", ".htm": "html", ".vm": "html", ".pdf": "pdf"}


class _File(InputPartition):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind


class _Documents(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        named = sorted((f.path, KINDS[end]) for f in found if f.type == fs.FileType.File for end in KINDS if f.path.lower().endswith(end))
        return [_File(p, k) for p, k in named] or [_File("", "none")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        from pyarrow import fs

        try:
            store = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
            with store.open_input_stream(partition.path) as f:
                blocks = list(self._blocks(partition.kind, f.read()))
        except Exception as e:  # noqa: BLE001  whatever is wrong with a file is told of that file
            yield partition.path, partition.kind, 0, None, None, f"{type(e).__name__}: {e}"
            return
        for i, (tag, text) in enumerate(blocks):
            yield partition.path, partition.kind, i, tag, text, None

    def _blocks(self, kind: str, content: bytes) -> Iterator[tuple[str, str]]:
        from ..operators.dom import tree
        from .documents import docx_blocks, pdf_chars

        if kind == "docx":
            yield from docx_blocks(content)
        elif kind == "html":
            yield from ((n["within"], n["text"]) for n in tree(content.decode("utf-8", "replace")) if n["text"])
        else:
            line, place = [], None
            for page, top, x, _, _, char in sorted(pdf_chars(content), key=lambda c: (c[0], round(c[1], 1), c[2])):
                if place not in (None, (page, round(top, 1))):
                    yield "p", "".join(line).strip()
                    line = []
                place = page, round(top, 1)
                line.append(char)
            if line:
                yield "p", "".join(line).strip()


class DocumentSource(DataSource):
    """path, kind, ord, tag, text of the blocks of all documents of a folder, and error of files that can't be read."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, kind string, ord int, tag string, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Documents(self.options["path"])


def register(spark: SparkSession) -> None:
    from ..shipping import ship

    ship(spark)
    spark.dataSource.register(DocumentSource)
