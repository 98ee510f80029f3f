"""Documents as rows: HTML, DOCX, PDF where a reader is installed, and the hand-edited sheets and reviews."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import html_escape
from ..staging import cut

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes) -> list[tuple[str, str]]:
    """(tag, text) of a .docx in order: h1, h2, strong (all bold), p, and td of tables. Empty paragraphs are left out."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}tbl":
            out += [("td", text(c)) for row in e.iter(f"{_W}tr") for c in row.iter(f"{_W}tc")]
        elif e.tag == f"{_W}p" and text(e):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
            runs = [r for r in e.iter(f"{_W}r") if text(r)]
            bold = runs and all(r.find(f"{_W}rPr/{_W}b") is not None for r in runs)
            out.append(("h1" if name in ("title", "heading1") else "h2" if name.startswith("heading") else "strong" if bold else "p", text(e)))
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, ord, tag, text of the blocks of all .docx files of a folder. A file that is none gives one error row."""

    def run(batches):
        for batch in batches:
            rows = []
            for p, c in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(p, i, *b) for i, b in enumerate(docx_blocks(bytes(c)))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((p, 0, "error", str(e)))
            yield pd.DataFrame(rows, columns=["path", "ord", "tag", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, ord int, tag string, text string")


#: A gap between characters that parts two cells, and how far the beginnings of cells may lie apart in a column, in sizes
#: of a character.
GAP, ASIDE = 1.5, 1.0


def _printed(chars: DataFrame) -> DataFrame:
    """doc_id, page, line (its top to a tenth), cs: a line's characters from left to right. Cells and lines come from the
    same rows, so that characters are shuffled once."""
    wide = F.col("width") if "width" in chars.columns else F.col("size") * 0.5
    char = F.struct("x", "char", (F.col("x") + wide).alias("end"), "size")
    return chars.groupBy("doc_id", "page", F.round("top", 1).alias("line")).agg(F.array_sort(F.collect_list(char)).alias("cs"))


def pdf_cells(chars: DataFrame) -> DataFrame:
    """Cells of (doc_id, page, top, x, size, char, and width, if there is one) as a PDF reader gives them: doc_id, page, line
    (its top to a tenth), cell (from 0), x, text, size. A line is cut where a gap is wider than GAP sizes."""
    wide = lambda a, b: F.coalesce(b["x"] - a["end"] > GAP * b["size"], F.lit(False))
    begins = lambda i: (i == 0) | wide(F.get("cs", i - 1), F.get("cs", i))
    cut_ = _printed(chars).withColumn("_at", F.filter(F.sequence(F.lit(0), F.size("cs") - 1), begins))
    held = lambda a, k: F.slice("cs", a + 1, F.coalesce(F.get("_at", k + 1), F.size("cs")) - a)
    cell = lambda cs: F.struct(F.get(cs, F.lit(0))["x"].alias("x"), F.trim(F.array_join(F.transform(cs, lambda c: c["char"]), "")).alias("text"), F.array_max(F.transform(cs, lambda c: c["size"])).alias("size"))
    cells = cut_.select("doc_id", "page", "line", F.posexplode(F.filter(F.transform(F.transform("_at", held), cell), lambda c: c["text"] != "")).alias("cell", "c"))
    return cells.select("doc_id", "page", "line", "cell", "c.x", "c.text", "c.size")


def pdf_tables(cells: DataFrame) -> DataFrame:
    """The cells (see pdf_cells) that lie in tables: doc_id, page, table (from 0 on its page), line, row, cell, text.

    A table is a run of two lines or more, one after another on the page, of as many cells (two at least), each of which
    begins within ASIDE sizes of the one above it. A line that is in none is text.
    """
    lines = cells.groupBy("doc_id", "page", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "x"))), lambda c: c["x"]).alias("xs"), F.max("size").alias("size"))
    down = Window.partitionBy("doc_id", "page").orderBy("line")
    above = lines.withColumn("_xs", F.lag("xs").over(down))
    near = F.forall(F.zip_with("xs", "_xs", lambda a, b: F.abs(a - b)), lambda d: F.coalesce(d <= ASIDE * F.col("size"), F.lit(False)))
    goes_on = (F.size("xs") >= 2) & F.coalesce(F.size("xs") == F.size("_xs"), F.lit(False)) & F.coalesce(near, F.lit(False))
    runs = above.withColumn("_run", F.sum((~goes_on).cast("int")).over(down))
    whole = Window.partitionBy("doc_id", "page", "_run")
    rows = runs.withColumn("_n", F.count("*").over(whole)).where("_n > 1").withColumn("row", F.row_number().over(whole.orderBy("line")) - 1)
    rows = rows.withColumn("table", F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy("_run")) - 1)
    # cells are far more than the files they come from tell, so none of these joins may be by broadcast
    return cells.join(rows.select("doc_id", "page", "line", "table", "row").hint("merge"), ["doc_id", "page", "line"]).select("doc_id", "page", "table", "line", "row", "cell", "text")


def pdf_lines(chars: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Lines of (doc_id, page, top, x, size, char): doc_id, page, line, text, tag (h2 if higher than 1.2 times the page's
    mean line, else p). Lines of tables (see pdf_tables) are left out."""
    lines = _printed(chars).select("doc_id", "page", "line", F.array_join(F.transform("cs", lambda c: c["char"]), "").alias("text"), F.array_max(F.transform("cs", lambda c: c["size"])).alias("height"))
    out = lines.withColumn("mean", F.avg("height").over(Window.partitionBy("doc_id", "page")))
    if tables is not None:
        out = out.join(tables.select("doc_id", "page", "line").distinct().hint("merge"), ["doc_id", "page", "line"], "left_anti")
    return out.select("doc_id", "page", "line", "text", F.when(F.col("height") > 1.2 * F.col("mean"), "h2").otherwise("p").alias("tag"))


def pdf_html(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """doc_id, html of the lines of pdf_lines: of a page its tables first, then a paragraph or heading a line; pages in
    order with a break between them."""
    text = F.concat(F.lit("<"), "tag", F.lit(">"), html_escape(F.trim("text")), F.lit("</"), "tag", F.lit(">"))
    parts = lines.select("doc_id", "page", F.lit(1).alias("kind"), F.col("line").cast("double").alias("at"), text.alias("t"))
    if tables is not None:
        cell = F.concat(F.lit("<td>"), html_escape(F.trim("text")), F.lit("</td>"))
        rows = tables.groupBy("doc_id", "page", "table", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", cell.alias("t")))), lambda c: c["t"]), "").alias("t"))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", F.concat(F.lit("  <tr>"), "t", F.lit("</tr>")).alias("t")))), lambda r: r["t"]), "\n")
        made = rows.groupBy("doc_id", "page", "table").agg(F.concat(F.lit("<table>\n"), body, F.lit("\n</table>")).alias("t"))
        parts = parts.unionByName(made.select("doc_id", "page", F.lit(0).alias("kind"), F.col("table").cast("double").alias("at"), "t"))
    page = parts.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("kind", "at", "t"))).alias("ls"))
    page = page.select("doc_id", "page", F.array_join(F.transform("ls", lambda x: x["t"]), "\n").alias("t"))
    pages = F.array_sort(F.collect_list(F.struct("page", "t")))
    return page.groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda x: x["t"]), "\n<!-- page break -->\n").alias("html"))


def pdf_chars(content: bytes):
    """(page, top, x, size, width, char) of a PDF, as its reader (pdfplumber, where it is installed) tells them."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for i, page in enumerate(pdf.pages):
            for c in page.chars:
                yield i, float(c["top"]), float(c["x0"]), float(c["size"]), float(c.get("x1", c["x0"] + c["size"] / 2)) - float(c["x0"]), c["text"]


def read_pdf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(html, errors) of all .pdf files of a folder: doc_id, html with tables and lines; and doc_id, error of files that
    can't be read. A file is read by one task; what follows is done by page and line."""

    def run(batches):
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows, error = [(p, *x, None) for x in pdf_chars(bytes(c))], None
                except Exception as e:  # noqa: BLE001  a reader's errors are of any kind
                    rows, error = [], f"{type(e).__name__}: {e}"
                yield pd.DataFrame(rows if error is None else [(p, None, None, None, None, None, None, error)], columns=["doc_id", "page", "top", "x", "size", "width", "char", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    read = cut(files.mapInPandas(run, "doc_id string, page int, top double, x double, size double, width double, char string, error string"))
    chars = read.where("error is null").drop("error")
    tables = pdf_tables(pdf_cells(chars))
    return pdf_html(pdf_lines(chars, tables), tables), read.where("error is not null").select("doc_id", "error")


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """leaf, final (the first line of the cell that isn't blank) of a reviewed sheet."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*(c.lstrip("﻿").strip().lower() for c in df.columns))
    lines = F.filter(F.split(F.coalesce("final", F.lit("")), "\r?\n"), lambda x: F.trim(x) != "")
    return df.select(F.trim("leaf").alias("leaf"), F.trim(F.get(lines, F.lit(0))).alias("final")).where("leaf <> ''")


def read_review_markdown(spark: SparkSession, path: str) -> DataFrame:
    """leaf, scope, final of the sections '## Field: name' of a review."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.explode(F.slice(F.split("value", r"(?m)^## Field:\s*"), 2, 1_000_000)).alias("part"))
    pick = lambda name: F.nullif(F.trim(F.regexp_extract("part", rf"(?mi)^[-*\s]*\**{name}\**\s*:\**\s*`?([^`\n]*)`?", 1)), F.lit(""))
    return parts.select(F.trim(F.regexp_replace(F.split_part("part", F.lit("\n"), F.lit(1)), "`", "")).alias("leaf"), pick("Scope").alias("scope"), pick("Final").alias("final"))


def read_condition_form(spark: SparkSession, path: str) -> DataFrame:
    """id, source, condition of the blocks '### Block n' of an older form; a block ends where the next begins."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.explode(F.slice(F.split("value", r"(?m)^### Block\s+"), 2, 1_000_000)).alias("part"))
    pick = lambda name: F.nullif(F.trim(F.regexp_extract("part", rf"(?mi)^[-*\s]*\**{name}\**\s*:\**[ \t]*(.*)$", 1)), F.lit(""))
    return parts.select(F.regexp_extract("part", r"^(\d+)", 1).try_cast("int").alias("id"), pick("Source").alias("source"), pick("Condition").alias("condition"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """path, html of all HTML files of a folder."""
    files = spark.read.option("pathGlobFilter", "*.{html,htm,vm}").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def existing_keys(source: DataFrame) -> DataFrame:
    """key, n of every put("key", ..) in (text) of generated sources: which keys an earlier run has made."""
    found = source.select(F.explode(F.regexp_extract_all("text", F.lit(r'put\(\s*"([^"]+)"'), 1)).alias("key"))
    return found.groupBy("key").agg(F.count("*").alias("n"))


def method_keys(source: DataFrame) -> DataFrame:
    """file, method, key, n of the put("key", ..) of each method in (file, text) of generated sources: a key that one method
    puts twice overwrites itself. A method begins where its name and an opening brace stand; what comes before is "".
    """
    begins = r"\b(\w+)\s*\([^()]*\)\s*\{"
    parts = F.split("text", begins, -1)
    names = F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(begins), 1))
    each = source.select("file", F.explode(F.arrays_zip(names.alias("method"), parts.alias("body"))).alias("m")).select("file", "m.method", F.explode(F.regexp_extract_all("m.body", F.lit(r'put\(\s*"([^"]+)"'), 1)).alias("key"))
    return each.groupBy("file", "method", "key").agg(F.count("*").alias("n"))


def variant_texts(rules: DataFrame) -> DataFrame:
    """Rule texts as documents, so that fields within them are resolved too: doc_id, text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return rules.groupBy().agg(F.array_join(ordered, "\n").alias("text")).select(F.lit("rules").alias("doc_id"), "text")


def with_sheet(form: DataFrame, sheet: DataFrame) -> DataFrame:
    """The blocks of an older form (source, condition; see read_condition_form) with the rows of a sheet beside it (key,
    when, text), by the name in a source such as $clause: source, key, n_rows, problem (no rows, no block)."""
    named = form.withColumn("key", F.nullif(F.regexp_extract("source", r"^\s*\$([A-Za-z_]\w*)\s*$", 1), F.lit("")))
    rows = sheet.groupBy("key").agg(F.count("*").alias("n_rows"))
    both = named.where("key is not null").select("source", "key").join(rows, "key", "full_outer")
    problem = F.when(F.col("n_rows").isNull(), "no rows").when(F.col("source").isNull(), "no block")
    own = named.where("key is null").select("source", F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("n_rows"), F.lit(None).cast("string").alias("problem"))
    return both.select("source", "key", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), problem.alias("problem")).union(own)


_ZIP_TEXT = re.compile(rb"(<w:t(?: [^>]*)?>)([^<]*)(</w:t>)")
_ZIP_PARAGRAPH = re.compile(rb"<w:p[ >].*?</w:p>", re.DOTALL)


def docx_rewritten(content: bytes, mapping: dict[str, str]) -> tuple[bytes, list[str]]:
    """A .docx with {leaf} changed to {path}, its symbol kept, and the leaves that were found. A marker that a change of
    style cuts into several runs goes into the first of them; all else of the file stays as it is."""
    from xml.sax.saxutils import escape, unescape

    marker, found = re.compile(r"\{([$+*]?)(" + "|".join(map(re.escape, sorted(mapping, key=len, reverse=True))) + r")\}") if mapping else None, set()

    def paragraph(m: re.Match) -> bytes:
        texts = [unescape(t.group(2).decode()) for t in _ZIP_TEXT.finditer(m[0])]
        whole, new = "".join(texts), list(texts)
        starts = [sum(map(len, texts[:i])) for i in range(len(texts))]
        for x in reversed(list(marker.finditer(whole))):
            found.add(x[2])
            made, a, b = "{" + x[1] + mapping[x[2]] + "}", x.start(), x.end()
            for i in reversed(range(len(texts))):
                lo, hi = max(a, starts[i]), min(b, starts[i] + len(texts[i]))
                if lo < hi:
                    put = made if lo == a else ""
                    new[i] = new[i][: lo - starts[i]] + put + new[i][hi - starts[i] :]
        it = iter(new)
        return _ZIP_TEXT.sub(lambda t: t[1] + escape(next(it)).encode() + t[3], m[0])

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in old.infolist():
            data = old.read(item)
            if marker and re.fullmatch(r"word/(document|header\d*|footer\d*)\.xml", item.filename):
                data = _ZIP_PARAGRAPH.sub(paragraph, data)
            z.writestr(item, data)
    return out.getvalue(), sorted(found)


def rewritten_docx(spark: SparkSession, path: str, mapping: dict[str, str]) -> DataFrame:
    """path, content, missed (leaves that it doesn't have) of all .docx files of a folder, rewritten."""

    def run(batches):
        for batch in batches:
            rows = [(p, *docx_rewritten(bytes(c), mapping)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame([(p, c, [x for x in mapping if x not in f]) for p, c, f in rows], columns=["path", "content", "missed"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, content binary, missed array<string>")


def is_schema_version(found: str, expected: str) -> bool:
    """Whether a file's version can be read: the same major number, and a minor one that is not newer."""
    number = lambda v: [int(x) for x in re.findall(r"\d+", v)[:2]] + [0, 0]
    (a, b, *_), (c, d, *_) = number(found), number(expected)
    return a == c and b <= d
