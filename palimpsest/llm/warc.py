"""Legacy archive converter: ARC files (versions 1 and 2) to WARC files, and readers and writers of both."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, staged

#: Fields of the ARC header line by version, as the format's description names them.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Bytes decompressed at a time.
STEP = 1 << 20
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


class Stream:
    """Reads lines and counted bytes from a plain or gzipped archive that is in memory as it was stored."""

    def __init__(self, stored: bytes):
        self.rest, self.at, self.buffer, self.pos = memoryview(stored), 0, b"", 0
        self.gzip = stored[:2] == b"\x1f\x8b"
        self.inflater = zlib.decompressobj(31) if self.gzip else None

    def _more(self) -> bool:
        if self.at >= len(self.rest) and not (self.gzip and self.inflater.unconsumed_tail):
            return False
        if not self.gzip:
            new, self.at = bytes(self.rest[self.at : self.at + STEP]), self.at + STEP
        else:
            if self.inflater.eof:  # the next member
                self.inflater = zlib.decompressobj(31)
            piece = self.inflater.unconsumed_tail or self.rest[self.at : self.at + STEP]
            if not self.inflater.unconsumed_tail:
                self.at += len(piece)
            new = self.inflater.decompress(piece, 4 * STEP)
            self.at -= len(self.inflater.unused_data)
        self.buffer, self.pos = self.buffer[self.pos :] + new, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end."""
        start = self.pos
        while (i := self.buffer.find(b"\n", start)) < 0:
            start = len(self.buffer) - self.pos
            if not self._more():
                if self.pos == len(self.buffer):
                    return None
                i = len(self.buffer)
                break
        out, self.pos = self.buffer[self.pos : i], i + 1
        return out[:-1] if out.endswith(b"\r") else out

    def take(self, n: int) -> bytes:
        if len(self.buffer) - self.pos < n:
            parts, have = [self.buffer[self.pos :]], len(self.buffer) - self.pos
            self.buffer, self.pos = b"", 0
            while have < n:
                if not self._more():
                    raise ValueError("an archive ends within a record")
                parts.append(self.buffer)
                have += len(self.buffer)
                self.buffer = b""
            whole = b"".join(parts)
            self.buffer, self.pos = whole, 0
        out, self.pos = self.buffer[self.pos : self.pos + n], self.pos + n
        return out


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def quoted(url: str) -> str:
    """A URL with what would break a header line percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


# --- ARC ---------------------------------------------------------------------------------------------------------------


def arc_opening(version: int, name: str, date: str) -> bytes:
    """The version block that an ARC file begins with."""
    body = f"{version} 0 own\nURL IP-address Archive-date Content-type " + ("Result-code Checksum Location Offset Filename " if version == 2 else "") + "Archive-length\n"
    more = f"200 - - 0 {name} " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(body)}\n{body}\n".encode()


def arc_record(version: int, name: str, url: str, ip: str, date: str, kind: str, block: bytes) -> bytes:
    more = f"200 {zlib.crc32(block):08x} - 0 {name} " if version == 2 else ""
    return f"{quoted(url)} {ip} {date} {kind} {more}{len(block)}\n".encode() + block + b"\n"


def arc_records(stored: bytes) -> Iterator[dict]:
    """Records of an ARC file: the fields of its version's header line, and block. The first is the version block."""
    stream, version = Stream(stored), None
    while (line := stream.line()) is not None:
        if not line:
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        if version is None:
            # the block names the version, so the count of fields tells how to read its own line
            fields = ARC_FIELDS[2] if len(parts) >= len(ARC_FIELDS[2]) else ARC_FIELDS[1]
        else:
            fields = ARC_FIELDS[version]
        if len(parts) < len(fields) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:200]!r}")
        # a URL may hold spaces, in old files: all that is over belongs to it
        over = len(parts) - len(fields)
        record = dict(zip(fields, [" ".join(parts[: over + 1]), *parts[over + 1 :]], strict=True))
        record["block"] = stream.take(int(record["length"]))
        if version is None:
            if not record["url"].startswith("filedesc:"):
                raise ValueError("an ARC file begins with its version block")
            version = int(record["block"].split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
        yield record | {"version": version}


def told(records: Iterator) -> Iterator[tuple]:
    """(record, None) of each record, and (None, what is wrong) where a file can't be read any further: a truncated one, or
    one that isn't what it should be. What came before it counts."""
    try:
        for record in records:
            yield record, None
    except (ValueError, KeyError, EOFError, OSError, zlib.error) as e:
        yield None, f"{type(e).__name__}: {e}"


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """Writes pages (page_id, url, html) as gzipped ARC files, one a partition, versions 1 and 2 in turn."""

    def members(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name, first = 1 + part % 2, f"part-{part:05d}.arc.gz", True
        for batch in batches:
            out = [arc_opening(version, name, date)[:-1]] if first else []
            first = False
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (html or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n"
                out.append(arc_record(version, name, url or f"urn:page:{page_id}", "0.0.0.0", date, "text/html", head.encode() + body)[:-1])
            for i in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 500], pa.binary())], names=["value"])

    pages.select("page_id", "url", "html").mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


# --- WARC --------------------------------------------------------------------------------------------------------------

CONVERTED = "target string, ip string, date string, arc_date string, filename string, record_id string, type string, mime string, page_id long, digest string, n_payload long, block_digest string, head binary, payload binary"


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """Header (with the empty line) and body of an HTTP response; None if it isn't one. Old servers end lines in \\n alone."""
    m = re.search(rb"\r?\n\r?\n", block) if block.startswith(b"HTTP/") else None
    return (block[: m.end()], block[m.end() :]) if m else None


def _page_id(head: bytes) -> int | None:
    m = re.search(rb"(?i)\nX-Page-Id: *(-?\d+)", head)
    return int(m[1]) if m else None


#: The date of records whose ARC date can't be read.
NO_DATE = "1970-01-01T00:00:00Z"


def warc_date(date: str) -> str | None:
    """An ARC date (14 digits, the last of which may be missing) as a WARC date; None if it isn't one."""
    digits = re.fullmatch(r"(\d{4,14})\d*", date)
    try:
        return dt.datetime.strptime(digits[1] + "00000101000000"[len(digits[1]) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ") if digits else None
    except ValueError:
        return None


def _information(block: bytes) -> bytes:
    """The fields of a warcinfo record in place of an ARC version block, which they quote line by line."""
    said = [x.strip() for x in block.decode("utf-8", "replace").splitlines() if x.strip()]
    lines = ["software: palimpsest", "format: WARC File Format 1.1", "conformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/"]
    return "".join(f"{x}\r\n" for x in lines + [f"arc-version-block: {x}" for x in said]).encode()


def _synthesised(record: dict, name: str, at: int) -> tuple:
    """What a WARC record needs and an ARC header line doesn't have. A date that can't be read is NO_DATE, and kept as it is besides."""
    block, date = record["block"], record["date"]
    when = warc_date(date)
    record_id = f"urn:uuid:{uuid.uuid5(_NAMES, f'{name}#{at}#{record["url"]}')}"
    http = split_http(block)
    mime = record["type"]
    if record["url"].startswith("filedesc:"):
        kind, head, payload, mime = "warcinfo", b"", _information(block), "application/warc-fields"
        block = payload
    elif http:
        kind, (head, payload), mime = "response", http, "application/http; msgtype=response"
    else:
        kind, head, payload = "resource", b"", block
    named = record["url"].partition("://")[2] if kind == "warcinfo" else None
    return quoted(record["url"]), record["ip"], when or NO_DATE, None if when else quoted(date), named and quoted(named), record_id, kind, mime, _page_id(head), sha1_base32(payload), len(payload), sha1_base32(block), head, payload


def _broken(name: str, at: int, error: str) -> tuple:
    """A metadata record in place of what can't be read of a file, which says why."""
    said = error.encode()
    return f"urn:archive:{quoted(name)}", None, NO_DATE, None, None, f"urn:uuid:{uuid.uuid5(_NAMES, f'{name}#{at}#{error}')}", "metadata", "text/plain", None, sha1_base32(said), len(said), sha1_base32(said), b"", said


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every archive file in a folder, in whichever store. A file is read by one task."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def convert_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the ARC files in a folder, with the WARC fields synthesised (CONVERTED).

    Identifiers are name-based, so that a task run again gives the same ones. payloads=False leaves head and payload out.
    Where a file can't be read any further, a metadata record says why, and the job goes on with the other files.
    """
    names = _names(CONVERTED)

    def parse(batches):
        for batch in batches:
            for name, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for at, (record, error) in enumerate(told(arc_records(stored.as_py()))):
                    row = _broken(name.rpartition("/")[2], at, error) if error else _synthesised(record, name.rpartition("/")[2], at)
                    rows.append(row if payloads else (*row[:-2], b"", b""))
                    held += len(row[-1]) if payloads else 100
                    if held > 4 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
                yield _batch(rows, names)

    return archives(spark, path).mapInArrow(parse, CONVERTED)


_TYPES = {"page_id": pa.int64(), "n_payload": pa.int64(), "head": pa.binary(), "payload": pa.binary(), "refers_to": pa.int64(), "payload_bytes": pa.int64()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(n, pa.string())) for c, n in zip(columns, names, strict=True)], names=names)


def with_revisits(records: DataFrame, small: DataFrame, min_bytes: int) -> DataFrame:
    """records with refers_id, refers_page, refers_target and refers_date: the response that a record with the same payload
    points to, or null.

    Only payloads on two records or more are kept as winners. These are written first, so their size is known: Spark
    broadcasts them if they are under its limit, and else joins by digest with skewed digests split.
    """
    seen = small.where(F.col("type").isin("response", "resource") & (F.col("n_payload") >= min_bytes))
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "record_id", "target", "date")
    winners = seen.groupBy("digest", "n_payload").agg(F.count("*").alias("n"), F.max(order).alias("best")).where("n > 1")
    named = {"refers_page": "page_id", "refers_id": "record_id", "refers_target": "target", "refers_date": "date"}
    winners = staged(winners.select("digest", "n_payload", *(F.col(f"best.{c}").alias(n) for n, c in named.items())), "winners")
    own = F.col("type").isin("response", "resource")
    joined = records.withColumn("_key", F.when(own, F.col("digest"))).join(winners.withColumnRenamed("digest", "_key").withColumnRenamed("n_payload", "_n"), ["_key"], "left")
    again = F.col("refers_id").isNotNull() & (F.col("refers_id") != F.col("record_id")) & (F.col("n_payload") == F.col("_n"))
    return joined.withColumns({n: F.when(again, F.col(n)) for n in named}).drop("_key", "_n")


def warc_record() -> Column:
    """The bytes of a WARC/1.1 record, without the two line ends that close it."""
    revisit = F.col("refers_id").isNotNull()
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.col("type"))
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.when(F.col("type") != "warcinfo", F.col("target"))),
        field("WARC-IP-Address", F.when(F.col("type") == "response", F.col("ip"))),
        field("WARC-Payload-Digest", F.when(F.col("type") != "warcinfo", F.concat(F.lit("sha1:"), "digest"))),
        field("WARC-Block-Digest", F.when(~revisit, F.concat(F.lit("sha1:"), "block_digest"))),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        field("WARC-Refers-To", F.concat(F.lit("<"), "refers_id", F.lit(">"))),
        field("WARC-Refers-To-Target-URI", F.col("refers_target")),
        field("WARC-Refers-To-Date", F.col("refers_date")),
        field("WARC-Filename", F.col("filename")),
        field("X-Refers-To-Page", F.when(revisit, F.col("refers_page").cast("string"))),
        field("X-Payload-Length", F.when(revisit, F.col("n_payload").cast("string"))),
        field("X-ARC-Date", F.col("arc_date")),
        field("Content-Type", F.col("mime")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head.cast("binary"), block)


def arc_to_warc(spark: SparkSession, arc: str, warc: str, min_bytes: int = 0) -> None:
    """Converts a folder of ARC files into one of gzipped WARC files.

    Records whose payload of min_bytes or more is that of a record with a larger page id become revisits of it.
    """
    records = with_revisits(convert_arc(spark, arc), convert_arc(spark, arc, payloads=False), min_bytes)
    records.select(warc_record().cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(warc)


def warc_records(stored: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields with lower-case names, block) of each record of a WARC file, plain or gzipped."""
    stream = Stream(stored)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        fields: dict = {}
        while line := stream.line():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, stream.take(int(fields["content-length"]))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, record_id string, date string"


def _left_out(fields: dict, head: bytes) -> int | None:
    """The length of a revisit's payload."""
    n = re.search(rb"(?i)\nContent-Length:[ \t]*(\d+)", head)
    return int(fields["x-payload-length"]) if fields.get("x-payload-length", "").isdigit() else int(n[1]) if n else None


def _row_of(fields: dict, block: bytes, check: bool) -> tuple | None:
    """A record as a row (READ); None for kinds that have no page."""
    kind = fields.get("warc-type")
    if kind is None:
        return None, None, None, "error", None, "a record without WARC-Type", fields.get("warc-record-id", "").strip("<>"), fields.get("warc-date")
    if kind not in ("response", "resource", "revisit"):
        return None
    head, payload = split_http(block) or (b"", block)
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2] or (None if kind == "revisit" else sha1_base32(payload))
    n = _left_out(fields, head or payload) if kind == "revisit" else len(payload)
    page, record_id = fields.get("x-refers-to-page", ""), fields.get("warc-record-id", "").strip("<>")
    if check and kind != "revisit" and sha1_base32(payload) != digest:
        return _page_id(head), n, digest, "error", None, "payload and digest differ", record_id, fields.get("warc-date")
    return _page_id(head), n, digest, kind, int(page) if re.fullmatch(r"-?\d+", page) else None, fields.get("warc-target-uri"), record_id, fields.get("warc-date")


def read_warc(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """A row per response, resource and revisit record of the WARC files in a folder (READ).

    payload_bytes and payload_digest are those of the full payload, which a revisit leaves out: its length is in a field
    that this writer adds. In revisits of others it is that of the HTTP header they keep, or null if that has none. With
    check, the digests of payloads that are there are computed anew and must agree. A record that has no type, or a wrong
    digest, and what can't be read of a file are rows of record_type error, with what is wrong as their target.
    """
    names = _names(READ)

    def parse(batches):
        for batch in batches:
            for stored in batch.column(1):
                rows = []
                for found, error in told(warc_records(stored.as_py())):
                    row = (None, None, None, "error", None, error, None, None) if error else _row_of(*found, check)
                    if row:
                        rows.append(row)
                    if len(rows) == 10_000:
                        yield _batch(rows, names)
                        rows = []
                yield _batch(rows, names)

    return archives(spark, path).mapInArrow(parse, READ)


def pages_through_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages as ARC files, converts them to WARC, and reads these back (READ).

    A null html is an empty payload, a null url a made-up one; equal page_ids are records of their own, of which the one
    with the larger record id counts as larger; a null page_id is smaller than all and stays null; an empty table gives
    no rows. Columns other than page_id, url and html are not looked at.
    """
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, arc)
    arc_to_warc(spark, arc, warc, min_bytes)
    return read_warc(spark, warc)
