"""Shared pieces of the corpus operators: table access, staged tables, and word hashing with numpy."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: The white space that the operators' contracts name: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Rows that Spark hands to a Python worker at a time, unless the session says otherwise: texts are long, and both sides hold
#: a batch and what is made of it.
ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Makes a session ready for the operators: the package on the executors, and batches of texts, not of numbers."""
    ship(spark)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000" and not spark.sparkContext.getConf().contains(batch):  # as it is by default
        spark.conf.set(batch, str(ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, an own one of this machine,
    if the session runs within it; a cluster has to name one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_own_shared_folder", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = sc._own_shared_folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        sc.setCheckpointDir(found)
    return found


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Hadoop's file system, whichever store it is in."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone; what is left is only scratch
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; what is in it goes when the driver ends."""
    prepare(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_folder, spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, after the staged table old, which nothing still to run reads, is deleted, and what its making shuffled too."""
    spark = old.sparkSession
    drop_folder(spark, old._staged_at)
    spark._jvm.System.gc()  # Spark deletes shuffle files once nothing on the driver refers to them
    return new


#: Bits of the table of hashes that rows are held against before a join: 4 MB, however large the tables are.
BITS = 1 << 25


def maybe_in(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose column may be among those of ids, which are all that are and few others, and rows whose column is
    not. A join that follows has to shuffle the texts of the first alone."""
    at, bucket, bits = (unused(df, f"_{x}") for x in ("at", "bucket", "bits"))
    hashed = F.pmod(F.xxhash64(column), F.lit(BITS)) + 1
    table = ids.select(hashed.alias(at)).groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    both = df.withColumn(at, F.bitmap_bit_position(hashed)).withColumn(bucket, F.bitmap_bucket_number(hashed)).join(F.broadcast(table), bucket, "left")
    byte = F.conv(F.hex(F.substring(bits, (F.col(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False))
    return both.where(there).drop(at, bucket, bits), both.where(~there).drop(at, bucket, bits)


def ascii_lower(c):
    """Lower-cases A-Z alone. lower() does the same, faster, where all characters are of one byte."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


# --- words and their hashes, for a whole batch of texts at once ------------------------------------------------------

BLANK = np.zeros(256, bool)
BLANK[list(BLANKS.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_LONG = 256
_powers: dict[int, np.ndarray] = {}
#: Texts of about this many bytes are hashed at a time: what a worker holds besides is some tens of times as much.
CHUNK = 1 << 20


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    if len(have := _powers.get(base, ())) < n:
        have = np.full(max(n, CHUNK + 1), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
        if n > 4 * CHUNK:  # not kept: a single very long text
            del _powers[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK):
    """(from, to, bytes, offsets) of runs of texts of about size bytes; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, len(texts))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and each text's first word's number (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes: polynomial hashes by prefix sums, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = _LOWER[data] if lower else data
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]
        h = mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(ends - starts >= _LONG):  # polynomials modulo 2 ** 64 have known collisions among long words
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def coded(data: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], pa.Array]:
    """The distinct ones of byte strings that lie one after another, and the number among them of each."""
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices


def laid_out(parts: list[bytes], which: pa.Array) -> tuple[bytes, np.ndarray]:
    """parts[i] for each i of which one after another, and where each begins; one more at the end."""
    out = pa.array(parts, pa.large_binary()).take(which)
    return out.buffers()[2].to_pybytes() if out.buffers()[2] is not None else b"", np.frombuffer(out.buffers()[1], np.int64)[: len(out) + 1]


def sequences(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A 64-bit Rabin-Karp hash of every n consecutive words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out *= np.uint64(base)
            out += h[i : len(h) - n + 1 + i]
        return mix(out)


def lean(f):
    """f, a function over batches, after which a worker gives back what it no longer needs: Spark keeps workers for later
    stages, and these would hold the most that any stage took."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
