"""Finding values that several documents hold, with sorted arrays instead of a row for each value.

Documents are dealt into blocks by a hash of their id. A block sends, to each of a number of buckets that split the
range of values, the sorted distinct values it has there, in one row. A bucket compares what the blocks sent and answers
each with an array aligned to what it sent. Within a block a value counts once, however many documents repeat it: a
value that a third of all documents hold is still one entry a block. Blocks and buckets grow with the input in number,
not in size; a block sends rows to the buckets that it has values for, so never more rows than values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES = "bucket int, blk int, values binary, more binary, owners binary"
ANSWERS = "blk int, bucket int, mask binary, least binary"
#: No document: larger than any.
NOBODY = np.int64(2**63 - 1)


def block_of(n: int, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def buckets_of(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets, of n that split the range of 64-bit values, that sorted values fall into, and where each begins there;
    one more at the end. The work grows with the values, not with n."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    of = ((values >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    return of[starts], np.append(starts, len(values))


def narrow(ids: np.ndarray) -> bytes:
    """ids with a byte that tells how wide each is."""
    wide = len(ids) and (ids.min() < 0 or ids.max() >= 2**32)
    return b"\x08" + ids.astype("<i8").tobytes() if wide else b"\x04" + ids.astype("<u4").tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8" if data[:1] == b"\x08" else "<u4", offset=1).astype(np.int64)


def entries(block: int, n: int, values: np.ndarray, more: np.ndarray, owners: np.ndarray | None) -> Iterator[tuple]:
    """A row for each bucket that has some of the sorted values. more: something of fixed width beside each value."""
    found, bounds = buckets_of(values, n)
    for i, b in enumerate(found.tolist()):
        part = slice(bounds[i], bounds[i + 1])
        yield b, block, values[part].tobytes(), more[part].tobytes(), narrow(owners[part]) if owners is not None else b""


def as_table(rows, ddl: str) -> pa.Table:
    names, kinds = zip(*(x.split() for x in ddl.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table([pa.array(c, arrow[k]) for c, k in zip(columns, kinds, strict=True)], names=names)


def _gathered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    values = [np.frombuffer(v, "<u8") for v in t["values"].to_pylist()]
    return np.concatenate(values), np.cumsum([0, *map(len, values)])


def _repeated(t: pa.Table) -> pa.Table:
    """more: a byte a value, 1 if several documents of the block have it. The mask has a bit for each value of several."""
    values, at = _gathered(t)
    several = np.concatenate([np.frombuffer(m, np.uint8) for m in t["more"].to_pylist()]).astype(bool)
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = np.zeros(len(v), bool)
    same[1:] = v[1:] == v[:-1]
    same[:-1] |= v[1:] == v[:-1]
    out = several
    out[order[same]] = True
    rows = [(k, b, np.packbits(out[at[i] : at[i + 1]]).tobytes(), b"") for i, (k, b) in enumerate(zip(t["blk"].to_pylist(), t["bucket"].to_pylist(), strict=True))]
    return as_table(rows, ANSWERS)


def repeated(sent: DataFrame) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(_repeated, ANSWERS)


def _counted(t: pa.Table) -> pa.Table:
    """more: 32 bits a value, in how many documents of the block it is. least: in how many of all, for values in several."""
    values, at = _gathered(t)
    own = np.concatenate([np.frombuffer(m, "<u4") for m in t["more"].to_pylist()]).astype(np.int64)
    order = np.argsort(values, kind="stable")
    v = values[order]
    first = np.ones(len(v), bool)
    first[1:] = v[1:] != v[:-1]
    number = np.cumsum(first) - 1
    total = np.empty(len(v), np.int64)
    total[order] = np.add.reduceat(own[order], np.flatnonzero(first))[number]
    rows = []
    for i, (k, b) in enumerate(zip(t["blk"].to_pylist(), t["bucket"].to_pylist(), strict=True)):
        part = total[at[i] : at[i + 1]]
        rows.append((k, b, np.packbits(part > 1).tobytes(), narrow(part[part > 1])))
    return as_table(rows, ANSWERS)


def counted(sent: DataFrame) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(_counted, ANSWERS)


def _least(t: pa.Table) -> pa.Table:
    """more: 32 further bits of each value's hash; owners: the block's smallest document. least: the smallest of all
    for values where it is smaller than the block's own, which mask marks."""
    values, at = _gathered(t)
    more = np.concatenate([np.frombuffer(m, "<u4") for m in t["more"].to_pylist()])
    owners = np.concatenate([widened(x) for x in t["owners"].to_pylist()])
    order = np.lexsort((owners, more, values))
    v, m = values[order], more[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (m[1:] != m[:-1])
    least = np.empty(len(v), np.int64)
    least[order] = owners[order][first][np.cumsum(first) - 1]
    below = least < owners
    rows = []
    for i, (k, b) in enumerate(zip(t["blk"].to_pylist(), t["bucket"].to_pylist(), strict=True)):
        part = slice(at[i], at[i + 1])
        rows.append((k, b, np.packbits(below[part]).tobytes(), narrow(least[part][below[part]])))
    return as_table(rows, ANSWERS)


def least_owners(sent: DataFrame) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(_least, ANSWERS)


def answered(t: pa.Table, n: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's answers for its sorted values: the mask, and the least owners of those that it marks."""
    found, bounds = buckets_of(values, n)
    mask, least = np.zeros(len(values), bool), [np.zeros(0, np.int64)]
    at = np.searchsorted(found, t["bucket"].to_numpy())
    for i, m, x in sorted(zip(at.tolist(), t["mask"].to_pylist(), t["least"].to_pylist(), strict=True)):
        mask[bounds[i] : bounds[i + 1]] = np.unpackbits(np.frombuffer(m, np.uint8), count=bounds[i + 1] - bounds[i]).astype(bool)
        if x:
            least.append(widened(x))
    return mask, np.concatenate(least)
