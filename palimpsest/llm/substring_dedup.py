"""Substring dedup: words covered by a window that also starts in a smaller document are removed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ANSWERS, ENTRIES, NOBODY, answered, as_table, block_of, entries, least_owners, repeated
from .common import chunks, mix, sequences, text_bytes, word_hashes, words_of

#: Bytes of text in a block, about.
BLOCK = 8 << 20
BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


class Windows:
    """The windows of a block's texts: Rabin-Karp hashes, and each one's minimizer (the least hash of a gram in it)."""

    def __init__(self, t: pa.Table, width: int, gram: int):
        ids = t["doc_id"].combine_chunks()
        self.ids = ids.fill_null(int(NOBODY)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.width, hashes, sizes = width, [], []
        for _, _, data, at in chunks(t["text"]):
            starts, ends, first = words_of(data, at)
            hashes.append(word_hashes(data, starts, ends))
            sizes.append(np.diff(first))
        self.h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.first = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        n = max(0, len(self.h) - width + 1)
        self.at = np.flatnonzero(doc[:n] == doc[width - 1 :]) if n else np.zeros(0, np.int64)
        self.doc = doc[self.at]
        self.owner = self.ids[self.doc]
        low, have, want = sequences(self.h, gram, BASES[0]), 1, width - gram + 1
        while have < want:  # the least of have, then of twice as many, grams in a row
            step = min(have, want - have)
            low, have = np.minimum(low[: len(low) - step], low[step:]), have + step
        self.minimizer = low[self.at]

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct minimizers, and a byte each: whether documents with different ids have it."""
        new = np.ones(len(self.at), bool)
        new[1:] = (self.minimizer[1:] != self.minimizer[:-1]) | (self.owner[1:] != self.owner[:-1])
        m, owner = self.minimizer[new], self.owner[new]
        order = np.lexsort((owner, m))
        m, owner = m[order], owner[order]
        first = np.ones(len(m), bool)
        first[1:] = m[1:] != m[:-1]
        starts = np.flatnonzero(first)
        last = np.append(starts[1:], len(m)) - 1 if len(starts) else starts
        return m[starts], (owner[starts] != owner[last]).astype(np.uint8)

    def shared(self, t: pa.Table, n: int) -> np.ndarray:
        """Numbers of the windows whose minimizer other documents have too: only they can be repeated."""
        values, _ = self.minimizers()
        mask, _ = answered(t, n, values)
        values = values[mask]
        if not len(values):
            return np.zeros(0, np.int64)
        return np.flatnonzero(values[np.minimum(np.searchsorted(values, self.minimizer), len(values) - 1)] == self.minimizer)

    def hashed(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the hash of each window in which."""
        a, b = sequences(self.h, self.width, BASES[1]), sequences(mix(self.h ^ np.uint64(BASES[0])), self.width, BASES[2])
        return a[self.at[which]], (b[self.at[which]] >> np.uint64(32)).astype(np.uint32)

    def distinct(self, which: np.ndarray) -> tuple:
        """Sorted distinct hashes (two arrays), the smallest owner of each, and the number among them of each window."""
        a, b = self.hashed(which)
        owner = self.owner[which]
        order = np.lexsort((owner, b, a))
        a, b = a[order], b[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        number = np.empty(len(a), np.int64)
        number[order] = np.cumsum(first) - 1
        return a[first], b[first], owner[order][first], number


def _intervals(cover: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


OUT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def substring_dedup(docs: DataFrame, width: int = 13, gram: int = 5, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (words joined by one space), removed (maximal intervals of words).

    Words are [^\\x20\\x09-\\x0D]+ of the whole text; a null text has none. A word goes if it is in a window of width
    words whose sequence also starts in a document with a smaller doc_id. Windows are judged on the input. Equal doc_ids
    are not smaller than one another; a null doc_id is larger than all others. Other columns are not looked at.

    Every window is hashed. As most are in one document alone, windows first tell only the least hash of the grams
    within them, which neighbours share: two equal windows have equal ones. Windows whose least gram is in several
    documents then send their own 96-bit hashes, and get the smallest document that has them. Both steps exchange sorted
    arrays (see blocks). Texts are shuffled once, into blocks; Spark reuses that exchange in all three steps.
    """
    n = max(1, -(-text_bytes(docs) // block))
    texts = docs.select("doc_id", "text").withColumn("blk", block_of(n, "doc_id", "text"))  # rows of one id, or of none, are dealt too
    few = max(1, n // 4)

    def tell(t: pa.Table) -> pa.Table:
        values, several = Windows(t, width, gram).minimizers()
        return as_table(entries(t["blk"][0].as_py(), few, values, several, None), ENTRIES)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return as_table([], ENTRIES)
        w = Windows(left, width, gram)
        a, b, owner, _ = w.distinct(w.shared(right, few))
        return as_table(entries(left["blk"][0].as_py(), n, a, b, owner), ENTRIES)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        w = Windows(left, width, gram)
        first = right.filter(pc.less(right["round"], 2))
        which = w.shared(first, few)
        a, _, owner, number = w.distinct(which)
        mask, least = answered(right.filter(pc.equal(right["round"], 2)), n, a)
        owner[mask] = least
        gone = w.at[which[owner[number] < w.owner[which]]]
        cover = np.zeros(len(w.h) + 1, np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + width, -1)
        cover = np.cumsum(cover)[:-1] > 0
        kept, removed, spans = [], [], []
        for i, text in enumerate(left["text"]):
            words = (text.as_py() or "").encode().split()
            c = cover[w.first[i] : w.first[i + 1]]
            k = int(c.sum())
            removed.append(k)
            spans.append(_intervals(c) if k else [])
            kept.append(b" ".join([words[j] for j in np.flatnonzero(~c)] if k else words).decode())
        return pa.table([left["doc_id"], pa.array(np.diff(w.first)), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, _SPAN)], names=["doc_id", "n_words", "n_removed", "kept", "removed"])

    grouped = texts.groupBy("blk")
    told = repeated(grouped.applyInArrow(tell, ENTRIES))
    sent = least_owners(grouped.cogroup(told.groupBy("blk")).applyInArrow(send, ENTRIES))
    answers = told.withColumn("round", F.lit(1)).union(sent.withColumn("round", F.lit(2)))
    return grouped.cogroup(answers.groupBy("blk")).applyInArrow(remove, OUT)
