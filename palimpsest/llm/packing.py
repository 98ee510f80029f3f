"""Vector best-fit packing of token pieces into sequences, planned on the histogram of piece lengths."""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, chunks, coded, laid_out, lean, staged, words_of

#: Words whose ids a worker remembers; beyond it the memory starts anew, which costs time alone.
REMEMBERED = 600_000
#: Pieces of a length ranked by one task, about, and how many parts a length has besides.
RANKED, PARTS = 200_000, 64
#: Ends of runs and words in the text that the encoder of runs gets; no word that it gets has them.
_END, _NEXT = "\0", "\n"
#: What a tokenizer's file must say for words to be encoded one by one, and by runs (fixed values of the format).
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: The same pattern for lower-case characters below 256 alone.
_RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\na-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: Words that are left to the tokenizer as a whole: special tokens, what may count as white space, characters from 256 on.
_ODD = re.compile("<\\||[\x00-\x09\x0b-\x1f\x7f-\xa0\u0100-\U0010ffff]").search


def byte_letters() -> list[str]:
    """The letters that stand for bytes in a byte-level vocabulary: a byte that prints stands for itself, the others are
    counted on from 256."""
    letters, n = [], 256
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        letters.append(chr(b if shown else n))
        n += not shown
    return letters


def run_ranks(file: bytes) -> dict[bytes, int] | None:
    """Ids of the byte strings of a tokenizer's vocabulary, a word's end being a zero byte; None if the file isn't of the
    kind whose words may be encoded by runs, in order of rank.

    Merging the pair whose union has the least id gives what the file's list of merges gives if ids follow the list, and
    if each token, merged by those before it alone, comes out as the two parts that the list names for it. Both is seen to.
    """
    said = json.loads(file)
    model, pre = said["model"], said.get("pre_tokenizer") or {}
    kind = {k: model.get(k) for k in _MODEL}
    if kind != _MODEL or said.get("normalizer") != _NORMAL or pre.get("type") != "Sequence" or pre.get("pretokenizers") != [_SPLIT, _LEVEL]:
        return None
    if said.get("post_processor") or not all(t["content"].startswith("<|") and not t["normalized"] for t in said["added_tokens"]):
        return None
    byte_of = {c: b for b, c in enumerate(byte_letters())}

    def raw(token: str) -> bytes:
        return bytes(map(byte_of.__getitem__, token.removesuffix("</w>"))) + b"\0" * token.endswith("</w>")

    try:
        ids = {raw(t): i for t, i in model["vocab"].items()}
        pairs = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    except KeyError:
        return None
    single = {bytes([b]) for b in range(256)}
    ends = {b + b"\0" for b in single}
    if len(ids) != len(model["vocab"]) or any(ids.get(a + b) != 512 + i for i, (a, b) in enumerate(pairs)) or len(ids) != 512 + len(pairs):
        return None
    if {b for b, i in ids.items() if i < 256} != single or {b for b, i in ids.items() if 256 <= i < 512} != ends:
        return None
    return ids if all(_parts(a + b, ids) == [a, b] for a, b in pairs) else None


def _parts(token: bytes, ids: dict[bytes, int]) -> list[bytes]:
    """A token as the merges before it leave it."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ids[token]
    while len(parts) > 1:
        best, at = min((ids.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if best >= own:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Ids of whole texts by a tokenizer's file. ranks: what run_ranks says of it."""

    def __init__(self, file: bytes, ranks: dict[bytes, int] | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.known = Tokenizer.from_str(file.decode()), {}
        self.runs = None
        if ranks:
            import tiktoken

            self.runs = tiktoken.Encoding("runs", pat_str=f"[^{_END}{_NEXT}]+{_END}|{_NEXT}", mergeable_ranks=ranks, special_tokens={})
            self.next = ranks[_NEXT.encode()]

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Ids of each text (its bytes begin at its place in at) as little-endian unsigned 32-bit numbers.

        Where the file allows it (see run_ranks), no token reaches over ASCII white space and none stands for it, so words
        are encoded one by one, and each only once while it is remembered. With any other file texts are encoded as a whole.
        """
        gc.disable()  # many small lists, and no cycles
        try:
            if self.runs is None:
                raw = data.tobytes()
                return self._whole([raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            starts, ends, first = words_of(data, at)
            words, which = coded(data[~BLANK[data]], ends - starts)
            new = [w for w in words if w not in self.known]
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = words
            self._learn(new)
            raw, place = laid_out(list(map(self.known.__getitem__, words)), which)
            cuts = place[first].tolist()
            return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        finally:
            gc.enable()

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 20_000):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch(texts[i : i + 20_000], add_special_tokens=False)]
        return out

    def _learn(self, new: list[bytes]) -> None:
        """A word of characters below 256, which normal form C leaves as they are, is cut into the runs that the pattern
        makes of it, and these are merged; any other goes through the tokenizer."""
        if not new:
            return
        text = b"\n".join(new).decode()
        if _ODD(text):
            odd = [w for w in new if _ODD(w.decode())]
            self.known.update(zip(odd, self._whole([w.decode() for w in odd]), strict=True))
            if not (new := list(set(new).difference(odd))):
                return
            text = b"\n".join(new).decode()
        ids = self.runs.encode_to_numpy(_RUN.sub(rf"\g<0>{_END}", text.lower()), disallowed_special=()).astype("<u4")
        at = np.flatnonzero(ids == self.next)
        raw = ids.tobytes()
        starts, ends = [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(raw)]
        self.known.update(zip(new, map(raw.__getitem__, map(slice, starts, ends)), strict=True))


_encoders: dict = {}


def encoder(key: str, sent) -> Encoder:
    """This worker's encoder; sent: a broadcast file and its ranks."""
    if key not in _encoders:
        _encoders.clear()  # one tokenizer at a time
        _encoders[key] = Encoder(*sent.value)
    return _encoders[key]


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of at most limit ids: doc_id, piece, start, length, ids_crc32, and ids (binary) if asked for.

    A document is its text's ids and then end_id; a null or empty text is end_id alone. Only longer documents are cut.
    """
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = np.array([end_id], "<u4").tobytes()
    with open(tokenizer_path, "rb") as f:  # on the driver; the executors get the content
        file = f.read()
    key, sent = hashlib.sha256(file).hexdigest(), docs.sparkSession.sparkContext.broadcast((file, run_ranks(file)))

    @lean
    def cut(batches):
        make = encoder(key, sent)
        for batch in batches:
            doc_ids = batch.column(0)
            for i, j, data, at in chunks(batch.column(1), 8 << 20):
                which, piece, sums, lengths, blobs = [], [], [], [], []
                for k, ids in enumerate(make.encode(data, at)):
                    ids += end
                    for p in range(0, len(ids), 4 * limit):
                        part = ids[p : p + 4 * limit]
                        which.append(i + k)
                        piece.append(p // (4 * limit))
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        if with_ids:
                            blobs.append(part)
                piece = np.array(piece, np.int32)
                columns = [doc_ids.take(pa.array(which)), pa.array(piece), pa.array(piece.astype(np.int64) * limit), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())] * with_ids, names=[x.split()[0] for x in ddl.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(cut, ddl)


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and how much each dimension weighs in the choice of a bin.

    A piece of n tokens asks for (n, 1, n * n): tokens, documents, and the cost of attention within it. rule: 'norm'
    takes the bin with the least weighted norm of what would be left, 'dot' the one whose residual has the largest
    weighted dot-product with the piece. The defaults for documents and attention never bind below tokens.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"


def plan(lengths: np.ndarray, counts: np.ndarray, cap: Capacity) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, longest first; pieces of a length are told apart by their rank from 0.

    A step says: pieces of this length with ranks from rank, in runs of copies, go to bins from bin on, one run to each,
    at offset. Bins that are alike are one range, so the work and the plan depend on the number of lengths (at most
    cap.tokens), not on that of pieces.
    """
    full = np.array([cap.tokens, cap.documents, cap.attention], np.float64)
    weight = np.array(cap.weights)
    left, start, size, steps, bins = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    shortest = lengths.min() if len(lengths) else 0
    for length, count in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        asked, rank = np.array([length, 1, length * length], np.float64), 0
        if (asked > full).any() or length < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while count:
            fits = (left >= asked).all(axis=1)
            if fits.any():
                if cap.rule == "dot":
                    score = -((left / full) * (asked / full) * weight).sum(axis=1)
                else:
                    score = (((left - asked) / full) ** 2 * weight).sum(axis=1)
                at = int(np.where(fits, score, np.inf).argmin())
            else:
                room = int((full // asked).min())
                left, start, size = np.vstack([left, full]), np.append(start, bins), np.append(size, -(-count // room))
                at, bins = len(size) - 1, bins + int(size[-1])
            copies = int((left[at] // asked).min())
            whole = min(int(size[at]), count // copies)
            used = 1 if not whole else whole
            copies = copies if whole else count
            steps.append((length, rank, used * copies, copies, int(start[at]), int(cap.tokens - left[at][0])))
            if used < size[at]:  # the rest of the range stays as it was
                left, start, size = np.vstack([left, left[at]]), np.append(start, start[at] + used), np.append(size, size[at] - used)
                size[at] = used
            left[at] = left[at] - copies * asked
            count, rank = count - used * copies, rank + used * copies
            if left[at][0] < shortest or left[at][1] < 1:
                keep = np.arange(len(size)) != at
                left, start, size = left[keep], start[keep], size[keep]
    table = np.array(sorted(steps), np.int64).reshape(-1, 6)
    return dict(zip(("length", "rank", "n", "copies", "bin", "offset"), table.T.copy(), strict=True))


def pack(pieces: DataFrame, cap: Capacity = Capacity(), order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """pieces with sequence_id and offset (its place in the sequence, gapless from 0). Their length column counts.

    Only the histogram of lengths (cap.tokens rows at most) goes to the driver, and the plan made of it back. Ranks
    within a length are counted in salted parts, more the more frequent it is, so that it is ranked by many tasks. Rows alike in
    every column of order may change places, which no result shows.
    """
    histogram = pieces.groupBy("length").count().collect()
    total = sum(r["count"] for r in histogram)
    steps = plan(np.array([r["length"] for r in histogram], np.int64), np.array([r["count"] for r in histogram], np.int64), cap)
    steps["key"] = steps["length"] * (total + 1) + steps["rank"]
    sent = pieces.sparkSession.sparkContext.broadcast(steps)
    parts = [(r["length"], -(-r["count"] // RANKED) + min(PARTS, r["count"] // 256)) for r in histogram]
    parts = pieces.sparkSession.createDataFrame(parts, "length long, _parts long")  # cap.tokens rows at most
    salted = pieces.join(F.broadcast(parts), "length").withColumn("_salt", F.pmod(F.xxhash64(*order), "_parts"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    ranked = salted.join(bases, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    ranked = ranked.select(*pieces.columns, "_rank")

    @lean
    def place(batches):
        s = sent.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(s["key"], length * (total + 1) + rank, "right") - 1
            nth = rank - s["rank"][at]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(s["bin"][at] + nth // s["copies"][at]), pa.array(s["offset"][at] + nth % s["copies"][at] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{ddl}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, cap: Capacity = Capacity(), end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Packs whole documents: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset per piece.

    Null and empty texts are one id (end_id); rows that repeat a doc_id or its text are packed one by one; an empty
    table gives no rows; columns of docs other than doc_id and text are not looked at.
    """
    return pack(staged(token_pieces(docs, tokenizer_path, cap.tokens, end_id, with_ids), "pieces"), cap)
