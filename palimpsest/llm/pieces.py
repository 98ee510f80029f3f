"""SentencePiece encoding and decoding: one forward pass over the trie of a batch's distinct marked words."""

from __future__ import annotations

import gc
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, coded, laid_out, lean

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stretches of text and pairs of pieces a worker remembers; beyond it the memory starts anew, which costs time alone.
REMEMBERED = 600_000


class Model:
    """A SentencePiece model file (unigram or BPE, identity normalisation): its pieces, and encoders of marked words.

    A forward pass over a word's prefixes keeps one state each. For a unigram model it is Viterbi's: the best score,
    and the last piece on the way there. For a BPE model the best sum of scores is not what merging gives, so the state
    is the last piece of the merged prefix: a piece ends a prefix if the prefix before it ends in a piece such that the
    two stay apart when merged on their own. Just one piece does, so the state is as small as Viterbi's and depends on
    the prefix alone, which words that begin alike share.
    """

    def __init__(self, file: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(file)
        norm = proto.normalizer_spec
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are known")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation are known")
        self.dummy = norm.add_dummy_prefix
        own = [(i, p) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)]
        if any(p.type == USER for _, p in own):
            raise ValueError("models with user-defined pieces are not known")
        self.ids = {p.piece: i for i, p in own}
        self.own = {i: p.piece for i, p in own}
        self.scores = {p.piece: p.score for _, p in own}
        self.worth = {i: p.score for i, p in own}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        text = [p.piece.encode() if p.type in (NORMAL, USER) else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b" \xe2\x81\x87 " if p.type == UNKNOWN else b"" for p in proto.pieces]
        self.text = pa.array(text, pa.large_binary())
        self.penalty = min(self.scores.values()) - 10.0
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches over the beginning of a word")
        # characters in no piece but their own stand alone, whatever is beside them
        soft = re.escape("".join(sorted({c for p in self.ids if len(p) > 1 for c in p} - {MARK})))
        self.words = re.compile(f"{MARK}*[{soft}]+|{MARK}+|[^{soft}{MARK}]", re.DOTALL).findall
        self.known: dict[bytes, bytes] = {}
        self.apart: dict[int, bool] = {}
        self.packed: dict[int, bytes] = {}
        self._build()

    def _build(self) -> None:
        """Aho and Corasick's automaton of the pieces: go, by state and character, and out, (size, id) of the pieces of two
        characters or more that end there, the longest first. Steps back along fail are added to go as they are met."""
        self.go, self.fail, self.out = [{}], [0], [()]
        for piece, i in self.ids.items():
            at = 0
            for c in piece:
                if (to := self.go[at].get(c)) is None:
                    to = self.go[at][c] = len(self.go)
                    self.go.append({})
                    self.fail.append(0)
                    self.out.append(())
                at = to
            if len(piece) > 1:
                self.out[at] = ((len(piece), i),)
        line = list(self.go[0].values())
        trie = [dict(x) for x in self.go]
        for at in line:  # grows as it is gone through: by depth
            own, trie[at] = trie[at], None
            for c, to in own.items():
                self.fail[to] = self._step(self.fail[at], c)
                line.append(to)
            self.out[at] += self.out[self.fail[at]]

    def _step(self, at: int, c: str) -> int:
        back = at
        while (to := self.go[back].get(c)) is None:
            if not back:
                return 0
            back = self.fail[back]
        self.go[at][c] = to
        return to

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the adjacent pair of the highest score is merged, the first of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, i: int) -> str:
        """The piece of an id, or what stands for one: -1 is nothing, numbers below are characters that are no piece."""
        return self.own[i] if i >= 0 else chr(-i - 2) if i < -1 else ""

    def _stay(self, a: int, b: int) -> bool:
        """Whether pieces a and b, side by side, are what merging gives. a may be the beginning of a word."""
        if len(self.apart) > 4 * REMEMBERED:
            self.apart.clear()
        x, y = self._text(a), self._text(b)
        got = self.apart[(a << 32) + b] = self.merged(x + y) == ([x, y] if x else [y])
        return got

    def encode_sorted(self, words: list[str]):
        """The ids of sorted words, depth first through their trie: states of a common prefix are those of the word before.

        States of a prefix: the automaton's, the size and id of its last piece, and for a unigram model its score.
        """
        step = self._merge_step if self.kind == BPE else self._viterbi_step
        state, size, last, score = [0], [0], [-1], [0.0]
        for word, n in zip(words, _shared(words).tolist(), strict=True):
            del state[n + 1 :], size[n + 1 :], last[n + 1 :], score[n + 1 :]
            step(word, n, state, size, last, score)
            out, i = [], len(word)
            while i:
                out.append(last[i])
                i -= size[i]
            out.reverse()
            yield b"".join([self.packed.get(x) or self._packed(x) for x in out])

    def _merge_step(self, word: str, n: int, state: list, size: list, last: list, score: list) -> None:
        """Adds the states of word's prefixes longer than n: the last piece is one that stays apart from the one before."""
        go, outs, apart, ids, at, i = self.go, self.out, self.apart.get, self.ids, state[n], n
        for c in word[n:]:
            i += 1
            found = go[at].get(c)
            at = self._step(at, c) if found is None else found
            for k, piece in outs[at]:
                if k > i:
                    continue
                before = last[i - k]
                stay = apart((before << 32) + piece)
                if self._stay(before, piece) if stay is None else stay:
                    size.append(k)
                    last.append(piece)
                    break
            else:
                size.append(1)
                last.append(ids.get(c, -2 - ord(c)))
            state.append(at)

    def _viterbi_step(self, word: str, n: int, state: list, size: list, last: list, score: list) -> None:
        """Adds the states of word's prefixes longer than n: the best score, and the last piece on the way there."""
        at, i = state[n], n
        for c in word[n:]:
            i += 1
            at = self._step(at, c)
            single = self.ids.get(c, -2 - ord(c))
            best, k, piece = -np.inf, 1, single
            for length, x in (*self.out[at], (1, single)):
                if length <= i and score[i - length] + (s := self.worth.get(x, self.penalty)) > best:
                    best, k, piece = score[i - length] + s, length, x
            state.append(at)
            size.append(k)
            last.append(piece)
            score.append(best)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        return [x for _, _, data, at in chunks(pa.array(texts, pa.large_string())) for x in self.encode_chunk(data, at)]

    def encode_chunk(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Ids of each text; a text's bytes begin at its place in at.

        A text falls into stretches of spaces with what follows them, over whose beginnings no piece reaches. Each
        distinct stretch is cut into marked words, and only those not remembered go through the trie.
        """
        gc.disable()  # many small lists, and no cycles
        try:
            if MARK.encode() in (raw := data.tobytes()):  # a mark in a text is a space, as in decoding
                parts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                data, at = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
            blank = data == 32
            start = blank.copy()
            start[1:] &= ~blank[:-1]
            start[at[:-1][at[:-1] < at[1:]]] = True
            starts = np.flatnonzero(start)
            whole = np.searchsorted(starts, at)
            found, which = coded(data, np.diff(np.append(starts, len(data))))
            lead = np.flatnonzero(np.diff(whole))  # the stretches that texts begin with get the mark that is put before a text
            if self.dummy and len(lead):
                firsts, place = coded_of(found, which, whole[lead])
                found, which = found + [b" " + found[i] for i in firsts], place
            new = [x for x in found if x not in self.known]
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = found
            self._learn(new)
            raw, place = laid_out(list(map(self.known.__getitem__, found)), which)
            cuts = place[whole].tolist()
            return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        finally:
            gc.enable()

    def _learn(self, stretches: list[bytes]) -> None:
        words = [self.words(x.decode().replace(" ", MARK)) for x in stretches]
        new = sorted(set().union(*words))
        ids = dict(zip(new, self.encode_sorted(new), strict=True))
        self.known.update((x, b"".join([ids[w] for w in ws])) for x, ws in zip(stretches, words, strict=True))

    def _packed(self, i: int) -> bytes:
        """The ids that stand for a piece, or for a character that is none: its bytes, or the unknown piece."""
        raw = np.array([i] if i >= 0 else [self.bytes[b] for b in chr(-i - 2).encode()] if self.bytes else [self.unknown], "<u4").tobytes()
        if len(self.packed) < REMEMBERED:
            self.packed[i] = raw
        return raw

    def decode(self, ids: bytes) -> str:
        return self.decode_all(np.frombuffer(ids, "<u4"), np.array([0, len(ids) // 4]))[0]

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of ids that lie one after another; a text's ids begin at its place in at."""
        out = self.text.take(pa.array(ids.astype(np.int32)))
        raw, place = out.buffers()[2], np.frombuffer(out.buffers()[1], np.int64)
        data, cuts = raw.to_pybytes() if raw is not None else b"", place[at].tolist()
        texts = [data[a:b].decode("utf-8", "replace").replace(MARK, " ") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [t[1:] if t.startswith(" ") else t for t in texts] if self.dummy else texts


def _shared(words: list[str], most: int = 32) -> np.ndarray:
    """How many characters each word has in common with the one before, as far as the first most go."""
    out = np.zeros(len(words), np.int64)
    for i in range(0, len(words) - 1, 50_000):
        part = np.array([w[:most] for w in words[i : i + 50_001]], f"<U{most}").view("<u4").reshape(-1, most)
        same = (part[1:] == part[:-1]) & (part[1:] != 0)
        out[i + 1 : i + 1 + len(same)] = np.where(same.all(axis=1), most, same.argmin(axis=1))
    return out


def coded_of(found: list[bytes], which: pa.Array, places: np.ndarray) -> tuple[list[int], pa.Array]:
    """The distinct numbers at some places of which, and which with these numbers moved behind all of found there."""
    numbers = which.to_numpy().copy()
    firsts, inverse = np.unique(numbers[places], return_inverse=True)
    numbers[places] = len(found) + inverse
    return firsts.tolist(), pa.array(numbers)


_loaded: dict[str, Model] = {}


def sent_model(df: DataFrame, path: str):
    """A model's file, read on the driver, and its digest; the executors get the content."""
    with open(path, "rb") as f:
        file = f.read()
    return hashlib.sha256(file).hexdigest(), df.sparkSession.sparkContext.broadcast(file)


def model(key: str, sent) -> Model:
    if key not in _loaded:
        _loaded.clear()  # one model at a time
        _loaded[key] = Model(sent.value)
    return _loaded[key]


def encode(docs: DataFrame, model_path: str, back: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers) of every whole text; with back, also text, decoded from
    the ids.

    Null and empty texts have no ids. Rows that repeat are encoded one by one; other columns are not looked at. The
    model's file is read on the driver.
    """
    key, sent = sent_model(docs, model_path)

    @lean
    def run(batches):
        m = model(key, sent)
        for batch in batches:
            for i, j, data, at in chunks(batch.column(1), 4 << 20):
                ids = m.encode_chunk(data, at)
                columns = [batch.column(0).slice(i, j - i), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                columns += [pa.array(_decoded(m, ids), pa.string())] * back
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "text"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", text string" * back)


def _decoded(m: Model, ids: list[bytes]) -> list[str]:
    return m.decode_all(np.frombuffer(b"".join(ids), "<u4"), np.cumsum([0, *(len(x) // 4 for x in ids)]))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with text, the text that the ids stand for."""
    key, sent = sent_model(encoded, model_path)

    @lean
    def run(batches):
        m = model(key, sent)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_decoded(m, [x or b"" for x in part.column(2).to_pylist()]), pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256 of every document, encoded and decoded again."""
    out = encode(docs, model_path, back=True)
    return out.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
