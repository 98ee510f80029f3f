"""Toxicity by maximum-scoring segments of token log-odds, aggregated by extreme-value statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, staged

#: Labelled rows that the model is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 30_000
TOKEN = re.compile(r"[^\W\d_]+")
EULER = 0.5772156649015329
#: Lengths of the beginnings of words that count besides the words: what inflected and compound words share.
STEMS = (4, 5, 6, 7)
#: Words whose scores a worker remembers.
REMEMBERED = 100_000


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that no label is learned from: crc32 of doc_id as text modulo 3 is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    """scores: of tokens that tell the classes apart; drift: what any token costs; rate, k: of the extreme-value law of
    the best segment of a clean text, P(S > x) = 1 - exp(-k n exp(-rate x)); weights: of (1, best, sum) in the logit."""

    scores: dict
    drift: float
    rate: float
    k: float
    weights: tuple


def features(word: str) -> list[str]:
    """A word, and its beginnings with a mark, the longest first."""
    return [word, *(word[:n] + "*" for n in reversed(STEMS) if len(word) > n)]


def own_stems(scores: dict, toxic: dict) -> dict:
    """scores without beginnings that owe theirs to a word: one that scores itself, in half of their toxic texts."""
    owed = {f for w in scores if not w.endswith("*") for f in features(w)[1:] if 2 * toxic[w] >= toxic.get(f, 0)}
    return {f: s for f, s in scores.items() if f not in owed}


def score_of(word: str, scores: dict, known: dict) -> float:
    """The score of the word, or of its longest beginning that has one; 0 if none has."""
    s = known.get(word)
    if s is None:
        if len(known) > REMEMBERED:
            known.clear()
        s = known[word] = next((scores[f] for f in features(word) if f in scores), 0.0)
    return s


def hits(text: str, scores: dict, known: dict) -> tuple[int, list[int], list[float]]:
    """Tokens of a text, and positions and scores of those that score. Every occurrence has its token's full score, so
    that a passage's score doesn't depend on what stands before it."""
    words = TOKEN.findall(text.lower())
    get, at, out = known.get, [], []
    for i, w in enumerate(words):
        s = get(w)
        if s is None:
            s = score_of(w, scores, known)
        if s:
            at.append(i)
            out.append(s)
    return len(words), at, out


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, prior: float = 20.0, sure: float = 4.0) -> np.ndarray:
    """Each token's log-odds ratio between the classes under a Dirichlet prior of prior texts with the sample's own
    shares. It is lessened by the part that sure is of the root of the likelihood ratio that the classes share the token
    alike, so that it is 0 for tokens that chance may deal so. Counts are of texts, so that a token repeated in one text
    tells no more."""
    share = (toxic + clean) / (n_toxic + n_clean)
    a, b, m, n = toxic + prior * share, clean + prior * share, n_toxic + prior, n_clean + prior
    delta = np.log(a / np.maximum(m - a, 0.5)) - np.log(b / np.maximum(n - b, 0.5))

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    ratio = sum(part(x, s) for x, s in ((toxic, share * n_toxic), (clean, share * n_clean), (n_toxic - toxic, (1 - share) * n_toxic), (n_clean - clean, (1 - share) * n_clean)))
    return delta * np.maximum(0, 1 - sure / np.sqrt(np.maximum(2 * ratio, 1e-9)))


def segments(at: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa) as (first token, last token, score), in linear time.

    at: positions of tokens with a score other than 0, rising; every token costs drift besides.
    """
    out: list[list] = []  # first, last, sum before, sum at the end, number of the nearest one before with a smaller sum before
    total, before = 0.0, -1
    for i, s in zip(at, scores, strict=True):
        total -= drift * (i - before - 1)
        before = i
        gain = s - drift
        left, total = total, total + gain
        if gain <= 0:
            continue
        new = [i, i, left, total, -1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            new[4] = j
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new[0], new[2] = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, r - l) for a, b, l, r, _ in out]


def _evidence(model: Model, text: str, known: dict) -> tuple[float, float, int, list]:
    """best and summed excess of the segments over what a clean text of this length has, its tokens, and the segments."""
    n, at, scores = hits(text, model.scores, known)
    found = segments(at, scores, model.drift)
    return *_excess(found, n, model.rate, model.k), n, found


def _excess(found: list, n: int, rate: float, k: float) -> tuple[float, float]:
    floor = np.log(max(k * max(n, 1), 1e-300))
    over = [max(0.0, rate * s - floor) for _, _, s in found]
    return max(over, default=0.0), float(sum(over))


def _features(best: float, total: float) -> tuple[float, float, float]:
    return 1.0, float(np.log1p(best)), float(np.log1p(total))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels.toxic, from at most sample labelled rows that are not held out; each text counts once.

    Of labels that repeat a doc_id the largest counts; null labels don't. Without both classes a text's score is the
    sample's share of toxic rows.
    """
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(rows), "doc_id").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("_sha")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    known = staged(known.select("text", "toxic"), "labelled")
    n = {r["toxic"] > 0: r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        share = n1 / max(1, n1 + n0)
        return Model({}, 1.0, 1.0, 1.0, (float(np.log((share + 1e-6) / (1 - share + 1e-6))), 0.0, 0.0))

    def table_of(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["token", "toxic", "clean"])

    @lean
    def count(batches):
        counts: dict = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in set(TOKEN.findall(text.as_py().lower())) for f in features(w)}:
                    counts.setdefault(f, [0, 0])[toxic > 0] += 1
                if len(counts) > REMEMBERED:  # after each text, so that a batch of many holds no more
                    yield table_of(counts)
                    counts = {}
        yield table_of(counts)

    counted = known.mapInArrow(count, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    @lean
    def scored(batches):
        for batch in batches:
            s = log_odds(*(batch.column(c).to_numpy().astype(float) for c in ("toxic", "clean")), n1, n0)
            told = pa.RecordBatch.from_arrays([batch.column("token"), batch.column("toxic"), pa.array(s)], names=["token", "toxic", "score"])
            yield told.filter(pa.array(s != 0))

    # all that tell the classes apart, however rare: log_odds is 0 for those that chance may deal so
    told = counted.mapInArrow(scored, "token string, toxic long, score double").toArrow()
    words = told["token"].to_pylist()
    scores = own_stems(dict(zip(words, told["score"].to_pylist(), strict=True)), dict(zip(words, told["toxic"].to_pylist(), strict=True)))

    @lean
    def values(batches):
        memory, counts, total = {}, {}, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, _, found = hits(text, scores, memory)
                total += n
                for x in found:
                    counts[x] = counts.get(x, 0) + 1
        counts[0.0] = total - sum(counts.values())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.float64()), pa.array(list(counts.values()), pa.int64())], names=["score", "n"])

    # how often clean texts' tokens have which score: a few for each token of the vocabulary
    clean_scores = known.where("toxic <= 0").select("text").mapInArrow(values, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).toArrow()
    value, times = clean_scores["score"].to_numpy(), clean_scores["n"].to_numpy()
    # drift: a clean text's expected score a token is negative, by as much as makes passages of some tens of tokens stand apart
    drift = max(0.05, 2 * float((value * times).sum()) / max(1, times.sum()))
    rate = _rate(value, times, drift)

    @lean
    def found_in(batches):
        memory: dict = {}
        for batch in batches:
            rows = [hits(text, scores, memory) for text in batch.column(0).to_pylist()]
            best = [[x for _, _, x in segments(at, found, drift)] for _, at, found in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([int(t > 0) for t in batch.column(1).to_pylist()]), pa.array(best, pa.list_(pa.float64()))], names=["n", "toxic", "s"])

    # the sample's rows at most, of the segments' scores alone
    seen = known.mapInArrow(found_in, "n long, toxic long, s array<double>").toArrow()
    n, y = seen["n"].to_numpy(), seen["toxic"].to_numpy()
    own = seen["s"].to_pylist()
    clean = [rate * max(s, default=0.0) - np.log(m) for s, m, t in zip(own, n, y, strict=True) if not t and m]
    # the mean of a Gumbel law: rate * E[S] = ln(k n) + Euler's constant
    k = max(float(np.exp(np.mean(clean) - EULER)), 1e-12) if clean else 1.0
    x = [_features(*_excess([(0, 0, v) for v in s], int(m), rate, k)) for s, m in zip(own, n, strict=True)]
    w = _logistic(np.array(x), y.astype(float))
    return Model(scores, drift, rate, k, tuple(float(v) for v in w))


def _rate(value: np.ndarray, times: np.ndarray, drift: float) -> float:
    """The positive root of E[exp(rate * s)] = 1 over a clean text's tokens (Karlin and Altschul)."""

    def over(r: float) -> float:
        return float((times * np.exp(r * (value - drift))).sum()) / max(1, times.sum()) - 1

    low, high = 1e-6, 1.0
    while over(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) < 0 else (low, mid)
    return low


def score_texts(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """docs with score (0 to 1), n_passages and passages (start, end in code points; score) of every whole text.

    A null or empty text has no segment, and the score of such. Columns of docs stay; prefix keeps names apart.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    at = columns.index("text")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {prefix}score double, {prefix}n_passages int, {prefix}passages array<struct<start:int,end:int,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    @lean
    def run(batches):
        model, known = sent.value, {}
        for batch in batches:
            score, n, passages = [], [], []
            for text in batch.column(at):
                text = text.as_py() or ""
                best, total, length, found = _evidence(model, text, known)
                logit = float(np.dot(model.weights, _features(best, total)))
                score.append(1 / (1 + np.exp(-max(-30.0, min(30.0, logit)))))
                floor = np.log(max(model.k * max(length, 1), 1e-300))
                found = [x for x in found if model.rate * x[2] - floor > 3.0]  # an E-value under 0.05
                if found:
                    spans = [m.span() for m in TOKEN.finditer(text.lower())]
                    found = [{"start": spans[a][0], "end": spans[b][1], "score": s} for a, b, s in found]
                n.append(len(found))
                passages.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array(n, pa.int32()), pa.array(passages, kind)], names=[*batch.schema.names, f"{prefix}score", f"{prefix}n_passages", f"{prefix}passages"])

    return docs.mapInArrow(run, ddl)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, n_passages, passages. Rows that repeat are scored alike."""
    found = score_texts(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "passages")
