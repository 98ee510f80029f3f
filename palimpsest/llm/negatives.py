"""Hard negatives by inverted lists of k-means: lists are visited by their upper bound, lists outside a score's window are
skipped, and a search ends once the next bound is under its kth score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .topk import usable

#: Anchors searched for in one round: bounds what the driver holds and broadcasts.
ROUND = 4096
#: Lists at most, rows of a list aimed at, rows that the centroids are fitted on at most, and rounds of fitting.
LISTS, LIST_ROWS, SAMPLE, FITTING = 4096, 512, 16_384, 8
#: Lists that a search visits at first; each further visit takes so many times as many.
FIRST, MORE = 4, 8
#: Rows and searches compared at a time.
TILE = 1024
_EXACT = 2.0**53


def scaled(component: Column) -> Column:
    """floor(256 * component) as a double; doubles from 2^53 on are whole."""
    x = component.cast("double") * 256
    return F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def centroids(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """K-means over a bounded sample; a centroid without rows stays where it was."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:lists]].astype(np.float64)
    for _ in range(FITTING):
        own = nearest(sample, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + TILE] @ c.T - half, axis=1) for i in range(0, len(x), TILE)] or [np.zeros(0, np.int64)])


class Index:
    """Inverted lists: rows (list, vec_id, label, x) written in the order of lists, with centroids, radii and the dimension."""

    def __init__(self, rows: DataFrame, centroid: np.ndarray, radius: np.ndarray, d: int, most: float):
        self.rows, self.centroid, self.radius, self.d, self.most = rows, centroid, radius, d, most

    @property
    def exact(self) -> bool:
        """Whether doubles hold every inner product, and a hundred times it; else whole numbers of any size are used."""
        return self.d * self.most**2 * 128 < _EXACT

    @np.errstate(over="ignore", invalid="ignore")
    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) inner product of each anchor with what each list may hold, by Cauchy and Schwarz from centroid
        and radius; widened by what rounding may err. What is no number counts as no bound."""
        middle, reach = a @ self.centroid.T, np.linalg.norm(a, axis=1)[:, None] * self.radius[None, :]
        slack = 1e-9 * (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(self.centroid, axis=1)[None, :] + reach) + 1
        low, high = middle - reach - slack, middle + reach + slack
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def inverted_lists(vectors: DataFrame, lists: int | None = None) -> Index:
    """The index of vectors (vec_id, label, x: doubles of one length), every row in the list of its nearest centroid.

    The centroids are fitted on SAMPLE distinct vectors at most, chosen by hash; which ones says only how well lists are
    pruned. Rows are dealt by list and hash, so that a list of very many rows is cut into several partitions.
    """
    vectors = staged(vectors, "vectors")
    n, d, most = vectors.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if not n:
        return Index(vectors.withColumn("list", F.lit(0)), np.zeros((1, 1)), np.zeros(1), 1, 0.0)
    some = vectors.where(F.pmod(F.xxhash64("x"), F.lit(max(1, n // (SAMPLE // 2)))) == 0).select("x").distinct().limit(SAMPLE).toArrow()
    sample = _matrix(some["x"].combine_chunks(), d) if len(some) else np.zeros((1, d))
    c = centroids(sample, lists or int(min(LISTS, max(1, n // LIST_ROWS))))
    sent = vectors.sparkSession.sparkContext.broadcast(c)

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            own = nearest(x, sent.value)
            far = np.linalg.norm(x - sent.value[own], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *batch.columns, pa.array(far)], names=["list", *batch.schema.names, "far"])

    dealt = vectors.select("vec_id", "label", "x").mapInArrow(assign, "list int, vec_id long, label long, x array<double>, far double")
    dealt = staged(dealt.repartitionByRange("list", F.xxhash64("vec_id", "x")).sortWithinPartitions("list"), "lists")
    radius = np.zeros(len(c))
    for r in dealt.groupBy("list").agg(F.max("far").alias("far")).collect():  # LISTS rows at most
        radius[r["list"]] = r["far"]
    return Index(dealt.select("list", "vec_id", "label", "x"), c, radius * (1 + 1e-9), d, float(most))


class _Searches:
    """Searches of one round: of each its anchor's number, what it may return, and its kth score so far."""

    def __init__(self, anchor: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray):
        self.anchor, self.same, self.low, self.high = anchor, same, low, high


def _visit(index: Index, anchors: tuple, searches: _Searches, kth: np.ndarray, plan: dict[int, np.ndarray], k: int) -> DataFrame:
    """search, vec_id, score: the k best entries of each task for each search among the lists that plan gives it."""
    sc, d, exact = index.rows.sparkSession.sparkContext, index.d, index.exact
    sent = sc.broadcast((anchors, searches, kth, plan))

    def run(batches):
        (ids, labels, a), s, kth, plan = sent.value
        have: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object if not exact else np.float64))]
        for batch in batches:
            where, vec, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            x = _matrix(batch.column(3), d)
            edges = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1), len(where)]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if begin == end or (asked := plan.get(int(where[begin]))) is None:
                    continue
                for i in range(0, len(asked), TILE):
                    q = asked[i : i + TILE]
                    who, which = np.unique(s.anchor[q], return_inverse=True)
                    for j in range(begin, end, TILE):
                        r = slice(j, min(j + TILE, end))
                        score = a[who] @ x[r].T if exact else _whole(a[who]) @ _whole(x[r]).T
                        score = score[which]
                        own = labels[s.anchor[q]][:, None] == label[r][None, :]
                        ok = own if s.same else ~own
                        ok &= ids[s.anchor[q]][:, None] != vec[r][None, :]
                        for side, limit in ((np.greater_equal, s.low[q]), (np.less_equal, s.high[q]), (np.greater_equal, kth[q])):
                            ok &= side(score, limit[:, None]).astype(bool)
                        at, row = np.nonzero(ok)
                        have.append((q[at], vec[r][row], score[at, row]))
                if sum(len(h[0]) for h in have) > 200_000:
                    have = [_best(have, k)]
        q, vec, score = _best(have, k)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(vec, pa.int64()), pa.array([str(int(v)) for v in score], pa.string())], names=["search", "vec_id", "score"])

    rows = index.rows.where(F.col("list").isin([int(i) for i in plan])) if len(plan) <= 256 else index.rows
    return rows.mapInArrow(run, "search long, vec_id long, score string").withColumn("score", F.col("score").cast("decimal(38,0)"))


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _best(parts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, vec, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((vec, -score, q))
    q, vec, score = q[order], vec[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[keep], vec[keep], score[keep]


def _first(found: DataFrame, k: int) -> DataFrame:
    """found with rank, of each search the first k."""
    w = Window.partitionBy("search").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search(index: Index, anchors: tuple, searches: _Searches, k: int) -> DataFrame | None:
    """search, vec_id, score, rank (staged): of each search its first k.

    A search has its lists in the order of their upper bounds, without those outside its window. It visits some, then more,
    and ends once the next bound is strictly under its kth score; lists of an equal bound may hold a smaller vec_id.
    """
    a, n = anchors[2], len(searches.anchor)
    lowest = -np.inf if index.exact else -(10**38)
    kth = np.full(n, lowest, None if index.exact else object)
    low, high = index.bounds(a)
    order = np.argsort(-high, axis=1, kind="stable")
    float_low, float_high = searches.low.astype(np.float64), searches.high.astype(np.float64)
    least, most = (lambda v: v - np.abs(v) * 1e-12 - 1), (lambda v: v + np.abs(v) * 1e-12 + 1)
    begin, width, open_, out = 0, FIRST, np.arange(n), None
    while begin < len(index.radius) and len(open_):
        end = min(begin + width, len(index.radius))
        who = searches.anchor[open_]
        lists = order[who, begin:end]
        bound = np.take_along_axis(high[who], lists, 1)
        # at and after the first list whose bound is under the kth score, or under the window, the search has ended
        ends = (bound < least(kth[open_].astype(np.float64))[:, None]) | (bound < least(float_low[open_])[:, None])
        live = ~np.logical_or.accumulate(ends, axis=1)
        over = np.take_along_axis(low[who], lists, 1) > most(float_high[open_])[:, None]
        at, col = np.nonzero(live & ~over)
        mine, theirs = open_[at], lists[at, col]
        by_list = np.argsort(theirs, kind="stable")
        mine, theirs = mine[by_list], theirs[by_list]
        cut = np.flatnonzero(np.diff(theirs)) + 1
        plan = {int(t[0]): m for t, m in zip(np.split(theirs, cut), np.split(mine, cut), strict=True) if len(t)}
        open_ = open_[live[:, -1]]
        begin, width = end, width * MORE
        if plan:
            new = _visit(index, anchors, searches, kth, plan, k)
            out = staged(_first(new if out is None else new.unionByName(out.drop("rank")), k), "found")
            last = out.where(F.col("rank") == k).select("search", F.col("score").cast("string").alias("score")).toArrow()
            if len(last):
                kth[last["search"].to_numpy()] = [int(v) for v in last["score"].to_pylist()]
    return out


def _long(c: Column) -> Column:
    return F.greatest(F.lit(-(2**63)).cast("decimal(38,0)"), F.least(F.lit(2**63 - 1).cast("decimal(38,0)"), c)).cast("long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 5, window: tuple[int, int, int] = (80, 100, 100), lists: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label. A row's score is its inner product with the anchor, over floor(256 * component) as
    whole numbers; higher ones come first, ties by smaller vec_id. An anchor's positives are its first rows of its own
    label. The negatives of a pair are the first k rows of other labels with low * positive <= scale * negative <= high *
    positive for window (low, high, scale); fewer if there are fewer, so a pair with a negative score has none where low is
    under high.

    Rows without vec_id or label, or with a vector that is null or holds null or non-finite components, take no part.
    Shorter vectors count as padded with zeros. Rows that repeat a vec_id are found one by one, but never by their own
    vec_id; as an anchor only the least of their labels and vectors counts. An empty table gives no rows. Scores beyond a
    long are shown as the nearest long. Other columns are not looked at.

    Every row is in the index, and a list that a search skips can't hold an answer, so results are exact. Anchors go in
    rounds of ROUND; the driver holds their vectors, order of lists and kth scores, and candidates stay in Spark.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", is_anchor.alias("_asked"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable())
    d = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 0)
    x = F.concat(F.transform("embedding", scaled), F.array_repeat(F.lit(0.0), F.lit(d) - F.size("embedding")))
    rows = rows.select("vec_id", "label", x.alias("x"), "_asked")
    index = inverted_lists(rows.select("vec_id", "label", "x"), lists)
    asked = staged(rows.where("_asked").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("a")).select("vec_id", "a.*"), "anchors")
    low, high, scale = window
    out = None
    rounds = max(1, -(-asked.count() // ROUND))
    for r in range(rounds):
        held = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).orderBy("vec_id").toArrow()
        if not len(held):
            continue
        anchors = (held["vec_id"].to_numpy(), held["label"].to_numpy(), _matrix(held["x"].combine_chunks(), d))
        n = len(anchors[0])
        number = None if index.exact else object
        free = np.full(n, np.inf if index.exact else 10**38, number)
        near = _search(index, anchors, _Searches(np.arange(n), True, -free, free), positives)
        if near is None:
            continue
        pairs = near.orderBy("search", "rank").select("search", "vec_id", F.col("score").cast("string").alias("score")).toArrow()
        if not len(pairs):
            continue
        score = [int(v) for v in pairs["score"].to_pylist()]
        # of whole numbers: scale * s >= low * p if s >= ceil(low * p / scale)
        wanted = _Searches(pairs["search"].to_numpy(), False, np.array([-(-low * p // scale) for p in score], number or np.float64), np.array([high * p // scale for p in score], number or np.float64))
        found = _search(index, anchors, wanted, k)
        if found is None:
            continue
        name = spark.createDataFrame(pa.table({"search": pa.array(np.arange(len(score))), "anchor_id": pa.array(anchors[0][wanted.anchor]), "positive_id": pairs["vec_id"], "_p": pairs["score"]}))
        found = found.join(F.broadcast(name), "search").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), _long(F.col("_p").cast("decimal(38,0)")).alias("positive_score"), _long(F.col("score")).alias("negative_score"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
