"""Exact top-k inner products by the three-phase uniform threshold, over lists of partial scores."""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Queries settled in one round: bounds what is sent to the driver and broadcast (with 64 components about 8 MB).
ROUND = 16_384
#: Of so many rows one takes part in finding the cutoff. All rows are held against it.
GATHERED = 8
#: Rows and queries multiplied at a time.
TILE = 1024
_EXACT = 2**53
#: The cutoff of queries that have fewer than k entries.
_NEVER = -np.inf


def usable(vector: str = "embedding") -> Column:
    """False for vectors that are null or hold null or non-finite components."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def _scaled(vectors: pa.Array) -> np.ndarray:
    """floor(256 * x) of every component, one row a vector; shorter vectors are padded with zeros."""
    values = np.floor(256.0 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.asarray(vectors.value_lengths(), np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    return out


def _lists(queries: np.ndarray, rows: np.ndarray, m: int, need: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each of m slices of the components, the partial scores (queries x rows), exactly; and which rows they are of.

    With need (a cutoff a query), a row is left out after the list from which on it can't reach the cutoff of any query:
    by Cauchy and Schwarz the lists still to come add no more than the products of the lengths in them.
    """
    d = max(queries.shape[1], rows.shape[1])
    pad = lambda x: np.pad(x, ((0, 0), (0, d - x.shape[1])))
    queries, rows = pad(queries), pad(rows)
    of_query, of_row = (_lengths(queries, d, m), _lengths(rows, d, m)) if need is not None else (None, None)
    if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(d, 1) >= _EXACT:
        whole = np.vectorize(int, otypes=[object])
        queries, rows = (whole(x) if x.size else x.astype(object) for x in (queries, rows))
    edges = np.linspace(0, d, m + 1).astype(int)
    left, out = np.arange(len(rows)), []
    for j, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        out.append(queries[:, a:b] @ rows[left, a:b].T if b > a else np.zeros((len(queries), len(left)), queries.dtype))
        if need is not None and j < m - 1 and len(left):
            with np.errstate(over="ignore", invalid="ignore"):
                so_far, rest = sum(out).astype(np.float64), of_query[j + 1 :].T @ of_row[j + 1 :, left]
                open_ = ~(so_far + rest + 1e-9 * (np.abs(so_far) + rest) + 1 < need).all(axis=0)  # what is no number counts as open
            if not open_.all():
                left, out = left[open_], [x[:, open_] for x in out]
    return left, out


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[keep], score[keep]


def _tiles(batches, qv: np.ndarray, m: int, t: np.ndarray | None = None):
    """(first query, ids, partial scores) of tiles of rows and queries; with t, of the rows that may reach it alone."""
    for batch in batches:
        ids, rows = batch.column(0).to_numpy(zero_copy_only=False), _scaled(batch.column(1))
        for i in range(0, len(ids), TILE):
            for j in range(0, len(qv), TILE):
                q, own, r, need = qv[j : j + TILE], ids[i : i + TILE], rows[i : i + TILE], None
                if t is not None and (t[j : j + TILE] > _NEVER).all():
                    need = t[j : j + TILE, None]
                    left = _open(q, r, need, m)
                    own, r = own[left], r[left]
                left, lists = _lists(q, r, m, need)
                if len(left):
                    yield j, own[left], lists


@np.errstate(over="ignore", invalid="ignore")  # what overflows counts as open
def _lengths(vectors: np.ndarray, d: int, m: int) -> np.ndarray:
    """The length of each vector in each list, m rows."""
    edges = np.linspace(0, d, m + 1).astype(int)
    return np.stack([np.sqrt((vectors[:, a:b] ** 2).sum(axis=1)) for a, b in zip(edges[:-1], edges[1:], strict=True)])


@np.errstate(over="ignore", invalid="ignore")
def _open(queries: np.ndarray, rows: np.ndarray, need: np.ndarray, m: int) -> np.ndarray:
    """Which rows may score need with any of a tile's queries: by Cauchy and Schwarz a list holds no more than the product
    of the lengths in it, so the tile's greatest lengths bound a row's score with all of them, at next to no cost. Queries
    are in the order of their lengths, so a tile's are alike. The bound is widened by what floating point may err."""
    d = max(queries.shape[1], rows.shape[1])
    bound = _lengths(queries, d, m).max(axis=1, initial=0) @ _lengths(rows, d, m)
    return np.flatnonzero(~(bound + 1e-9 * np.abs(bound) + 1 < need.min()))  # what is no number counts as open


_WIDE = pa.decimal128(38, 0)


def _rows(q, ids, score) -> pa.RecordBatch:
    """Entries with their scores as decimals, which order right beyond a long too."""
    most = 10**38 - 1
    score = pa.array([decimal.Decimal(min(max(int(x), -most), most)) for x in score], _WIDE) if score.dtype == object else pa.array(score.astype(np.int64)).cast(_WIDE)
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids.astype(np.int64)), score], names=["q", "vec_id", "score"])


def _not_over(score: int) -> float:
    """The largest double that isn't over a score; one that was clamped from below bounds nothing."""
    near = float(score)
    return _NEVER if score <= -(10**38 - 1) else float(np.nextafter(near, -np.inf)) if int(near) > score else near


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, m: int = 4) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k highest inner products of floor(256 * component).

    vectors: vec_id, embedding (array of float or double), and maybe more columns, not looked at. Candidates are all
    rows but those with the query's own vec_id; ties go to the smaller vec_id. Vectors null or with null or non-finite
    components, or without vec_id, take no part. Shorter vectors count as padded with zeros. Rows that repeat a vec_id
    are candidates one by one; as a query only the least of their vectors counts. Scores beyond a long are shown as the
    nearest one, in the order of what they are (up to 38 digits).

    The components are cut into m lists of partial scores. In rounds of ROUND queries: (1) every partition gathers, of one
    row in GATHERED by a hash of its id, the k entries with the highest partial score of each list; the k-th best of their
    totals is a sure lower bound t of the k-th best score, whichever rows it comes from. (2) An entry that scores t in all must have t / m in some list, so with t broadcast each
    partition, looking at every row, leaves out those that can't score t with any query of a tile (_open),
    list by list, and collects just the entries that reach that cutoff in a list, and drops those whose upper bound (t / m
    for lists they don't reach it in) is under t. (3) The others are resolved to exact totals. A partition
    hands on its own k best of each query, so equal vectors, however many, cost no more rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable())
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = staged(asked, "queries")  # aggregated once, whatever the rounds
    rounds = max(1, -(-asked.count() // ROUND))
    out = None
    for r in range(rounds):
        held = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).orderBy("vec_id").toArrow()
        qid = held["vec_id"].to_numpy()
        qv = _scaled(held["embedding"].combine_chunks()) if len(qid) else np.zeros((0, 0))
        with np.errstate(over="ignore"):
            by_length = np.argsort(np.sqrt((qv**2).sum(axis=1)), kind="stable")
        qid, qv = qid[by_length], qv[by_length]
        sent = spark.sparkContext.broadcast((qid, qv))

        def gather(batches, sent=sent):
            qid, qv = sent.value
            have = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            for j, ids, lists in _tiles(batches, qv, m):
                total = sum(lists)
                own = ids[None, :] == qid[j : j + len(total), None]
                n = min(k + 1, len(ids))  # one may be the query's own row
                at = np.concatenate([np.argsort(-x, axis=1)[:, :n] if x.dtype == object else np.argpartition(-x, n - 1, axis=1)[:, :n] for x in lists], axis=1)
                at.sort(axis=1)
                once = np.ones(at.shape, bool)
                once[:, 1:] = at[:, 1:] != at[:, :-1]
                q = np.broadcast_to(np.arange(len(total))[:, None], at.shape)
                once &= ~own[q, at]
                q, at = q[once], at[once]
                have = [np.concatenate(x) for x in zip(have, (q + j, ids[at], total[q, at]), strict=True)]
                have = list(_best(*have, k))
            yield _rows(*have)

        some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(GATHERED)) == 0)
        found = some.mapInArrow(gather, "q int, vec_id long, score decimal(38,0)")
        bound = found.groupBy("q").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("t")).where("t is not null").toArrow()
        cut = np.full(len(qid), _NEVER)
        cut[bound["q"].to_numpy()] = [_not_over(int(x)) for x in bound["t"].to_pylist()]
        bounds = spark.sparkContext.broadcast(cut)

        def resolve(batches, sent=sent, bounds=bounds):
            qid, qv = sent.value
            t = bounds.value
            have = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            more: list = []
            for j, ids, lists in _tiles(batches, qv, m, t):
                need = t[j : j + len(lists[0]), None]
                share = np.ceil(need / m - np.abs(need) * 1e-12)  # a smaller share is as safe
                reach = [(x >= share).astype(bool) for x in lists]
                upper = sum(np.where(y, x, share) for x, y in zip(lists, reach, strict=True)).astype(np.float64)
                q, at = np.nonzero(np.logical_or.reduce(reach) & (upper + 1e-9 * np.abs(upper) + 1 >= need) & (ids[None, :] != qid[j : j + len(need), None]))
                total = sum(x[q, at] for x in lists)
                ok = (total >= need[q, 0]).astype(bool)
                more.append((q[ok] + j, ids[at[ok]], total[ok]))
                if sum(len(x[0]) for x in more) > 200_000:
                    have, more = list(_best(*(np.concatenate(x) for x in zip(have, *more, strict=True)), k)), []
            yield _rows(*_best(*(np.concatenate(x) for x in zip(have, *more, strict=True)), k))

        best = rows.mapInArrow(resolve, "q int, vec_id long, score decimal(38,0)")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        name = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(qid)), pa.int32()), "query_id": pa.array(qid)}))
        best = best.join(F.broadcast(name), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.greatest(F.lit(-(2**63)), F.least(F.lit(2**63 - 1), "score")).cast("long").alias("score"))
        best = best if rounds == 1 else staged(best, "round")  # a round's plan ends here
        out = best if out is None else out.union(best)
    return out
