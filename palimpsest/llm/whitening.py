"""Whitening of embeddings by the leading principal components: a randomised range finder over all centred rows, checked by
its residuals and widened to the full dimension where these are too large, and Rayleigh-Ritz on what it found."""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .topk import usable

#: Directions tried besides those asked for, and power passes before the full dimension is taken.
OVERSAMPLING, PASSES = 10, 4
#: Largest residual |V u - e u| of a component, as a share of the largest eigenvalue, that counts as double precision.
RESIDUAL = 1e-13
_SAFE = 2**62


def scaled(vectors: DataFrame, d: int) -> DataFrame:
    """vectors (vec_id, embedding) with x: floor(256 * component) as an array of d longs, shorter ones padded with zeros."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * 256))
    return vectors.select("vec_id", F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("embedding"))).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: longs, or whole numbers of any size."""
    if n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0) < _SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_from_mean(x, n, sums) / n).astype(np.float64)


def _summed(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The sum of the matrices that tasks hand on as rows (i, y); what reaches the driver is one matrix of that size."""
    cells = parts.select("i", F.posexplode("y").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((rows, columns))
    out[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    return out


def _over(fit: DataFrame, d: int, rows: int, columns: int, part) -> np.ndarray:
    """The sum over all batches of part(matrix of a batch), a rows x columns matrix."""

    def run(batches):
        total = np.zeros((rows, columns))
        for batch in batches:
            total += part(_matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "y"])

    return _summed(fit.mapInArrow(run, "i int, y array<double>"), rows, columns)


def _count_and_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    def run(batches):
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            safe = len(x) * float(np.abs(x.astype(np.float64)).max(initial=0)) < _SAFE
            n += len(x)
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0) if safe else x.astype(object).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d), pa.int32()), pa.array([decimal.Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], names=["i", "s"])

    found = {r["i"]: int(r["s"]) for r in fit.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def principal(fit: DataFrame, d: int, n: int, sums: list[int], k: int, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(eigenvalues, unit eigenvectors as columns, trace, directions held at last) of the covariance of fit (x).

    A pass multiplies the covariance with an orthonormal basis: every task adds C'(CQ) over its centred rows C. Rayleigh-
    Ritz on the basis gives candidates, and the product their residuals, without another pass. They count if the residuals
    are at double precision and what the basis leaves of the trace is less than the last one's eigenvalue, so that none can
    have been missed; else the product is the next basis. After so many passes the basis becomes the whole space, in which
    Rayleigh-Ritz is the full eigenproblem.
    """
    width, sent = min(d, k + oversampling), fit.sparkSession.sparkContext.broadcast
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0] if width < d else np.eye(d)
    for done in range(passes + 1):
        if done == passes:
            q = np.eye(d)
        basis = sent(q)

        def part(x, basis=basis):
            c = _centred(x, n, sums)
            out = np.zeros((d + 1, basis.value.shape[1]))
            out[:d] = c.T @ (c @ basis.value)
            out[d, 0] = np.einsum("ij,ij->", c, c)
            return out

        y = _over(fit, d, d + 1, q.shape[1], part) / n
        y, trace = y[:d], float(y[d, 0])
        small = q.T @ y
        e, w = np.linalg.eigh((small + small.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        u = q @ w
        far = np.linalg.norm(y @ w - u * e, axis=0)[:k]
        last = min(k, len(e)) - 1
        if q.shape[1] == d or (far.max(initial=0) <= RESIDUAL * max(e[0], 0) and trace - e.sum() < e[last]):
            break
        q = np.linalg.qr(y)[0]
    return e, u, trace, q.shape[1]


def whitened(vectors: DataFrame, k: int = 4, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 0) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, directions of every usable row of
    vectors (vec_id, embedding) and each of the k leading components.

    A component c of a vector becomes x = floor(256 * c), a long (clamped to one). The fit list has each distinct x vector
    once: n of them, with sums S. deviation is the sum of (n * x - S)^2, exact, as a decimal(38,0); null beyond that.
    whitened is x - S / n projected on the unit eigenvector, over the root of its eigenvalue, which is explained times the
    trace; identity_error is the largest entry of whitened's covariance over the fit list minus the identity. directions is
    how many the components were found in (the dimension, where the randomised basis didn't do).

    Vectors null or with null or non-finite components take no part; those without vec_id, and rows that repeat, are
    projected one by one. Shorter vectors count as padded with zeros. Components without variance (less than what rounding
    makes of none) can't be whitened and have no rows, so one distinct vector alone, or an empty table, gives none. Ties of
    eigenvalues leave the choice of their eigenvectors open; it is the same for all rows. Other columns are not looked at.

    Plan: one shuffle of the vectors for the distinct ones, with map-side dedup, however many copies a vector has; passes
    over the written list send one matrix of dimension x directions a task. With the dimension in the thousands the full
    matrix is what is sent.
    """
    rows = vectors.select("vec_id", "embedding").where(usable())
    d = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    empty = rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, directions int")
    if not d:
        return empty
    x = scaled(rows, d)
    fit = staged(x.select("x").distinct(), "fit")
    n, sums = _count_and_sums(fit, d)
    e, u, trace, held = principal(fit, d, n, sums, k, oversampling, passes, seed)
    found = int((e[:k] > 4 * d * np.finfo(float).eps * max(e[0], 0)).sum())
    if not found:
        return empty
    e, project = e[:found], u[:, :found] / np.sqrt(e[:found])

    def squares(m):
        w = _centred(m, n, sums) @ project
        return np.concatenate([w.T @ w, w.sum(axis=0)[None, :]])

    both = _over(fit, d, found + 1, found, squares) / n
    error = float(np.abs(both[:found] - np.outer(both[found], both[found]) - np.eye(found)).max())
    explained, most, names = e / trace, 10**38, empty.columns

    def map_rows(batches):
        for batch in batches:
            m = _matrix(batch.column(1), d)
            from_mean = _from_mean(m, n, sums)
            if from_mean.dtype == object or d * float(np.abs(from_mean.astype(np.float64)).max(initial=0)) ** 2 >= _SAFE:
                total = [int(v) for v in (from_mean.astype(object) ** 2).sum(axis=1)]
                deviation = pa.array([decimal.Decimal(v) if v < most else None for v in total], pa.decimal128(38, 0))
            else:
                deviation = pa.array((from_mean**2).sum(axis=1)).cast(pa.decimal128(38, 0))
            w = (from_mean / n).astype(np.float64) @ project
            each = pa.array(np.repeat(np.arange(len(m)), found))
            count = len(m) * found
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(m))), pa.array(np.full(count, n, np.int64)), deviation.take(each), pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(m))), pa.array(np.full(count, error)), pa.array(np.full(count, held, np.int32)),
                ],
                names=names,
            )

    return x.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(map_rows, empty.schema)
