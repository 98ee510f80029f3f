"""Exact dedup with a heavy-hitter split: frequent digests are settled by a broadcast of winners, the rest by a shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, staged

#: Misra-Gries counters a summary holds: every digest on more than one row in COUNTERS is found. Bounds the broadcast.
COUNTERS = 1024
#: Summaries merged by one task.
FAN_IN = 64


def misra_gries(counts: dict, k: int) -> dict:
    """The k strongest counters of a summary, lessened by the next one's count, as merging summaries asks."""
    if len(counts) <= k:
        return counts
    least = sorted(counts.values(), reverse=True)[k]
    return {x: n - least for x, n in counts.items() if n > least}


def heavy_digests(digests: DataFrame, column: str, k: int = COUNTERS) -> DataFrame:
    """At most k values of a binary column, every one that is on more than a k-th of the rows among them.

    Each partition keeps a Misra-Gries summary; summaries are merged FAN_IN at a time, so that no task ever holds more
    than FAN_IN * k counters.
    """
    schema = pa.schema([("part", pa.int64()), (column, pa.binary()), ("n", pa.int64())])

    def rows(counts, part):
        return pa.RecordBatch.from_arrays([pa.array([part] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def summarise(batches):
        from pyspark import TaskContext

        counts: dict = {}
        for batch in batches:
            for x, n in ((v["values"], v["counts"]) for v in batch.column(0).value_counts().to_pylist()):
                counts[x] = counts.get(x, 0) + n
            counts = misra_gries(counts, k)
        yield rows(counts, TaskContext.get().partitionId())

    def merge(t: pa.Table) -> pa.Table:
        counts: dict = {}
        for x, n in zip(t[column].to_pylist(), t["n"].to_pylist(), strict=True):
            counts[x] = counts.get(x, 0) + n
        return pa.Table.from_batches([rows(misra_gries(counts, k), t["part"][0].as_py())])

    ddl = f"part long, {column} binary, n long"
    parts = digests.rdd.getNumPartitions()
    found = digests.select(column).mapInArrow(summarise, ddl)
    while True:
        parts = -(-parts // FAN_IN)
        found = found.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(merge, ddl)
        if parts <= 1:
            return found.select(column)


def signatures(docs: DataFrame, carry: tuple = ()) -> DataFrame:
    """doc_id, the columns to carry, digest (SHA-256 of the text without white space) and n_points (code points of the text) of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", *carry, F.unhex(F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256)).alias("digest"), F.char_length(text).cast("long").alias("n_points"))


def exact_dedup(docs: DataFrame, carry: tuple = ()) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, digest (binary SHA-256 of the text without white space).

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts the row
    with the most code points stays, then the one with the smallest doc_id; a null doc_id comes after all others. Of rows
    that repeat the winner's doc_id and length too, each counts as kept: they can't be told apart. Other columns are not
    looked at; those to carry follow.
    """
    rows = staged(signatures(docs, carry), "signatures")
    # order: most code points, then smallest doc_id; nulls last
    better = F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("turned"))
    settle = lambda df: df.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(better).alias("best"))
    suspects = heavy_digests(rows, "digest")
    winners = settle(rows.join(F.broadcast(suspects), "digest", "left_semi"))  # COUNTERS rows at most
    winners = staged(winners, "winners")
    light = rows.join(F.broadcast(winners), "digest", "left_anti")
    light = light.join(settle(light), "digest")  # summed before the shuffle; the join splits a digest that is still long
    heavy = rows.join(F.broadcast(winners), "digest")
    both = heavy.select(*light.columns).union(light)
    keep = F.bitwise_not("best.turned")
    kept = F.col("doc_id").eqNullSafe(keep) & (F.col("n_points") == F.col("best.n_points"))
    return both.select("doc_id", keep.alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "digest", *carry)
