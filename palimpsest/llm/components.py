"""Connected components of a graph in a table, by contraction; nothing of it goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Rounds within which any graph that fits a store is contracted: each leaves a fraction of the vertices.
ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every vertex of edges (a long, b long).

    In each round every vertex goes to the neighbour, or itself, with the least hash, which is drawn anew; what is left
    are edges between these. A path shrinks by a constant factor a round, so the rounds grow as the logarithm of the
    diameter. A vertex of very many edges is a group that is reduced before the shuffle, and the long side of a join
    with a unique key.
    """
    left = staged(edges.where("a <> b").select("a", "b").distinct(), "edges")
    where = staged(left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("at", F.col("id")), "vertices")
    for i in range(ROUNDS):
        if left.isEmpty():
            break
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64(F.lit(i), F.col("b")).alias("h"), F.col("b").alias("to"))
        own = F.struct(F.xxhash64(F.lit(i), F.col("a")).alias("h"), F.col("a").alias("to"))
        moves = both.groupBy("a").agg(F.min(F.least(order, own))["to"].alias("to"))
        moves = staged(moves, "moves")
        a, b = moves.select("a", F.col("to").alias("na")), moves.select(F.col("a").alias("b"), F.col("to").alias("nb"))
        left = staged(left.join(a, "a").join(b, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges")
        where = staged(where.join(moves.withColumnRenamed("a", "at"), "at", "left").select("id", F.coalesce("to", "at").alias("at")), "vertices")
    else:
        raise RuntimeError("the graph was not contracted")
    least = where.groupBy("at").agg(F.min("id").alias("component"))
    return where.join(staged(least, "least"), "at").select("id", "component")
