"""Line dedup with DataFrame functions alone: frequent lines go, except in the largest document that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, staged


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, kept (text).

    A text is split at \\n; a null or empty one has one empty line. A line's key is the line without white space at both
    ends and with A-Z lower-cased. A key of min_chars code points or more that is in min_docs documents or more loses all
    its lines, except in the rows with the largest doc_id that holds it. Rows that repeat a doc_id are one document when
    documents are counted, and each loses its own lines; rows whose doc_id is null are returned as they are and count for
    nothing. Other columns are not looked at.

    Plan: a line becomes (128-bit hash of its key, position); sorting these within the row marks each key's first line
    there. They are written as a table of one row a text, so that lines are hashed once. Counting documents per key needs
    one shuffle with map-side sums, however hot the key; only the keys of rows that share a doc_id are made distinct
    before, by that id. Keys over the threshold are written too, so that their size is
    known, and joined back to the lines: broadcast under Spark's limit, else by hash. They are unique, so a hot key makes
    only one side long, which the adaptive skew join splits. The texts are shuffled once, by doc_id and a hash of the
    text (rows equal in both lose the same lines), to meet the positions they lose and be put together again.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("own", F.xxhash64("text"))

    def hashed(line, at):
        key = F.btrim(line, F.lit(BLANKS))
        return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(7), key).alias("g"), at.alias("at")))

    keys = docs.where("doc_id is not null").select("doc_id", "own", F.transform(F.split(ascii_lower(F.col("text")), "\n", -1), hashed).alias("k"))
    keys = staged(keys.select("doc_id", "own", F.sort_array(F.filter("k", lambda x: x.isNotNull())).alias("k")).where(F.size("k") > 0), "lines")
    before = lambda i, name: F.get("k", i - 1)[name]
    first = lambda x, i: ((i > 0) & (before(i, "h") == x["h"]) & (before(i, "g") == x["g"])).cast("int")
    keys = keys.select("doc_id", "own", F.explode(F.transform("k", lambda x, i: F.struct(x["h"].alias("h"), x["g"].alias("g"), x["at"].alias("at"), (1 - F.coalesce(first(x, i), F.lit(0))).alias("first")))).alias("k"))
    keys = keys.select("doc_id", "own", "k.*")
    again = staged(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    each = keys.where("first = 1").select("doc_id", "h", "g")
    once = each.join(again, "doc_id", "left_anti").unionByName(each.join(again, "doc_id", "left_semi").distinct())
    frequent = once.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder")).where(F.col("n") >= min_docs)
    frequent = staged(frequent.select("h", "g", "holder"), "frequent")
    gone = keys.select("doc_id", "own", "h", "g", "at").join(frequent, ["h", "g"]).where("doc_id <> holder")
    gone = gone.groupBy("doc_id", "own").agg(F.collect_set("at").alias("gone"))
    met = docs.join(gone, ["doc_id", "own"], "left").select("doc_id", "text", "gone", F.split("text", "\n", -1).alias("lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    return met.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )
