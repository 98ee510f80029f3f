"""The corpus pipeline: toxicity, exact dedup, near-duplicate join, PII and packing, each over what the last one kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents; the last returns the packed pieces. For all stages: a null text counts
as an empty one and stays null; an empty table gives no rows; rows that repeat are judged one by one; columns that docs
has besides, whatever their names, come through as they are (but for the last stage, which returns none of them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import maybe_in, staged, table, unused
from palimpsest.llm.exact_dedup import exact_dedup
from palimpsest.llm.near_dup import ngram_jaccard_classes
from palimpsest.llm.packing import best_fit_packing
from palimpsest.llm.pii import surrogates
from palimpsest.llm.queries import surrogate_key, vocabulary
from palimpsest.llm.toxicity import fit, score_texts

#: A document with a toxicity score of this or more goes.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the model learns from labels of documents that are not held out. Empty
    texts have the score of a text without toxic passages, and stay; without labels of both kinds all do, unless most
    labels are toxic."""
    model, p = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")), prefix(docs, "_toxic_")
    return score_texts(docs, model, prefix=p).where(F.col(f"{p}score") < TOXIC).select(*docs.columns)


def prefix(docs: DataFrame, name: str) -> str:
    """name, or a longer one, with which no column of docs begins."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    return name


def without(docs: DataFrame, gone: DataFrame, *by: str) -> DataFrame:
    """docs without the rows that gone names: a row goes by the verdict on its own text. Only rows whose doc_id may be among
    those of gone meet it in a join, so that most texts are not shuffled."""
    gone = staged(gone.select(*by).distinct(), "gone")
    some, rest = maybe_in(docs, gone, "doc_id")
    return some.join(gone, list(by), "left_anti").select(*docs.columns).union(rest.select(*docs.columns))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a digest of the text, which with doc_id tells rows apart that repeat a doc_id, and its name."""
    key = unused(docs, "_key")
    return docs.withColumn(key, F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))), key


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one stays, and rows that repeat its doc_id and length. Rows without doc_id can't
    be named by a verdict, and stay. All empty texts are equal."""
    rows, key = keyed(docs)
    gone = exact_dedup(rows, carry=(key,)).where("not kept and doc_id is not null")
    return without(rows, gone, "doc_id", key).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 or more in five-word shingles, the one with the smallest id stays.

    Rows that repeat a doc_id are judged each by its own text, under numbers in the order of doc_id and digest. Empty
    texts and rows without doc_id are like nothing, and stay.
    """
    judge = lambda df: ngram_jaccard_classes(df, words=5, t=(80, 100)).where("doc_id <> component_id")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return without(docs, judge(docs), "doc_id").select(*docs.columns)
    rows, key = keyed(docs)
    row = unused(rows, "_row")
    each = rows.where("doc_id is not null").select("doc_id", key).distinct().orderBy("doc_id", key)
    each = staged(each.withColumn(row, F.monotonically_increasing_id()), "rows")
    gone = judge(rows.join(each, ["doc_id", key]).select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row))
    return without(rows, each.join(staged(gone.distinct(), "judged"), row), "doc_id", key).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates; n_chars, if there is such a column, follows the text where it changed."""
    p = prefix(docs, "_pii_")
    made = surrogates(docs, surrogate_key(spark), prefix=p)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col(f"{p}n_entities") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return made.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, and their places in sequences of 4096 tokens at most."""
    return best_fit_packing(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("ngram_jaccard", near), ("pii", pii), ("packing", packing)]

#: No SQL states the toxicity model, the near-duplicate components, the surrogates or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
