"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, line_dedup, near_dup, packing, pieces, pii, substring_dedup, topk, toxicity, warc

LONG = " ".join(f"word{i % 997} mail{i}@example.org" for i in range(20_000))
SAME = "the quick brown fox jumps over the lazy dog and runs far away from it all today\nshort"
TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, SAME), (4, SAME), (5, SAME), (6, SAME.upper()), (7, LONG), (8, "x"), (None, SAME), (9, "\n\n"), (10, SAME + " end")]
#: Names that operators use within, as columns of the table.
CLASH = ["h", "g", "gone", "n", "rep", "home", "part", "digest", "score", "kept", "piece", "length", "blk", "bucket", "mark", "keys", "kinds", "_rank", "sequence_id", "toxic", "ids", "best"]


def documents(spark, rows=TEXTS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))


LABELS = [(4, 1), (5, 0), (5, 1), (7, 0), (8, None), (None, 1), (2, 0)]
MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "pieces": lambda df: pieces.decode(pieces.encode(df, MODEL), MODEL),
    "line_dedup": line_dedup.line_dedup,
    "pii": lambda df: pii.surrogates(df.select("doc_id", "text", "kinds", "score"), b"k", "made_"),
    "substring_dedup": substring_dedup.substring_dedup,
    "exact_dedup": exact_dedup.exact_dedup,
    "near_dup": near_dup.ngram_jaccard_classes,
    "toxicity": lambda df: toxicity.toxicity(df, df.sparkSession.createDataFrame(LABELS, "doc_id long, toxic int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, name):
    out = OPERATORS[name](documents(spark))
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark, [])).collect() == []


def test_packing(spark):
    out = packing.best_fit_packing(documents(spark), WORDS).toPandas()
    whole = out.groupby(out["doc_id"].fillna(-1)).size()
    assert whole[7] > 1 and out[out.doc_id == 1][["start", "length"]].values.tolist() == [[0, 1]]
    assert len(out[out.doc_id == 4]) == 2 and packing.best_fit_packing(documents(spark, []), WORDS).collect() == []


def test_line_dedup(spark):
    out = {(r.doc_id, r.kept): r for r in line_dedup.line_dedup(documents(spark)).collect()}
    assert out[1, ""].n_lines == 1 and out[9, "\n\n"].n_lines == 3
    # the line is in rows 4, 4, 5, 6 and 10: it stays in 10 alone; a row without doc_id is left as it is
    assert out[4, "short"].n_dropped == 1 and out[6, "SHORT"].n_dropped == 1 and out[10, SAME + " end"].n_dropped == 0 and out[None, SAME].n_dropped == 0


def test_line_dedup_of_rows_that_repeat_an_id(spark):
    """Each row loses its own lines, whatever other rows have its doc_id."""
    often = "a line that many of the documents have"
    rows = [(1, f"{often}\nkeepA0"), (1, "only in B\nsecond B"), (1, f"x\n{often}"), (2, often), (3, often)]
    out = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.line_dedup(documents(spark, rows)).collect())
    assert out == [(1, 2, 0, "only in B\nsecond B"), (1, 2, 1, "keepA0"), (1, 2, 1, "x"), (2, 1, 1, ""), (3, 1, 0, often)]


def test_pii(spark):
    out = {(r.doc_id, r.text): r for r in pii.surrogates(documents(spark).select("doc_id", "text", "kinds", "score"), b"k", "made_").collect()}
    assert out[1, None].made_n_entities == 0 and out[2, ""].made_n_entities == 0 and out[4, SAME].made_kinds == [] and out[4, SAME].kinds == "own kinds"
    long = next(r for r in out.values() if r.doc_id == 7)
    assert long.made_n_entities == 20_000 and len(long.text) == len(LONG) and not set(long.text.split()[1::2]) & set(LONG.split()[1::2]) and long.text.split()[::2] == LONG.split()[::2]
    with pytest.raises(ValueError):
        pii.surrogates(documents(spark), b"")


def test_pieces(spark):
    out = {r.doc_id: r for r in OPERATORS["pieces"](documents(spark)).collect()}
    assert (out[1].n_tokens, out[1].text, out[2].text, out[3].text, out[7].text) == (0, "", "", " \t\n", LONG) and out[7].n_tokens > 40_000


def test_exact_dedup(spark):
    out = exact_dedup.exact_dedup(documents(spark)).collect()
    same = [r for r in out if r.doc_id in (4, 5, None)]
    assert {r.keep_id for r in same} == {4} and {r.group_size for r in same} == {4} and [r.kept for r in same if r.doc_id == 4] == [True, True]
    empty = [r for r in out if r.doc_id in (1, 2, 3, 9)]
    assert {(r.keep_id, r.group_size) for r in empty} == {(3, 4)}  # the most code points stay


def test_substring_dedup(spark):
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(documents(spark)).collect()}
    assert out[1].n_words == 0 and out[5].n_removed == 18 and out[4].n_removed == 0
    assert out[None].n_removed == 18 and out[10].n_removed == 18 and out[10].kept == "end"


def test_substring_dedup_of_one_id_in_many_blocks(spark):
    """Rows of one id, or of none, lie in several blocks; equal ids are no smaller than one another."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(7, f"a{i} {passage} b{i}") for i in range(12)] + [(None, f"c{i} {passage}") for i in range(6)] + [(3, f"x {passage}")]
    for own, others in ((rows, True), (rows[:12], False)):
        out = substring_dedup.substring_dedup(documents(spark, own), block=100).collect()
        assert all(r.n_removed == (20 if others and r.doc_id != 3 else 0) for r in out) and len(out) == len(own)


def test_near_dup(spark):
    out = {r.doc_id: r for r in near_dup.ngram_jaccard_classes(documents(spark)).collect()}
    assert out[1].n_shingles == 0 and out[1].component_id == 1 and out[2].component_id == 2
    assert {out[i].component_id for i in (4, 5, 6, 10)} == {4} and out[8].n_shingles == 1 and out[None].component_id is None


def test_toxicity_needs_both_classes(spark):
    df, labels = documents(spark), spark.createDataFrame([(4, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(df, labels.where("doc_id < 0")).collect()} == {0}
    both = spark.createDataFrame([(4, 1), (5, 0), (6, 0)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(df, labels).union(toxicity.toxicity(df, both)).collect())


VECTORS = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [9.0, 9.0]), (50, [-1.0, -2.0]), (8, [3e30, 1.0])]


def test_topk(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumn("q", F.lit("x")).withColumn("score", F.lit("y"))
    out = topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect()
    mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == 0)
    assert mine == [(1, 8, 2**63 - 1), (2, 7, 5 * 65536), (3, 7, 5 * 65536), (4, 5, 65536), (5, 6, 0)]
    assert [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == 50] == [6, 5, 0, 7, 7]
    assert topk.exact_topk(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).collect() == []


PAGES = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://b c/ü", None), (4, "http://d/", ""), (None, "http://e/", "x"), (5, "u", "\r\n\r\nWARC/1.1\r\n" * 9), (6, "u", "é🙂" * 300_000), (7, "u", "x")]


def test_warc(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("type", F.lit("t"))
    out = {r.page_id: r for r in warc.pages_through_archives(df).collect()}
    assert len(out) == 8 and {i for i, r in out.items() if r.record_type == "revisit"} == {1, 2, 3, None}
    assert {out[i].refers_to for i in (1, 2, None)} == {7} and out[3].refers_to == 4 and out[6].payload_bytes == 6 * 300_000
    assert warc.pages_through_archives(df.where("page_id < 0")).collect() == []
    assert {r.record_type for r in warc.pages_through_archives(df, min_bytes=10**9).collect()} == {"response"}
