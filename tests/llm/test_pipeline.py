"""The pipeline's stages over one another, each held against what it got."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from palimpsest.llm.queries import table
from tests.llm.test_operators import brute_classes

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, []
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect())
    before = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    clean, exact, near, private, packed = kept
    gone = set(before) - set(clean)
    assert 0 < len(gone) < 0.15 * len(before)
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert len({bare(r.text) for r in exact.values()}) == len(exact) and {bare(r.text) for r in exact.values()} == {bare(r.text) for r in clean.values()}
    classes = brute_classes([(i, r.text) for i, r in exact.items()], 5, (80, 100))
    assert set(near) == {i for i, (_, c) in classes.items() if i == c}
    assert set(private) == set(near) and all(private[i].text == near[i].text or re.search(r"[0-9@]", near[i].text) for i in near)
    assert not any(re.search(r"(?<!\d)AKIA[0-9A-Z]{16}", r.text) and r.text == before[i].text for i, r in private.items())
    assert {r.doc_id for r in packed} == set(private)


def test_rows_that_repeat_an_id(spark):
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"w{i}" for i in range(60))
    rows = lambda *own: spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in own], ddl)
    left = lambda stage, *own: sorted((r.doc_id or -1, r.text) for r in stage(spark, rows(*own), SF).collect())
    assert left(P.exact, (5, "a  b"), (5, "a b")) == [(5, "a  b")]
    assert left(P.exact, (5, "own"), (5, "a b"), (3, "a b"), (None, "a b")) == [(-1, "a b"), (3, "a b"), (5, "own")]
    for copy in (words, words + " end"):  # equal and similar to the text of 3
        assert left(P.near, (3, words), (5, "quite another text of its own"), (5, copy), (None, words)) == [(-1, words), (3, words), (5, "quite another text of its own")]
    assert len(left(P.near, (5, words), (5, words + " end"))) == 1


def test_run(spark):
    assert P.run(spark, SF).count() > 0


LONG = " ".join(f"word{i % 997} and{i}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, " \t"), (4, "a text of some words that stays as it is"), (4, "a text of some words that stays as it is"), (4, "another text of the same id, with mail a@b.org in it"), (5, LONG), (None, "a text without an id"), (None, None)]


def edge_docs(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("_key", "_row", "_toxic_score", "_pii_kinds", "score", "digest", "kept", "_staged", "n")
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in clash))


def test_edges_of_every_stage(spark):
    """Nulls, empty and very long texts, repeated rows, no rows, and columns with names that stages use within."""
    docs = edge_docs(spark, ROWS)
    shown = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {tuple(r)[5:] for r in out.collect()} == {tuple(f"own {c}" for c in docs.columns[5:])}, name
        assert stage(spark, docs.where("false"), SF).collect() == [], name
    assert shown(P.toxicity(spark, docs, SF)) == shown(docs)
    exact = shown(P.exact(spark, docs, SF))
    assert len(exact) == 7 and ("3", " \t") in exact and ("1", "None") not in exact and ("None", "None") in exact
    assert exact.count(("4", ROWS[3][1])) == 2
    assert ("5", LONG) in shown(P.near(spark, docs, SF)) and len(shown(P.near(spark, docs, SF))) == 9
    private = P.pii(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in private) == sorted(str(i) for i, _ in ROWS) and sum(r.text != t for r, (_, t) in zip(sorted(private, key=lambda r: (str(r.doc_id), str(r.text))), sorted(ROWS, key=lambda x: (str(x[0]), str(x[1]))), strict=True)) == 1
    assert all(r.n_chars == len(r.text or "") for r in private)
    packed = P.packing(spark, docs, SF)
    assert sum(r.piece == 0 for r in packed.collect()) == len(ROWS) and P.packing(spark, docs.where("false"), SF).collect() == []


def shuffled(df):
    """Rows that the exchanges of df's plan wrote when it ran."""
    df.collect()
    seen, rows, left = set(), 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec" and node.id() not in seen:
            seen.add(node.id())
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        left += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_rows_that_stay_are_not_shuffled(spark):
    docs = P.staged(spark.range(5000).selectExpr("if(id % 100 = 1, null, id) AS doc_id", "'x' || id AS text"), "docs")
    gone = docs.where("doc_id % 50 = 0").select("doc_id")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        out = P.without(docs, gone, "doc_id")
        assert shuffled(out) < 1000
        assert {r.text for r in out.collect()} == {f"x{i}" for i in range(5000) if i % 50}
    finally:
        spark.conf.set(limit, before)
