import pytest
from pyspark.sql import functions as F

from palimpsest.operators import conditions as C
from palimpsest.operators import graph, nested, templates, variants


def test_rule_sets_report_all_errors_at_once():
    rules = variants.rule_set([("a", "x ==", "t"), ("b", "x present", "1"), ("b", "x absent", "2"), ("c", "", "[[$c]]"), ("d", "", "[[$z]]"), ("e", "", "1"), ("e", "else", "2"), ("f", "quote.a present", ""), ("f", "policy.a present", "")])
    text = " | ".join(rules.errors)
    for part in ("a: a literal expected", "b: no default", "a cycle: c -> c", "d: refers to z", "e: several defaults", "f: conditions on policy and quote"):
        assert part in text


def test_loops_and_presence():
    rules = variants.rule_set([("Items", "", ""), ("Some", "policy.a present", ""), ("P", "policy.a present", ""), ("Two", "policy.a present", ""), ("Two", "policy.b present", "x")], loops=("Items", "Some", "Two"), presence=("P",))
    assert rules.dropped == ["Items"] and rules.blocks["Some"].kind == "loop"
    assert {e.split(":")[0] for e in rules.errors} == {"P", "Two"}
    assert "x: no rows" in variants.rule_set([("y", "", "t")], template=("x",)).errors and "y: not in the template" in variants.rule_set([("y", "", "t")], template=("x",)).errors


def test_no_match_is_a_space_and_an_empty_text_is_empty(spark):
    df = spark.createDataFrame([(1, ("a",)), (2, ("b",)), (3, None)], "i int, policy struct<s:string>")
    out = variants.with_variants(df, variants.rule_set([("v", "policy.s == 'a'", ""), ("v", "policy.s == 'z'", "z"), ("v", "", "")])).orderBy("i")
    assert [r.v for r in out.collect()] == ["", " ", " "]
    with pytest.raises(C.ConditionError):
        variants.with_variants(df, variants.rule_set([("v", "policy.nothing present", "")]))


def test_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('﻿# a note\nPlaceholder;When;Text\nk;x == 1;"two\nlines # kept"\n;;\nk;else; t \n', "utf-8")
    rows = variants.read_sheet(spark, str(tmp_path / "s.csv")).orderBy("ord").collect()
    assert [(r.key, r.when, r.text) for r in rows] == [("k", "x == 1", "two\nlines # kept"), ("k", "else", "t")]


def test_graphs():
    assert graph.find_cycle({"a": ["b"], "b": ["c"], "c": ["b"]}) == ["b", "c", "b"]
    assert graph.find_cycle({"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": []}) is None
    assert graph.ordered({"a": ["b"], "b": [], "c": ["a"]}) == ["b", "a", "c"]
    assert graph.parents({"a": ["b"], "b": ["c"], "c": []}) == {"a": (None, 0), "b": ("a", 1), "c": ("b", 2)}


def test_templates(spark):
    df = spark.createDataFrame([(1, "x", [("a", 1), (None, 2)], True), (2, None, None, None)], "i int, s string, items array<struct<k:string,n:int>>, b boolean")
    loops = {"Item": templates.Loop("items", "it")}
    render = lambda t, strict=False: [r.t for r in df.orderBy("i").select(templates.compile_template(t, df.schema, loops, strict).alias("t")).collect()]
    assert render("<{s}|{$s}>") == ["<x|x>", "<|>"]
    assert render("[Item/]({it.k}{it.n})[/Item]") == ["(a1)(2)", ""]
    assert render("[b?]yes[/b]no") == ["yesno", "no"]
    assert render("[Item/][it.k?][/Item]") == render("[Item/][it.k?][/Item]")
    assert templates.parse("[A/] [/B] [C]")[1] == ["B closes nothing", "[C] is neither a loop nor a region", "A is not closed"]
    with pytest.raises(Exception, match="s is required"):
        render("{s}", strict=True)


def test_strict_guard_stops(spark):
    df = spark.createDataFrame([(1, None)], "i int, s string")
    gaps = nested.missing({"s": F.col("s")})
    assert nested.split_rejects(df, gaps)[1].first().missing == ["s (required)"]
    with pytest.raises(Exception, match="record 1 lacks s"):
        nested.strict(df, gaps, "i").collect()


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(1, "premium", 1234.125), (1, "Premium", 0.0), (1, "nonFinancial", 5.0), (2, None, 1.0)], "k int, category string, amount double")
    rows = {r.k: tuple(r)[1:] for r in nested.charge_totals(df, ["k"]).collect()}
    assert rows == {1: ("1234.12", "0.00", "1234.12"), 2: ("0.00", "1.00", "1.00")}


def test_plans_read_each_table_once(spark):
    """What asks whether, how many or how much gathers no lists, reads no customers, and the letter reads the lines once."""
    from palimpsest.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    plan = lambda name: Q.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("presence_any", "item_filter_region", "guard_missing_required", "guard_rejects", "item_x_coverage_unpivot"):
        assert "collect_list" not in plan(name) and "c_custkey" not in plan(name), name
    assert plan("letter_flagship").count("l_orderkey") and plan("letter_flagship").count("Relation [l_orderkey") == 1
    assert "c_custkey" not in plan("loop_rows")
