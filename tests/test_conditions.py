from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.operators import conditions as C

FIELDS = {"r.s": ["CA", "NY", None], "r.n": [1, 7, None], "r.b": [True, False, None]}
ROWS = [(s, n, b) for s in FIELDS["r.s"] for n in FIELDS["r.n"] for b in FIELDS["r.b"]]


def judged(c, record):
    """The language's meaning in plain Python; record is None where a parent is null."""

    def one(x):
        v = None if record is None else record[x.path]
        if x.op in C.UNARY:
            return (v is not None) == (x.op == "present")
        if x.op == "!=":
            return v != x.value or v is None
        if v is None:
            return False
        return {"==": lambda: v == x.value, "in": lambda: v in x.value, ">": lambda: v > x.value, "<=": lambda: v <= x.value}[x.op]()

    parts = [one(x) for x in c.comparisons]
    return all(parts) if c.join == "and" else any(parts)


comparison = st.one_of(
    st.builds(C.Comparison, st.sampled_from(sorted(FIELDS)), st.sampled_from(C.UNARY)),
    st.builds(C.Comparison, st.just("r.s"), st.sampled_from(["==", "!="]), st.sampled_from(["CA", "x"])),
    st.builds(C.Comparison, st.just("r.n"), st.sampled_from(["==", "!=", ">", "<="]), st.integers(0, 8)),
    st.builds(C.Comparison, st.just("r.s"), st.just("in"), st.just(("CA", "NY"))),
    st.builds(C.Comparison, st.just("r.n"), st.just("in"), st.just((7, 9))),
    st.builds(C.Comparison, st.just("r.b"), st.sampled_from(["==", "!="]), st.booleans()),
)
condition = st.builds(lambda xs, j: C.Condition(tuple(xs), j if len(xs) > 1 else "and"), st.lists(comparison, min_size=1, max_size=4), st.sampled_from(C.JOINS))


def spelled(c):
    word = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    one = lambda x: f"{x.path} {x.op}" if x.op in C.UNARY else f"{x.path} in [{', '.join(map(word, x.value))}]" if x.op == "in" else f"{x.path} {x.op} {word(x.value)}"
    return f" {c.join} ".join(map(one, c.comparisons))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(condition, min_size=8, max_size=8))
def test_both_modes_mean_what_the_language_says(spark, conditions):
    df = spark.createDataFrame([(i, r) for i, r in enumerate([*ROWS, None])], "i int, r struct<s:string,n:int,b:boolean>")
    assert all(C.parse(spelled(c)) == c and C.from_json(C.to_json(c)) == c for c in conditions)
    got = df.select("i", *(C.compile_value(c, df.schema).alias(f"v{k}") for k, c in enumerate(conditions)), *(F.coalesce(C.compile_filter(c, df.schema), F.lit(False)).alias(f"f{k}") for k, c in enumerate(conditions))).collect()
    for row in got:
        record = None if row.i == len(ROWS) else dict(zip(FIELDS, ROWS[row.i], strict=True))
        for k, c in enumerate(conditions):
            assert row[f"v{k}"] == row[f"f{k}"] == judged(c, record), (spelled(c), record)


@pytest.mark.parametrize("text", ["", "a", "a ==", "a b c", "a and b", "a present or b present and c present", "a in []", "a in 3", "a == foo", "a in [1", "a in [1 2]", "#", "present present", "a present b"])
def test_errors(text):
    with pytest.raises(C.ConditionError):
        C.parse(text)


def test_literals_and_null_spellings():
    assert C.parse(r"a == 'it\'s' and b in [1, 2.50, true, \"x\"]".replace('\\"', '"')).comparisons[1].value == (1, Decimal("2.50"), True, "x")
    assert C.parse("a != null OR b == NIL").comparisons == (C.Comparison("a", "present"), C.Comparison("b", "absent"))
    assert C.parse("a == 'x == null'").comparisons == (C.Comparison("a", "==", "x == null"),)


def test_checks(spark):
    schema = spark.createDataFrame([], "policy struct<s:string,n:int,b:boolean,d:date>").schema
    bad = lambda t, scope=None: len(C.check(C.parse(t), schema, scope))
    assert [bad(t) for t in ("policy.n > 1", "policy.d < '2020-01-01'", "policy.b == true", "policy.n in [1]", "policy.s in [1]")] == [0] * 5
    assert [bad(t) for t in ("policy.s > 'a'", "policy.n == 'a'", "policy.b == 'x'", "policy.d == 3", "policy.s == true", "policy.n in ['a']", "policy.x present")] == [1] * 7
    assert bad("quote.n > 'a'", "policy") == 1


def test_false_is_absent_for_elements(spark):
    df = spark.createDataFrame([([(True, 1), (False, 2), (None, 3)],)], "items array<struct<b:boolean,n:int>>")
    test = C.compile_element(C.parse("item.b present"), df.schema["items"].dataType.elementType, "item")
    assert df.select(F.transform(F.filter("items", test), lambda i: i["n"]).alias("n")).first().n == [1]
