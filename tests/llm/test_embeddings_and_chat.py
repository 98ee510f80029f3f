"""Whitening, chat formatting and hard negatives against brute force, and their edge cases."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, negatives, queries, whitening

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, label int"


# --- 11 --------------------------------------------------------------------------------------------------------------


def by_definition(rows, k=4):
    """{vec_id: [(n, deviation, whitened, explained)]} with whole numbers for the sums and numpy for the eigenproblem."""
    d = max((len(v) for _, v in rows), default=0)
    x = [(i, [math.floor(256 * c) for c in v] + [0] * (d - len(v))) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in fit])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return {i: [(n, sum((n * a - b) ** 2 for a, b in zip(v, s)), float(np.array([(n * a - b) / n for a, b in zip(v, s)]) @ u[:, j] / math.sqrt(e[j])), e[j] / e.sum()) for j in range(min(k, d))] for i, v in x}


def whitened_rows(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.vec_id, r.component)):
        out[r.vec_id].append((r.n, None if r.deviation is None else int(r.deviation), r.whitened, r.explained))
        assert r.identity_error < 1e-6
    return dict(out)


def same_up_to_sign(got, want):
    assert got.keys() == want.keys()
    signs = [0.0] * 4
    for i in want:
        assert len(got[i]) == len(want[i])
        for j, (g, w) in enumerate(zip(got[i], want[i])):
            assert g[:2] == w[:2] and math.isclose(g[3], w[3], rel_tol=1e-9)
            signs[j] = signs[j] or (1.0 if g[2] * w[2] > 0 else -1.0)
            assert math.isclose(g[2], signs[j] * w[2], rel_tol=1e-7, abs_tol=1e-8)


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = queries.op11_whitening(spark, SF)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and dict(df.dtypes)["deviation"] == "bigint"
    same_up_to_sign(whitened_rows(df), by_definition(rows))


def test_the_randomised_basis_does_where_the_spectrum_falls(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 30)) * (0.03 ** np.arange(30)).clip(1e-4) * 40 + 1000
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), k=2, oversampling=6)
    assert df.first().directions == 8
    same_up_to_sign(whitened_rows(df), by_definition(rows, k=2))
    flat = whitening.whitened(spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(rng.standard_normal((300, 30)))], VECTORS), k=2, oversampling=2)
    assert flat.first().directions == 30  # residuals fail


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i * i % 5), i * 5 % 11 / 3, -float(i)]) for i in range(12)]
    bad = [(50, None), (51, [1.0, None, 1.0, 1.0]), (52, [nan, 0.0, 0.0, 0.0]), (53, [0.0, -inf, 0.0, 0.0])]
    make = lambda rows: spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).withColumn("x", F.lit(1)).withColumn("component", F.lit("a"))
    same_up_to_sign(whitened_rows(whitening.whitened(make(good + bad))), by_definition(good))
    # copies are once in the fit list; each row has its results; short vectors are padded
    copies = good + [(100 + i, good[3][1]) for i in range(30)] + [(200, [1.0]), (201, [])]
    same_up_to_sign(whitened_rows(whitening.whitened(make(copies))), by_definition(copies))
    assert whitening.whitened(make([])).count() == 0
    assert whitening.whitened(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    assert whitening.whitened(make(bad)).count() == 0
    # sums and squares beyond a long
    large = [(i, [2.0**44 * (i + 1), 2.0**43 * (i * i), 1.0 * i, 0.5]) for i in range(9)]
    got = whitened_rows(whitening.whitened(make(large), k=2))
    want = by_definition(large, k=2)
    assert {i: [w[1] for w in v] for i, v in got.items()} == {i: [w[1] for w in v] for i, v in want.items()}


# --- 12 --------------------------------------------------------------------------------------------------------------


def told(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def chat_rows(df):
    return {r.tree_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(df).collect()}


def expected(conversations):
    out = {}
    for i, turns in conversations.items():
        turns = [(r or "", t or "") for r, t in turns]
        learnt = "".join(t for r, t in turns if r == "assistant")
        out[i] = (len(turns), told(turns), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_texts_come_back_whatever_they_hold(spark):
    rnd = random.Random(5)
    parts = [*chat.CONTROL, "<", ">", "[", "]", "/", "\\", "\\n", "\n", "s>", "INST]", "SYS>>", " ", "é", "🙂", "ok", "\\/"]
    said = {i: [(rnd.choice(["user", "assistant", "system", "a\nb", "</s>[INST]", "\\n", "", None]), rnd.choice([None, ""] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))] * 8)) for _ in range(rnd.randint(1, 9))] for i in range(120)}
    rows = [(i, t, r, x, "tree", 1) for i, v in said.items() for t, (r, x) in enumerate(v)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string, copies int")
    pieces = chat.chat_format(df)
    assert chat_rows(pieces) == expected(said)
    whole = {r.tree_id: r for r in chat.documents(pieces).collect()}
    for i, v in said.items():
        text = whole[i].text
        assert chat.turns(text) == [(r or "", t or "") for r, t in v]
        marks = sum(text.count(c) for c in chat.CONTROL)
        assert marks == 2 * len(v)  # none but the template's
        assert "".join(chat.unescaped(text[a:b]) for a, b in whole[i].loss) == "".join(t or "" for r, t in v if r == "assistant")


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, None, "system", "s"), (None, 0, "user", "x"), (2, 5, None, None)]
    got = chat_rows(chat.chat_format(spark.createDataFrame(rows, schema)))
    assert got == expected({1: [("system", "s"), ("user", "a")] + [("assistant", "b")] * 3, None: [("user", "x")], 2: [(None, None)]})
    assert chat.read_back(chat.chat_format(spark.createDataFrame([], schema))).count() == 0
    # a long conversation: joins grow with the logarithm of its length
    long = {7: [("user" if i % 2 else "assistant", f"t{i}") for i in range(700)]}
    df = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(long[7])], schema)
    assert chat_rows(chat.chat_format(df)) == expected(long)


def test_reply_trees(spark):
    rnd = random.Random(9)
    trees, rows = {}, []
    for tree in range(25):
        n = rnd.randint(1, 40)
        up = {i: (rnd.randrange(max(0, i - 4), i) if i else None) for i in range(n)}
        if tree == 3:
            up[0] = 99  # a parent that isn't there: a root
        score = {i: rnd.randint(0, 3) / 2 for i in range(n)}
        trees[tree] = (up, score)
        rows += [(tree, i, up[i], "user" if i % 2 else "assistant", f"{tree}.{i}", score[i]) for i in range(n)]
    rows += [(100, 1, 2, "user", "r", 1.0), (100, 2, 1, "user", "r", 1.0), (100, 3, 1, "user", "r", 1.0)]  # goes round
    rows += rows[:5]  # rows that repeat are one node
    links, texts = chat.replies(spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double"), "score")
    for keep in (None, 2):
        got = defaultdict(list)
        for r in chat.formatted(chat.tree_paths(links, keep), texts).collect():
            got[r.tree_id, r.leaf].append(r)
        seen = defaultdict(list)
        for (tree, _), v in got.items():
            v.sort(key=lambda r: r.pos)
            assert [r.pos for r in v] == list(range(len(v)))
            seen[tree].append((v[0].rank, v[0].score, [chat.turns(r.piece)[0][1] for r in v]))
        for tree, (up, score) in trees.items():
            want = []
            for leaf in set(up) - set(up.values()):
                path, at = [], leaf
                while at is not None and at in up:
                    path.append(at)
                    at = up[at]
                want.append((sum(score[i] for i in path), [f"{tree}.{i}" for i in reversed(path)]))
            ranked = sorted(seen.pop(tree))
            assert [r for r, _, _ in ranked] == list(range(1, len(ranked) + 1))
            assert len(ranked) == min(len(want), keep or len(want))
            assert [s for _, s, _ in ranked] == sorted((s for s, _ in want), reverse=True)[: len(ranked)]
            assert all((s, p) in want for _, s, p in ranked)
        assert not seen


# --- 13 --------------------------------------------------------------------------------------------------------------


def brute(rows, anchors, k_pos=5, k=5, window=(80, 100, 100)):
    d = max((len(v) for _, v, _ in rows), default=0)
    x = [(i, [math.floor(256 * c) for c in v] + [0] * (d - len(v)), label) for i, v, label in rows]
    out = []
    for a in sorted({i for i, _, _ in x if anchors(i)}):
        label, own = min((label, v) for i, v, label in x if i == a)
        score = [(-sum(p * q for p, q in zip(v, own)), i, la) for i, v, la in x if i != a]
        for ps, pid, _ in sorted((s for s in score if s[2] == label), key=lambda s: s[:2])[:k_pos]:
            fit = sorted(s[:2] for s in score if s[2] != label and window[0] * -ps <= window[2] * -s[0] <= window[1] * -ps)[:k]
            out += [(a, pid, r + 1, i, -ps, -s) for r, (s, i) in enumerate(fit)]
    return sorted(out)


def mined(df, **kw):
    found = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **kw)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("lists", [1, 7, 60])
def test_hard_negatives_equal_brute_force(spark, lists):
    rng = np.random.default_rng(lists)
    middle = rng.standard_normal((6, 8))
    rows = [(i, [float(c) for c in (middle[i % 6] + 0.4 * rng.standard_normal(8)).round(1)], int(rng.integers(3))) for i in range(300)]
    rows += [(300 + i, rows[10][1], i % 2) for i in range(60)]  # a vector that very many rows have
    df = spark.createDataFrame(rows, VECTORS)
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and mined(df, lists=lists) == want


def test_lists_are_pruned(spark, monkeypatch):
    """Searches skip lists under their kth score or outside their window, and lose nothing."""
    rng = np.random.default_rng(1)
    middle = 4 * rng.standard_normal((40, 16))
    rows = [(i, [float(c) for c in middle[i % 40] + 0.1 * rng.standard_normal(16)], i // 40 % 2) for i in range(800)]
    visits, real = [], negatives._visit

    def counted(index, anchors, searches, kth, plan, k):
        visits.append(sum(map(len, plan.values())) / len(searches.anchor))
        return real(index, anchors, searches, kth, plan, k)

    monkeypatch.setattr(negatives, "_visit", counted)
    assert mined(spark.createDataFrame(rows, VECTORS), lists=40) == brute(rows, lambda i: i % 10 == 0)
    assert sum(visits) < 40  # of 2 * 40 a search


def test_hard_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 4 - 1), float(i % 3), 0.5], i % 3) for i in range(40)]
    bad = [(90, None, 1), (100, [nan, 1.0, 1.0], 1), (110, [1.0, None, 1.0], 1), (120, [inf, 1.0, 1.0], 0), (130, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    extra = lambda rows: spark.createDataFrame(rows, VECTORS).withColumn("list", F.lit("x")).withColumn("x", F.lit(1))
    assert mined(extra(rows + bad)) == brute(rows, lambda i: i % 10 == 0)
    # ids that repeat, short and empty vectors
    more = rows + [(10, [3.0, 1.0, 1.0], 0), (10, [3.0, 1.0, 1.0], 0), (5, [1.0, 2.0, 0.5], 1), (61, [1.0], 2), (62, [], 1)]
    assert mined(extra(more)) == brute(more, lambda i: i % 10 == 0)
    assert mined(extra([])) == [] and mined(extra(bad)) == [] and mined(extra(rows[:1])) == []
    blank = [(i, [], i % 2) for i in range(25)]
    assert mined(extra(blank)) == brute(blank, lambda i: i % 10 == 0) and mined(extra(blank))
    # products beyond 2^53 are exact
    large = [(i, [94_906_267.0 / 256 + i % 5, 94_906_267.0 / 256 - (i * i) % 7], i % 2) for i in range(30)]
    assert mined(extra(large)) == brute(large, lambda i: i % 10 == 0)


def test_anchors_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROUND", 3)
    rows = [(i, [float(i % 5), float(i % 7), 1.0], i % 2) for i in range(100)]
    assert mined(spark.createDataFrame(rows, VECTORS)) == brute(rows, lambda i: i % 10 == 0)
