"""Faults that reviews found, held against brute force."""

import gzip
import ipaddress
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import line_dedup, near_dup, pii, topk, toxicity


def short_sets(n, seed, low=12, high=40):
    rng = np.random.default_rng(seed)
    size = rng.integers(low, high + 1, n)
    at = np.concatenate([[0], np.cumsum(size)])
    tokens = rng.integers(0, 2**64, at[-1], np.uint64)
    owner = np.repeat(np.arange(n), size)
    return tokens[np.lexsort((tokens, owner))], at


@pytest.mark.parametrize("t", [(80, 100), (90, 100)])
def test_unrelated_short_sets_share_no_key(t):
    """The sets that have the most frequent key: about as many of 160,000 as of 4,000."""
    most = {}
    for n in (4_000, 40_000, 160_000):
        keys, _, _ = near_dup.Bands(t).keys(*short_sets(n, 1))
        most[n] = int(np.unique(keys, return_counts=True)[1].max())
    assert most[160_000] <= 3, most


def test_sets_of_few_tokens_lose_no_link():
    """Pairs at the threshold share a key, and as many as their counts ask for, whichever has too many empty parts."""
    bands, rng = near_dup.Bands((80, 100)), np.random.default_rng(3)
    sets = []
    for _ in range(6000):
        n = int(rng.integers(4, 60))
        a = rng.integers(0, 2**64, n, np.uint64)
        both = [k for k in range(1, n + 1) if 100 * k >= 80 * (n + max(0, math.floor(k / 0.8) - n) + n - n)]
        k = int(rng.choice(both)) if both else n
        more = max(0, math.floor(k * 100 / 80) - n)
        sets += [np.sort(a), np.sort(np.concatenate([a[:k], rng.integers(0, 2**64, more, np.uint64)]))]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    keys, ka, counts = bands.keys(np.concatenate(sets), at)
    tried = 0
    for i in range(0, len(sets), 2):
        a, b = sets[i], sets[i + 1]
        common = len(np.intersect1d(a, b))
        if min(len(a), len(b)) < bands.least or 100 * common < 80 * (len(a) + len(b) - common) or common == len(a) == len(b):
            continue
        x, y = set(keys[ka[i] : ka[i + 1]].tolist()), set(keys[ka[i + 1] : ka[i + 2]].tolist())
        assert x & y, (len(a), len(b), common)
        for j, other in ((i, y), (i + 1, x)):
            own = keys[ka[j] : ka[j + 1]].tolist()
            shared = [k in other for k in own]
            assert sum(shared[: counts[0, j]]) >= counts[1, j] or sum(shared[counts[0, j] :]) >= counts[2, j]
        tried += 1
    assert tried > 1000


def best(rows, queries, k=5):
    x = {i: [math.floor(256 * c) for c in v] for i, v in rows}
    out = []
    for q in queries:
        score = sorted((-sum(a * b for a, b in zip(x[q], x[i])), i) for i in x if i != q)[:k]
        out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(score)]
    return sorted(out)


@pytest.mark.parametrize("d", [1, 2, 3, 4, 5, 9])
@pytest.mark.parametrize("about", [94_906_267.0, 3.0e9, 40.0])
def test_topk_of_few_components_and_large_products(spark, d, about):
    rng = np.random.default_rng(d)
    rows = [(i, [float(c) for c in (about + rng.integers(-9, 9, d)) / 256 * rng.choice([-1, 1], d)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 6 == 0).collect())
    assert got == best(rows, range(0, 60, 6))


def test_lists_leave_out_only_what_cannot_reach():
    rng = np.random.default_rng(5)
    q, r = np.floor(100 * rng.standard_normal((7, 12))), np.floor(100 * rng.standard_normal((400, 12)) * rng.random((400, 1)))
    whole = q @ r.T
    need = np.sort(whole, axis=1)[:, -9][:, None]
    left, lists = topk._lists(q, r, 4, need)
    assert len(left) < 400 and (sum(lists) == whole[:, left]).all()
    assert not (whole >= need)[:, np.setdiff1d(np.arange(400), left)].any()


def test_lines_are_counted_by_documents(spark):
    line = "a line that is long enough to count"
    rows = [(1, f"{line}\nown words of one"), (1, f"other\n{line}\n{line}"), (2, line), (5, "x")]
    kept = lambda rows: sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [r[2] for r in kept(rows)] == [0, 0, 0, 0]  # two documents hold it
    more = kept([*rows, (3, line), (3, f"{line}\ny")])
    assert [(r[0], r[2]) for r in more] == [(1, 1), (1, 2), (2, 1), (3, 0), (3, 0), (5, 0)]  # three do: the rows of the last keep it


def test_rare_words_count(spark):
    """A word in two toxic texts of few, and in none of many clean ones, tells the classes apart, and is in the model."""
    assert toxicity.log_odds(np.array([2.0]), np.array([0.0]), 100, 9900)[0] > 0.5
    ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 != 1]
    texts = [f"plain words about the weather n{i}" for i in range(3000)] + [f"plain words {'zorgblat' if i < 2 else ''} vile{i % 5} m{i}" for i in range(30)]
    docs, labels = list(zip(ids, texts)), [(ids[i], int(i >= 3000)) for i in range(len(texts))]
    out = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(k.startswith("zorg") and v > 0 for k, v in out.scores.items()), out.scores


KEY = b"k" * 32


def changed(text):
    return pii.replaced(text, pii.entities(text), KEY, {})


def test_addresses_of_any_script_change_whole():
    rnd = random.Random(6)
    pools = ["abcz09", "żółćęłŁ", "王小明", "مريم", "Петр", "한국어", "ñü", "αβ", "हिन्दी", "𠀀𠀁"]
    seen = {}
    for _ in range(3000):
        local = "".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(1, 6)))
        text = f"{local}@{''.join(rnd.choice(rnd.choice(pools[:2])) for _ in range(rnd.randint(1, 5)))}.org"
        found = pii.entities(text)
        if not found or found[0][:2] != (0, len(text)):
            continue
        new = changed(text)
        assert new != text and new.partition("@")[0] != local and new.endswith(".org") and len(new) == len(text)
        for a, b in zip(text, new):
            assert a == b or pii.class_of(a.lower()) == pii.class_of(b.lower()) != ""
        assert seen.setdefault(new.lower(), text.lower()) == text.lower()  # different ones stay different
    assert len(seen) > 1500


def test_permutations_leave_nothing_in_its_place():
    for size in (2, 3, 10, 37, 100):
        made = [pii.permuted(KEY, "t", v, size) for v in range(size)]
        assert sorted(made) == list(range(size)) and all(a != b for a, b in enumerate(made))
        even = lambda v: v % 2 == 0
        if size > 3:
            some = [pii.permuted(KEY, "t", v, size, even) for v in range(0, size, 2)]
            assert sorted(some) == list(range(0, size, 2)) and all(a != b for a, b in zip(range(0, size, 2), some))


def test_addresses_stay_in_their_ranges():
    for text in ("10.0.0.1", "192.168.1.7", "172.31.255.255", "127.0.0.1", "169.254.0.9", "8.8.8.8", "100.64.3.3"):
        new = changed(text)
        a, b = ipaddress.ip_address(text), ipaddress.ip_address(new)
        assert new != text and (a.is_private, a.is_loopback, a.is_link_local, a.is_global) == (b.is_private, b.is_loopback, b.is_link_local, b.is_global)


@pytest.mark.parametrize(
    ("text", "gone"),
    [
        ("Mr JOHN SMITH; John Smith left", ["JOHN", "John", "Smith"]), ("Mr. Smith came. We met John Smith there.", ["John", "Smith"]), ("MR. John Smith", ["John", "Smith"]),
        ("call 555 123 4567 now", ["555", "4567"]), ("call 00447911123456 now", ["7911123456"]), ("ssn 123 45 6789", ["123 45", "6789"]), ("Bearer eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.SflKxwRJSMeKKF2QT4", ["hbGciOiJ", "SflKxw"]),
    ],
)
def test_mentions_and_forms_that_leaked(text, gone):
    new = changed(text)
    assert not [g for g in gone if g in new], new


def test_one_number_in_two_forms_has_one_surrogate():
    a, b = re.findall(r"\d{11,}", changed("00447911123456 and +447911123456"))
    assert a == "00" + b or a.removeprefix("00") == b


def test_bad_archives_are_error_rows(spark, tmp_path):
    from palimpsest.llm import warc

    good = warc.arc_opening(1, "x.arc", "20240101000000") + warc.arc_record(1, "x.arc", "http://a/", "0.0.0.0", "20240101000000", "text/html", b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\nbody")
    files = {"good": good, "cut": good[:-9], "odd": good + b"\nno header line\n", "bare": b"http://a/ 0.0.0.0 20240101000000 text/html 3\nabc\n", "empty": b"", "half.gz": gzip.compress(good)[:-12]}
    (tmp_path / "arc").mkdir()
    for name, stored in files.items():
        (tmp_path / "arc" / name).write_bytes(stored)
    warc.arc_to_warc(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    got = sorted((r.record_type, r.page_id) for r in warc.read_warc(spark, f"file://{tmp_path}/warc").collect())
    # of the good record, in three files, one is the response
    assert [g for g in got if g[0] != "revisit"] == [("response", 7)] and len(got) in (2, 3)
    why = [r.type for r in warc.convert_arc(spark, f"file://{tmp_path}/arc").collect()]
    assert why.count("metadata") == 4 and why.count("warcinfo") >= 3
    record = lambda *fields, block=b"abc": b"WARC/1.1\r\n" + "".join(f"{f}\r\n" for f in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    (tmp_path / "in").mkdir()
    length, kind = "Content-Length: 3", "WARC-Type: resource"
    (tmp_path / "in" / "a").write_bytes(record(length) + record(length, kind, "WARC-Payload-Digest: sha1:NO") + record(length, kind, "WARC-Record-ID: <urn:x>") + record(kind) + record(length, kind))
    (tmp_path / "in" / "b").write_bytes(b"not a record")
    got = sorted((r.record_type, r.target or "", r.record_id or "") for r in warc.read_warc(spark, f"file://{tmp_path}/in").collect())
    assert [(a, b.partition(":")[0], c) for a, b, c in got] == [("error", "KeyError", ""), ("error", "ValueError", ""), ("error", "a record without WARC-Type", ""), ("error", "payload and digest differ", ""), ("resource", "", "urn:x")]
