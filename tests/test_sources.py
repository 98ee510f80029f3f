import io
import json
import zipfile

from pyspark.sql import functions as F

from palimpsest.sources import config_tree, documents, sinks


CONFIG = [
    ("products/Multi/config.json", '{"displayName":"Multi","contents":["Vehicle+","Driver*","Home"],"charges":["Levy"],"data":{"term":{"type":"int","displayName":"Term"},"state":{"type":"string","options":["CA","NY"]}}}'),
    ("exposures/Vehicle/config.json", '{"displayName":"Vehicle","contents":["Collision!","MedPay?"],"data":{"make":{"type":"string"},"drivers":{"type":"Driver+"}}}'),
    ("exposures/Driver/config.json", '{"displayName":"Driver","data":{"license":{"type":"string?"}}}'),
    ("exposures/Home/config.json", '{"data":{"address":{"type":"Address"}}}'),
    ("coverages/Collision/config.json", '{"displayName":"Collision","charges":["Premium"],"data":{"deductible":{"type":"decimal"}},"coverageTerms":["LimitTerm",{"name":"Inline","options":["*a","b"]}],"qualification":"x"}'),
    ("coverages/MedPay/config.json", '{"displayName":"Medical","data":{"limit":{"type":"decimal"},"limitExtra":{"type":"decimal"}}}'),
    ("charges/Premium/config.json", '{"category":"premium"}'),
    ("coverageTerms/LimitTerm/config.json", '{"displayName":"Limit","value":{"type":"decimal"},"options":{"low":"1","high":"2"}}'),
    ("customDataTypes/Address/config.json", '{"data":{"street":{"type":"string"},"next":{"type":"Address?"}}}'),
    ("exposures/Broken/config.json", "{not json"),
]


def test_config_tree_from_files(spark, tmp_path):
    for rel, text in CONFIG:
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(text)
    cfgs = config_tree.configs(config_tree.config_files(spark, str(tmp_path)))
    assert cfgs.where("name = 'Broken'").isEmpty() and cfgs.count() == len(CONFIG) - 1
    paths = config_tree.paths(cfgs)
    sinks.write_catalog(paths, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == paths.count() == 35
    assert {r.quantifier for r in paths.where("exposure = 'Driver' and field = 'license'").collect()} == {"?"}
    assert paths.where("custom_type_ref is not null").select("field").toPandas()["field"].tolist() == ["address"] or paths.where("custom_type_ref = 'Address'").count() == 1


def test_empty_config(spark):
    cfgs = config_tree.configs(spark.createDataFrame([("products/P/config.json", json.dumps({"displayName": "P"}))], "rel string, text string"))
    assert config_tree.paths(cfgs).count() == 17 and config_tree.iterables(cfgs).count() == 0
    assert config_tree.features(cfgs).where("enabled").count() == 0 and config_tree.features(cfgs).count() == 10


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_docx(spark, tmp_path):
    p = lambda t, style="", bold="": f'<w:p><w:pPr>{style}</w:pPr><w:r><w:rPr>{bold}</w:rPr><w:t>{t}</w:t></w:r></w:p>'
    body = p("Title", '<w:pStyle w:val="Heading1"/>') + p("sub", '<w:pStyle w:val="Heading2"/>') + p("loud", bold="<w:b/>") + p("") + f"<w:tbl><w:tr><w:tc>{p('cell')}</w:tc></w:tr></w:tbl>" + p("Dear {name}")
    (tmp_path / "a.docx").write_bytes(docx(body))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    rows = documents.read_docx(spark, str(tmp_path)).orderBy("path", "ord").collect()
    assert [(r.tag, r.text) for r in rows[:-1]] == [("h1", "Title"), ("h2", "sub"), ("strong", "loud"), ("td", "cell"), ("p", "Dear {name}")]
    assert rows[-1].tag == "error"


def test_pdf_lines(spark):
    chars = [("d", 0, 10.04, float(i), 20.0, c) for i, c in enumerate("Head")] + [("d", 0, t, float(i), 10.0, c) for t in (30.0, 40.0) for i, c in enumerate("ab")]
    rows = documents.pdf_lines(spark.createDataFrame(chars[::-1], "doc_id string, page int, top double, x double, size double, char string")).orderBy("line").collect()
    assert [(r.text, r.tag) for r in rows] == [("Head", "h2"), ("ab", "p"), ("ab", "p")]


def test_reviews(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿Leaf,Suggested,Final\nstate,a,"\n policy.data.state \nx"\nterm,b,\n', "utf-8")
    assert {(r.leaf, r.final) for r in documents.read_review_csv(spark, str(tmp_path / "r.csv")).collect()} == {("state", "policy.data.state"), ("term", None)}
    (tmp_path / "r.md").write_text("# Review\n## Field: `state`\n- **Scope:** policy\n- **Final:** `policy.data.state`\n## Field: term\n- Final:\n")
    assert {tuple(r) for r in documents.read_review_markdown(spark, str(tmp_path / "r.md")).collect()} == {("state", "policy", "policy.data.state"), ("term", None, None)}
    (tmp_path / "f.md").write_text("### Block 1\nSource: a b\nCondition: x == 1\n### Block 2\nSource: c\nCondition:\n")
    assert {tuple(r) for r in documents.read_condition_form(spark, str(tmp_path / "f.md")).collect()} == {(1, "a b", "x == 1"), (2, "c", None)}
    assert documents.is_schema_version("1.2", "1.10") and not documents.is_schema_version("2.0", "1.9")


def test_rules_sink_keeps_what_people_wrote(spark, tmp_path):
    blocks = spark.createDataFrame([("a", "text"), ("l", "loop"), ("p", "presence")], "key string, kind string")
    old = spark.createDataFrame([("a", 1, "x == 1", "mine"), ("gone", 1, "", "old")], "key string, ord int, when string, text string")
    sinks.write_rules(old, blocks, str(tmp_path / "rules"))
    got = spark.read.option("header", True).csv(str(tmp_path / "rules"))
    assert {(r.key, r.text) for r in got.collect()} == {("a", "mine"), ("l", None)}
    assert json.loads(sinks.mapping_json(spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "doc_id int, pos int, name string")).first().json)["tokens"] == [{"pos": 0, "name": "a"}, {"pos": 1, "name": "b"}]
    assert documents.variant_texts(old).first().text == "mine\nold" and F is not None


def test_docx_rewriting(spark, tmp_path):
    run = lambda t, more="": f"<w:r>{more}<w:t xml:space=\"preserve\">{t}</w:t></w:r>"
    body = f"<w:p>{run('Dear {na')}{run('me', '<w:rPr><w:b/></w:rPr>')}{run('}, {$age} &amp; {other}')}</w:p><w:p >{run('{name}{name} {names}')}</w:p>"
    (tmp_path / "a.docx").write_bytes(docx(body))
    got = documents.rewritten_docx(spark, str(tmp_path), {"name": "account.name", "age": "a<b", "gone": "x"}).first()
    assert got.missed == ["gone"]
    assert [t for _, t in documents.docx_blocks(bytes(got.content))] == ["Dear {account.name}, {$a<b} & {other}", "{account.name}{account.name} {names}"]
    assert b"<w:b/>" in zipfile.ZipFile(io.BytesIO(bytes(got.content))).read("word/document.xml")


def test_older_forms_with_their_sheet(spark):
    form = spark.createDataFrame([(1, " $a ", "x == 1"), (2, "plain text", None), (3, "$b", None)], "id int, source string, condition string")
    sheet = spark.createDataFrame([("a", "x", "1"), ("a", "", "2"), ("c", "", "3")], "key string, when string, text string")
    assert {(r.source, r.key, r.n_rows, r.problem) for r in documents.with_sheet(form, sheet).collect()} == {(" $a ", "a", 2, None), ("$b", "b", 0, "no rows"), (None, "c", 1, "no block"), ("plain text", None, 0, None)}


FAKE_READER = '''
import json


class Page:
    def __init__(self, chars):
        self.chars = chars


class Document:
    def __init__(self, pages):
        self.pages = [Page(p) for p in pages]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def open(stream):
    return Document(json.loads(stream.read()))
'''


def test_files_as_a_data_source(spark, tmp_path):
    """A fake PDF reader, as none is installed: pages as JSON lists of characters."""
    import json

    from palimpsest.sources import documents, files

    (tmp_path / "fake").mkdir()
    (tmp_path / "fake" / "pdfplumber.py").write_text(FAKE_READER)
    spark.sparkContext.addPyFile(str(tmp_path / "fake" / "pdfplumber.py"))
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    chars = lambda top, x, text, size=10: [{"top": top, "x0": x + i * 5, "x1": x + i * 5 + 5, "size": size, "text": c} for i, c in enumerate(text)]
    page = chars(10, 10, "Head", 20) + [c for i in range(3) for c in chars(30 + 10 * i, 10, f"a{i}") + chars(30 + 10 * i, 100, f"b {i}")] + chars(90, 10, "the end")
    (folder / "one.pdf").write_text(json.dumps([page, chars(5, 5, "next")]))
    (folder / "bad.pdf").write_text("no pdf")
    (folder / "deep" / "page.html").write_text("<h1>T</h1><p>a &amp; b</p>")
    (folder / "broken.docx").write_text("no zip")
    (folder / "other.txt").write_text("not looked at")
    files.register(spark)
    df = spark.read.format(files.NAME).load(str(folder))
    assert df.rdd.getNumPartitions() == 4
    got = {}
    for r in df.collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.tag, r.text) if r.error is None else r.error.partition(":")[0])
    assert got == {"one.pdf": [("p", "Head"), ("p", "a0b 0"), ("p", "a1b 1"), ("p", "a2b 2"), ("p", "the end"), ("p", "next")], "bad.pdf": ["JSONDecodeError"], "page.html": [("h1", "T"), ("p", "a & b")], "broken.docx": ["BadZipFile"]}
    (tmp_path / "empty").mkdir()
    assert spark.read.format(files.NAME).load(str(tmp_path / "empty")).count() == 0
    html, errors = documents.read_pdf(spark, str(folder))
    table = "<table>\n" + "\n".join(f"  <tr><td>a{i}</td><td>b {i}</td></tr>" for i in range(3)) + "\n</table>"
    assert [r.html for r in html.collect()] == [f"{table}\n<h2>Head</h2>\n<p>the end</p>\n<!-- page break -->\n<p>next</p>"]
    assert [r.error.partition(":")[0] for r in errors.collect()] == ["JSONDecodeError"]


def test_tables_of_characters_by_brute_force(spark):
    """Random pages of lines of cells: what a plain loop over sorted lines finds."""
    import random

    from palimpsest.sources import documents

    rnd = random.Random(11)
    rows, want = [], []
    for doc in range(60):
        lines, columns = [], [40.0]
        for i in range(rnd.randint(1, 12)):
            if rnd.random() < 0.3 or i == 0:
                columns = [40.0 + 80 * k for k in range(rnd.randint(1, 3))]
            lines.append((10.0 + 11 * i, [(x + rnd.choice([0, 3, -4, 14]) if k else x, rnd.choice("abcd") * rnd.randint(1, 5)) for k, x in enumerate(columns)]))
        for top, cells in lines:
            rows += [(doc, 0, top, x + 5 * j, 10.0, c) for x, text in cells for j, c in enumerate(text)]
        runs = [[lines[0]]]
        for a, b in zip(lines, lines[1:]):
            same = len(a[1]) == len(b[1]) >= 2 and all(abs(p[0] - q[0]) <= 10 for p, q in zip(a[1], b[1]))
            runs[-1].append(b) if same else runs.append([b])
        found = [r for r in runs if len(r) > 1]
        want += [(doc, t, i, k, text) for t, r in enumerate(found) for i, (_, cells) in enumerate(r) for k, (_, text) in enumerate(cells)]
    chars = spark.createDataFrame(rows, "doc_id int, page int, top double, x double, size double, char string")
    got = sorted((r.doc_id, r.table, r.row, r.cell, r.text) for r in documents.pdf_tables(documents.pdf_cells(chars)).collect())
    assert got == sorted(want)


def test_fingerprints_by_section(spark, monkeypatch):
    import hashlib

    import pytest

    from palimpsest.functions import text as X

    files = {"a/x.json": "1", "a/y.json": "2", "b/z.json": "3", "top": ""}
    df = spark.createDataFrame(list(files.items()), "p string, t string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    section = {}
    for p, t in sorted(files.items()):
        section.setdefault(p.split("/")[0], []).append(f"{p} {sha(f'{p}\n{t}')}")
    want = {k: sha("\n".join(v)) for k, v in section.items()}
    sections, whole = X.tree_fingerprint(df, "p", "t")
    assert {r.section: r.digest for r in sections.collect()} == want
    assert whole.first().fingerprint == sha("\n".join(f"{k} {want[k]}" for k in sorted(want)))
    monkeypatch.setattr(X, "FLAT", 10)
    with pytest.raises(ValueError, match="too many"):
        X.fingerprint(df, "p", "t")
