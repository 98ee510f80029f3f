"""The way from a document to its final text, and the files between its steps, on small examples by hand."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import assembly, dom, tokens
from palimpsest.sources import config_tree, contracts


def made(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_blocks_that_are_not_closed(spark):
    texts = ["[[a [[b]] c", "x ]] [[y]]", "[[a [[b]] c]] [[d]]", "[[", "", None, "[[a]][[b]]", "[[o [[p [[q]]"]
    got = {r.doc_id: [b.text for b in r.b] for r in tokens.bracket_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("b")).collect()}
    assert got == {0: ["b"], 1: ["y"], 2: ["a [[b]] c", "d"], 6: ["a", "b"], 7: ["q"]}


def test_markers_by_place(spark):
    docs = spark.createDataFrame([(1, "[/A] x [A/]"), (2, "[A/] [A/] [/A]"), (3, "[A] [/A] [/A]"), (4, "[/C?] [C/] [[b]] [/C]"), (5, "[A] [A/]x[/A] [/A]")], "doc_id int, text string")
    got = sorted((r.doc_id, r.warning, r.at) for r in tokens.marker_warnings(docs).collect())
    assert got == [(1, "closes nothing", 0), (1, "not closed", 7), (2, "reopened", 0), (3, "closes nothing", 9), (3, "old style", 4), (4, "block in a loop", 10), (4, "malformed", 0), (5, "old style", 14)]


def test_guards():
    from palimpsest.operators import marks

    put = lambda text, values=(), keys=(), loops=(): marks.assembled(text, dict(values), set(keys), dict(loops))
    text = "a\n#if($TBD_x)\nb\n#if($y)\nc\n#end\nd\n#end\n#foreach ($i in $TBD_L)\n$TBD_x\n#end"
    assert put(text) == "a\nb\n#if($y)\nc\n#end\nd\n#foreach ($i in $TBD_L)\n$TBD_x\n#end"
    text = "<p>#if($doc.k)</p>\n#if($doc.gone)\n[[a [[$in]]$doc.in b]]$doc.k\n<b>#end</b>\n#end\n$doc.k [[free]]"
    assert put(text, keys=["k", "in"]) == "<p>#if($data.k)</p>\n\n${data.k}\n<b></b>\n#end\n${data.k} [[free]]"
    # a guard in a guard stays, with its own end; one that stands in a line ends where it ends
    assert put("#if($TBD_a)\n#if($TBD_b)\nx\n#end\n#if($z) y #end\n#end\nt", {"$TBD_b": "$b"}) == "#if($b)\nx\n#end\n#if($z) y #end\nt"
    # keys are whole words
    assert put("$doc.kk $doc.k. ]]$doc.k [[ $k ]] [[$k]]$doc.other", keys=["k"]) == "$doc.kk ${data.k}. ]]${data.k} ${data.k} ${data.other}"
    assert put("  #foreach ($l in $TBD_L)\n{car.x} $TBD_L\n#end #foreach ($m in $TBD_M.a)", {"$TBD_M.a": "$m"}, loops={"$TBD_L": "#foreach ($car in $data.cars)"}) == "#foreach ($car in $data.cars)\n$TBD_car.x $TBD_L\n#end #foreach ($m in $m)"
    deep = "".join(f"[[{i} " for i in range(3000)) + "x" + "".join(f"]]$doc.k{i}" for i in range(3000))
    assert put(deep) == "${data.k2999}"
    assert put("#end [[ #if($doc.z) ]]$doc.k #end", keys=["k"]) == "#end ${data.k} #end" and put("") == ""


def test_references_are_cut_once(spark):
    from palimpsest.operators import marks

    docs = spark.createDataFrame([(1, "$TBD_a.b. $TBD_a $TBD_c$TBD_d"), (1, "{a}"), (2, None), (3, "plain")], "doc_id int, text string")
    values = spark.createDataFrame([(1, "$TBD_a", "$TBD_c"), (1, "$TBD_a.b", "x"), (1, "$TBD_d", "")], "doc_id int, token string, value string")
    assert sorted(((r.doc_id, r.text) for r in marks.final_texts(docs, values, []).collect()), key=str) == [(1, "$TBD_c"), (1, "x. $TBD_c $TBD_c$TBD_d"), (2, None), (3, "plain")]


def test_innermost_blocks(spark):
    from palimpsest.operators import marks

    docs = spark.createDataFrame([(1, "[[a $TBD_x [[b $TBD_y]]$doc.in $TBD_x]]$doc.out $TBD_z [[ $TBD_x"), (2, "[[open [[$TBD_x]] $TBD_y ]] $TBD_w ]]"), (3, None), (4, "[[$TBD_p.q.]]$doc.k [[$TBD_p]]$doc.l")], "doc_id int, text string")
    got = {(r.doc_id, r.token): (r.delegated, r.blocks) for r in marks.delegated(docs).collect()}
    assert got == {(1, "$TBD_x"): (False, []), (1, "$TBD_y"): (True, ["in"]), (1, "$TBD_z"): (False, []), (2, "$TBD_x"): (True, []), (2, "$TBD_y"): (True, []), (2, "$TBD_w"): (False, []), (4, "$TBD_p.q"): (True, ["k"]), (4, "$TBD_p"): (True, ["l"])}


def test_rows_that_repeat_an_id(spark):
    docs = spark.createDataFrame([(1, "abc [A/]{x}[/A]"), (1, "{x} [A/] {x}[/A]")], "doc_id int, text string")
    assert sorted((r.at, r.name) for r in tokens.loop_marks(docs).collect()) == [(4, "A"), (4, "A"), (11, "A"), (12, "A")]


def test_mustache_loops(spark):
    page = "<ul>[drivers]<li>{{name}} {{age}} {{name}}</li>[/drivers]</ul><p>{{due.date}}</p>"
    html, found, wrong = dom.loops(page)
    assert html == "<ul>\n#foreach ($driver in $TBD_drivers)\n<li>$driver.TBD_name $driver.TBD_age $driver.TBD_name</li>\n#end\n</ul><p>$TBD_due.date</p>"
    assert found == [{"name": "drivers", "iterator": "driver", "fields": ["name", "age"]}] and wrong == []
    html, found, wrong = dom.loops("<p>[a]{{x}}</p><p>[/a]</p> [boxes]{{y}}[cars]{{z}}[/cars][/boxes] [never] [/stray]")
    assert wrong == ["loop a: its ends lie in different elements"] and "[a]$TBD_x</p><p>[/a]" in html and html.endswith("[never] [/stray]")
    assert [(x["name"], x["iterator"], x["fields"]) for x in found] == [("cars", "car", ["z"]), ("boxes", "box", ["y"])]
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert {r.page_id: (len(r.loops), r.html) for r in tokens.mustache_loops(pages).collect()}[2] == (0, "")


def test_prose(spark):
    docs = spark.createDataFrame([(1, "[a long [inner [deep one]] text] [abc] [x] $ [Name] [/Name] [four]"), (2, None), (3, "")], "doc_id int, text string")
    out = {r.doc_id: r for r in tokens.prose_blocks(docs).collect()}
    assert out[1].template == "$doc.cond3 [abc] [x] $ [Name] [/Name] [four]" and [(b.id, b.text, b.parent, b.depth) for b in out[1].blocks] == [(1, "deep one", 2, 2), (2, "inner $doc.cond1", 3, 1), (3, "a long $doc.cond2 text", None, 0)]
    assert not out[3].blocks
    stubs = contracts.stub_blocks(tokens.prose_blocks(docs).select("doc_id", F.inline("blocks")))
    assert sorted((r.key, r.parent_id) for r in stubs.collect()) == [("cond1", 2), ("cond2", 3), ("cond3", None)]
    assert made(spark, contracts.shown_blocks(F.col("t")), t="a $doc.cond12 b") == "a [12] b"


def test_files_between_steps(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    config = [("products/P/config.json", '{"displayName":"P","data":{"n":{"type":"int?"}}}')]
    paths = config_tree.paths(config_tree.configs(spark.createDataFrame(config, "rel string, text string")))
    contracts.write_catalogue(paths, at("catalogue"))
    back = contracts.read_catalogue(spark, at("catalogue"))
    assert sorted(map(str, back.select(*paths.columns).collect())) == sorted(map(str, paths.collect())) and back.schema.simpleString() == paths.schema.simpleString()
    assert {r.section: r.n for r in contracts.section_counts(paths).collect()} == {"system_paths": 8, "account_paths": 9, "policy_data": 1, "total": 18}
    blocks = contracts.block_rows(spark.createDataFrame([('{"id": 2, "source_text": "t", "operator": " or ", "conditions": [" a ", ""]}',)], "json string")).drop("json", "error")
    contracts.write_blocks(blocks, at("blocks"))
    assert [(r.key, r.operator, r.conditions) for r in contracts.read_blocks(spark, at("blocks")).collect()] == [("cond2", "OR", ["a"])]
    assert contracts.read_blocks(spark, at("none"), required=False).count() == 0
    for missing in (lambda: contracts.read_blocks(spark, at("none")), lambda: contracts.read_catalogue(spark, at("none"))):
        with pytest.raises(contracts.ContractError):
            missing()
    spark.createDataFrame([('{"schema_version": "2.0", "blocks": 3}',)], "value string").coalesce(1).write.text(at("wrong"))
    with pytest.raises(contracts.ContractError, match=r"(?s)can't be read as 1.0.*blocks: not a list"):
        contracts.read_blocks(spark, at("wrong"))
    with pytest.raises(contracts.ContractError, match="and 4 more"):
        contracts.checked({}, {f"k{i}": str for i in range(12)}, "it")
    spark.createDataFrame([("# words",), ('{"synonyms": {"fields": {"state": ["region", "land"]}}}',)], "value string").coalesce(1).write.text(at("words"))
    assert sorted(tuple(r) for r in contracts.read_terminology(spark, at("none"), at("words")).collect()) == [("state", "land"), ("state", "region")]
    assert contracts.read_terminology(spark, at("none")) is None


def test_contexts_of_text_nodes(spark):
    from palimpsest.operators import pages

    page = "<html><body><h2>Head</h2><p><b>Name:</b> {{x}}</p><table><tr><th>A</th><th>B:</th></tr><tr><td>1</td><td>2</td></tr></table><script>no</script></body></html>"
    found = pages.context(pages.tree(spark.createDataFrame([(1, page)], "page_id long, html string"))).orderBy("ord").collect()
    got = [(n.tag, n.text, n.heading, n.label, n.header) for n in found]
    assert got == [("h2", "Head", "Head", "", ""), ("b", "Name:", "Head", "Head", ""), ("p", "{{x}}", "Head", "Name", ""), ("th", "A", "Head", "Head", ""), ("th", "B:", "Head", "A", ""), ("td", "1", "Head", "A B", "A"), ("td", "2", "Head", "1", "B:")]


def test_collisions_and_order_of_columns(spark):
    parts = spark.createDataFrame([(1, "block", "a"), (1, "loop", "a"), (1, "field", "b"), (1, "loop", "b"), (2, "block", "a")], "doc_id int, kind string, name string")
    assert [tuple(r) for r in assembly.key_collisions(parts).collect()] == [(1, "a", 2)]
    assert assembly.reordered(spark.range(1).selectExpr("1 z", "2 name", "3 y", "4 doc_id")).columns == ["doc_id", "name", "z", "y"]
    counts = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "doc_id int, section string, n int")
    assert assembly.report_text(counts, "doc_id", "Form").first().text == "# Form 1\n- a: 1\n- b: 2\ntotal: 3"


def test_items_outside_lists_and_roots(spark, tmp_path):
    from palimpsest.operators import types
    from palimpsest.sources import documents

    (tmp_path / "a.html").write_text("<ul><li>in</ul><div><li>out</div>")
    pages = documents.read_html(spark, str(tmp_path)).select(F.lit(1).cast("long").alias("page_id"), "html")
    from palimpsest.operators import pages as P

    assert [(r.category, r.found) for r in P.findings(P.tree(pages)).collect()] == [("loose list item", "out")]
    assert {tuple(r) for r in types.root_descriptors(spark, "P", "own").collect()} == {("quote", "own.PQuote", "PQuoteRequest"), ("segment", "own.PSegment", "PRequest"), ("invoice", None, "InvoiceRequest")}


def test_graphs_against_all_ways():
    import itertools
    import random

    from palimpsest.operators import graph

    rnd = random.Random(3)
    for _ in range(200):
        keys = "abcdef"[: rnd.randint(1, 6)]
        refs = {k: sorted({rnd.choice("abcdefz") for _ in range(rnd.randint(0, 2))}) for k in keys}
        closed = {(a, b) for a in keys for b in refs[a] if b in refs}
        for _ in keys:
            closed |= {(a, d) for (a, b), (c, d) in itertools.product(closed, closed) if b == c}
        assert graph.on_cycles(refs) == {a for a in keys if (a, a) in closed}
        assert (graph.find_cycle(refs) is not None) == bool(graph.on_cycles(refs))
        if not graph.on_cycles(refs):
            at = {k: i for i, k in enumerate(graph.ordered(refs))}
            assert all(at[b] < at[a] for a, b in closed)


def test_loops_of_repeated_elements(spark):
    page = "<h2>My Pets</h2><ul><li>{{name}}</li><li>b</li><li>c</li></ul><p>{{x}}</p><table><tr><td>1</td></tr></table>"
    html, found = dom.auto_loops(page)
    assert html == "<h2>My Pets</h2><ul>\n#foreach ($my_pet in $TBD_my_pets)\n<li>$my_pet.TBD_name</li>\n#end\n</ul><p>$TBD_x</p><table><tr><td>1</td></tr></table>"
    assert found == [{"name": "my_pets", "iterator": "my_pet", "fields": ["name"]}]
    html, found = dom.auto_loops('<div class="card row"><p>a<p>b</div><ul><li>x</li></ul><table><thead></thead><tbody></tbody></table><table><tbody><tr><td>{{a}}</td></tr><tr><td>2</td></tr></tbody></table>')
    assert [x["name"] for x in found] == ["card_row", "items"] and found[1]["fields"] == ["a"] and html.count("#foreach") == 2 and "<p>b" not in html and "<tr><td>2" not in html
    assert tokens.auto_loops(spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")).count() == 2 and dom.auto_loops("<div><b>open") == ("<div><b>open", [])


def test_pages_of_pdf_lines(spark):
    from palimpsest.sources import documents

    lines = spark.createDataFrame([(1, 1, 5.0, "b & c", "p"), (1, 0, 9.0, "two", "p"), (1, 0, 2.0, " One ", "h2")], "doc_id int, page int, line double, text string, tag string")
    assert documents.pdf_html(lines).first().html == "<h2>One</h2>\n<p>two</p>\n<!-- page break -->\n<p>b &amp; c</p>"


def test_long_chains_and_large_graphs(spark, monkeypatch):
    import random

    from palimpsest.operators import graph

    n = 100_000
    chain = {f"{i:06}": [f"{i + 1:06}"] for i in range(n)}
    assert graph.find_cycle(chain) is None and not graph.on_cycles(chain) and graph.ordered(chain)[0] == f"{n - 1:06}"
    assert graph.parents(chain)[f"{n - 1:06}"] == (f"{n - 2:06}", n - 1)
    ring = chain | {f"{n:06}": ["000000"]}
    assert len(graph.on_cycles(ring)) == n + 1 and len(graph.shortest_cycle(ring)) == n + 2
    rnd = random.Random(2)
    edges = [(1, f"{rnd.randrange(200_000):06}", f"{rnd.randrange(200_000):06}") for _ in range(1_000_000)]
    refs = {k: [] for _, k, _ in edges}
    for _, a, b in edges:
        refs[a].append(b)
    assert len(graph.on_cycles(refs)) > 150_000
    # joins alone give the same
    small = [(g, rnd.choice("abcdefghij"), rnd.choice("abcdefghijz")) for g in range(12) for _ in range(rnd.randint(1, 16))]
    df = spark.createDataFrame(small, "g long, a string, b string")
    want = {r.g: (r.cyclic, r.n_in_cycles) for r in graph.cycles(df).collect()}
    for r in graph.cycles(df).collect():
        if r.cyclic:
            own = {(a, b) for g, a, b in small if g == r.g}
            assert r.cycle[0] == r.cycle[-1] and all(e in own for e in zip(r.cycle, r.cycle[1:]))
    monkeypatch.setattr(graph, "EDGES", 3)
    assert {r.g: (r.cyclic, r.n_in_cycles) for r in graph.cycles(df).collect()} == want


def test_walks_of_any_length(spark):
    from palimpsest.operators import types

    known = spark.createDataFrame([("x.A", "a", "x.A"), ("x.A", "b", "List<x.B>"), ("x.B", "a", "x.A"), ("x.B", "n", "int"), ("x.C", "d", "x.D")], "type string, field string, declared string")
    paths = {1: "a." * 11 + "b", 2: "a." * 7 + "zzz", 3: "b.a." * 6 + "b.n", 4: "b.n.x", 5: "b.a." * 9 + "q.b"}
    got = {r.id: (r.verdict, r.hop) for r in types.walked(spark.createDataFrame([(i, "x.A", p) for i, p in paths.items()], "id int, type string, path string"), known).collect()}
    assert got == {1: ("verified", 12), 2: ("not_found", 8), 3: ("verified", 14), 4: ("not_navigable", 3), 5: ("not_found", 19)}
    assert types.walked(spark.createDataFrame([], "id int, type string, path string"), known).count() == 0
    roots = spark.createDataFrame([("x.A",)], "type string")
    long = known.union(spark.createDataFrame([(f"x.T{i}", "f", f"x.T{i + 1}") for i in range(9)] + [("x.B", "t", "x.T0"), ("x.T9", "end", "int")], known.schema))
    assert {r.type: r.depth for r in types.index(long, roots, None).collect()} == {"x.A": 0, "x.B": 1} | {f"x.T{i}": i + 2 for i in range(10)}
    assert {r.type for r in types.index(long, roots).collect()} == {"x.A", "x.B", "x.T0", "x.T1"}
