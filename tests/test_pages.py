"""Page trees, what names a text in them, and wrapping, against brute force over random pages."""

import random
import re

import pytest

from palimpsest.operators import dom, pages

TAGS = ["div", "p", "ul", "li", "b", "h2", "table", "thead", "tr", "td", "th", "section", "span", "br"]


class Node:
    """A page as objects, for the brute force: children in order, elements or texts."""

    def __init__(self, tag, parent):
        self.tag, self.parent, self.children = tag, parent, []


def random_page(rnd, words):
    out = []

    def put(depth):
        for _ in range(rnd.randint(0, 4)):
            if rnd.random() < 0.5 or depth > 5:
                out.append(rnd.choice(words))
            else:
                tag = rnd.choice(TAGS)
                out.append(f"<{tag}>")
                if tag != "br":
                    put(depth + 1)
                    out.append(f"</{tag}>" if rnd.random() < 0.9 else "")

    put(0)
    return "".join(out) + "".join(f"<table><tr><th>A{i}</th><th>B</th></tr><tr><td>x</td><td><b>y</b></td><td>z</td></tr></table>" for i in range(rnd.randint(0, 2)))


def built(rows):
    """Nodes by number, out of the table's parents alone."""
    nodes = {-1: Node("", None)}
    for r in sorted(rows, key=lambda r: r["node"]):
        n = nodes[r["node"]] = Node(r["tag"], nodes[r["parent"]])
        n.text, n.line = r["text"], r["line"]
        n.parent.children.append(n)
    return nodes


def walk(n):
    for c in n.children:
        yield c
        yield from walk(c)


def words(n):
    return n.text if n.tag is None else " ".join(c.text for c in walk(n) if c.tag is None)


def label(n):
    text = words(n)
    return "" if re.search(r"TBD_|\$|\{\{", text) else text.rstrip(":").strip()[:80]


def brute_context(nodes):
    order = list(walk(nodes[-1]))
    for n in order:
        if n.tag is not None:
            continue
        heads = [h for h in order[: order.index(n)] if h.tag in pages.HEADINGS]
        named, at = "", n
        for _ in range(6):
            if at is None or at.parent is None:
                break
            before = [label(s) for s in at.parent.children[: at.parent.children.index(at)]]
            named = next((x for x in reversed(before) if x), "")
            if named:
                break
            at = at.parent
        up, at = [], n.parent
        while at is not None and at.parent is not None:
            up.append(at)
            at = at.parent
        header, cell = "", next((u for u in up if u.tag == "td"), None)
        if cell is not None and cell.parent.tag == "tr":
            table, at = None, cell
            while at is not None and table is None:
                table = at if at.tag == "table" else None
                at = at.parent
            rows = [r for r in walk(table) if r.tag == "tr"] if table else []

            def in_head(r, table=table):
                at = r.parent
                while at is not table:
                    if at.tag == "thead":
                        return True
                    at = at.parent
                return False

            rows = [r for r in rows if in_head(r)] or rows
            i = [c for c in cell.parent.children if c.tag].index(cell)
            heads_row = [c for c in rows[0].children if c.tag in ("th", "td")] if rows else []
            header = words(heads_row[i]) if i < len(heads_row) else ""
        yield n.text, words(heads[-1]) if heads else "", named, header, (up[0].tag if up else None), (up[1].tag if len(up) > 1 else "")


@pytest.fixture(scope="module")
def made():
    rnd = random.Random(4)
    vocabulary = ["Name:", "{{a}}", " {{ b.c }} {{d}}", "x {{e}}", "$5", "text ", "&amp; more", "TBD_q", "<!-- no -->", "long " * 30 + ": :", "\n"]
    return {i: random_page(rnd, vocabulary) for i in range(150)} | {900: None, 901: "", 902: "<div>" * 1500 + "deep" + "</div>" * 1500}


def test_tree_and_context(spark, made):
    df = spark.createDataFrame(list(made.items()), "page_id long, html string")
    tree = pages.tree(df).cache()
    rows = {}
    for r in tree.collect():
        rows.setdefault(r.page_id, []).append(r.asDict())
    got = {}
    for r in pages.context(tree).collect():
        got.setdefault(r.page_id, []).append(r)
    assert 900 not in rows and 901 not in rows and len(rows[902]) == 1501
    for i, own in rows.items():
        if i == 902:
            assert sorted(r["last"] for r in own) == [1500] * 1501
            continue
        nodes = built(own)
        for r in own:  # an element holds the nodes from its number to its last
            assert r["last"] - r["node"] == len(list(walk(nodes[r["node"]])))
            if r["tag"]:
                assert made[i][r["begin"]] == "<" and r["finish"] >= r["begin"]
        found = [(r.text, r.heading, r.label, r.header, r.tag, r.parent) for r in sorted(got.get(i, []), key=lambda r: r.ord)]
        assert [(t, h, x, c, g or None, p) for t, h, x, c, g, p in found] == [(t, h, x, c, g, p) for t, h, x, c, g, p in brute_context(nodes)], made[i]
    assert [(r.tag, r.parent) for r in got[902]] == [("div", "div")]


def test_repeats_and_findings(spark, made):
    tree = pages.tree(spark.createDataFrame(list(made.items()), "page_id long, html string")).cache()
    rows = {}
    for r in tree.collect():
        rows.setdefault(r.page_id, []).append(r.asDict())
    repeats, findings = {}, {}
    for r in pages.repeats(tree).collect():
        repeats.setdefault(r.page_id, []).append((r.node, r.child, r.n))
    for r in pages.findings(tree).collect():
        findings.setdefault(r.page_id, []).append((r.line, r.category, r.found))
    variable = re.compile(r"\{\{\s*([a-zA-Z_][\w.]*)\s*\}\}")
    for i, own in rows.items():
        if i == 902:
            continue
        nodes = built(own)
        number = {id(n): k for k, n in nodes.items()}
        want, flaws = [], []
        for n in walk(nodes[-1]):
            tags = [c.tag for c in n.children if c.tag]
            if n.tag in dom.CONTAINERS:
                want += [(number[id(n)], t, tags.count(t)) for t in set(tags) if tags.count(t) > 1]
            up, at = [], n.parent
            while at is not None:
                up.append(at.tag)
                at = at.parent
            if n.tag is None:
                before = any(label(s) for s in n.parent.children[: n.parent.children.index(n)])
                for m in variable.finditer(n.text):
                    if not before and not variable.sub("", n.text[: m.start()]).strip() and (n.line, "unlabeled variable", m[1]) not in flaws:
                        flaws.append((n.line, "unlabeled variable", m[1]))
            else:
                texts = [c.text for c in walk(n) if c.tag is None]
                if n.tag in pages.SINGLE and len(texts) == 1 and variable.fullmatch(texts[0]):
                    flaws.append((n.line, "single variable", f"{n.tag} {variable.fullmatch(texts[0])[1]}"))
                if n.tag == "li" and "ul" not in up and "ol" not in up:
                    flaws.append((n.line, "loose list item", label(n)))
        assert sorted(repeats.get(i, [])) == sorted(want)
        assert sorted(findings.get(i, [])) == sorted(flaws)


def test_wrapping(spark):
    rnd = random.Random(8)
    vocabulary = ["$TBD_a ", "$TBD_b.c, ", "$i.TBD_a ", "$TBD_d", "plain ", "#foreach ($i in $TBD_l) ", "é "]
    made = {i: random_page(rnd, vocabulary) for i in range(120)} | {500: None}
    df = spark.createDataFrame(list(made.items()), "page_id long, html string")
    rows = {}
    for r in pages.tree(df).collect():
        rows.setdefault(r.page_id, []).append(r.asDict())
    own = re.compile(r"(?<![\w.])\$TBD_([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*)", re.ASCII)
    for r in pages.guarded(df).collect():
        html = made[r.page_id]
        if html is None:
            assert r.html is None and r.n_guards == 0
            continue
        nodes = built(rows.get(r.page_id, []))
        number = {id(n): k for k, n in nodes.items()}
        place = {x["node"]: (x["begin"], x["finish"]) for x in rows.get(r.page_id, [])}
        wrap = {}
        for n in walk(nodes[-1]):
            if n.tag is not None or not own.search(n.text) or re.search(r"\$\w+\.TBD_", n.text):
                continue
            at = n.parent
            while at is not None and at.tag not in pages.BLOCKS:
                at = at.parent
            block, looped = at, False
            while at is not None and at.parent is not None:
                looped |= any(s.tag is None and "#foreach" in s.text for s in at.parent.children[: at.parent.children.index(at)])
                at = at.parent
            if block is None or looped:
                continue
            text = "\n".join(c.text for c in walk(block) if c.tag is None)
            names = [x for x in dict.fromkeys(own.findall(text)) if not re.search(rf"\$\w+\.TBD_{re.escape(x)}(?![\w.])", text, re.ASCII)]
            if names:
                wrap[number[id(block)]] = names
        inserts = {}
        for k, names in wrap.items():
            inserts.setdefault(place[k][0], [[], []])[1].append((k, "\n#if(" + " and ".join(f"$TBD_{x}" for x in names) + ")\n"))
            inserts.setdefault(place[k][1], [[], []])[0].append((-k, "\n#end\n"))
        want = "".join("".join(x for part in inserts.get(i, [[], []]) for _, x in sorted(part)) + html[i : i + 1] for i in range(len(html) + 1))
        assert (r.html, r.n_guards) == (want, len(wrap))


def test_references_with_and_without_semicolons():
    text = "a &quot; &quot &amp &am &ampx; &amp;quot &copy &notit; &lt; &#39; &#39 &#x27; &"
    own = lambda html, *bare: [n["text"] for n in dom.tree(html, *bare) if n["text"]]
    for page in (text, f"<p>{text}</p>"):
        assert own(page) == ["a \" \" & &am &x; &quot © ¬it; < ' ' ' &"]
        assert own(page, ("amp",)) == ["a \" &quot & &am &x; &quot &copy &notit; < ' &#39 ' &"]
        assert own(page, ()) == ["a \" &quot &amp &am &ampx; &quot &copy &notit; < ' &#39 ' &"]
    assert own("<a&quot>&quot</a>x &quot<b &quot", ("amp",))[:2] == ["&quot", "x &quot"]
