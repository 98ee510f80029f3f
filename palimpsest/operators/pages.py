"""Pages as tables of nodes: an element holds the nodes from its own number to its last, so that headings, labels, column
headers and what lies within what are looked up by ranges and equal keys.

tree: page_id, node (from 0, in the order in which nodes begin), last, parent (-1: none), within (the parent's tag), depth,
tag (null: a text), text, line, begin and finish (of an element, in the page's source), child (number among the elements of
its parent), class, label (its text as a label, empty if it can't be one), words (all text, of headings and cells), up (the
elements around a text, a row, a cell or a list item, the outermost first).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..staging import cut

#: What optional values are guarded in, and what is fragile if it holds one variable alone (fixed).
BLOCKS = ("p", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "div", "section")
SINGLE = (*BLOCKS, "span", "strong", "em")
#: How many elements up a label is looked for, besides next to the node itself (fixed).
LEVELS = 5
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

#: Nodes that a task holds at once, besides those of one page.
HELD = 4096

_UP = pa.list_(pa.struct([("node", pa.int32()), ("tag", pa.string())]))
_TREE = {
    "node": pa.int32(), "last": pa.int32(), "parent": pa.int32(), "within": pa.string(), "depth": pa.int32(), "tag": pa.string(), "text": pa.string(), "line": pa.int32(), "begin": pa.int32(), "finish": pa.int32(),
    "child": pa.int32(), "class": pa.string(), "label": pa.string(), "words": pa.string(), "up": _UP,
}
_DDL = "node int, last int, parent int, within string, depth int, tag string, text string, line int, begin int, finish int, child int, class string, label string, words string, up array<struct<node:int,tag:string>>"


def _read(batches: Iterable[pa.RecordBatch], key: str, bare: tuple[str, ...] | None = None) -> Iterator[pa.RecordBatch]:
    """The nodes of batches of (key, html), page by page: a batch may hold thousands of pages, and their nodes as dicts are
    many times its bytes."""
    from .dom import tree as parsed

    def table(keys, rows):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array([r[c] for r in rows], kind) for c, kind in _TREE.items())], names=[key, *_TREE])

    keys, rows = [], []
    for batch in batches:
        for k, page in zip(batch.column(0), batch.column(1), strict=True):
            found = parsed(page.as_py() or "", bare)
            keys += [k.as_py()] * len(found)
            rows += found
            if len(rows) > HELD:
                yield table(keys, rows)
                keys, rows = [], []
    yield table(keys, rows)


def tree(pages: DataFrame, key: str = "page_id", html: str = "html", bare: tuple[str, ...] | None = None) -> DataFrame:
    """The nodes of each page of (key, html), read with a parser of the standard library. A null page has none. Elements
    that aren't closed end with what they are in, or where their kind does; comments and what scripts and styles hold are
    no text. Character references in texts are read by HTML's rule, by which old names need no semicolon (&quot, &copy); with
    bare, those of its names alone need none. Rows that repeat a key should be told apart by the caller."""

    return pages.select(F.col(key).cast("long").alias(key), html).mapInArrow(lambda batches: _read(batches, key, bare), f"{key} long, {_DDL}")


def _before(value: Column, *by: str) -> Column:
    """The last value that isn't null among the nodes before a node, of those with the same keys."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy("node").rowsBetween(Window.unboundedPreceding, -1))


def siblings(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """nodes with beside: the label of the nearest node before it, of the same parent, that can be one."""
    return nodes.withColumn("beside", _before(F.nullif("label", F.lit("")), key, "parent"))


def column_headers(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, node, header of cells (td): the text of the cell at the same place in the first row of their table, or of its
    thead, if it has one."""
    within = lambda tags: F.get(F.reverse(F.filter("up", lambda u: u["tag"].isin(*tags))), F.lit(0))["node"]
    rows = nodes.where("tag = 'tr'").select(key, "node", F.explode(F.filter(F.transform("up", lambda u, i: F.struct(u["node"].alias("table"), u["tag"].alias("tag"), i.alias("i"))), lambda u: u["tag"] == "table")).alias("t"), "up")
    headed = F.exists(F.slice("up", F.col("t.i") + 1, F.size("up")), lambda u: u["tag"] == "thead")
    first = rows.groupBy(key, F.col("t.table").alias("table")).agg(F.min_by("node", F.struct((~headed).alias("other"), "node")).alias("parent"))
    heads = nodes.where("tag in ('th', 'td') and within = 'tr'").select(key, "parent", "node", "words", "child")
    place = Window.partitionBy(key, "table", "parent").orderBy("node")
    heads = heads.join(first, [key, "parent"]).withColumn("place", F.row_number().over(place) - 1).select(key, "table", F.col("place").alias("child"), F.col("words").alias("header"))
    cells = nodes.where("tag = 'td' and within = 'tr'").select(key, "node", "child", within(("table",)).alias("table"))
    return cells.join(heads, [key, "table", "child"]).select(key, "node", "header")


def context(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Texts with what names them (nodes are read several times, so they should be a table): key, ord (among the page's texts), node, line, tag (of the element they are in), text,
    heading (the text of the last one that begins before), label (of the nearest node before it beside the text, or else
    beside one of the LEVELS elements around it, the innermost first), header (of the table column), parent (tag around tag)."""
    # dealt by page once: windows over siblings and over whole pages need no other order of pages
    marked = siblings(nodes.repartition(key), key).withColumn("heading", _before(F.when(F.col("tag").isin(*HEADINGS), F.col("words")), key))
    texts = marked.where("text is not null").withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("node")) - 1)
    around = F.reverse(F.slice("up", F.greatest(F.size("up") - LEVELS + 1, F.lit(1)), LEVELS))
    asked = texts.where("beside is null").select(key, "node", F.posexplode(F.transform(around, lambda u: u["node"])).alias("level", "at"))
    found = asked.join(marked.where("beside is not null and tag is not null").select(key, F.col("node").alias("at"), "beside"), [key, "at"])
    label = found.groupBy(key, "node").agg(F.min_by("beside", "level").alias("_label"))
    cell = F.get(F.reverse(F.filter("up", lambda u: u["tag"] == "td")), F.lit(0))["node"]
    headers = column_headers(nodes, key).select(key, F.col("node").alias("_cell"), "header")
    out = texts.withColumn("_cell", cell).join(label, [key, "node"], "left").join(headers, [key, "_cell"], "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return out.select(key, "ord", "node", "line", F.col("within").alias("tag"), "text", empty(F.col("heading")).alias("heading"), empty(F.coalesce("beside", "_label")).alias("label"), empty(F.col("header")).alias("header"), empty(F.get("up", F.size("up") - 2)["tag"]).alias("parent"))


def repeats(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Containers with children of one tag that repeat, which a loop may stand for: key, node, container, child, n."""
    from .dom import CONTAINERS

    own = nodes.where(F.col("tag").isNotNull() & F.col("within").isin(*CONTAINERS))
    out = own.groupBy(key, F.col("parent").alias("node"), F.col("within").alias("container"), F.col("tag").alias("child")).agg(F.count("*").cast("int").alias("n"))
    return out.where("n >= 2").select(key, "node", "container", "child", "n")


def findings(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """What in a page of {{variables}} needs a look: key, line, category, found.

    unlabeled variable: no words before it in its text, nor beside it; a page's line tells one name once. single variable:
    an element that holds a variable and nothing else, so that it is empty when the value is missing. loose list item: a
    list item that lies in no list.
    """
    beside = siblings(nodes, key)
    texts = beside.where(F.col("text").rlike(X.MUSTACHE))
    names = F.regexp_extract_all("text", F.lit(X.MUSTACHE), 1)
    # words before the n-th variable: some part of the text cut at its variables, up to there, isn't blank
    parts = F.split("text", X.MUSTACHE, -1)
    worded = lambda i: F.exists(F.slice(parts, F.lit(1), i + 1), lambda p: F.trim(p) != "")
    each = texts.where("beside is null").select(key, "line", F.explode(F.filter(F.transform(names, lambda n, i: F.struct(n.alias("name"), worded(i).alias("worded"))), lambda v: ~v["worded"])).alias("v"))
    unlabeled = each.select(key, "line", F.lit("unlabeled variable").alias("category"), F.col("v.name").alias("found")).distinct()
    # an element with one text has the same first and last text: counted over the texts within each of the elements around
    held = nodes.where("text is not null").select(key, F.explode("up").alias("u"), "text").where(F.col("u.tag").isin(*SINGLE))
    only = held.groupBy(key, F.col("u.node").alias("node")).agg(F.count("*").alias("n"), F.min(F.when(F.col("text").rlike(rf"^{X.MUSTACHE}$"), F.col("text"))).alias("text")).where("n = 1 and text is not null")
    single = only.join(nodes.select(key, "node", "line", "tag"), [key, "node"]).select(key, "line", F.lit("single variable").alias("category"), F.concat("tag", F.lit(" "), F.regexp_extract("text", X.MUSTACHE, 1)).alias("found"))
    loose = nodes.where("tag = 'li'").where(~F.exists("up", lambda u: u["tag"].isin("ul", "ol"))).select(key, "line", F.lit("loose list item").alias("category"), F.coalesce("label", F.lit("")).alias("found"))
    return unlabeled.unionByName(single).unionByName(loose)


def guards(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Elements that are to be wrapped because their values may be missing: key, node, begin, finish, names.

    A text with open references of the document ($TBD_x, none of an element of a loop) asks for the innermost block
    element around it. It guards all such references within it, each once, in their order; those that its texts also use
    of a loop's element don't count. Blocks within a loop (text #foreach before them, beside them or an element around
    them) are left, and so are texts in no block.
    """
    texts = nodes.where("text is not null")
    blocks = F.filter("up", lambda u: u["tag"].isin(*BLOCKS))
    own, of_element = r"(?<![\w.])\$TBD_([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*)", r"\$[a-zA-Z_]\w*\.TBD_"
    asks = texts.where(F.col("text").rlike(own) & ~F.col("text").rlike(of_element)).select(key, F.get(blocks, F.size(blocks) - 1)["node"].alias("node")).where("node is not null").distinct()
    # a loop's directive reaches over what follows it beside it: an element within is told by the elements around it
    opened = texts.where(F.col("text").contains("#foreach")).groupBy(key, "parent").agg(F.min("node").alias("opens"))
    chain = nodes.select(key, "node", "parent", "last", "begin", "finish").join(asks, [key, "node"])
    around = texts.select(key, F.explode(F.transform("up", lambda u, i: F.struct(u["node"].alias("node"), F.transform(F.slice("up", F.lit(1), i + 1), lambda v, j: F.struct(v["node"].alias("at"), F.when(j > 0, F.get("up", j - 1)["node"]).otherwise(F.lit(-1)).alias("parent"))).alias("chain")))).alias("x")).select(key, "x.node", "x.chain").join(asks, [key, "node"]).dropDuplicates([key, "node"])
    looped = around.select(key, "node", F.explode("chain").alias("c")).select(key, "node", F.col("c.at").alias("at"), F.col("c.parent").alias("parent")).join(opened, [key, "parent"]).where("opens < at").select(key, "node").distinct()
    held = texts.where(F.col("text").contains("TBD_")).select(key, F.col("node").alias("at"), "text", F.explode(F.transform("up", lambda u: u["node"])).alias("node")).join(asks.join(looped, [key, "node"], "left_anti"), [key, "node"])
    whole = held.groupBy(key, "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda t: t["text"]), "\n").alias("text"))
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(own), 1))
    elements = F.regexp_extract_all("text", F.lit(r"\$[a-zA-Z_]\w*\.TBD_([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*)"), 1)
    found = whole.select(key, "node", F.array_except(names, elements).alias("names")).where(F.size("names") > 0)
    return chain.join(found, [key, "node"]).select(key, "node", "begin", "finish", "names")


def guarded(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, html, n_guards: pages with #if($TBD_x and ..) and #end put around the elements that guards names."""
    found = guards(cut(tree(pages, key, html)), key)
    test = F.array_join(F.transform("names", lambda n: F.concat(F.lit("$TBD_"), n)), " and ")
    # at one place an element that ends is closed before another begins, the inner before the outer, and opened the other way round
    edits = found.select(key, F.explode(F.array(
        F.struct(F.col("begin").alias("at"), F.lit(1).alias("kind"), F.col("node").alias("ord"), F.concat(F.lit("\n#if("), test, F.lit(")\n")).alias("new")),
        F.struct(F.col("finish").alias("at"), F.lit(0).alias("kind"), (-F.col("node")).alias("ord"), F.lit("\n#end\n").alias("new")),
    )).alias("e"))
    per = edits.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("_e"))
    page = F.col(html)
    ends = F.concat(F.transform("_e", lambda e: e["at"]), F.array(F.length(page)))
    pieces = F.transform("_e", lambda e, i: F.concat(e["new"], F.substring(page, e["at"] + 1, F.get(ends, i + 1) - e["at"])))
    new = F.concat(F.left(page, F.get(ends, F.lit(0))), F.array_join(pieces, ""))
    out = pages.select(key, html).join(per, key, "left")
    return out.select(key, F.when(F.col("_e").isNull(), page).otherwise(new).alias(html), F.coalesce((F.size("_e") / 2).cast("int"), F.lit(0)).alias("n_guards"))
