"""Tokenisers: fields, conditional blocks, loop markers and open references out of text columns.

A document is a row of (doc_id, text). Positions are those of occurrences in the text's order, from 0; spans are in
characters.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FIELD, MARKER, MUSTACHE, OCCURRENCES, OPEN_TOKEN, VARIANT, lookup
from . import marks


def plain_text(html: Column) -> Column:
    """Text of HTML without its tags."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]+>", " "))


def headings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, heading: the text of every heading (h1 to h6, with attributes or not) that holds text alone, in order."""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r"(?i)<h[1-6](?:\s[^>]*)?>([^<]*)</h[1-6]>"), 1)).alias("heading"))


def tag_count(html: Column, tag: str) -> Column:
    """How many elements of a tag HTML opens."""
    return F.regexp_count(html, F.lit(rf"<{tag}[ >]"))


def field_occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, symbol, name of every {field}, in order."""
    found = docs.select("doc_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(FIELD), 1).alias("symbol"), F.regexp_extract_all("text", F.lit(FIELD), 2).alias("name"))).alias("pos", "x"))
    return found.select("doc_id", "pos", "x.symbol", "x.name")


def fields(docs: DataFrame) -> DataFrame:
    """Distinct fields by first occurrence: doc_id, name, pos, occurrence, n, conflict (whether symbols differ)."""
    out = field_occurrences(docs).groupBy("doc_id", "name").agg(
        F.min("pos").alias("pos"), F.min_by("symbol", "pos").alias("symbol"), F.count("*").alias("n"), (F.count_distinct("symbol") > 1).alias("conflict")
    )
    return out.select("doc_id", "name", "pos", lookup(OCCURRENCES, F.col("symbol")).alias("occurrence"), "n", "conflict")


def conditional_tokens(docs: DataFrame) -> DataFrame:
    """Outermost [[...]] blocks: doc_id, id (counting all blocks from 1), name (null if it isn't one bare $name), text, n.

    Repeats are one block, with the id of the first, so ids may skip. A block without a name is one to be rejected.
    """
    found = bracket_blocks(docs)
    name = F.nullif(F.regexp_extract(F.trim("text"), r"^\$([A-Za-z_]\w*)$", 1), F.lit(""))
    found = found.select("doc_id", (F.col("ord") + 1).alias("id"), name.alias("name"), F.trim("text").alias("text"))
    return found.groupBy("doc_id", "name", F.when(F.col("name").isNull(), F.col("text")).alias("text")).agg(F.min("id").alias("id"), F.count("*").alias("n")).select("doc_id", "id", "name", "text", "n")


def block_spans(text: Column) -> Column:
    """Where the outermost [[...]] blocks of a text begin and end, without their brackets: an array of (start, end), from 0.

    An opener that is not closed is skipped, and what follows it counts; so does a closer without an opener. Open ones wait
    on a stack while the marks are gone through, and a block that closes takes the place of those within it.
    """
    pattern = F.lit(r"(?s)(.*?)(\[\[|\]\]|$)")
    parts = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("text"), F.regexp_extract_all(text, pattern, 2).alias("mark")), lambda p: F.struct(F.length(p["text"]).alias("n"), p["mark"].alias("mark"))
    )
    span = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("open"), F.array().cast(span).alias("done"))

    def step(s: Column, p: Column) -> Column:
        begins = s["at"] + p["n"]
        after = (begins + F.length(p["mark"])).alias("at")
        last = F.element_at(s["open"], -1)
        closed = F.concat(F.filter(s["done"], lambda d: d["start"] < last), F.array(F.struct(last.alias("start"), begins.alias("end"))))
        return (
            F.when(p["mark"] == "[[", F.struct(after, F.concat(s["open"], F.array(begins + 2)).alias("open"), s["done"].alias("done")))
            .when((p["mark"] == "]]") & (F.size(s["open"]) > 0), F.struct(after, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1).alias("open"), closed.alias("done")))
            .otherwise(F.struct(after, s["open"].alias("open"), s["done"].alias("done")))
        )

    return F.aggregate(parts, start, step)["done"]


def bracket_blocks(docs: DataFrame) -> DataFrame:
    """Outermost [[...]] blocks, which may hold others: doc_id, ord, text, start and end (see block_spans)."""
    out = docs.select("doc_id", "text", F.posexplode(block_spans(F.col("text"))).alias("ord", "s"))
    return out.select("doc_id", "ord", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"), "s.start", "s.end")


def placed(text: Column, pattern: str) -> Column:
    """An array of (at, token): every match of a pattern without groups of its own, with the character at which it begins.
    A match begins where the text before it ends, so places are sums over the parts of a split at the matches."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, t: F.struct(F.length(p).alias("gap"), t.alias("token")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,token:string>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        begins = s["at"] + p["gap"]
        return F.struct((begins + F.length(p["token"])).alias("at"), F.concat(s["out"], F.array(F.struct(begins.alias("at"), p["token"].alias("token")))).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def marked_parts(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, pos, at (character at which it begins) and token of every match of a pattern, within the row: no shuffle, and
    rows that repeat a doc_id don't meet."""
    found = docs.select("doc_id", F.posexplode(placed(F.col("text"), pattern)).alias("pos", "m"))
    return found.select("doc_id", "pos", F.col("m.at").cast("long").alias("at"), F.col("m.token").alias("token"))


_ANY_MARKER = MARKER.replace("(/?)([A-Za-z_]\\w*)([/?]?)", "/?[A-Za-z_]\\w*[/?]?")


def loop_marks(docs: DataFrame) -> DataFrame:
    """Markers in order: doc_id, pos, at, after, name, kind (loop, region, close, plain or malformed)."""
    mark = F.regexp_extract("token", r"([/?]?)\]$", 1)
    closes = F.col("token").startswith("[/")
    kind = F.when(closes & (mark != ""), "malformed").when(closes, "close").when(mark == "/", "loop").when(mark == "?", "region").otherwise("plain")
    return marked_parts(docs, _ANY_MARKER).select("doc_id", "pos", "at", (F.col("at") + F.length("token")).alias("after"), F.regexp_extract("token", r"([A-Za-z_]\w*)", 1).alias("name"), kind.alias("kind"))


def loop_spans(docs: DataFrame) -> DataFrame:
    """Loops and regions: doc_id, name, kind (loop or region), start, end (null if not closed, or opened anew before).

    [Name/] or [Name?] is closed by the next [/Name].
    """
    return marks.in_rows(docs, lambda text: marks.spans(text)[0], "name string, kind string, start long, end long", [pa.string(), pa.string(), pa.int64(), pa.int64()])


def marker_warnings(docs: DataFrame) -> DataFrame:
    """doc_id, name, warning, at: what is wrong with markers, by their place.

    not closed, reopened (the earlier opener is ignored), closes nothing, old style (a closer whose opener is a plain
    [Name]), malformed ([/Name?] and [/Name/]), and block in a loop ([[...]] within [Name/], which is alike for all
    elements). An opener waits for the
    next opener or closer of its name; a plain [Name] waits from the last closer that closed nothing on. A text is gone
    through where it is: no shuffle.
    """
    return marks.in_rows(docs, marks.warned, "name string, warning string, at long", [pa.string(), pa.string(), pa.int64()])


def _span_lists(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, spans: a document's closed loops or regions as one array of (end, start, name), by end."""
    spans = loop_spans(docs).where((F.col("kind") == kind) & F.col("end").isNotNull())
    return spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("end", "start", "name"))).alias("spans"))


def loop_membership(docs: DataFrame) -> DataFrame:
    """doc_id, name, loop: the loop that has all of a field's occurrences, the first that closes of several; else null.

    First and last occurrence tell, so a document's loops meet a row for each field, not one for each occurrence.
    """
    tokens = marked_parts(docs, r"\{[$+*]?[a-zA-Z_][a-zA-Z0-9_.]*\}").select("doc_id", "at", F.regexp_extract("token", FIELD, 2).alias("name"))
    ends = tokens.groupBy("doc_id", "name").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    around = F.filter("spans", lambda s: (s["start"] <= F.col("first")) & (F.col("last") < s["end"]))
    return ends.join(_span_lists(docs, "loop"), "doc_id", "left").select("doc_id", "name", F.get(around, F.lit(0))["name"].alias("loop"))


def regions(docs: DataFrame, coverages: DataFrame) -> DataFrame:
    """Regions with their class: doc_id, name, class, loop. coverages: name, exposure.

    In a loop of the coverage's own exposure it is the element's; elsewhere in a loop a value of the element; outside of
    loops a coverage's presence in the document, or else a value of the document. A coverage of several exposures is that
    of the least.
    """
    own = loop_spans(docs).where("kind = 'region' and end is not null").select("doc_id", "name", "start", F.col("end").alias("stop"))
    # of the loops around a region the innermost: the one that begins last
    around = F.filter("spans", lambda s: (s["start"] <= F.col("start")) & (F.col("stop") <= s["end"]))
    inner = F.array_max(F.transform(around, lambda s: F.struct(s["start"].alias("start"), s["name"].alias("name"))))["name"]
    placed = own.join(_span_lists(docs, "loop"), "doc_id", "left").select("doc_id", "name", inner.alias("loop"))
    out = placed.join(coverages.groupBy("name").agg(F.min("exposure").alias("exposure")), "name", "left")
    kind = (
        F.when(F.col("loop").isNotNull() & F.col("exposure").eqNullSafe(F.col("loop")), "element_coverage")
        .when(F.col("loop").isNotNull(), "element_value")
        .when(F.col("exposure").isNotNull(), "presence")
        .otherwise("document_value")
    )
    return out.select("doc_id", "name", kind.alias("class"), "loop")


def open_references(docs: DataFrame) -> DataFrame:
    """doc_id, pos, token of every reference that is still open. A sentence's full stop is not part of one."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({OPEN_TOKEN})"), 1)).alias("pos", "token"))


def nested_references(rules: DataFrame) -> DataFrame:
    """key, target of every [[$name]] in the texts of (key, text)."""
    return rules.select("key", F.explode(F.regexp_extract_all("text", F.lit(VARIANT), 1)).alias("target")).distinct()


def rewritten(docs: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """doc_id, text with {leaf} changed to {path} for each leaf of a small mapping, and missed: leaves not found.

    The occurrence symbol stays. Whole names are changed, so the order of the mapping doesn't matter.
    """
    import re

    text = F.col("text")
    for leaf in mapping:
        text = F.regexp_replace(text, r"\{([$+*]?)" + re.escape(leaf) + r"\}", "{$1" + mapping[leaf].replace("\\", "\\\\").replace("$", "\\$") + "}")
    there = F.regexp_extract_all("text", F.lit(FIELD), 2)
    missed = F.array_except(F.array(*(F.lit(x) for x in mapping)).cast("array<string>"), there)
    return docs.select("doc_id", text.alias("text"), missed.alias("missed"))


def integrity(before: Column, after: Column) -> Column:
    """Markers of the one text that the other lost, as a conversion between formats may do."""
    marks = lambda t: F.regexp_extract_all(t, F.lit(r"(\{[$+*]?[a-zA-Z_][a-zA-Z0-9_.]*\}|\[\[[^\[\]]*\]\])"), 1)
    return F.array_except(marks(before), marks(after))


def best_prefix(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """name, hint: of (prefix, hint), the one whose prefix and _ the name begins with; the longest of several."""
    key = F.concat(F.lower("prefix"), F.lit("_"))
    # prefixes of a name are few: a join by equality, not a comparison of all with all
    parts = F.split(F.lower("name"), "_")
    tries = names.select("name").distinct().withColumn("try", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "_"), F.lit("_")))))
    hit = tries.join(prefixes.withColumn("try", key), "try").groupBy("name").agg(F.max_by("hint", F.length("try")).alias("hint"))
    return names.join(hit, "name", "left")


def mustache(docs: DataFrame) -> DataFrame:
    """doc_id, pos, name of every {{name}}."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(MUSTACHE), 1)).alias("pos", "name"))


def prose_conditionals(docs: DataFrame) -> DataFrame:
    """doc_id, pos, text of every [text] of four characters or more that is no name of a loop."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\[([^\[\]\n]{4,})\]"), 1)).alias("pos", "text"))
    return found.where(~F.trim("text").rlike(r"^/?[a-zA-Z_][a-zA-Z0-9_]*$"))


def prose_blocks(docs: DataFrame, passes: int = 10) -> DataFrame:
    """docs (doc_id, text) with template, in which [text] of four characters or more that is no name is $doc.condN, and
    blocks: an array of (id, text, parent, depth). The innermost go first, pass by pass, and are numbered on; a block
    whose text refers to another one is its parent."""
    pattern = r"\[(?!/?[a-zA-Z_][a-zA-Z0-9_]*\])[^\[\]\n]{4,}\]"
    start = F.struct(F.coalesce("text", F.lit("")).alias("template"), F.array().cast("array<struct<id:int,text:string>>").alias("blocks"))

    def replaced(s: Column, found: Column) -> Column:
        new = F.transform(found, lambda t, i: F.struct((F.size(s["blocks"]) + i + 1).alias("id"), F.trim(F.substring(t, F.lit(2), F.length(t) - 2)).alias("text")))
        marks = F.concat(F.transform(found, lambda t, i: F.concat(F.lit("$doc.cond"), (F.size(s["blocks"]) + i + 1).cast("string"))), F.array(F.lit("")))
        text = F.array_join(F.flatten(F.zip_with(F.split(s["template"], pattern, -1), marks, lambda p, m: F.array(p, m))), "")
        return F.struct(text.alias("template"), F.concat(s["blocks"], new).alias("blocks"))

    def step(s: Column, _: Column) -> Column:
        # the matches are found once a pass; a pass without any changes nothing
        once = F.transform(F.array(F.regexp_extract_all(s["template"], F.lit(f"({pattern})"), 1)), lambda found: replaced(s, found))
        return F.when(F.rlike(s["template"], F.lit(pattern)), F.get(once, F.lit(0))).otherwise(s)

    # one expression over a row: no shuffle; most texts have no block and go through no pass
    parsed = F.when(F.rlike("text", F.lit(pattern)), F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, step)).otherwise(start)
    out = docs.withColumn("_p", parsed).select(*docs.columns, "_p.template", "_p.blocks")
    refers = lambda b, i: F.rlike(b["text"], F.concat(F.lit(r"\$doc\.cond"), i.cast("string"), F.lit(r"(?!\d)")))
    parent = lambda i: F.get(F.filter("blocks", lambda b: refers(b, i)), F.lit(0))["id"]
    linked = out.withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["id"].alias("id"), b["text"].alias("text"), parent(b["id"]).alias("parent"))))
    up = lambda i: F.get(F.filter("blocks", lambda b: b["id"] == i), F.lit(0))["parent"]
    climb = lambda b: F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.struct(b["parent"].alias("at"), F.lit(0).alias("n")), lambda s, _: F.struct(up(s["at"]).alias("at"), (s["n"] + s["at"].isNotNull().cast("int")).alias("n")))["n"]
    return linked.withColumn("blocks", F.transform("blocks", lambda b: b.withField("depth", climb(b))))


def mustache_loops(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, html, loops (name, iterator, fields) and warnings of pages with [name] ... [/name] around a loop's body: its
    {{field}} becomes $iterator.TBD_field, others $TBD_name. A loop whose ends lie in different elements is left."""
    ddl = f"{key} long, html string, loops array<struct<name:string,iterator:string,fields:array<string>>>, warnings array<string>"

    def read(batches):
        from .dom import loops

        for batch in batches:
            rows = [(k, *loops(h or "")) for k, h in zip(batch[key], batch[html], strict=True)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in (key, "html", "loops", "warnings")])

    return pages.select(key, html).mapInPandas(read, ddl)


def auto_loops(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, html, loops (name, iterator, fields) of pages whose repeated elements are made loops (see dom.auto_loops)."""
    ddl = f"{key} long, html string, loops array<struct<name:string,iterator:string,fields:array<string>>>"

    def read(batches):
        from .dom import auto_loops

        for batch in batches:
            rows = [(k, *auto_loops(h or "")) for k, h in zip(batch[key], batch[html], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "html", "loops"])

    return pages.select(key, html).mapInPandas(read, ddl)
