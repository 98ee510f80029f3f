"""Counts, states and merges: what is resolved, what is missing, and how a hand-edited table meets a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

CONFIDENCES = ("high", "medium", "low", "none")
NEXT_ACTIONS = ("supply-from-plugin", "restructure-template", "pick-one", "confirm-assumption", "delete-from-template")


def confidence_counts(verdicts: DataFrame) -> DataFrame:
    """root and a count for each confidence; other values are not counted."""
    return verdicts.groupBy("root").agg(*(F.count_if(F.col("confidence") == c).alias(c) for c in CONFIDENCES))


def next_action_counts(verdicts: DataFrame, root: str) -> DataFrame:
    """action, n of a root's reasons, with zeros for actions that none names."""
    found = verdicts.where(F.col("root") == root).select(X.next_action(F.col("reason")).alias("action")).groupBy("action").count()
    every = verdicts.sparkSession.createDataFrame([(a,) for a in NEXT_ACTIONS], "action string")
    return every.join(found, "action", "left").select("action", F.coalesce("count", F.lit(0)).alias("n"))


def review_order(entries: DataFrame) -> DataFrame:
    """entries (doc_id, name, line, pos) with their place in the review: by line, those without one last."""
    w = Window.partitionBy("doc_id").orderBy(F.coalesce("line", F.lit(999)), "pos")
    return entries.withColumn("place", F.row_number().over(w))


def substitution_state(tokens: DataFrame) -> DataFrame:
    """Per document of (doc_id, kind: resolved, unresolved, delegated or block): counts and state."""
    n = tokens.groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("resolved", "unresolved", "delegated", "block")))
    total = F.col("resolved") + F.col("unresolved") + F.col("delegated")
    state = (
        F.when((total == 0) & (F.col("block") == 0), "EMPTY").when(total == 0, "CONDITIONAL-ONLY").when(F.col("unresolved") == 0, "COMPLETE")
        .when((F.col("resolved") == 0) & (F.col("delegated") == 0), "BLOCKED").otherwise("PARTIAL")
    )
    return n.select("doc_id", "resolved", "unresolved", "delegated", "block", state.alias("state"))


def findings(docs: DataFrame) -> DataFrame:
    """Lines of (doc_id, text) that look unfinished: doc_id, line (from 1), category, found."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    kinds = {"suspicious token": X.SUSPICIOUS, "dollar amount": X.DOLLARS}
    found = [lines.select("doc_id", (F.col("pos") + 1).alias("line"), F.lit(k).alias("category"), F.explode(F.regexp_extract_all("line", F.lit(f"({p})"), 1)).alias("found")) for k, p in kinds.items()]
    return found[0].union(found[1])


def findings_text(found: DataFrame) -> DataFrame:
    """doc_id, text: categories in order, each with its count."""
    per = found.groupBy("doc_id", "category").count()
    rows = F.array_sort(F.collect_list(F.struct("category", "count")))
    return per.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: F.concat(r["category"], F.lit(": "), r["count"].cast("string"))), "\n").alias("text"))


def reused_names(tokens: DataFrame) -> DataFrame:
    """Names that are in two loops or more: doc_id, name, n_loops."""
    return tokens.where("loop is not null").groupBy("doc_id", "name").agg(F.count_distinct("loop").alias("n_loops")).where("n_loops >= 2")


def mixed_scopes(fields: DataFrame) -> DataFrame:
    """block, n_fields, mixed: of (block, scope), whether a block reads both quotes and policies."""
    return fields.groupBy("block").agg(F.count("*").alias("n_fields"), (F.count_distinct(F.when(F.col("scope").isin("quote", "policy"), F.col("scope"))) > 1).alias("mixed"))


def reconciled(existing: DataFrame, current: DataFrame, key: str = "key") -> DataFrame:
    """A hand-edited table after its keys changed: rows of keys that are still there stay as they are, those of others
    go, and new keys get the rows of current. Both have the same columns."""
    kept = existing.join(current.select(key).distinct(), key, "left_semi")
    new = current.join(existing.select(key).distinct(), key, "left_anti")
    return kept.select(*existing.columns).unionByName(new.select(*existing.columns))


def orphans(existing: DataFrame, current: DataFrame, key: str = "key") -> DataFrame:
    return existing.join(current.select(key).distinct(), key, "left_anti").select(key).distinct()


def missing_keys(required: DataFrame, existing: DataFrame) -> DataFrame:
    """Keys (key) that existing lacks, with the name they get: named ones keep theirs, condN are counted on from the
    highest N there."""
    number = lambda c: F.regexp_extract(c, r"^cond(\d+)$", 1).try_cast("int")
    high = existing.agg(F.coalesce(F.max(number(F.col("key"))), F.lit(0)).alias("high"))
    new = required.select("key").distinct().join(existing.select("key"), "key", "left_anti").join(F.broadcast(high))  # one row
    n = number(F.col("key"))
    return new.select("key", F.when(n.isNotNull(), F.concat(F.lit("cond"), (F.col("high") + n).cast("string"))).otherwise(F.col("key")).alias("name"))


def duplicates(keys: DataFrame) -> DataFrame:
    """key, n of keys that are there more than once."""
    return keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def audit(rendered: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with markers left over: doc_id, n_left, left (distinct, sorted)."""
    marks = F.regexp_extract_all("text", F.lit(r"(\$(?:\w+\.)?TBD_\w+(?:\.\w+)*|\{[$+*]?[a-zA-Z_][a-zA-Z0-9_.]*\}|\[\[[^\[\]]*\]\])"), 1)
    return rendered.select("doc_id", F.size(marks).alias("n_left"), F.array_sort(F.array_distinct(marks)).alias("left")).where("n_left > 0")


#: Keys of the entities that a template's data is read from; data is told apart (fixed).
ENTITIES = X.ENTITY_KEYS


def prose(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), chunk: the words of documents (doc_id, text) that a template must have as they are. A line is
    cut where it has markers of fields and loops and where two blanks or more stand; pieces of less than four characters, and
    blanks, full stops and commas at their ends, don't count, nor do lines with [[...]] blocks, whose text goes elsewhere."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    cut = rf"{X.FIELD}|(?<!\[)\[/?[A-Za-z_]\w*[/?]?\](?!\])|\s{{2,}}"
    own = lines.where(~F.col("line").rlike(r"\[\[.*?\]\]"))
    chunk = F.regexp_replace(F.col("chunk"), r"^[\s.,]+|[\s.,]+$", "")
    return own.select("doc_id", (F.col("pos") + 1).alias("line"), F.explode(F.split("line", cut, -1)).alias("chunk")).select("doc_id", "line", chunk.alias("chunk")).where(F.length("chunk") >= 4)


def coverage(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, line, chunk, state of the words of docs (doc_id, text) in their templates (doc_id, text): there, moved (there,
    but before what an earlier line has) or missing. White space and tags of the template don't count.

    Both sides are sequences of chunks in order; the first place of each in the template's text must not go back.
    """
    flat = lambda c: F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " ")
    both = prose(docs).join(templates.select("doc_id", flat(F.col("text")).alias("_flat")), "doc_id", "left")
    at = F.coalesce(F.call_function("locate", F.regexp_replace("chunk", r"\s+", " "), F.col("_flat")), F.lit(0))
    placed = both.select("doc_id", "line", "chunk", at.alias("_at"))
    w = Window.partitionBy("doc_id").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(F.col("_at") > 0, F.col("_at"))).over(w)
    return placed.select("doc_id", "line", "chunk", F.when(F.col("_at") == 0, "missing").when(F.col("_at") < F.coalesce(before, F.lit(0)), "moved").otherwise("there").alias("state"))


def shape(templates: DataFrame, system: DataFrame) -> DataFrame:
    """doc_id, problem, found: references of templates (doc_id, text) that their data can't answer: those without the key of
    an entity (data.data.x, or a bare field of system (field)), and those of a key that is none."""
    refs = templates.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\$\{?data\.([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)"), 1))).alias("ref"))
    first, rest = F.split_part("ref", F.lit("."), F.lit(1)), F.col("ref").contains(".")
    known = refs.withColumn("_first", first).join(system.select(F.col("field").alias("_first"), F.lit(True).alias("_own")).distinct(), "_first", "left")
    problem = F.when((first == "data") & rest, "no entity").when(F.col("_own"), "no entity").when(rest & ~first.isin(*ENTITIES), "unknown entity")
    return known.select("doc_id", problem.alias("problem"), F.col("ref").alias("found")).where("problem is not null")


def stale(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """doc_id, inputs: outputs (doc_id, at) that are older than something they were made of (doc_id, name, at), and of what."""
    late = inputs.withColumnRenamed("at", "_at").join(outputs, "doc_id").where("_at > at")
    return late.groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("inputs"))


def validation(docs: DataFrame, templates: DataFrame, blocks: DataFrame, system: DataFrame, inputs: DataFrame | None = None, configured: bool = True) -> DataFrame:
    """One report of each template (doc_id, text, at): doc_id, n_checks, failures, notes (arrays of texts, sorted) and passed.

    Checked are: markers left over, prose that is missing (docs: doc_id, text), blocks (doc_id, key) that the template
    doesn't refer to, the shape of references, and inputs (doc_id, name, at) that are newer. What only a configuration can
    answer (open references, shape) is a failure if there is one, else a note.
    """
    told = lambda df, kind, text: df.select("doc_id", F.lit(kind).alias("kind"), text.alias("said"))
    marks = templates.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\$TBD_\w+(?:\.\w+)*|(?<!\[)\[(?:[A-Za-z_]\w*[/?]|/[A-Za-z_]\w*)\](?!\])|(?<!\$)\{[$+*]?[a-zA-Z_][a-zA-Z0-9_.]*\}|\$doc\.\w+)"), 1))).alias("mark"))
    open_ = F.col("mark").startswith("$TBD_")
    found = [
        told(marks.where(open_), "config", F.concat(F.lit("open reference: "), "mark")),
        told(marks.where(~open_), "author", F.concat(F.lit("marker left: "), "mark")),
        told(shape(templates, system), "config", F.concat(F.lit("shape: "), "problem", F.lit(": "), "found")),
        told(coverage(docs, templates).where("state = 'missing'"), "author", F.concat(F.lit("prose missing: "), "chunk")),
    ]
    refers = F.coalesce(F.contains(F.col("text"), F.concat(F.lit("${data."), "key", F.lit("}"))), F.lit(False))
    found.append(told(blocks.join(templates.select("doc_id", "text"), "doc_id", "left").where(~refers), "author", F.concat(F.lit("no reference to block: "), "key")))
    if inputs is not None:
        found.append(told(stale(templates.select("doc_id", "at"), inputs), "author", F.concat(F.lit("older than: "), F.array_join("inputs", ", "))))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    fails = (F.col("kind") == "author") | F.lit(configured)
    of = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("said"))))
    per = every.groupBy("doc_id").agg(of(fails).alias("failures"), of(~fails).alias("notes"))
    checks = prose(docs).select("doc_id").unionByName(blocks.select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("_n"))
    none = F.array().cast("array<string>")
    out = templates.select("doc_id").join(per, "doc_id", "left").join(checks, "doc_id", "left")
    return out.select("doc_id", (F.coalesce("_n", F.lit(0)) + 4).alias("n_checks"), F.coalesce("failures", none).alias("failures"), F.coalesce("notes", none).alias("notes"), (F.size(F.coalesce("failures", none)) == 0).alias("passed"))


def fingerprint_gate(stored: DataFrame, actual: DataFrame, key: str, required: bool = False, stale: bool = False) -> DataFrame:
    """key, state of catalogues (key, fingerprint) against their configs (the same): match; skipped where the catalogue
    has none or there is no config, which fails if a check is required; fail where they differ, or stale if that is allowed."""
    both = stored.select(key, F.col("fingerprint").alias("_a")).join(actual.select(key, F.col("fingerprint").alias("_b")), key, "left")
    missing = F.lit("fail: required") if required else F.when(F.col("_a").isNull(), "skipped: no fingerprint").otherwise("skipped: no config")
    state = F.when(F.col("_a").isNull() | F.col("_b").isNull(), missing).when(F.col("_a") == F.col("_b"), "match").otherwise("stale" if stale else "fail")
    return both.select(key, state.alias("state"))


def appended(existing: DataFrame, new: DataFrame, key: str = "leaf") -> DataFrame:
    """existing as it is, and of new the least row of each key that it lacks."""
    first = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("_row")).select(key, "_row.*")
    fresh = first.join(existing.select(key).distinct(), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def review_sheet(matches: DataFrame) -> DataFrame:
    """A sheet for people to decide in, of resolve.match_leaves: leaf, suggested (the choices, the best first, a line each,
    over all documents and loops that ask for the leaf), final (empty)."""
    each = matches.select("name", F.posexplode_outer("choices").alias("pos", "choice"))
    best = each.groupBy("name", "choice").agg(F.min("pos").alias("pos")).groupBy("name").agg(F.array_sort(F.collect_list(F.when(F.col("choice").isNotNull(), F.struct("pos", "choice")))).alias("c"))
    return best.select(F.col("name").alias("leaf"), F.array_join(F.transform("c", lambda x: x["choice"]), "\n").alias("suggested"), F.lit("").alias("final"))


def path_map(applied: DataFrame) -> DataFrame:
    """One row, json: leaf to accessor, of a reviewed mapping (resolve.applied), by leaf; leaves without one are left out."""
    pairs = F.array_sort(F.collect_list(F.when(F.col("final").isNotNull(), F.struct("leaf", "final"))))
    return applied.agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def path_audit(applied: DataFrame, prior: DataFrame) -> DataFrame:
    """leaf, before, after, provenance, changed: what a review made of each leaf."""
    out = applied.join(prior.select("leaf", F.col("suggested").alias("before")), "leaf", "left")
    return out.select("leaf", "before", F.col("final").alias("after"), "provenance", (~F.col("before").eqNullSafe(F.col("final"))).alias("changed"))
