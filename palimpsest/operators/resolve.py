"""Resolution: tokens of documents against a path catalogue, by joins with precedence, scope and feature gates.

A catalogue is a table of paths (see sources.config_tree.PATHS). Tokens are many, catalogues small in comparison; every
join here is by equality of a key computed on either side, so neither side is held against all of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Flags that bar a config, or part of it, when set; and fields that only exist while a flag is (fixed).
REFUSALS = ("nested_iterables", "custom_data_types", "recursive_cdts", "jurisdictional_scopes", "peril_based", "multi_product", "default_option_prefix")
PARTIAL = ("array_data_extensions",)
GATED_FIELDS = {"jurisdiction": "jurisdictional_scopes"}


def candidates(paths: DataFrame, roots: list[str]) -> DataFrame:
    """What a token can stand for: accessor, path, field, leaf, display, exposure, category, suggestable, ...

    Policy data is also reached by quote.data.x where a quote is rendered, and by that alone if nothing else is. The
    type name of an exposure is reachable in full, but not suggested.
    """
    own = paths.select(
        X.accessor(F.col("path"), F.col("category")).alias("accessor"), "path", "field", F.lower("field").alias("leaf"), "display_name", "exposure", "category", "quantifier",
        (~((F.col("category") == "exposure_system") & (F.col("field") == "name"))).alias("suggestable"),
    )
    if "quote" not in roots:
        return own
    alias = own.where("category = 'policy_data'").withColumn("accessor", F.regexp_replace("accessor", r"^policy\.", "quote.")).withColumn("path", F.regexp_replace("path", r"^\$data\.", r"\$data.quote."))
    if all(r == "quote" for r in roots):
        own = own.where("category not in ('policy_data', 'system')")
    return own.unionByName(alias)


def match_leaves(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """tokens (doc_id, name, loop) with status, match, chosen, choices (the best first), n_choices and note.

    Candidates of the token's loop, or, if the loop has none at all, of the document (with a note). Tiers: the field in
    any case; the field but for signs; a display name that equals or holds it but for signs. All candidates of the best
    tier of the first two, and those of the third, are told apart by accessor; a single exact one is resolved, several
    are ambiguous; a single similar one is resolved where none is exact. A full accessor stands for itself.

    The answer depends on name and loop alone: distinct ones are matched, however many documents ask for them, and the
    documents meet the answers in one join, which Spark broadcasts where these are few.
    """
    found = found.withColumn("_field", X.loose(F.col("field"))).withColumn("_display", X.loose(F.col("display_name"))).withColumn("scope", F.coalesce("exposure", F.lit("")))
    loops = found.where("exposure is not null").select(F.col("exposure").alias("loop")).distinct().withColumn("known", F.lit(True))
    placed = tokens.select("name", "loop").distinct().join(loops, "loop", "left")
    placed = placed.select("name", "loop", F.coalesce(F.when(F.col("known"), F.col("loop")), F.lit("")).alias("scope"), F.when(F.col("loop").isNotNull() & F.col("known").isNull(), F.lit("no such field in the loop")).otherwise("").alias("note"))
    names = placed.select("name", "scope", X.loose(F.col("name")).alias("_n")).distinct()
    offered = found.where("suggestable")
    tiers = lambda a, b: F.explode(F.array(F.struct(F.lit(0).alias("tier"), a.alias("key")), F.struct(F.lit(1).alias("tier"), b.alias("key")))).alias("k")
    keys = offered.select("accessor", "scope", tiers(F.col("leaf"), F.col("_field"))).select("accessor", "scope", "k.*")
    asked = names.select("name", "scope", tiers(F.lower("name"), F.col("_n"))).select("name", "scope", "k.*")
    hits = asked.join(keys, ["scope", "tier", "key"]).select("name", "scope", "tier", "accessor").unionByName(holding(names, offered).withColumn("tier", F.lit(2)))
    per = hits.groupBy("name", "scope").agg(*(F.sort_array(F.collect_set(F.when(F.col("tier") == t, F.col("accessor")))).alias(f"t{t}") for t in (0, 1, 2)))
    exact = F.when(F.size("t0") > 0, F.col("t0")).otherwise(F.col("t1"))
    per = per.select("name", "scope", exact.alias("exact"), F.array_except("t2", exact).alias("similar"))
    full = found.select(F.col("accessor").alias("name")).distinct().withColumn("full", F.lit(True))
    out = placed.join(per, ["name", "scope"], "left").join(full, "name", "left")
    none = F.array().cast("array<string>")
    exact, similar = F.coalesce("exact", none), F.coalesce("similar", none)
    single = F.when(F.size(exact) == 1, F.get(exact, F.lit(0))).when((F.size(exact) == 0) & (F.size(similar) == 1), F.get(similar, F.lit(0)))
    some = F.size(exact) + F.size(similar) > 0
    status = F.when(single.isNotNull() | (~some & F.col("full").isNotNull()), "resolved").when(some, "ambiguous").otherwise("unmatched")
    match = F.when(F.size(exact) > 0, "exact").when(some, "name-similar").when(F.col("full").isNotNull(), "full accessor").otherwise("")
    chosen = F.coalesce(single, F.when(~some & F.col("full").isNotNull(), F.col("name")), F.lit(""))
    answers = out.select("name", F.col("loop").alias("_loop"), status.alias("status"), match.alias("match"), chosen.alias("chosen"), F.concat(exact, similar).alias("choices"), (F.size(exact) + F.size(similar)).alias("n_choices"), "note")
    both = tokens.select("doc_id", "name", "loop").alias("t").join(answers.alias("a"), (F.col("t.name") == F.col("a.name")) & F.col("t.loop").eqNullSafe(F.col("a._loop")))
    return both.select("t.doc_id", "t.name", "t.loop", "status", "match", "chosen", "choices", "n_choices", "note")


#: Length of the parts that display names are looked up by.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def holding(names: DataFrame, offered: DataFrame) -> DataFrame:
    """name, scope, accessor: candidates (accessor, scope, _display) whose display name holds a name (name, scope, _n).

    An index has the display names' parts of GRAM signs and less: rows in proportion to their lengths. A name asks for that
    of its parts which the fewest candidates have, and none if one of its parts is in no display name; what it finds is
    held against the whole name. A name shorter than GRAM asks for itself.
    """
    parts = F.concat(*(_grams(F.col("_display"), n) for n in range(1, GRAM + 1)))
    index = offered.select("accessor", "scope", "_display", F.explode(parts).alias("gram"))
    sizes = index.groupBy("scope", "gram").agg(F.count("*").alias("_size"))
    own = names.where("_n <> ''").select("name", "scope", "_n", F.explode(F.when(F.length("_n") < GRAM, F.array("_n")).otherwise(_grams(F.col("_n"), GRAM))).alias("gram"))
    best = own.join(sizes, ["scope", "gram"], "left").groupBy("name", "scope", "_n").agg(F.min_by("gram", F.struct(F.coalesce("_size", F.lit(0)).alias("s"), "gram")).alias("gram"))
    return best.join(index, ["scope", "gram"]).where(F.contains("_display", "_n")).select("name", "scope", "accessor").distinct()


def strict_match(tokens: DataFrame, paths: DataFrame) -> DataFrame:
    """tokens (doc_id, name) of the form Entity.field that are in the catalogue as they stand; a field in the token's own
    case is preferred to one in another: doc_id, name, path (null if none)."""
    key = lambda c: F.lower(c)
    parts = tokens.withColumn("_field", F.element_at(F.split("name", r"\."), -1)).withColumn("_entity", F.element_at(F.split("name", r"\."), 1))
    own = paths.select(F.coalesce("exposure", F.lit("policy")).alias("entity"), F.col("field").alias("f"), "path")
    hit = parts.where("name like '%.%'").join(own, (key("_entity") == key("entity")) & (key("_field") == key("f")))
    best = hit.groupBy("doc_id", "name").agg(F.min_by("path", F.struct((F.col("_field") != F.col("f")).alias("other"), F.col("path").alias("p"))).alias("path"))
    return tokens.join(best, ["doc_id", "name"], "left").select("doc_id", "name", "path")


def scope_check(tokens: DataFrame, iterables: DataFrame) -> DataFrame:
    """tokens (doc_id, name, iterator that is needed or null, loop, loop_hint) with scope: not_required, satisfied,
    violated_with_hint or violated_no_hint. A loop may be named as its iterator, its name or its list."""
    names = iterables.select(F.explode(F.array_distinct(F.array(F.lower("iterator"), F.lower("name"), F.lower("list_key")))).alias("key"), F.lower("iterator").alias("is")).distinct()
    bare = F.lower(F.regexp_replace("iterator", r"^\$", ""))
    out = tokens.withColumn("_it", bare)
    for c in ("loop", "loop_hint"):
        out = out.join(names.select(F.col("key").alias(f"_{c}"), F.col("is").alias(f"_{c}_is")), F.lower(c) == F.col(f"_{c}"), "left")
    same = lambda c: F.coalesce((F.lower(c) == F.col("_it")) | (F.col(f"_{c}_is") == F.col("_it")), F.lit(False))
    scope = F.when(F.col("_it").isNull() | (F.col("_it") == ""), "not_required").when(same("loop"), "satisfied").when(same("loop_hint"), "violated_with_hint").otherwise("violated_no_hint")
    return out.select(*tokens.columns, scope.alias("scope")).distinct()


def verdicts(tokens: DataFrame, roots: DataFrame, paths: DataFrame) -> DataFrame:
    """Each token (doc_id, name, path, match, category) in each root (root): status, confidence and path there.

    roots is a fixed relation of at most four rows. paths: root, path, of what the record of that root really has. A path
    is verified there; sibling_only if only another root has it; else not_found; skipped without a path. Only an exact
    and verified match is graded high; an exact one otherwise low; all others none.
    """
    named = [r["root"] for r in roots.select("root").distinct().limit(len(X.ROOTS) + 1).collect()]
    if len(named) > len(X.ROOTS):
        raise ValueError("there are more roots than a document can have")
    grid = tokens.withColumn("root", F.explode(F.array(*map(F.lit, sorted(named))).cast("array<string>"))).withColumn("at", X.root_splice(F.col("path"), F.col("root")))
    own = paths.select("root", F.col("path").alias("at")).distinct().withColumn("here", F.lit(True))
    tail = lambda c: F.regexp_replace(c, r"^\$data\.(quote|segment|policy)\.", r"\$data.")
    siblings = paths.select(tail("path").alias("_tail"), F.col("root").alias("r")).distinct().groupBy("_tail").agg(F.collect_set("r").alias("others"))
    out = grid.join(own, ["root", "at"], "left").withColumn("_tail", tail("at")).join(siblings, "_tail", "left")
    status = F.when(F.col("path").isNull() | (F.col("path") == ""), "skipped").when(F.col("here"), "verified").when(F.size(F.array_remove("others", F.col("root"))) > 0, "sibling_only").otherwise("not_found")
    out = out.withColumn("status", status)
    grade = F.when(F.col("match") != "exact", "none").when(F.col("status") == "verified", "high").otherwise("low")
    return out.select("doc_id", "name", "root", F.when(F.col("status") == "verified", F.col("at")).otherwise(F.lit("")).alias("data_source"), "status", grade.alias("confidence"))


def feature_gates(tokens: DataFrame, features: DataFrame) -> DataFrame:
    """tokens (.., field, requires_feature) with gate: the flag that is explicitly false, or null. The entry's own tag
    comes before the fixed relation; a flag that isn't there bars nothing."""
    flag = F.coalesce(F.nullif("requires_feature", F.lit("")), X.lookup(GATED_FIELDS, F.col("field")))
    out = tokens.withColumn("_flag", flag).join(features.select(F.col("flag").alias("_flag"), "enabled"), "_flag", "left")
    return out.select(*tokens.columns, F.when(F.col("enabled").eqNullSafe(F.lit(False)), F.col("_flag")).alias("gate"))


def refusals(features: DataFrame) -> DataFrame:
    """flag, verdict of flags that are set: refused (a config that has it can't be worked with) or partial (what has it is
    left out); other flags, and those that aren't set, bar nothing."""
    verdict = F.when(F.col("flag").isin(*REFUSALS), "refused").when(F.col("flag").isin(*PARTIAL), "partial")
    return features.where("enabled").select("flag", verdict.alias("verdict")).where("verdict is not null")


def fetch_problems(rows: DataFrame) -> DataFrame:
    """rows of entities to be fetched (key, method, arg, roots) with problem: what keeps a row from being used."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    strange = F.array_except(F.coalesce("roots", F.array().cast("array<string>")), F.array(*map(F.lit, X.ROOTS)))
    problem = F.when(blank("key"), "no key").when(blank("method"), "no method").when(blank("arg"), "no argument").when(F.size(strange) > 0, F.concat(F.lit("unknown root: "), F.array_join(strange, ", "))).otherwise("")
    return rows.select("*", problem.alias("problem"))


#: Methods that no document may call, and those that a root has nothing for: what it lacks (fixed).
BLOCKED = ("getQuote", "getSegment")
LACKING = {
    ("getPolicy", "quote"): "policy", ("getTermCharges", "quote"): "term", ("getTermSubsegmentSummaries", "quote"): "term", ("getTransaction", "quote"): "transaction", ("getTransactionPricing", "quote"): "transaction",
    ("getSegmentDocuments", "quote"): "segment", ("getQuotePricing", "segment"): "quote", ("getQuoteUnderwritingFlags", "segment"): "quote",
}


def fetch_verdicts(rows: DataFrame, roots: list[str]) -> DataFrame:
    """rows of entities to be fetched (key, method, arg, roots: null for all) in each of roots: status and reason.

    blocked: the entity is the root's own, or another's that can't be fetched at all; unavailable: what it belongs to
    doesn't exist yet, or not there; other_root: the row isn't for this root; else ok. A row with a problem of its own (see
    fetch_problems) is invalid everywhere. roots is a fixed relation of four at most, so a row becomes four at most.
    """
    each = fetch_problems(rows).withColumn("root", F.explode(F.array(*map(F.lit, roots))))
    lacks = X.lookup({f"{m}:{r}": what for (m, r), what in LACKING.items()}, F.concat_ws(":", "method", "root"))
    status = (
        F.when(F.col("problem") != "", "invalid").when(F.col("method").isin(*BLOCKED), "blocked").when(F.col("roots").isNotNull() & ~F.array_contains("roots", F.col("root")), "other_root").when(lacks.isNotNull(), "unavailable").otherwise("ok")
    )
    each = each.withColumn("status", status)
    reason = (
        F.when(F.col("status") == "invalid", F.col("problem")).when(F.col("status") == "blocked", F.concat("method", F.lit(" can't be fetched — next-action: delete-from-template")))
        .when(F.col("status") == "unavailable", F.concat("method", F.lit(": a "), "root", F.lit(" has no "), lacks, F.lit(" — next-action: supply-from-plugin"))).otherwise("")
    )
    return each.withColumn("reason", reason).drop("problem")


def coverage_map(paths: DataFrame, iterables: DataFrame) -> DataFrame:
    """name (of a coverage), exposure (the least that has it), list_method and iterator (empty if that doesn't repeat)."""
    first = paths.where("coverage is not null").groupBy(F.col("coverage").alias("name")).agg(F.min("exposure").alias("exposure"))
    own = iterables.select(F.col("name").alias("exposure"), F.expr("substr(list_path, 7)").alias("_list"), F.col("iterator").alias("_iterator"))
    out = first.join(own, "exposure", "left")
    method = F.when(~F.col("_list").contains("."), F.col("_list"))
    return out.select("name", "exposure", F.coalesce(method, F.lit("")).alias("list_method"), F.coalesce("_iterator", F.lit("")).alias("iterator"))


def loop_roots(loops: DataFrame, iterables: DataFrame, synthesise: bool = False) -> DataFrame:
    """loops (doc_id, loop) with list_path, iterator, directive, match and synthesised: by the iterable's exact name, or made
    up of the loop's word and its plural."""
    own = iterables.select(F.col("name").alias("loop"), F.col("list_path").alias("_path"), F.col("iterator").alias("_iterator"))
    made, word = F.concat(F.lit("$data."), X.plural(F.lower("loop"))), F.lower("loop")
    path = F.coalesce("_path", made) if synthesise else F.col("_path")
    iterator = F.concat(F.lit("$"), F.coalesce("_iterator", word) if synthesise else F.col("_iterator"))
    directive = F.concat(F.lit("#foreach ("), iterator, F.lit(" in "), path, F.lit(")"))
    match = F.when(F.col("_path").isNotNull(), "exact").otherwise("none")
    return loops.join(own, "loop", "left").select("doc_id", "loop", path.alias("list_path"), iterator.alias("iterator"), directive.alias("directive"), match.alias("match"), (F.col("_path").isNull() & F.lit(synthesise)).alias("synthesised"))


def loop_fields(tokens: DataFrame, paths: DataFrame) -> DataFrame:
    """tokens (doc_id, exposure, name in snake case) with path and match.

    In turn: the whole name as a field of the exposure; its last word as one (fuzzy); a prefix that names a coverage,
    its underscores left out, and a rest that is a field of the coverage or ends in one, the shortest prefix first.
    """
    name = X.field_name(F.col("name"))
    t = tokens.withColumn("_snake", name).withColumn("_parts", F.split(name, "_"))
    size = F.size("_parts")
    words = lambda a, n: F.array_join(F.slice("_parts", a, n), "_")
    option = lambda order, cov, field, kind: F.struct(order.alias("order"), cov.alias("cov"), F.lower(field).alias("f"), F.lit(kind).alias("kind"))
    none = F.lit("")
    whole = [option(F.lit(0), none, X.camel(F.col("_snake")), "exact"), option(F.lit(1), none, F.element_at("_parts", -1), "fuzzy")]
    split = F.when(size > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.array(
        option(i * 2, F.lower(F.array_join(F.slice("_parts", F.lit(1), i), "")), X.camel(words(i + 1, size - i)), "exact"),
        option(i * 2 + 1, F.lower(F.array_join(F.slice("_parts", F.lit(1), i), "")), F.element_at("_parts", -1), "exact"),
    ))))
    tries = t.select("doc_id", "exposure", "name", F.explode(F.concat(F.array(*whole), F.coalesce(split, F.array()))).alias("o")).select("doc_id", F.lower("exposure").alias("e"), "exposure", "name", "o.*")
    own = paths.where("exposure is not null").select(F.lower("exposure").alias("e"), F.lower(F.coalesce("coverage", F.lit(""))).alias("cov"), F.lower("field").alias("f"), "path")
    best = tries.join(own, ["e", "cov", "f"]).groupBy("doc_id", "exposure", "name").agg(F.min_by(F.struct("path", "kind"), F.struct("order", "path")).alias("b"))
    return tokens.join(best, ["doc_id", "exposure", "name"], "left").select("doc_id", "exposure", "name", F.coalesce("b.path", F.lit("")).alias("path"), F.coalesce("b.kind", F.lit("none")).alias("match"))


def path_lookup(paths: DataFrame) -> DataFrame:
    """key, path: full accessors, and bare fields as shorthands where no accessor is spelled so; the first path of each."""
    full = paths.select(X.accessor(F.col("path"), F.col("category")).alias("key"), "path", F.lit(0).alias("rank"))
    short = paths.select(F.col("field").alias("key"), "path", F.lit(1).alias("rank"))
    return full.union(short).groupBy("key").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def condition_paths(names: DataFrame, found: DataFrame, scope: str) -> DataFrame:
    """names (name) with accessor and problem: the accessor itself, or the only one in scope with that field."""
    own = found.where(F.split_part("accessor", F.lit("."), F.lit(1)) == scope)
    leaf = own.groupBy(F.col("field").alias("name")).agg(F.sort_array(F.collect_set("accessor")).alias("_all"))
    full = own.select(F.col("accessor").alias("name"), F.col("accessor").alias("_full")).distinct()
    out = names.join(leaf, "name", "left").join(full, "name", "left")
    single = F.when(F.size("_all") == 1, F.get("_all", F.lit(0)))
    return out.select("name", F.coalesce("_full", single).alias("accessor"), F.when(F.col("_full").isNotNull() | single.isNotNull(), None).when(F.size("_all") > 1, "ambiguous").otherwise("unknown").alias("problem"))


def wired(tokens: DataFrame, paths: DataFrame) -> DataFrame:
    """tokens (doc_id, path) with the record they are read from: quote, segment (custom fields), policy or account."""
    entity = F.when(F.col("category") == "quote_system", "quote").when(F.col("category") == "policy_data", "segment").when(F.col("category") == "system", "policy").when(F.col("category") == "account", "account")
    return tokens.join(paths.select("path", "category").distinct(), "path", "left").select("doc_id", "path", "category", entity.alias("entity"))


def flattened(by_root: Column, order: list[str]) -> Column:
    """One data source of a map from roots to data sources: that of the first root in order which has one, else empty."""
    return F.coalesce(*(F.nullif(F.try_element_at(by_root, F.lit(r)), F.lit("")) for r in order), F.lit(""))


def kept_or(resolved: Column, given: Column) -> Column:
    """A data source set by hand stays; an empty or UNRESOLVED: one is replaced."""
    return F.when(F.coalesce(given, F.lit("")).rlike(r"^(|UNRESOLVED:.*)$"), resolved).otherwise(given)


def applied(prior: DataFrame, review: DataFrame) -> DataFrame:
    """A reviewed mapping: leaf, final, provenance. prior: leaf, suggested; review: leaf, final (null or blank: none)."""
    both = prior.join(review, "leaf", "full_outer")
    final = F.nullif(F.trim("final"), F.lit(""))
    kind = (
        F.when(final.isNull() & F.col("suggested").isNull(), "needs human")
        .when(final.isNull() | (final == F.col("suggested")), "suggested")
        .when(F.col("suggested").isNull(), "selection")
        .otherwise("override")
    )
    return both.select("leaf", F.coalesce(final, F.col("suggested")).alias("final"), kind.alias("provenance"))


def merged_rules(rules: DataFrame, blocks: DataFrame) -> DataFrame:
    """Keys of a sheet (key) and of a template's blocks (key, kind) with what is wrong: missing rows or orphan."""
    both = rules.select("key").distinct().withColumn("in_rules", F.lit(True)).join(blocks.select("key", "kind").distinct(), "key", "full_outer")
    problem = F.when(F.col("in_rules").isNull() & (F.col("kind") != "presence"), "missing rows").when(F.col("kind").isNull(), "orphan")
    return both.select("key", "kind", problem.alias("problem"))
