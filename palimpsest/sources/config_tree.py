"""A nested product configuration as a catalogue of paths: one table of typed, scoped template paths, and feature flags.

The tree is <section>/<name>/config.json with sections products, exposures, coverages, charges, accounts, perils,
customDataTypes (or dataTypes), and coverageTerms/config.json or coverageTerms/<name>/config.json. All is read by Spark's
file source, so the tree may lie in any store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..staging import cut

#: Types that a field can have without being of a custom type (fixed).
PRIMITIVES = ("string", "text", "int", "number", "decimal", "boolean", "date", "datetime", "binary")
PATHS = "section string, field string, display_name string, type string, base_type string, quantifier string, cardinality string, iterable boolean, category string, path string, iterator string, list_path string, exposure string, coverage string, options array<string>, custom_type_ref string, requires_feature string"
CONFIG = "struct<displayName:string,contents:array<string>,charges:array<string>,category:string,data:map<string,struct<displayName:string,type:string,options:array<string>>>,coverageTerms:array<string>,qualification:string,appliesTo:string,exclusive:string,options:string,value:struct<type:string>>"
#: Paths of every record, whatever the config (fixed).
SYSTEM = [("locator", "Policy/quote locator", "string"), ("productName", "Product name", "string"), ("policyNumber", "Policy number", "string"), ("currency", "Currency", "string"), ("policyStartTime", "Policy start (epoch ms)", "datetime"), ("policyEndTime", "Policy end (epoch ms)", "datetime"), ("created", "Created timestamp", "datetime"), ("updated", "Last updated timestamp", "datetime")]
ACCOUNT = [("name", "Account name"), ("addressLine1", "Address line 1"), ("addressLine2", "Address line 2"), ("city", "City"), ("state", "State"), ("postalCode", "Postal code"), ("country", "Country"), ("email", "Email"), ("phone", "Phone")]


def config_files(spark: SparkSession, folder: str) -> DataFrame:
    """rel, text of all config.json files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "config.json").option("recursiveFileLookup", "true").load(folder)
    rel = F.regexp_extract("path", r"/((?:products|exposures|coverages|charges|accounts|perils|customDataTypes|dataTypes|coverageTerms)/(?:[^/]+/)?config\.json)$", 1)
    return files.select(rel.alias("rel"), F.col("content").cast("string").alias("text")).where("rel <> ''")


def configs(files: DataFrame) -> DataFrame:
    """section, name, cfg (CONFIG) of (rel, text); text that is no JSON object is skipped."""
    parts = F.split("rel", "/")
    out = files.select(F.get(parts, F.lit(0)).alias("section"), F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).alias("name"), "text", F.from_json("text", CONFIG).alias("cfg"))
    return out.where(F.trim("text").startswith("{") & F.expr("try_parse_json(text) is not null"))


def first_product(cfgs: DataFrame) -> DataFrame:
    return cfgs.where("section = 'products'").groupBy().agg(F.min("name").alias("name"), F.min_by("cfg", "name").alias("cfg")).where("name is not null")


def _row(df: DataFrame, section: str, category: str, field: Column, display: Column, kind: Column, path: Column, iterator: Column | None = None, list_path: Column | None = None, exposure: Column | None = None, coverage: Column | None = None, options: Column | None = None, quantifier: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    typed = X.quantified(F.coalesce(kind, F.lit("")))
    q = quantifier if quantifier is not None else typed["quantifier"]
    base = typed["name"]
    custom = F.when((base != "") & ~base.isin(*PRIMITIVES) & F.lit(category.endswith("_data")), base)
    return df.select(
        F.lit(section).alias("section"), field.alias("field"), F.coalesce(display, field).alias("display_name"), kind.alias("type"), base.alias("base_type"), q.alias("quantifier"),
        X.lookup(X.QUANTIFIERS, q).alias("cardinality"), q.isin(*X.REPEATING).alias("iterable"), F.lit(category).alias("category"), path.alias("path"),
        (iterator if iterator is not None else null).alias("iterator"), (list_path if list_path is not None else null).alias("list_path"), (exposure if exposure is not None else null).alias("exposure"),
        (coverage if coverage is not None else null).alias("coverage"), (options if options is not None else F.lit(None).cast("array<string>")).alias("options"), custom.alias("custom_type_ref"),
        F.when(field == "jurisdiction", F.lit("jurisdictional_scopes")).alias("requires_feature"),
    )


def _data_rows(df: DataFrame, section: str, category: str, prefix: Column, **where) -> DataFrame:
    """A row per entry of cfg.data."""
    out = df.select("*", F.explode("cfg.data").alias("key", "def"))
    return _row(out, section, category, F.col("key"), F.col("def.displayName"), F.coalesce("def.type", F.lit("string")), F.concat(prefix, F.lit("."), F.col("key")), options=F.col("def.options"), **where)


def exposures(cfgs: DataFrame) -> DataFrame:
    """name, cfg, iterator, list_key, quantifier of exposures that the product contains or that are just there."""
    product = first_product(cfgs).select(F.explode("cfg.contents").alias("token")).select(X.quantified(F.col("token")).alias("q"))
    product = product.select(F.col("q.name").alias("name"), "q.quantifier")
    own = cfgs.where("section = 'exposures' and name is not null").select("name", "cfg")
    out = own.join(product, "name", "left")
    return out.select("name", "cfg", X.lower_first(F.col("name")).alias("iterator"), X.list_key(F.col("name")).alias("list_key"), F.coalesce("quantifier", F.lit("")).alias("quantifier"))


def coverages(cfgs: DataFrame) -> DataFrame:
    """exposure, iterator, list_path, name, quantifier, cfg of the coverages that exposures contain."""
    held = exposures(cfgs).select(F.col("name").alias("exposure"), "iterator", F.concat(F.lit("$data."), F.col("list_key")).alias("list_path"), F.explode("cfg.contents").alias("token"))
    held = held.select("exposure", "iterator", "list_path", X.quantified(F.col("token")).alias("q")).select("exposure", "iterator", "list_path", F.col("q.name").alias("name"), "q.quantifier")
    return held.join(cfgs.where("section = 'coverages'").select("name", "cfg"), "name")


def charges(cfgs: DataFrame) -> DataFrame:
    """owner (null: the product), name, category (unknown without a definition), amount_path, object_path."""
    own = first_product(cfgs).select(F.lit(None).cast("string").alias("owner"), F.lit("$data").alias("at"), F.explode("cfg.charges").alias("name"))
    cov = coverages(cfgs).select(F.col("name").alias("owner"), F.concat(F.lit("$"), "iterator", F.lit("."), "name").alias("at"), F.explode("cfg.charges").alias("name"))
    defined = cfgs.where("section = 'charges'").select("name", F.col("cfg.category").alias("category"))
    out = own.union(cov).join(defined, "name", "left")
    whole = F.concat("at", F.lit(".charges."), "name")
    return out.select("owner", "name", F.coalesce("category", F.lit("unknown")).alias("category"), F.concat(whole, F.lit(".amount")).alias("amount_path"), whole.alias("object_path"))


def terms(cfgs: DataFrame) -> DataFrame:
    """Coverage terms as path rows: named ones with their definition, or inline objects."""
    text = F.col("term")
    inline = F.from_json(text, "struct<name:string,displayName:string,value:struct<type:string>,options:variant>")
    out = coverages(cfgs).select("exposure", "iterator", "list_path", F.col("name").alias("coverage"), F.explode("cfg.coverageTerms").alias("term"))
    out = out.withColumn("in", F.when(text.startswith("{"), inline)).withColumn("q", X.quantified(F.when(~text.startswith("{"), text)))
    out = out.withColumn("name", F.coalesce("in.name", "q.name")).where("name <> ''")
    known = cfgs.where("section = 'coverageTerms' and name is not null").select("name", F.col("cfg.displayName").alias("d1"), F.col("cfg.value.type").alias("t1"), F.col("cfg.options").alias("o1"))
    listed = cfgs.where("section = 'coverageTerms' and name is null").select(F.explode(F.from_json("text", "map<string,struct<displayName:string,value:struct<type:string>,options:string>>")).alias("name", "v"))
    known = known.union(listed.select("name", "v.displayName", "v.value.type", "v.options"))
    out = out.join(known, "name", "left")
    options = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.map_keys(F.from_json(c, "map<string,string>")))
    raw = F.coalesce(F.col("o1"), F.to_json("in.options"))
    accessor = X.lower_first(F.col("name"))
    base = F.concat(F.lit("$"), "iterator", F.lit("."), "coverage", F.lit("."), accessor, F.lit(".value"))
    return _row(out, "coverage_terms", "coverage_term", accessor, F.coalesce("in.displayName", "d1", "name"), F.coalesce("in.value.type", "t1", F.lit("")), base, F.col("iterator"), F.col("list_path"), F.col("exposure"), F.col("coverage"), options(raw), F.coalesce("q.quantifier", F.lit("")))


def paths(cfgs: DataFrame) -> DataFrame:
    """The catalogue: PATHS."""
    spark = cfgs.sparkSession
    system = spark.createDataFrame(SYSTEM, "field string, display string, type string")
    account = spark.createDataFrame(ACCOUNT, "field string, display string")
    exp = exposures(cfgs).withColumn("list_path", F.concat(F.lit("$data."), F.col("list_key")))
    cov = coverages(cfgs)
    at = {"iterator": F.col("iterator"), "list_path": F.col("list_path")}
    own = exp.select("*", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(d).alias("d")) for f, d in (("locator", "Exposure locator (system)"), ("name", "Exposure type name (system)"))))).alias("s"))
    charge = charges(cfgs).where("owner is null")
    parts = [
        _row(system, "system_paths", "system", F.col("field"), F.col("display"), F.col("type"), F.concat(F.lit("$data."), "field")),
        _row(account, "account_paths", "account", F.col("field"), F.col("display"), F.lit("string"), F.concat(F.lit("$data.account.data."), "field")),
        _data_rows(first_product(cfgs), "policy_data", "policy_data", F.lit("$data.data")),
        _row(charge, "policy_charges", "charge", F.col("name"), F.col("name"), F.lit("decimal"), F.col("amount_path")),
        _row(own, "exposures", "exposure_system", F.col("s.f"), F.col("s.d"), F.lit("string"), F.concat(F.lit("$"), "iterator", F.lit("."), "s.f"), exposure=F.col("name"), **at),
        _data_rows(exp, "exposures", "exposure_data", F.concat(F.lit("$"), "iterator", F.lit(".data")), exposure=F.col("name"), **at),
        _data_rows(cov, "coverages", "coverage_data", F.concat(F.lit("$"), "iterator", F.lit("."), "name", F.lit(".data")), exposure=F.col("exposure"), coverage=F.col("name"), **at),
        terms(cfgs),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gathered(found: DataFrame) -> DataFrame:
    """A catalogue as a written table of its own, so that what uses it several times need not derive it each time."""
    return cut(found)


def iterables(cfgs: DataFrame) -> DataFrame:
    """name, display_name, list_key, list_path, iterator, quantifier of exposures that repeat."""
    out = exposures(cfgs).where(F.col("quantifier").isin(*X.REPEATING))
    return out.select("name", F.coalesce("cfg.displayName", "name").alias("display_name"), "list_key", F.concat(F.lit("$data."), "list_key").alias("list_path"), "iterator", "quantifier")


def features(cfgs: DataFrame) -> DataFrame:
    """flag, enabled: ten flags, found in one pass over the configs."""
    product = first_product(cfgs).select(F.lit("products").alias("section"), "name", "cfg", F.lit(None).cast("string").alias("text"))
    used = cfgs.where("section <> 'products'").select("section", "name", "cfg", "text").union(product)
    kinds = F.transform(F.map_values(F.coalesce("cfg.data", F.create_map().cast("map<string,struct<displayName:string,type:string,options:array<string>>>"))), lambda v: F.coalesce(v["type"], F.lit("")))
    scanned = F.col("section").isin("products", "exposures", "coverages", "accounts", "customDataTypes")
    some = lambda a, test: scanned & F.exists(a, test)
    repeats = lambda t: t.endswith("+") | t.endswith("*")
    base = lambda t: F.regexp_replace(t, r"[!?+*]$", "")
    custom = lambda t: repeats(t) & (base(t) != "") & ~base(t).isin(*PRIMITIVES)
    contents = F.coalesce("cfg.contents", F.array().cast("array<string>"))
    limited = F.coalesce("cfg.qualification", "cfg.appliesTo", "cfg.exclusive").isNotNull() & F.col("section").isin("products", "coverages")
    cov_terms = F.coalesce("cfg.coverageTerms", F.array().cast("array<string>"))
    star = F.exists(cov_terms, lambda t: t.startswith("{") & t.rlike(r'"options"\s*:\s*\[[^\]]*"\*'))
    flags = {
        "nested_iterables": some(kinds, custom),
        "custom_data_types": F.col("section") == "customDataTypes",
        "recursive_cdts": (F.col("section") == "customDataTypes") & F.exists(kinds, lambda t: base(t) == F.col("name")),
        "jurisdictional_scopes": limited,
        "peril_based": F.col("section") == "perils",
        "coverage_terms": (F.col("section") == "coverages") & (F.size(cov_terms) > 0),
        "default_option_prefix": (F.col("section") == "coverages") & star,
        "auto_elements": some(kinds, lambda t: t.endswith("!")) | (F.col("section").isin("products", "exposures", "coverages") & F.exists(contents, lambda t: t.endswith("!"))),
        "array_data_extensions": some(kinds, repeats),
    }
    one = used.agg(*(F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False)).alias(k) for k, c in flags.items()))
    many = cfgs.agg((F.count_distinct(F.when(F.col("section") == "products", F.col("name"))) > 1).alias("multi_product"))
    both = one.join(F.broadcast(many))  # one row each
    return both.select(F.explode(F.create_map(*(x for k in [*flags, "multi_product"] for x in (F.lit(k), F.col(k))))).alias("flag", "enabled"))
