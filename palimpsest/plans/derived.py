"""Template documents and a product configuration made of the supplied tables, for the queries of the catalogue.

Documents come from orders, by an expression that Spark and the SQL of the checks share; the configuration comes from
part. The SQL side never sees the configuration: it says what a catalogue must hold in terms of part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import table


def _text(*parts: str) -> str:
    return " || ".join(parts)


def _n(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def _case(by: str, *parts: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(parts[:-1])) + f" ELSE {parts[-1]} END"


_K, _C = "o_orderkey", "o_custkey"
TEXT = _text(
    "'Dear {name'", _n(f"{_K} % 5"), "'}, '",
    _case(f"{_K} % 4", _text("'{$name'", _n(f"{_K} % 3"), "'} '"), _text("'{+items} {a.b'", _n(f"{_C} % 9"), "'.c} '"), "'{*rows} {name1} {$name1} '", "''"),
    _case(
        f"{_K} % 5", _text("'[[$clause'", _n(f"{_C} % 6"), "']] and [[ $clause'", _n(f"{_C} % 4"), "' ]] '"), _text("'[[bare text '", _n(f"{_C} % 3"), "']] '"),
        _text("'[[outer [[$in'", _n(f"{_C} % 2"), "']] $TBD_a.b'", _n(f"{_C} % 3"), "' tail]] '"), _text("'[[open [[$late'", _n(f"{_C} % 5"), "']] $TBD_a.b1 '"), "''",
    ),
    _case(
        f"{_K} % 6", _text("'[Item/]{line} {total'", _n(f"{_C} % 2"), "'}[/Item] {total1} '"), "'[Item/]{line} [Theft?]{cap} yes[/Theft] [Part/]{total0}[/Part] {line}[/Item] '", "'[Fire?]{line}[/Fire] [Open/] '",
        "'[/Stray] [Item] {x}[/Item] [Bad/] [Bad/]{y}[/Bad] '", "'[/Worse?] [Item/][[$clause0]]{z}[/Item][Item/]{z}[Fire?]{u}[/Fire][/Item] [Theft?]{w}[/Theft] '", "''",
    ),
    _case(f"{_K} % 7", "'$TBD_policy.number. '", _text("'$TBD_a.b'", _n(f"{_C} % 3"), "' '"), _text("'$'", _n(f"{_K} % 90 + 10"), "',000.50 XXXX '"), "'TODO $TBD_a.b0'", "'{{ due.date }} {{bad-name}} [shown if {{paid}} twice] [it [is nested] here] '", "'end'"),
)
#: The documents as SQL.
DOCS = f'(SELECT o_orderkey AS doc_id, {TEXT} AS "text" FROM orders)'


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a template document for every order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(TEXT).alias("text"))


#: Names of files as they declare their roots.
FILE = _text("'dir/Letter'", _n(_K), _case(f"{_K} % 7", "'(quote,segment).html'", "'(segment).docx'", "'.html'", "'(foo).html'", "'(quote, quote).html'", "'(old)(invoice).html'", "'().html'"))


# --- a product configuration ---------------------------------------------------------------------------------------


def _object(df: DataFrame, section: str, name, *fields) -> DataFrame:
    path = F.concat(F.lit(f"{section}/"), name, F.lit("/config.json"))
    return df.select(path.alias("rel"), F.to_json(F.struct(*fields)).alias("text"))


def _map(key, value) -> F.Column:
    """A map of the rows of a group, by key."""
    return F.map_from_entries(F.array_sort(F.collect_set(F.struct(key.alias("k"), value.alias("v")))))


def _listed(c) -> F.Column:
    return F.array_sort(F.collect_set(c))


BRAND, TYPE, SIZE = "replace(p_brand, '#', '')", "upper(left(p_type, 1)) || lower(substr(p_type, 2))", "p_size"
FIELD_TYPE = "CASE p_size % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'int?' WHEN 2 THEN 'Address' ELSE 'decimal+' END"
HELD = f"{TYPE} || CASE length(p_type) % 3 WHEN 0 THEN '?' WHEN 1 THEN '!' ELSE '' END"
CONTAINED = f"{BRAND} || CASE CAST(right(p_brand, 1) AS INT) % 3 WHEN 0 THEN '+' WHEN 1 THEN '*' ELSE '' END"
CATEGORIES = {"Charge0": "premium", "Charge1": "tax", "Charge2": "fee"}


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel, text of a configuration: an exposure for each brand, a coverage for each type, fields for sizes."""
    p = table(spark, sf_dir, "part").select(F.expr(BRAND).alias("brand"), F.expr(TYPE).alias("type"), F.col("p_size").alias("size"), F.expr(FIELD_TYPE).alias("kind"), F.expr(HELD).alias("held"), F.expr(CONTAINED).alias("contained"))
    size = F.col("size").cast("string")
    field = lambda display, kind: F.struct(display.alias("displayName"), kind.alias("type"))
    exposures = p.groupBy("brand").agg(_listed("held").alias("contents"), _map(F.concat(F.lit("size"), size), field(F.concat(F.lit("Size "), size), F.col("kind"))).alias("data"))
    inline = F.concat(F.lit('{"name":"Inline'), size, F.lit('","options":["*a","b'), size, F.lit('"]}'))
    term = F.when(F.col("size") % 10 == 0, inline).otherwise(F.concat(F.lit('"Term'), (F.col("size") % 3).cast("string"), F.lit('"')))
    limits = F.when(F.col("size") % 5 == 0, F.concat(F.lit("limit"), size))
    cov = p.groupBy("type").agg(
        _listed(F.concat(F.lit("Charge"), (F.col("size") % 4).cast("string"))).alias("charges"), _listed(term).alias("terms"),
        F.map_from_entries(F.array_sort(F.array_compact(F.collect_set(F.when(limits.isNotNull(), F.struct(limits.alias("k"), field(F.concat(F.lit("Limit "), size), F.lit("decimal")).alias("v"))))))).alias("data"),
    )
    plain = F.to_json(F.struct(F.col("type").alias("displayName"), "charges", "data"))
    coverages = cov.select(F.concat(F.lit("coverages/"), "type", F.lit("/config.json")).alias("rel"), F.concat(F.left(plain, F.length(plain) - 1), F.lit(',"coverageTerms":['), F.array_join("terms", ","), F.lit("]}")).alias("text"))
    product = p.agg(_listed("contained").alias("contents"), _map(F.concat(F.lit("term"), (F.col("size") % 7).cast("string")), field(F.concat(F.lit("Term "), (F.col("size") % 7).cast("string")), F.lit("int"))).alias("data"))
    out = _object(exposures, "exposures", F.col("brand"), F.concat(F.lit("Brand "), F.expr("substr(brand, 6)")).alias("displayName"), "contents", "data").union(coverages)
    out = out.union(_object(product, "products", F.lit("Multi"), F.lit("Multi").alias("displayName"), "contents", F.array(F.lit("Levy")).alias("charges"), "data"))
    fixed = [(f"charges/{k}/config.json", f'{{"category":"{v}"}}') for k, v in CATEGORIES.items()]
    fixed += [(f"coverageTerms/Term{i}/config.json", f'{{"displayName":"Term no {i}","value":{{"type":"decimal"}},"options":{{"low":"1","high{i}":"2"}}}}') for i in range(2)]
    fixed += [("customDataTypes/Address/config.json", '{"data":{"street":{"type":"string"}}}'), ("exposures/Broken/config.json", "{not json")]
    return out.union(spark.createDataFrame(fixed, "rel string, text string"))


_LOW = "lower(left(brand, 1)) || substr(brand, 2)"
#: Common table expressions that state the catalogue in terms of part: paths(section, field, display_name, type, category, path, iterator, list_path, exposure, coverage).
CATALOGUE = f"""p AS (SELECT {BRAND} AS brand, {TYPE} AS ptype, p_size AS size, {FIELD_TYPE} AS kind, {HELD} AS held, {CONTAINED} AS contained FROM part),
 own AS (SELECT DISTINCT brand, {_LOW} AS iterator, '$data.' || {_LOW} || 's' AS list_path, regexp_extract(contained, '[!?+*]$') AS quantifier FROM p),
 limits AS (SELECT DISTINCT ptype, size FROM p WHERE size % 5 = 0),
 held AS (SELECT DISTINCT o.brand, o.iterator, o.list_path, p.ptype FROM p JOIN own o USING (brand)),
 term AS (SELECT DISTINCT ptype, CASE WHEN size % 10 = 0 THEN 'Inline' || size ELSE 'Term' || size % 3 END AS name, CASE WHEN size % 10 = 0 THEN ['*a', 'b' || size] WHEN size % 3 < 2 THEN ['low', 'high' || size % 3] END AS options, CASE WHEN size % 10 = 0 THEN 'Inline' || size WHEN size % 3 < 2 THEN 'Term no ' || size % 3 ELSE 'Term2' END AS shown, CASE WHEN size % 10 = 0 OR size % 3 = 2 THEN '' ELSE 'decimal' END AS type FROM p),
 paths AS (
 SELECT 'system_paths' AS section, t.f AS field, t.d AS display_name, t.k AS type, 'system' AS category, '$data.' || t.f AS path, NULL AS iterator, NULL AS list_path, NULL AS exposure, NULL AS coverage FROM (VALUES ('locator', 'Policy/quote locator', 'string'), ('productName', 'Product name', 'string'), ('policyNumber', 'Policy number', 'string'), ('currency', 'Currency', 'string'), ('policyStartTime', 'Policy start (epoch ms)', 'datetime'), ('policyEndTime', 'Policy end (epoch ms)', 'datetime'), ('created', 'Created timestamp', 'datetime'), ('updated', 'Last updated timestamp', 'datetime')) t(f, d, k)
 UNION ALL SELECT 'account_paths', t.f, t.d, 'string', 'account', '$data.account.data.' || t.f, NULL, NULL, NULL, NULL FROM (VALUES ('name', 'Account name'), ('addressLine1', 'Address line 1'), ('addressLine2', 'Address line 2'), ('city', 'City'), ('state', 'State'), ('postalCode', 'Postal code'), ('country', 'Country'), ('email', 'Email'), ('phone', 'Phone')) t(f, d)
 UNION ALL SELECT DISTINCT 'policy_data', 'term' || size % 7, 'Term ' || size % 7, 'int', 'policy_data', '$data.data.term' || size % 7, NULL, NULL, NULL, NULL FROM p
 UNION ALL SELECT 'policy_charges', 'Levy', 'Levy', 'decimal', 'charge', '$data.charges.Levy.amount', NULL, NULL, NULL, NULL
 UNION ALL SELECT 'exposures', t.f, t.d, 'string', 'exposure_system', '$' || iterator || '.' || t.f, iterator, list_path, brand, NULL FROM own, (VALUES ('locator', 'Exposure locator (system)'), ('name', 'Exposure type name (system)')) t(f, d)
 UNION ALL SELECT DISTINCT 'exposures', 'size' || size, 'Size ' || size, kind, 'exposure_data', '$' || iterator || '.data.size' || size, iterator, list_path, brand, NULL FROM p JOIN own USING (brand)
 UNION ALL SELECT 'coverages', 'limit' || size, 'Limit ' || size, 'decimal', 'coverage_data', '$' || iterator || '.' || ptype || '.data.limit' || size, iterator, list_path, brand, ptype FROM held JOIN limits USING (ptype)
 UNION ALL SELECT 'coverage_terms', lower(left(name, 1)) || substr(name, 2), shown, term.type, 'coverage_term', '$' || iterator || '.' || ptype || '.' || lower(left(name, 1)) || substr(name, 2) || '.value', iterator, list_path, brand, ptype FROM held JOIN term USING (ptype))"""
