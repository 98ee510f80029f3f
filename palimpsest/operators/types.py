"""Declared types as a table (type, field, declared): what they wrap, what is reachable from a root, what a path leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import cut

#: Containers whose element counts as the type (fixed).
WRAPPERS = ("Optional", "Collection", "List", "Set", "Iterable")
#: Hops from a root that an index goes, unless it is told another number or none.
DEPTH = 3
#: Hops that are one plan.
TOGETHER = 8


def unwrapped(declared: Column) -> Column:
    """The named type within a declared one, without container and type arguments; null for primitives and java types."""
    inner = F.regexp_replace(F.trim(declared), rf"^[\w.]*(?:{'|'.join(WRAPPERS)})<(.+)>$", "$1")
    inner = F.trim(F.regexp_replace(inner, r"<.*>$", ""))
    return F.when(inner.contains(".") & ~inner.startswith("java."), inner)


def short_name(name: Column) -> Column:
    """A type's name without its package and what it is nested in."""
    return F.regexp_extract(name, r"([^.$]*)$", 1)


def version_key(name: Column) -> Column:
    """The three numbers of a name such as own-v1.2.3.jar, as an array that sorts as versions do; zeros without them."""
    numbers = [F.coalesce(F.regexp_extract(name, r"v(\d+)\.(\d+)\.(\d+)", i).try_cast("int"), F.lit(0)) for i in (1, 2, 3)]
    return F.array(*numbers)


def newest(files: DataFrame, by: str, name: str = "name") -> DataFrame:
    """Per group the file with the highest version; sources and documentation don't count."""
    own = files.where(~F.col(name).contains("-sources") & ~F.col(name).contains("-javadoc"))
    return own.groupBy(by).agg(F.max_by(name, F.struct(version_key(F.col(name)).alias("v"), F.col(name))).alias(name))


def shortest(names: DataFrame, by: str, name: str = "name") -> DataFrame:
    """Per group the name whose last part is shortest, the first in the alphabet of equals."""
    return names.groupBy(by).agg(F.min_by(name, F.struct(F.length(short_name(F.col(name))).alias("n"), F.col(name))).alias(name))


def index(types: DataFrame, roots: DataFrame, depth: int | None = DEPTH) -> DataFrame:
    """type, depth of every type reachable from roots (type) in so many hops, or (None) in any number, by the shortest way:
    breadth first, a join a hop, until a hop finds none that wasn't seen, so types that lead to each other end it. Types
    that aren't declared are left out."""
    edges = types.select(F.col("type").alias("from"), unwrapped(F.col("declared")).alias("to")).where("to is not null").distinct()
    seen = front = roots.select("type").distinct().withColumn("depth", F.lit(0))
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        front = front.select(F.col("type").alias("from")).join(edges, "from").select(F.col("to").alias("type")).distinct().join(seen.select("type"), "type", "left_anti").withColumn("depth", F.lit(hop))
        if depth is None:  # each hop is written, as their number isn't known
            front = cut(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front)
    return seen.join(types.select("type").distinct(), "type", "left_semi")


def schema_entries(types: DataFrame, found: DataFrame) -> DataFrame:
    """entity (short name), field, declared of the types of an index; of types of one short name the last one counts."""
    own = types.join(found.select("type"), "type", "left_semi").withColumn("entity", short_name(F.col("type")))
    last = own.groupBy("entity").agg(F.max("type").alias("type"))
    return own.join(last, ["entity", "type"]).select("entity", "field", "declared")


def return_types(methods: DataFrame, types: DataFrame) -> DataFrame:
    """methods (method, declared) with returns: the declared type unwrapped, or else, for a method such as getOwner, the
    type with the shortest name that ends in its stem."""
    stem = F.lower(F.regexp_replace("method", "^(?:get|fetch|find)", ""))
    names = types.select("type").distinct().withColumn("_short", F.lower(short_name(F.col("type"))))
    # a name ends in a stem if the stem is one of its ends: looked up by equality
    ends = names.select("type", F.length("_short").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.length("_short")), lambda i: F.substring("_short", i, 10_000))).alias("_stem"))
    best = ends.groupBy("_stem").agg(F.min_by("type", F.struct("n", "type")).alias("_found"))
    out = methods.withColumn("_stem", stem).join(best, "_stem", "left")
    return out.select("method", "declared", F.coalesce(unwrapped(F.col("declared")), "_found").alias("returns"))


def root_descriptors(spark: SparkSession, product: str, package: str) -> DataFrame:
    """root, record, request: the types that a product's documents are made from; invoices have no record type."""
    rows = [("quote", f"{package}.{product}Quote", f"{product}QuoteRequest"), ("segment", f"{package}.{product}Segment", f"{product}Request"), ("invoice", None, "InvoiceRequest")]
    return spark.createDataFrame(rows, "root string, record string, request string")


def walked(paths: DataFrame, types: DataFrame) -> DataFrame:
    """paths (id, type, path: dotted fields from the type on) with verdict: verified, not_found (no such field; the hop
    is told) or not_navigable (a field follows a value). Fields are met in any case.

    A join a hop, for all paths at once, up to the end of the longest one; every TOGETHER hops the paths that have more
    are written, so that a plan stays small however long they are.
    """
    own = types.groupBy("type", F.lower("field").alias("_f")).agg(F.min_by("declared", "field").alias("_d"))
    most = paths.agg(F.max(F.size(F.split("path", r"\.")))).first()[0] or 0
    at = paths.select("id", "type", "path", F.split("path", r"\.").alias("_parts"), F.col("type").alias("_at"), F.lit(None).cast("string").alias("verdict"), F.lit(0).alias("hop"))
    for i in range(most):
        part = F.lower(F.get("_parts", F.lit(i)))
        step = at.withColumn("_f", part).join(own.withColumnRenamed("type", "_at"), ["_at", "_f"], "left")
        open_ = F.col("verdict").isNull() & F.col("_f").isNotNull()
        wrong = F.when(F.col("_at").isNull(), "not_navigable").when(F.col("_d").isNull(), "not_found")
        at = step.select("id", "type", "path", "_parts", F.when(open_, unwrapped(F.col("_d"))).otherwise(F.col("_at")).alias("_at"), F.when(open_, wrong).otherwise(F.col("verdict")).alias("verdict"), F.when(open_, F.lit(i + 1)).otherwise(F.col("hop")).alias("hop"))
        if i % TOGETHER == TOGETHER - 1:
            at = cut(at)
    return at.select("id", "type", "path", F.coalesce("verdict", F.lit("verified")).alias("verdict"), "hop")
