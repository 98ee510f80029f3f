"""Nested records: ordered lists, presence, unpivoting, roll-ups and guards, over arrays of structs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(df: DataFrame, by: list[str], order: list[str], item: list[Column], name: str = "items", more: Sequence[Column] = ()) -> DataFrame:
    """Rows gathered into a list per key, in a total order: order's columns and then all of the item's; beside it more
    aggregates of the same rows."""
    struct = F.struct(*order, F.struct(*item).alias("_item"))
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(struct)).alias(name), *more).withColumn(name, F.transform(name, lambda x: x["_item"]))


def with_aggregates(records: DataFrame, rows: DataFrame, key: str, row_key: str, **aggregates: Column) -> DataFrame:
    """records with aggregates of their rows, summed before the shuffle; null for records without rows. What asks only
    whether, how many or how much needs no list of the rows."""
    per = rows.groupBy(F.col(row_key).alias("_key")).agg(*(c.alias(n) for n, c in aggregates.items()))
    return records.join(per, records[key] == per["_key"], "left").drop("_key")


def presence(records: DataFrame, rows: DataFrame, key: str, row_key: str, test: Column, name: str = "present") -> DataFrame:
    """records with whether any of their rows passes; false without rows."""
    return with_aggregates(records, rows, key, row_key, **{name: F.bool_or(test)}).withColumn(name, F.coalesce(name, F.lit(False)))


def unpivoted(rows: DataFrame, keys: list[Column], parts: dict[str, tuple[Column | None, dict[str, Column]]], name: str = "part") -> DataFrame:
    """A row for each part that each row has: keys, the part's name, and the part's columns. parts: name -> (test or None,
    columns). Rows are looked at one by one, so nothing is shuffled."""
    entries = []
    for part, (test, columns) in parts.items():
        entry = F.struct(F.lit(part).alias(name), *(c.alias(n) for n, c in columns.items()))
        entries.append(entry if test is None else F.when(test, entry))
    return rows.select(*keys, F.explode(F.array_compact(F.array(*entries))).alias("_part")).select("*", "_part.*").drop("_part")


def any_with(items: Column, part: str) -> Column:
    """Whether any element has the part; false for a null or empty list."""
    return F.coalesce(F.exists(items, lambda i: i[part].isNotNull()), F.lit(False))


def only_with(items: Column, test: Callable[[Column], Column]) -> Column:
    """The elements that pass, in order; an empty list for a null one."""
    return F.filter(F.coalesce(items, F.array()), test)


def unpivot(items: Column, parts: list[str], row: Callable[[Column, Column, str], Column]) -> Column:
    """A list with an entry for each part that each element has, elements in order, parts as given.

    row(element, part's struct, part's name) gives a string, or a struct of the same type for all parts.
    """
    entries = lambda i: F.array(*(F.when(i[p].isNotNull(), row(i, i[p], p)) for p in parts))
    return F.filter(F.flatten(F.transform(items, entries)), lambda x: x.isNotNull())


def charge_sums(category: Column, amount: Column) -> dict[str, Column]:
    """Aggregates of charges: premium, and other (neither premium nor nonFinancial); 0 without any."""
    kind, value, zero = F.lower(F.coalesce(category, F.lit(""))), amount.cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)")
    return {"premium": F.coalesce(F.sum(F.when(kind == "premium", value)), zero), "other": F.coalesce(F.sum(F.when(~kind.isin("premium", "nonfinancial"), value)), zero)}


def money(amount: Column) -> Column:
    """An amount as text with two places, half to even."""
    return F.bround(amount, 2).cast("decimal(28,2)").cast("string")


def charge_totals(charges: DataFrame, by: list[str], category: str = "category", amount: str = "amount") -> DataFrame:
    """premium, other (neither premium nor nonFinancial) and total per key, as text with two places, half to even."""
    out = charges.groupBy(*by).agg(*(c.alias(n) for n, c in charge_sums(F.col(category), F.col(amount)).items()))
    return out.select(*by, money(F.col("premium")).alias("premium"), money(F.col("other")).alias("other"), money(F.col("premium") + F.col("other")).alias("total"))


def missing(required: dict[str, Column], one_or_more: dict[str, Column] | None = None, counted: dict[str, Column] | None = None) -> Column:
    """Names of what is required and null, of lists that are null or empty, and of counts that are null or 0; an empty list
    if all is there."""
    parts = [F.when(c.isNull(), F.lit(f"{n} (required)")) for n, c in required.items()]
    lists = {n: F.size(c) for n, c in (one_or_more or {}).items()} | (counted or {})
    parts += [F.when(F.coalesce(c, F.lit(0)) <= 0, F.lit(f"{n} (one_or_more)")) for n, c in lists.items()]
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def split_rejects(df: DataFrame, gaps: Column) -> tuple[DataFrame, DataFrame]:
    """(records with nothing missing, records with what is missing in `missing`)."""
    marked = df.withColumn("missing", gaps)
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0)


def strict(df: DataFrame, gaps: Column, key: str) -> DataFrame:
    """df, whose reading stops at the first record that lacks something."""
    text = F.concat(F.lit("record "), F.col(key).cast("string"), F.lit(" lacks "), F.array_join(gaps, ", "))
    return df.where(F.when(F.size(gaps) == 0, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def fetched(records: DataFrame, entity: DataFrame, key: str, name: str, entity_key: str | None = None) -> DataFrame:
    """records with the entity of the key as a struct, null where there is none. One entity a key, else it is an error
    that rows multiply: the entity's key is deduplicated first, by its least row."""
    entity_key = entity_key or key
    one = entity.where(F.col(entity_key).isNotNull()).groupBy(F.col(entity_key).alias("_key")).agg(F.min(F.struct(*entity.columns)).alias(name))
    return records.join(one, records[key] == one["_key"], "left").drop("_key")
