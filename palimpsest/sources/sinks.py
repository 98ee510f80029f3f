"""Sinks: catalogues, mappings and reports; hand-edited tables are merged, not overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reports import reconciled


def write_catalog(paths: DataFrame, folder: str) -> None:
    paths.write.mode("overwrite").partitionBy("section").json(folder)


def mapping_json(tokens: DataFrame) -> DataFrame:
    """A JSON document per doc_id of tokens (doc_id, pos, name, ...), in their order."""
    entry = F.struct(*[c for c in ("pos", *[c for c in tokens.columns if c not in ("doc_id", "pos")])])
    out = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("tokens"))
    return out.select("doc_id", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.col("doc_id").cast("string").alias("source"), "tokens")).alias("json"))


def stub_rules(blocks: DataFrame) -> DataFrame:
    """Rows for a person to fill in, of (key, kind): two for a text, one for a loop or region, none for presence."""
    n = F.when(F.col("kind") == "text", 2).when(F.col("kind").isin("loop", "region"), 1).otherwise(0)
    rows = blocks.select("key", F.explode(F.filter(F.sequence(F.lit(1), F.lit(2)), lambda i: i <= n)).alias("ord"))
    return rows.select("key", "ord", F.lit("").alias("when"), F.lit("").alias("text"))


def write_rules(existing: DataFrame | None, blocks: DataFrame, folder: str) -> None:
    """Rules for the blocks of a template; rows that a person wrote stay if their block is still there."""
    stubs = stub_rules(blocks)
    out = stubs if existing is None else reconciled(existing, stubs)
    out.orderBy("key", "ord").coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(folder)  # a sheet is one small file


def catalog_markdown(paths: DataFrame) -> DataFrame:
    """section, text: a Markdown table of a section's paths, with at most five options named."""
    options = F.when(F.size("options") > 5, F.concat(F.array_join(F.slice("options", 1, 5), ", "), F.lit(", …"))).otherwise(F.array_join(F.coalesce("options", F.array().cast("array<string>")), ", "))
    required = F.when(F.col("quantifier") == "?", F.lit("")).otherwise(F.lit("yes"))
    row = F.concat_ws(" | ", "display_name", "path", "type", required, options)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("path", row.alias("row")))), lambda r: F.concat(F.lit("| "), r["row"], F.lit(" |")))
    head = F.lit("| Name | Path | Type | Required | Options |\n|---|---|---|---|---|\n")
    return paths.groupBy("section").agg(F.concat(head, F.array_join(rows, "\n")).alias("text"))
