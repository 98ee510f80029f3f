"""Files that one step hands to the next: catalogues, block sheets and other words for fields, with a check of what they hold.

A file is JSON below a header of # lines, which is YAML too; where a YAML parser is installed, files that people wrote in
YAML are read as well.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import is_schema_version

#: Errors that are listed of a file.
LISTED = 8
BLOCK = "struct<id:int,key:string,source_text:string,operator:string,conditions:array<string>,parent_id:int,depth:int,render:string>"
RENDERS = ("plugin", "template")


class ContractError(ValueError):
    pass


def section_counts(paths: DataFrame) -> DataFrame:
    """section, n of a catalogue, and the sum of all as section total."""
    return paths.groupBy("section").agg(F.count("*").alias("n")).union(paths.groupBy().agg(F.lit("total"), F.count("*")))


def body(text: str) -> dict:
    """What a file says, below its header."""
    lines = text.splitlines()
    start = next((i for i, x in enumerate(lines) if not x.startswith("#")), len(lines))
    rest = "\n".join(lines[start:])
    try:
        return json.loads(rest)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError:
            raise ContractError("the file is no JSON, and no YAML parser is installed") from None
        return yaml.safe_load(rest)


def checked(said: object, required: dict[str, type], name: str, version: str | None = None) -> dict:
    """said, if it has what is required in the right kinds; else a ContractError that lists LISTED errors at most."""
    errors = [] if isinstance(said, dict) else ["(document): not a mapping"]
    if not errors:
        if version and not is_schema_version(str(said.get("schema_version", "")), version):
            errors.append(f"schema_version: {said.get('schema_version')!r} can't be read as {version}")
        errors += [f"{k}: missing" if k not in said else f"{k}: not a {t.__name__}" for k, t in required.items() if not isinstance(said.get(k), t)]
    if errors:
        more = [f"... and {len(errors) - LISTED} more"] * (len(errors) > LISTED)
        raise ContractError("\n- ".join([f"{name} is not as agreed:", *errors[:LISTED], *more]))
    return said


def _write(spark: SparkSession, path: str, header: str, said: dict) -> None:
    """A file is as small as a configuration: the driver writes it, by Spark, into whichever store."""
    text = "".join(f"# {x}\n" for x in header.splitlines()) + json.dumps(said, ensure_ascii=False, indent=1)
    spark.createDataFrame([(x,) for x in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read(spark: SparkSession, path: str) -> str | None:
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return "".join(r.value for r in rows)


#: Rows that a file for people holds at most: it is one text, which the driver writes.
ROWS = 200_000


def _gathered(rows: DataFrame, *order: str) -> list[dict]:
    found = rows.limit(ROWS + 1).count()
    if found > ROWS:
        raise ContractError(f"more than {ROWS} rows are no file for people: keep them as a table")
    return [json.loads(r) for r in rows.orderBy(*order).toJSON().collect()]


def write_catalogue(paths: DataFrame, path: str, meta: dict | None = None) -> None:
    """A catalogue (see config_tree.PATHS) by section."""
    sections: dict = {}
    for entry in _gathered(paths, "section", "path"):
        sections.setdefault(entry.pop("section"), []).append(entry)
    _write(paths.sparkSession, path, "A catalogue of paths", {"schema_version": "1.0", "meta": meta or {}, "sections": sections})


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The paths of a catalogue's file, checked."""
    from .config_tree import PATHS

    text = _read(spark, path)
    if text is None:
        raise ContractError(f"no catalogue at {path}")
    said = checked(body(text), {"sections": dict, "meta": dict}, "the catalogue", "1.0")
    rows = [json.dumps({"section": s} | e) for s, entries in said["sections"].items() for e in entries]
    return spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", PATHS).alias("x")).select("x.*")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """The blocks of a template (columns of BLOCK)."""
    _write(blocks.sparkSession, path, "Blocks of a template", {"schema_version": "1.0", "blocks": _gathered(blocks, "id")})


def read_blocks(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """The blocks of a file, as block_rows gives them. A missing file is an error, or no blocks if it isn't required."""
    text = _read(spark, path)
    if text is None and required:
        raise ContractError(f"no blocks at {path}")
    said = checked(body(text), {"blocks": list}, "the block file", "1.0") if text is not None else {"blocks": []}
    out = block_rows(spark.createDataFrame([(json.dumps(b),) for b in said["blocks"]], "json string"))
    wrong = [r.error for r in out.where("error <> ''").limit(LISTED).collect()]
    if wrong:
        raise ContractError("\n- ".join(["the block file is not as agreed:", *wrong]))
    return out


def block_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """df with the fields of a block's JSON as agreed, and error: key is cond<id> unless given, the operator is in upper
    case and AND unless given, blank conditions go, render is plugin unless given. A block has an id or a key, and a text."""
    b = F.from_json(column, BLOCK)
    key = F.coalesce(F.nullif(F.trim(F.col("_b.key")), F.lit("")), F.concat(F.lit("cond"), F.col("_b.id").cast("string")))
    operator = F.coalesce(F.nullif(F.upper(F.trim(F.col("_b.operator"))), F.lit("")), F.lit("AND"))
    conditions = F.filter(F.transform(F.coalesce("_b.conditions", F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))
    render = F.coalesce("_b.render", F.lit("plugin"))
    out = df.withColumn("_b", b)
    error = F.when(F.col("_b").isNull(), "no block").when(key.isNull(), "neither id nor key").when(F.col("_b.source_text").isNull(), "no source_text").when(~render.isin(*RENDERS), "unknown render").otherwise("")
    return out.select(*df.columns, F.col("_b.id").alias("id"), key.alias("key"), "_b.source_text", operator.alias("operator"), conditions.alias("conditions"), render.alias("render"), F.coalesce("_b.depth", F.lit(0)).alias("depth"), error.alias("error"))


def stub_blocks(prose: DataFrame) -> DataFrame:
    """Blocks for a person to fill in, of conditionals found in prose (doc_id, id, text, parent, depth): BLOCK's columns."""
    return prose.select("doc_id", "id", F.concat(F.lit("cond"), F.col("id").cast("string")).alias("key"), F.col("text").alias("source_text"), F.lit("AND").alias("operator"), F.array().cast("array<string>").alias("conditions"), F.col("parent").alias("parent_id"), "depth", F.lit("plugin").alias("render"))


def shown_blocks(text: Column) -> Column:
    """A template for people to read: $doc.cond7 as [7]."""
    return F.regexp_replace(text, r"\$doc\.cond(\d+)", "[$1]")


def read_terminology(spark: SparkSession, *paths: str) -> DataFrame | None:
    """field, alias of the first of several files that is there: other words for fields. None if none is."""
    text = next((t for p in paths if (t := _read(spark, p)) is not None), None)
    if text is None:
        return None
    said = checked(body(text), {"synonyms": dict}, "the terminology")
    rows = [(field, a) for field, aliases in (said["synonyms"].get("fields") or {}).items() for a in aliases]
    return spark.createDataFrame(rows, "field string, alias string")
