"""Rule sets: rows of (placeholder, when, text) become first-match-wins columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import conditions as C
from .graph import find_cycle, ordered
from .templates import interpolate

#: What a `when` of a default row may hold, and the columns of a sheet (fixed).
DEFAULT_WHEN = ("", "*", "else", "default")
COLUMNS = ("placeholder", "when", "text")
NESTED = r"\[\[\s*\$([A-Za-z_]\w*)\s*\]\]"


@dataclass(frozen=True)
class Block:
    key: str
    rows: tuple[tuple[C.Condition, str], ...] = ()
    default: str | None = None
    scope: str = "policy"
    kind: str = "text"  # text | loop | presence

    @property
    def shows(self) -> bool:
        """One conditioned row without a default and without a text of its own: a yes or no."""
        return len(self.rows) == 1 and self.default is None

    def refs(self) -> list[str]:
        return re.findall(NESTED, " ".join([*(t for _, t in self.rows), self.default or ""]))


@dataclass
class RuleSet:
    blocks: dict[str, Block]
    errors: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet in any of , ; tab, with # lines, a byte order mark and headers of any case: key, ord, when, text.

    The separator is the one most frequent in the header line. Quoted cells may hold line ends and #.
    """
    head = next((r.value.lstrip("﻿") for r in spark.read.text(path).where("value not like '#%' and trim(value) <> ''").take(1)), "")
    sep = max(",;\t", key=head.count)
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("comment", "#").option("escape", '"').csv(path)
    df = df.toDF(*(c.lstrip("﻿").strip().lower() for c in df.columns))
    cell = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in df.columns else F.lit("")
    # sheets are written by hand: one file, read by one task, so the id is its order
    return df.select(cell("placeholder").alias("key"), F.monotonically_increasing_id().alias("ord"), cell("when").alias("when"), cell("text").alias("text")).where("key <> ''")


def checks(rules: DataFrame, loops: tuple[str, ...] = ()) -> DataFrame:
    """Per key of (key, ord, when, text): n_rows, n_conditions, n_defaults, default_text (the last) and errors."""
    default = F.lower(F.trim(F.coalesce("when", F.lit("")))).isin(*DEFAULT_WHEN)
    out = rules.groupBy("key").agg(
        F.count("*").alias("n_rows"),
        F.count_if(~default).alias("n_conditions"),
        F.count_if(default).alias("n_defaults"),
        F.max_by("text", F.when(default, F.col("ord"))).alias("default_text"),
        F.count_if(F.coalesce("text", F.lit("")) != "").alias("n_texts"),
    )
    loop = F.col("key").isin(*loops) if loops else F.lit(False)
    errors = F.array(
        F.when(loop & (F.col("n_conditions") > 1), "a loop has several conditions"),
        F.when(loop & (F.col("n_texts") > 0), "a loop has a text"),
        F.when(~loop & (F.col("n_defaults") > 1), "several defaults"),
        F.when(~loop & (F.col("n_conditions") > 1) & (F.col("n_defaults") == 0), "no default"),
    )
    default_text = F.when(F.col("n_defaults") > 0, F.col("default_text"))
    return out.select("key", "n_rows", "n_conditions", "n_defaults", default_text.alias("default_text"), F.array_compact(errors).alias("errors"))


def _scope(c: C.Condition) -> set[str]:
    return {x.path.split(".")[0] for x in c.comparisons} & {"quote", "policy"}


def rule_set(rows: list[tuple[str, str, str]], loops: tuple[str, ...] = (), presence: tuple[str, ...] = (), template: tuple[str, ...] = ()) -> RuleSet:
    """Blocks of (key, when, text) rows in their order, and all errors at once.

    A key's rows are tried in turn; a default counts wherever it stands, and of several the last. A loop's blank
    condition drops it: it always shows. template: keys that a template needs; those without rows are errors, and rows
    for other keys too unless another row refers to them.
    """
    out = RuleSet({})
    grouped: dict[str, list[tuple[str, str]]] = {}
    for key, when, text in rows:
        grouped.setdefault(key, []).append(((when or "").strip(), text or ""))
    for key, own in grouped.items():
        kept, defaults = [], []
        for when, text in own:
            if when.lower() in DEFAULT_WHEN:
                defaults.append(text)
                continue
            try:
                kept.append((C.parse(when), text))
            except C.ConditionError as e:
                out.errors.append(f"{key}: {e}")
        scopes = set().union(*(_scope(c) for c, _ in kept))
        if len(scopes) > 1:
            out.errors.append(f"{key}: conditions on {' and '.join(sorted(scopes))}")
        if key in presence:
            out.errors.append(f"{key}: a presence region has no rows")
        elif key in loops:
            if len(kept) > 1:
                out.errors.append(f"{key}: a loop has several conditions")
            if any(t for _, t in own):
                out.errors.append(f"{key}: a loop has a text")
            if not kept:
                out.dropped.append(key)
                continue
        elif len(defaults) > 1:
            out.errors.append(f"{key}: several defaults")
        elif len(kept) > 1 and not defaults:
            out.errors.append(f"{key}: no default")
        out.blocks[key] = Block(key, tuple(kept), defaults[-1] if defaults else None, next(iter(sorted(scopes)), "policy"), "loop" if key in loops else "text")
    refs = {k: b.refs() for k, b in out.blocks.items()}
    for key in template:
        if key not in grouped and key not in presence:
            out.errors.append(f"{key}: no rows")
    if template:
        named = set(template) | {r for rs in refs.values() for r in rs}
        out.errors += [f"{k}: not in the template" for k in out.blocks if k not in named]
    out.errors += [f"{k}: refers to {r}, which has no rows" for k, rs in refs.items() for r in rs if r not in grouped]
    if cycle := find_cycle(refs):
        out.errors.append("a cycle: " + " -> ".join(cycle))
    return out


def with_variants(records: DataFrame, rules: RuleSet, scope: str = "policy", prefix: str = "") -> DataFrame:
    """records with a column for each block: text, or a boolean for loops and show-or-hide blocks.

    The first row whose condition holds gives the text. With none, the default; one space where there is none, or an
    empty one. A block of another scope is one space, or false. Blocks that refer to others come after them, in a
    projection of their own, so that no text is computed twice.
    """
    if rules.errors:
        raise C.ConditionError("; ".join(rules.errors))
    bad = [e for b in rules.blocks.values() for c, _ in b.rows if b.scope == scope for e in C.check(c, records.schema)]
    if bad:
        raise C.ConditionError("; ".join(bad))
    df = records
    for key in ordered({k: b.refs() for k, b in rules.blocks.items()}):
        block = rules.blocks[key]
        df = df.withColumn(prefix + key, block_column(block, df.schema, scope, prefix))
    return df


def block_column(block: Block, schema: T.StructType, scope: str, prefix: str = "") -> Column:
    yes = block.kind == "loop" or (block.shows and not block.rows[0][1])
    if block.scope != scope:
        return F.lit(False) if yes else F.lit(" ")
    if yes:
        return C.compile_value(block.rows[0][0], schema)
    text = lambda t: interpolate(re.sub(NESTED, lambda m: "{" + prefix + m[1] + "}", t), schema)
    column = None
    for condition, t in block.rows:
        when = F.when if column is None else column.when
        column = when(C.compile_value(condition, schema), text(t))
    default = text(block.default) if block.default else F.lit(" ")
    return default if column is None else column.otherwise(default)
