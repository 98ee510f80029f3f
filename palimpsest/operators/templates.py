"""Templates: text with fields, loops and regions, compiled to one string column.

{a.b} is a field, required; {$a.b} an optional one, empty where null. [Name/] ... [/Name] repeats its body for each
element of a list; [Name?] ... [/Name] shows its body where a boolean or struct is there. Within a loop, paths that begin
with the loop's variable are the element's.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FIELD, MARKER
from .conditions import leaf_type

Leaf = Callable[[str], Column]


@dataclass(frozen=True)
class Loop:
    """A loop's list (a path of the record) and the variable that its body calls an element."""

    items: str
    variable: str


@dataclass(frozen=True)
class Part:
    kind: str  # text | field | loop | region
    value: str
    mark: str = ""
    body: tuple[Part, ...] = ()


def parse(template: str) -> tuple[list[Part], list[str]]:
    """Parts, and warnings: markers that are not closed, or close nothing."""
    warnings: list[str] = []
    stack: list[tuple[str, str, list]] = [("", "", [])]
    at = 0
    for m in re.finditer(f"(?P<marker>{MARKER})|(?P<field>{FIELD})", template):
        if m.start() > at:
            stack[-1][2].append(Part("text", template[at : m.start()]))
        at = m.end()
        if m["field"]:
            stack[-1][2].append(Part("field", m[7], m[6]))
            continue
        slash, name, end = m[2], m[3], m[4]
        if slash:
            if any(s[1] == name for s in stack[1:]):
                while stack[-1][1] != name:
                    kind, lost, body = stack.pop()
                    warnings.append(f"{lost} is not closed")
                    stack[-1][2].extend(body)
                kind, _, body = stack.pop()
                stack[-1][2].append(Part(kind, name, "", tuple(body)))
            else:
                warnings.append(f"{name} closes nothing")
        elif end:
            stack.append(("loop" if end == "/" else "region", name, []))
        else:
            stack[-1][2].append(Part("text", m[0]))
            warnings.append(f"{m[0]} is neither a loop nor a region")
    if at < len(template):
        stack[-1][2].append(Part("text", template[at:]))
    while len(stack) > 1:
        _, lost, body = stack.pop()
        warnings.append(f"{lost} is not closed")
        stack[-1][2].extend(body)
    return stack[0][2], warnings


def shown(value: Column, t: T.DataType | None) -> Column:
    """Text of a value: decimals in their scale, dates and times as ISO has them, doubles as decimals of two places."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return value.cast("decimal(28,2)").cast("string")
    return value.cast("string")


def _leaf(schema: T.StructType, variables: dict[str, tuple[Column, T.DataType]]) -> Callable[[str], tuple[Column, T.DataType | None]]:
    def leaf(path: str) -> tuple[Column, T.DataType | None]:
        first, *rest = path.split(".")
        if first in variables:
            column, kind = variables[first]
            for p in rest:
                column = column[p]
            return column, leaf_type(T.StructType([T.StructField(first, kind)]), path)
        return F.col(".".join(f"`{p}`" for p in path.split("."))), leaf_type(schema, path)

    return leaf


def render(parts: list[Part] | tuple[Part, ...], schema: T.StructType, loops: dict[str, Loop] | None = None, variables: dict | None = None, strict: bool = False) -> Column:
    """A column of the text. strict: a required field that is null stops the job; else it is empty."""
    loops, variables = loops or {}, variables or {}
    leaf, out = _leaf(schema, variables), []
    for p in parts:
        if p.kind == "text":
            out.append(F.lit(p.value))
        elif p.kind == "field":
            column, kind = leaf(p.value)
            text = shown(column, kind)
            missing = F.raise_error(F.lit(f"{p.value} is required")).cast("string") if strict and p.mark in ("", "+") else F.lit("")
            out.append(F.coalesce(text, missing))
        elif p.kind == "region":
            column, kind = leaf(p.value)
            there = F.coalesce(column, F.lit(False)) if isinstance(kind, T.BooleanType) else column.isNotNull()
            out.append(F.when(there, render(p.body, schema, loops, variables, strict)).otherwise(F.lit("")))
        else:
            loop = loops[p.value]
            items, kind = leaf(loop.items)
            if not isinstance(kind, T.ArrayType):
                raise ValueError(f"{loop.items} is not a list")
            body = _body(p.body, schema, loops, variables, loop.variable, kind.elementType, strict)
            out.append(F.coalesce(F.array_join(F.transform(items, body), ""), F.lit("")))
    return F.concat(*out) if out else F.lit("")


def _body(parts, schema, loops, variables, name, kind, strict) -> Callable[[Column], Column]:
    return lambda item: render(parts, schema, loops, variables | {name: (item, kind)}, strict)


def compile_template(template: str, schema: T.StructType, loops: dict[str, Loop] | None = None, strict: bool = False) -> Column:
    return render(parse(template)[0], schema, loops, None, strict)


def interpolate(text: str, schema: T.StructType) -> Column:
    """Text with fields; nulls are empty."""
    parts, at = [], 0
    for m in re.finditer(FIELD, text):
        parts += [Part("text", text[at : m.start()])] if m.start() > at else []
        parts.append(Part("field", m[2], "$"))
        at = m.end()
    parts += [Part("text", text[at:])] if at < len(text) else []
    return render(parts, schema)


def guarded(block: Column, values: list[Column]) -> Column:
    """A block that names several optional values, empty where any is null; of one alone, the block as it is."""
    if len(values) < 2:
        return block
    there = values[0].isNotNull()
    for v in values[1:]:
        there = there & v.isNotNull()
    return F.when(there, block).otherwise(F.lit(""))
