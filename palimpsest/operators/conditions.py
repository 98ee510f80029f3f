"""The condition language: text to a checked tree to Spark columns.

comparison (and comparison)* | comparison (or comparison)*, without brackets. A comparison is `path present`,
`path absent`, `path in [literal, ...]`, or `path op literal` with == != > >= < <=. `path == null` means absent,
`path != null` present. Every comparison is two-valued: a null leaf, or a null anywhere on the way to it, makes all false
but `absent` and `!=`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNARY = ("present", "absent")
ORDER = (">", ">=", "<", "<=")
JOINS = ("and", "or")
#: Roots that a condition of a scope may name.
SCOPE_ROOTS = {"quote": {"quote"}, "policy": {"policy"}}
#: Literals, operators and words of the language (fixed by its grammar, SURVEY 8.5).
_LEX = re.compile(r"""\s*(?:(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<op>[=!<>]=|[<>])|(?P<mark>[\[\],])|(?P<number>-?\d+(?:\.\d+)?)|(?P<word>[A-Za-z_][\w.]*))""")


class ConditionError(ValueError):
    pass


@dataclass(frozen=True)
class Comparison:
    path: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Condition:
    comparisons: tuple[Comparison, ...] = ()
    join: str = "and"


class _Reader:
    def __init__(self, text: str):
        self.text, self.items, at = text, [], 0
        while text[at:].strip():
            if not (m := _LEX.match(text, at)):
                raise ConditionError(f"unexpected {text[at:].strip()[0]!r} at {at} in {text!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def next(self, what: str) -> tuple[str, str]:
        if self.at == len(self.items):
            raise ConditionError(f"{what} expected at the end of {self.text!r}")
        self.at += 1
        return self.items[self.at - 1]

    def more(self) -> bool:
        return self.at < len(self.items)

    def literal(self) -> object:
        kind, text = self.next("a literal")
        if kind == "string":
            return re.sub(r"\\([\"'\\])", r"\1", text[1:-1])
        if kind == "number":
            return Decimal(text) if "." in text else int(text)
        if kind == "word" and text.lower() in ("true", "false"):
            return text.lower() == "true"
        raise ConditionError(f"a literal expected, not {text!r}, in {self.text!r}")

    def comparison(self) -> Comparison:
        kind, path = self.next("a path")
        if kind != "word" or path.lower() in (*UNARY, *JOINS, "in"):
            raise ConditionError(f"a path expected, not {path!r}, in {self.text!r}")
        kind, op = self.next("an operator")
        op = op.lower()
        if op in UNARY:
            return Comparison(path, op)
        if op == "in":
            return Comparison(path, op, tuple(self.list()))
        if kind != "op":
            raise ConditionError(f"an operator expected, not {op!r}, in {self.text!r}")
        if op in ("==", "!=") and self.more() and self.items[self.at][0] == "word" and self.items[self.at][1].lower() in ("null", "nil", "none"):
            self.at += 1
            return Comparison(path, "absent" if op == "==" else "present")
        return Comparison(path, op, self.literal())

    def list(self):
        if self.next("a list")[1] != "[":
            raise ConditionError(f"'in' needs a list in {self.text!r}")
        if self.more() and self.items[self.at][1] == "]":
            raise ConditionError(f"an empty list in {self.text!r}")
        while True:
            yield self.literal()
            end = self.next("',' or ']'")[1]
            if end == "]":
                return
            if end != ",":
                raise ConditionError(f"',' or ']' expected in {self.text!r}")


def parse(text: str) -> Condition:
    read = _Reader((text or "").strip())
    if not read.items:
        raise ConditionError("an empty condition")
    found, joins = [read.comparison()], set()
    while read.more():
        word = read.next("'and' or 'or'")[1].lower()
        if word not in JOINS:
            raise ConditionError(f"'and' or 'or' expected, not {word!r}, in {text!r}")
        joins.add(word)
        found.append(read.comparison())
    if len(joins) > 1:
        raise ConditionError(f"'and' and 'or' in one condition: {text!r}")
    return Condition(tuple(found), joins.pop() if joins else "and")


def to_json(c: Condition) -> str:
    """Decimals are written as {"decimal": digits}, so that none changes on the way."""
    plain = lambda v: [plain(x) for x in v] if isinstance(v, tuple) else {"decimal": str(v)} if isinstance(v, Decimal) else v
    return json.dumps({"join": c.join, "comparisons": [{"path": x.path, "op": x.op, "value": plain(x.value)} for x in c.comparisons]})


def from_json(text: str) -> Condition:
    """A tree from to_json, or from {"raw": text}."""
    d = json.loads(text)
    if "comparisons" not in d:
        return parse(d["raw"])
    value = lambda v: tuple(value(x) for x in v) if isinstance(v, list) else Decimal(v["decimal"]) if isinstance(v, dict) else v
    return Condition(tuple(Comparison(x["path"], x["op"], value(x["value"])) for x in d["comparisons"]), d["join"])


# --- checking --------------------------------------------------------------------------------------------------------


def leaf_type(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a dotted path, following structs without regard to case as Spark does; None if it isn't there."""
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType):
            return None
        kind = next((f.dataType for f in kind if f.name.lower() == part.lower()), None)
        if kind is None:
            return None
    return kind


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "string" if isinstance(t, T.StringType) else "object"


def _literal_kind(v: object) -> str:
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float, Decimal)) else "string"


def check(c: Condition, schema: T.StructType, scope: str | None = None) -> list[str]:
    """All that is wrong with a condition over records of a schema; an out-of-scope root ends its comparison's checks."""
    errors = []
    for x in c.comparisons:
        root = x.path.split(".")[0]
        if scope and root not in SCOPE_ROOTS.get(scope, {root}):
            errors.append(f"{x.path}: {root} is not in scope {scope}")
            continue
        t = leaf_type(schema, x.path)
        if t is None:
            errors.append(f"{x.path}: no such field")
            continue
        field = kind_of(t)
        if x.op in UNARY or field == "object":
            continue
        if x.op == "in":
            if field == "number" and any(_literal_kind(v) != "number" for v in x.value):
                errors.append(f"{x.path}: a number's list holds other literals")
            continue
        given = _literal_kind(x.value)
        if x.op in ORDER and field not in ("number", "date"):
            errors.append(f"{x.path}: {x.op} needs a number or a date")
        elif field == "number" and given != "number":
            errors.append(f"{x.path}: a number is compared with a {given}")
        elif field == "boolean" and given != "boolean":
            errors.append(f"{x.path}: a boolean is compared with a {given}")
        elif field in ("string", "date") and given != "string":
            errors.append(f"{x.path}: a {field} is compared with a {given}")
    return errors


# --- columns ---------------------------------------------------------------------------------------------------------


def at(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def _literal(v: object, t: T.DataType | None) -> Column:
    if t is not None and kind_of(t) == "date":
        return F.lit(str(v)).cast(t)
    return F.lit(v)


def _in(leaf: Column, values: tuple, t: T.DataType | None, strict: bool) -> Column:
    if not strict and t is not None and kind_of(t) == "number":
        return leaf.isin(*(v for v in values if _literal_kind(v) == "number"))
    text = [str(v).lower() if isinstance(v, bool) else str(v) for v in values]
    return leaf.cast("string").isin(*text)


def _compare(x: Comparison, leaf: Column, t: T.DataType | None, strict: bool, truthy: bool) -> Column:
    """Null where Spark's logic is: for filters. compile_value makes it two-valued."""
    if x.op in UNARY:
        there = F.coalesce(leaf, F.lit(False)) if truthy and t is not None and kind_of(t) == "boolean" else leaf.isNotNull()
        return there if x.op == "present" else ~there
    if x.op == "in":
        return _in(leaf, x.value, t, strict)
    value = _literal(x.value, t)
    return {"==": lambda: leaf == value, "!=": lambda: ~leaf.eqNullSafe(value), ">": lambda: leaf > value, ">=": lambda: leaf >= value, "<": lambda: leaf < value, "<=": lambda: leaf <= value}[x.op]()


def _joined(parts: list[Column], join: str) -> Column:
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if join == "and" else (lambda a, b: a | b), parts)


def compile_value(c: Condition, schema: T.StructType, leaf: Callable[[str], Column] = at, strict: bool = False, truthy: bool = False) -> Column:
    """True or false, never null. strict: `in` compares texts, so a decimal's scale counts. truthy: a false boolean
    counts as absent, as it does for the elements of a list."""
    return _joined([F.coalesce(_compare(x, leaf(x.path), leaf_type(schema, x.path), strict, truthy), F.lit(False)) for x in c.comparisons], c.join)


def compile_filter(c: Condition, schema: T.StructType, strict: bool = False) -> Column:
    """For where(): keeps the same rows as compile_value, without the coalesce that would keep it from the scan."""
    return _joined([_compare(x, at(x.path), leaf_type(schema, x.path), strict, False) for x in c.comparisons], c.join)


def compile_element(c: Condition, element: T.StructType, variable: str) -> Callable[[Column], Column]:
    """A function of an array's element. Paths begin with the variable's name, which is the element."""
    own = T.StructType([T.StructField(variable, element)])

    def of(item: Column) -> Column:
        def leaf(path: str) -> Column:
            out = item
            for part in path.split(".")[1:]:
                out = out[part]
            return out

        return compile_value(c, own, leaf, truthy=True)

    return of


def legacy(expression: str, scope: str) -> Condition:
    """An old-style expression: policy.data. stands for the segment's custom fields; otherwise the same language."""
    return parse(expression if scope == "quote" else re.sub(r"\bsegment\.data\.", "policy.data.", expression))


def checked(written: DataFrame, schema: T.StructType, scope: str | None = None, column: str = "condition") -> DataFrame:
    """written with readable, and problems (what is wrong, empty if nothing) of each condition text over records of a schema."""
    ddl = T.StructType([*written.schema.fields, T.StructField("readable", T.BooleanType()), T.StructField("problems", T.ArrayType(T.StringType()))])

    def judged(text):
        try:
            return True, check(parse(text), schema, scope)
        except ConditionError as e:
            return False, [str(e)]

    def run(batches):
        for batch in batches:
            known = {text: judged(text) for text in batch[column].unique()}  # sheets repeat their conditions
            told = [known[text] for text in batch[column]]
            yield batch.assign(readable=[r for r, _ in told], problems=[p for _, p in told])

    return written.mapInPandas(run, ddl)
