"""Names, types and literals to Spark columns.

A field is a name and a type; one name may have several. Without a type hint a predicate holds if it
holds for any of the name's types that the literal can be read as. Nulls follow SQL: a predicate on a missing value is neither true
nor false, and neither is its negation.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.templates import log_template, timestamp_template
from . import parser as P

NUMERIC = ("int", "double")
TEXT = ("string", "logtype", "timestamp", "array", "object")
_INT = re.compile(r"[+-]?\d+")
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


class ResolveError(ValueError):
    """A field is unknown or a literal does not fit it."""


@dataclass(frozen=True)
class Field:
    """``name`` as users write it (nested ones begin with ``~``), its type, and the physical column."""

    name: str
    type: str
    column: str
    native: bool = False  # a TIMESTAMP column of Spark's own type rather than text

    def col(self) -> Column:
        return F.col(quoted(self.column))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def physical_names(fields: Sequence[tuple[str, str]], taken: Iterable[str] = ()) -> list[str]:
    """A column for each (name, type): the name, or ``name__type`` where it has several types; a number follows where Spark, which
    does not tell capitals from small letters, has that column already."""
    times = Counter(name for name, _ in fields)
    used = {t.lower() for t in taken}
    # Names of one type come first, so that a field ``x__int`` keeps its name beside the types of ``x``.
    order = sorted(range(len(fields)), key=lambda i: times[fields[i][0]] > 1)
    out = [""] * len(fields)
    for i in order:
        name, kind = fields[i]
        base = name if times[name] == 1 else f"{name}__{kind}"
        column, n = base, 1
        while column.lower() in used:
            n += 1
            column = f"{base}__{n}"
        used.add(column.lower())
        out[i] = column
    return out


def type_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(data_type, T.ArrayType):
        return "array"
    if isinstance(data_type, T.NullType):
        return "null"
    return "string"


def fields_of(df: DataFrame) -> list[Field]:
    """The fields of a plain DataFrame."""
    return [Field(f.name, type_of(f.dataType), f.name, isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))) for f in df.schema.fields]


class Resolver:
    def __init__(self, fields: Iterable[Field], null_is_different: bool = False):
        self.fields = list(fields)
        self.null_is_different = null_is_different

    # --- names ---------------------------------------------------------------------------------

    def find(self, name: str, kind: str | None = None) -> list[Field]:
        """Fields of a name: the literal name first, then the nested one, then by wildcards."""
        wanted = {"template": None, "dict": None}.get(kind, kind)
        for spelled in (name, f"~{name}"):
            found = [f for f in self.fields if f.name == spelled]
            if found:
                break
        else:
            found = []
            if "*" in name:
                pattern = re.compile("".join("[^.]*" if p == "*" else re.escape(p) for p in re.split(r"(\*)", name)))
                tail = re.compile(".*" + pattern.pattern[len("[^.]*") :]) if name.startswith("*") else pattern
                found = [f for f in self.fields if tail.fullmatch(f.name.lstrip("~"))]
        if not found:
            raise ResolveError(f"no field {name!r}; fields are {sorted({f.name for f in self.fields})[:50]}")
        if wanted is not None:
            typed = [f for f in found if f.type == wanted]
            if not typed:
                raise ResolveError(f"{name!r} is {', '.join(sorted({f.type for f in found}))}, not {wanted}")
            found = typed
        return found

    def columns(self, name: str) -> list[str]:
        return [f.column for f in self.find(name)]

    def value(self, name: str) -> Column:
        """One column of a name: its only type's column, or the text of whichever type a row has."""
        found = self.find(name)
        if len(found) == 1:
            return found[0].col()
        return F.coalesce(*[f.col().cast("string") for f in found])

    def number(self, name: str) -> Column:
        """A name as doubles; values that are no numbers are null."""
        out = [f.col().cast("double") if f.type in NUMERIC else f.col().try_cast("double") for f in self.find(name) if f.type not in ("array", "object", "bool") and not f.native]
        return F.coalesce(*out) if out else F.lit(None).cast("double")

    # --- literals ------------------------------------------------------------------------------

    def literal(self, field: Field, text: str):
        """The literal in the field's type, or None if it cannot be read as one."""
        if field.type == "int":
            if _INT.fullmatch(text) and -(1 << 63) <= int(text) < 1 << 63:
                return F.lit(int(text)).cast("bigint")
            return F.lit(float(text)) if _FLOAT.fullmatch(text) else None
        if field.type == "double":
            return F.lit(float(text)) if _FLOAT.fullmatch(text) else None
        if field.type == "bool":
            return F.lit(text == "true") if text in ("true", "false") else None
        if field.type == "null":
            return None
        if field.native:
            return F.lit(text).cast("timestamp") if re.match(r"\d{4}-\d{2}-\d{2}", text) else None
        return F.lit(text)

    # --- predicates ----------------------------------------------------------------------------

    def _one(self, f: Field, p: P.Predicate) -> Column | None:
        col = f.col()
        if p.op == "exists":
            return col.isNotNull()
        if p.type == "template":
            made = timestamp_template(col) if f.type == "timestamp" else log_template(col)
            return made == F.lit(p.values[0])
        if p.op in ("matches", "~", "!~"):
            text = col.cast("string")
            if p.op == "matches":
                return text.rlike("(?s)^" + "".join(".*" if c == "*" else _quote(c) for c in re.split(r"(\*)", p.values[0]) if c) + "$")
            return text.contains(p.values[0]) if p.op == "~" else ~text.contains(p.values[0])
        values = [self.literal(f, v) for v in p.values]
        if any(v is None for v in values):
            return None
        if p.op == "range":
            return col.between(*values)
        if p.op == "!=" and self.null_is_different:
            return ~col.eqNullSafe(values[0])
        compare = {"=": col.__eq__, "!=": col.__ne__, ">": col.__gt__, ">=": col.__ge__, "<": col.__lt__, "<=": col.__le__}[p.op]
        return compare(values[0])

    def predicate(self, p: P.Predicate) -> Column:
        found = self.find(p.field, p.type)
        held = [c for c in (self._one(f, p) for f in found) if c is not None]
        if not held:
            raise ResolveError(f"{' or '.join(repr(v) for v in p.values)} is no {' or '.join(sorted({f.type for f in found}))} for {p.field!r}")
        if len(found) == 1:
            return held[0]
        if p.op in ("!=", "!~"):
            return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(True)) for c in held]) & F.coalesce(*[f.col().cast("string") for f in found]).isNotNull()
        # A row has one of the types; the columns of the others are null there.
        present = F.coalesce(*[f.col().cast("string") for f in found]).isNotNull()
        any_ = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in held])
        return any_ if p.op == "exists" else F.when(present, any_)

    def condition(self, node) -> Column:
        if isinstance(node, P.Predicate):
            return self.predicate(node)
        if isinstance(node, P.And):
            return self.condition(node.left) & self.condition(node.right)
        if isinstance(node, P.Or):
            return self.condition(node.left) | self.condition(node.right)
        if isinstance(node, P.Not):
            return ~self.condition(node.child)
        raise ResolveError(f"{type(node).__name__} is no condition")


def _quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def split_aggregates(node) -> tuple[object | None, list[P.Aggregate]]:
    """The condition and the aggregates of a tree in which aggregates stand alone or are joined by AND."""
    if isinstance(node, P.Aggregate):
        return None, [node]
    if isinstance(node, P.And):
        left, a = split_aggregates(node.left)
        right, b = split_aggregates(node.right)
        both = left if right is None else right if left is None else P.And(left, right)
        return both, a + b
    if isinstance(node, (P.Or, P.Not, P.GroupBy)):
        children = [node.left, node.right] if isinstance(node, P.Or) else [node.child]
        if any(split_aggregates(c)[1] for c in children) or isinstance(node, P.GroupBy):
            raise P.QueryError("aggregates combine with conditions by AND only")
    return node, []
