"""JSON text to typed columns.

Objects are flattened to leaves named by dots, nested ones with a leading ``~`` that tells them from literal
dotted keys. A leaf name with several types becomes a column for each type, and columns whose names Spark could not tell apart get a
number; the field list keeps the names as they are. Arrays stay JSON text, or become columns
of their elements with ``structured``. Discovery parses a record once for every ``LEVELS`` levels of nesting; only the
list of (path, type) reaches the driver. Two bounds keep that list and the plan small without losing a value: an object below ``depth`` levels, and
one with more than ``wide`` keys over all records (keyed by ids, say), stays JSON text of type ``object``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from ..functions.detect import string_type
from ..plans.resolver import Field, physical_names, quoted

DEPTH = 32
WIDE = 2000
LEVELS = 3


@dataclass(frozen=True)
class Leaf:
    path: tuple[str, ...]  # keys; array elements are "[i]"
    name: str
    type: str
    occurrences: int


def parse_json(col: Column) -> Column:
    return F.try_parse_json(col)


#: Types by the head of a value's VARIANT schema.
CLASSES = {"BIGINT": "int", "DECIMAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "bool", "VOID": "null", "ARRAY": "array", "OBJECT": "object", "STRING": "string"}


def _head(v: Column) -> Column:
    return F.substring_index(F.substring_index(F.call_function("schema_of_variant", v), "<", 1), "(", 1)


def _is(item: Column, kind: str) -> Column:
    return F.call_function("schema_of_variant", item).rlike(f"^(?:{'|'.join(h for h, k in CLASSES.items() if k == kind)})")


def _typed(level: DataFrame, timestamp_fields: Iterable[str]) -> DataFrame:
    """``(path, type)`` of a level's values."""
    text = F.try_variant_get("v", "$", "string")
    detected = string_type(text)
    names = list(timestamp_fields)
    if names:
        leaf = F.concat(F.when(F.size("path") > 1, "~").otherwise(""), F.array_join("path", "."))
        detected = F.when(leaf.isin(*names), "timestamp").otherwise(detected)
    return level.select("path", F.when(F.col("head") == "STRING", detected).otherwise(F.col("head")).alias("type"))


#: The name of a record that is one field because it has too many keys.
RECORD = "_record"


def name_of(path: tuple[str, ...]) -> str:
    if not path:
        return RECORD
    out = path[0]
    for part in path[1:]:
        out += part if part.startswith("[") else f".{part}"
    nested = any(not p.startswith("[") for p in path[1:])
    return f"~{out}" if nested else out


def discover(
    frame: DataFrame, column: str, timestamp_fields: Iterable[str] = (), structured: bool = False, depth: int = DEPTH, wide: int = WIDE
) -> list[Leaf]:
    """All leaves of a VARIANT column, sorted by name and type."""
    whole: set[tuple[str, ...]] = set()  # objects that stay text
    while True:
        found, crowded = _explore(frame, column, timestamp_fields, structured, depth, wide, whole)
        if not crowded:
            break
        whole |= crowded
    counts: dict[tuple, int] = {}
    for path, kind, n in found:
        key = path, CLASSES.get(kind, kind.lower())
        counts[key] = counts.get(key, 0) + n
    return sorted((Leaf(path, name_of(path), kind, n) for (path, kind), n in counts.items()), key=lambda x: (x.name, x.type, x.path))


_KEY = "\x1f"


def _explore(frame: DataFrame, column: str, timestamp_fields, structured: bool, depth: int, wide: int, whole: set) -> tuple[list, set]:
    """(path, type, count) of all leaves, and the objects with more than ``wide`` keys."""
    into = ("OBJECT", "ARRAY") if structured else ("OBJECT",)
    level = frame.select(F.array().cast("array<string>").alias("path"), F.col(column).alias("v")).withColumn("head", _head(F.col("v")))
    # A record is an object; its own arrays, where it is none, are not explored.
    level = level.where("head = 'OBJECT'")
    found: list = []
    at = 0
    while True:
        steps = min(LEVELS, depth - at)
        for _ in range(steps):
            level = _descend(level, into, whole)
        at += steps
        # What is still to be opened is an object deeper than these levels; leaves were passed on as they were.
        kinds = _typed(level.where("head is not null"), timestamp_fields).groupBy("path", "type").count()
        rows = kinds.limit(wide * 8 + 1).collect()
        if len(rows) > wide * 8:
            steps = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.struct(F.slice("path", 1, i - 1).alias("parent"), F.get("path", i - 1).alias("key"))))
            members = kinds.select("path").distinct().select(steps.alias("s")).select("s.*").distinct().groupBy("parent").count()
            crowded = _outermost({tuple(r["parent"]) for r in members.where(F.col("count") > wide).collect()}) - whole
        else:
            members: dict[tuple, set] = {}
            for r in rows:
                for i, key in enumerate(r["path"]):
                    members.setdefault(tuple(r["path"][:i]), set()).add(key)
            crowded = _outermost({parent for parent, keys in members.items() if len(keys) > wide}) - whole
        if crowded:
            return [], crowded
        if len(rows) > wide * 8:
            rows = kinds.collect()  # many fields, but no object has more than ``wide`` of them
        deeper = False
        for r in rows:
            path = tuple(r["path"])
            if r["type"] in into and path not in whole and at < depth:
                deeper = True
            else:
                found.append((path, r["type"], r["count"]))
        if not deeper:
            return found, set()
        level = level.where(F.col("head").isin(*into) & ~_among(whole))


def _outermost(paths: set[tuple[str, ...]]) -> set[tuple[str, ...]]:
    return {p for p in paths if not any(p[:i] in paths for i in range(len(p)))}


def _among(paths: set) -> Column:
    return F.array_join("path", _KEY).isin(*[_KEY.join(p) for p in paths]) if paths else F.lit(False)


def _descend(level: DataFrame, into: tuple[str, ...], whole: set) -> DataFrame:
    """Objects give way to their members, everything else stays; objects without members are dropped.

    What follows an explode cannot be pushed below it, so nothing is parsed twice.
    """
    opened = F.col("head").isin(*into) & ~_among(whole)
    spread = level.withColumn("o", F.when(opened, F.col("v"))).lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("o").outer()))
    key = F.coalesce("key", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    member = key.isNotNull()
    spread = spread.where(F.col("o").isNull() | member).select(
        F.when(member, F.concat("path", F.array(key))).otherwise(F.col("path")).alias("path"),
        F.when(member, F.col("value")).otherwise(F.col("v")).alias("v"),
        F.when(~member, F.col("head")).alias("head"),
    )
    return spread.withColumn("head", F.coalesce("head", _head(F.col("v"))))


_SPARK = {"int": "bigint", "double": "double", "bool": "boolean"}


def value_at(source: Column, path: Iterable[str], kind: str = "variant") -> Column:
    """The value at a path of keys and ``[i]``, cast to ``kind``; null where it is missing or cannot be cast."""
    steps, at = "$", source
    for part in path:
        if part.startswith("["):
            steps += part
        elif "'" not in part:
            steps += f"['{part}']"
        elif '"' not in part:
            steps += f'["{part}"]'
        else:  # a path cannot spell a key with both kinds of quotes
            at = F.try_variant_get(at, steps, "map<string,variant>").getItem(part)
            steps = "$"
    return F.try_variant_get(at, steps, kind)


def column_of(source: str, leaf: Leaf, timestamp_fields: Iterable[str] = (), only: bool = False) -> Column:
    """The typed column of a leaf; null where the row has another type. ``only``: no row has another type, so none is looked at."""
    item = value_at(F.col(source), leaf.path)
    if leaf.type == "null":
        return F.lit(None).cast("string")
    if leaf.type in ("array", "object"):
        value = F.to_json(item)
    else:
        value = value_at(F.col(source), leaf.path, _SPARK.get(leaf.type, "string"))
    if only:
        return value
    if leaf.type in ("array", "object", *_SPARK):
        return F.when(_is(item, leaf.type), value)
    return F.when(_is(item, "string") & (string_type(value, leaf.name, timestamp_fields) == leaf.type), value)


def flatten(
    frame: DataFrame, column: str, keep: Iterable[str] = (), timestamp_fields: Iterable[str] = (), structured: bool = False,
    leaves: list[Leaf] | None = None, prefix: str = "",
) -> tuple[DataFrame, list[Field], list[Leaf]]:
    """The wide typed frame of a column of JSON text, or of VARIANT, its fields, and the leaves found.

    ``leaves`` given from elsewhere are not trusted: each value's type is looked at. ``keep`` are columns that stay in front. A name with several types
    has a column ``name__type`` for each; names that differ in nothing but case, and other columns of one name, get a number. ``prefix`` goes before
    every name, as ``props.``.
    """
    keep = list(keep)
    given = F.col(quoted(column))
    # Parsed once: what comes later, filters above all, cannot be pushed below the explode of one element.
    parsed = frame.withColumn("_v", given if isinstance(frame.schema[column].dataType, VariantType) else F.explode(F.array(parse_json(given))))
    found_here = leaves is None
    leaves = discover(parsed, "_v", timestamp_fields, structured) if found_here else leaves
    names = [leaf.name for leaf in leaves if leaf.type != "null"]
    leaves = [leaf for leaf in leaves if leaf.type != "null" or leaf.name not in names]
    shown = [prefix + leaf.name.lstrip("~") if prefix else leaf.name for leaf in leaves]
    physical = physical_names([(name, leaf.type) for name, leaf in zip(shown, leaves)], keep)
    columns = [
        column_of("_v", leaf, timestamp_fields, only=found_here and names.count(leaf.name) <= 1).alias(name) for leaf, name in zip(leaves, physical)
    ]
    fields = [Field(name, leaf.type, column) for name, leaf, column in zip(shown, leaves, physical)]
    return parsed.select(*[F.col(quoted(c)) for c in keep], *columns), fields, leaves


def extract(source: str, path: tuple[str, ...] | str, kind: str = "string") -> Column:
    """A value of a VARIANT column by path, as ``a.b[0].c`` or keys; null where it is missing or of another type."""
    if isinstance(path, str):
        parts: list[str] = []
        for piece in path.split("."):
            head, *indexes = piece.replace("[", "\0[").split("\0")
            parts += ([head] if head else []) + indexes
        path = tuple(parts)
    return value_at(F.col(source), path, kind)
