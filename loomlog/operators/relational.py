"""Filters, aggregates, groups and rebuilt rows over catalogued fields."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import parser as P
from ..plans.resolver import NUMERIC, Resolver, quoted, split_aggregates

# --- filters ---------------------------------------------------------------------------------------


def point(df: DataFrame, r: Resolver, field: str, value: str, kind: str | None = None) -> DataFrame:
    """Rows whose field equals the value."""
    return df.where(r.predicate(P.Predicate(field, "=", (value,), kind)))


def text_point(df: DataFrame, r: Resolver, field: str, value: str) -> DataFrame:
    """Rows whose field, of whatever type, reads as the value."""
    return df.where(r.value(field).cast("string") == value)


def between(df: DataFrame, r: Resolver, field: str, low: str, high: str, kind: str | None = None) -> DataFrame:
    """Rows in the inclusive range: by number for numbers, by time for timestamps, else by text. Reversed bounds give no rows."""
    return df.where(r.predicate(P.Predicate(field, "range", (low, high), kind)))


def lexicographic_between(df: DataFrame, r: Resolver, field: str, low: str, high: str) -> DataFrame:
    """The range over the text of any value, numbers included."""
    return df.where(r.value(field).cast("string").between(low, high))


# --- aggregates ------------------------------------------------------------------------------------


def aggregate_column(r: Resolver, function: str, field: str | None, skip_empty: bool = False) -> Column:
    """COUNT counts values that are there; the others work on numbers and skip what is none.

    MIN and MAX of one numeric type keep it; all other results are doubles. ``skip_empty`` leaves out empty strings when counting.
    """
    if function == "COUNT":
        if field is None:
            return F.count(F.lit(1))
        value = r.value(field)
        return F.count(F.when(value.cast("string") != "", value)) if skip_empty else F.count(value)
    found = r.find(field)
    value = found[0].col() if len(found) == 1 and found[0].type in NUMERIC else r.number(field)
    made = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[function](value)
    return made.cast("double") if function in ("SUM", "AVG") else made


def label(a: P.Aggregate) -> str:
    return f"{a.function.lower()}_{a.field}" if a.field else a.function.lower()


def aggregate(df: DataFrame, r: Resolver, aggregates: Sequence[P.Aggregate], where: Column | None = None, skip_empty: bool = False) -> DataFrame:
    """One row with a column for each aggregate."""
    df = df if where is None else df.where(where)
    return df.agg(*[aggregate_column(r, a.function, a.field, skip_empty).alias(label(a)) for a in aggregates])


# --- groups ----------------------------------------------------------------------------------------


def _keys(r: Resolver, fields: Iterable[str]) -> list[Column]:
    return [r.value(f).alias(f) for f in fields]


def group(
    df: DataFrame, r: Resolver, fields: Sequence[str], aggregates: Sequence[P.Aggregate] = (), where: Column | None = None, drop_missing: bool = False
) -> DataFrame:
    """Groups with their counts or aggregates. Missing keys are a group of null, or dropped with ``drop_missing``."""
    df = df if where is None else df.where(where)
    if drop_missing:
        for f in fields:
            df = df.where(r.value(f).isNotNull())
    aggregates = aggregates or [P.Aggregate("COUNT")]
    return df.groupBy(*_keys(r, fields)).agg(*[aggregate_column(r, a.function, a.field).alias(label(a)) for a in aggregates])


def group_rows(df: DataFrame, r: Resolver, fields: Sequence[str], where: Column | None = None) -> DataFrame:
    """Every row as JSON beside its group's keys: the members of all groups, one a row, so that a large group stays spread out."""
    df = df if where is None else df.where(where)
    return df.select(*_keys(r, fields), row_json(df).alias("record"))


def group_records(df: DataFrame, r: Resolver, fields: Sequence[str], sample: int, where: Column | None = None) -> DataFrame:
    """Groups with their count and the first ``sample`` records in order of text. ``sample`` is the feature: a printed excerpt."""
    from pyspark.sql import Window

    rows = group_rows(df, r, fields, where)
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*fields).orderBy("record"))).where(F.col("_n") <= sample)
    firsts = ranked.groupBy(*fields).agg(F.array_sort(F.collect_list("record")).alias("records"))
    counts = group(df, r, fields, where=where).select(*[F.col(quoted(f)).alias(f"_k{i}") for i, f in enumerate(fields)], "count")
    on = [F.col(quoted(f)).eqNullSafe(F.col(f"_k{i}")) for i, f in enumerate(fields)]
    return firsts.join(counts, on).drop(*[f"_k{i}" for i in range(len(fields))])


# --- rows ------------------------------------------------------------------------------------------


def row_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A row as JSON: missing values left out, everything escaped."""
    return F.to_json(F.struct(*[F.col(quoted(c)) for c in (columns or df.columns)]))


def distinct_records(df: DataFrame, block: str | None = None) -> DataFrame:
    """Rows as a set: over everything, or within each block."""
    return df.dropDuplicates() if block is None else df.dropDuplicates([block, *[c for c in df.columns if c != block]])


def rebuild(
    df: DataFrame, r: Resolver, required: Sequence[str] = (), columns: Sequence[str] | None = None, descending: bool | None = None, limit: int | None = None
) -> DataFrame:
    """Rows as JSON text. ``required`` keeps rows that have all these fields; ``descending`` sorts by the text; ``limit`` cuts."""
    for f in required:
        df = df.where(r.value(f).isNotNull())
    out = df.select(row_json(df, columns).alias("record"))
    if descending is not None:
        out = out.orderBy(F.desc("record") if descending else F.asc("record"))
    return out if limit is None else out.limit(limit)


def project(df: DataFrame, r: Resolver, fields: Sequence[str]) -> DataFrame:
    return df.select(*_keys(r, fields))


# --- queries ---------------------------------------------------------------------------------------


def run(df: DataFrame, r: Resolver, text: str) -> DataFrame:
    """A query of the query language: rows, one row of aggregates, or groups."""
    tree = P.parse(text)
    if isinstance(tree, P.GroupBy):
        condition, aggregates = split_aggregates(tree.child)
        where = None if condition is None else r.condition(condition)
        return group(df, r, tree.fields, [*aggregates, *tree.aggregates], where)
    condition, aggregates = split_aggregates(tree)
    where = None if condition is None else r.condition(condition)
    return aggregate(df, r, aggregates, where) if aggregates else df.where(where)
