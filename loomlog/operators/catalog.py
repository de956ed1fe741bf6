"""What fields there are and what they hold.

Statistics of all fields come from one pass that turns each row into (field, type, value) rows; counts are
combined before they are shuffled, and per-value counts are shuffled by field and value, so that no field gathers in one
task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.templates import log_template, log_variables, timestamp_template, timestamp_variables
from ..plans.resolver import TEXT, Field, Resolver
from .flatten import value_at


def field_exists(spark: SparkSession, r: Resolver, asked: Sequence[tuple[str, str | None]]) -> DataFrame:
    """For each (name, expected type): whether it exists, its first type, and whether some type of it matches. Nothing is read."""
    rows = []
    for name, expected in asked:
        found = [(i, f) for i, f in enumerate(r.fields) if f.name == name] or [(i, f) for i, f in enumerate(r.fields) if f.name == f"~{name}"]
        match = bool(found) and (expected is None or any(f.type == expected for _, f in found))
        rows.append((name, bool(found), match, found[0][1].type if found else None, found[0][0] if found else None))
    return spark.createDataFrame(rows, "name string, exists boolean, type_matches boolean, actual_type string, position int")


def key_exists(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Whether any record of a JSON text column has the key; an explicit null counts as there."""
    v = df.select(F.try_parse_json(F.col(column)).alias("v"))
    made = [
        F.coalesce(F.max(value_at(F.col("v"), (k,)).isNotNull()), F.lit(False)).alias(f"e{i}") for i, k in enumerate(keys)
    ]
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"e{i}").alias("exists")) for i, k in enumerate(keys)]))
    return v.agg(*made).select(pairs.alias("p")).select("p.*")


def key_counts(df: DataFrame, column: str) -> DataFrame:
    """``(key, n)``: in how many records of a JSON text column each top-level key is there, explicit nulls included."""
    keys = F.json_object_keys(F.col(column))
    return df.select(F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def browse(df: DataFrame, r: Resolver, field: str, templates: bool = False) -> DataFrame:
    """The distinct values of a field, or the distinct templates of its texts."""
    parts = []
    for f in r.find(field):
        value = f.col()
        if templates and f.type in TEXT:
            value = timestamp_template(value) if f.type == "timestamp" else log_template(value)
        parts.append(value if len(r.find(field)) == 1 else value.cast("string"))
    return df.select(F.coalesce(*parts).alias("value")).where("value is not null").distinct()


def browse_all(df: DataFrame, r: Resolver) -> DataFrame:
    """The distinct strings of all text fields together."""
    texts = [f.col().cast("string") for f in r.fields if f.type in TEXT and not f.native]
    return df.select(F.explode(F.array(*texts)).alias("value")).where("value is not null").distinct()


def lookup(df: DataFrame, r: Resolver, field: str, value: str) -> DataFrame:
    """One row: whether the field holds the value anywhere. Stops at the first."""
    from ..plans.parser import Predicate

    hit = df.where(r.predicate(Predicate(field, "=", (value,)))).select(F.lit(1).alias("one")).limit(1)
    return hit.agg((F.count("one") > 0).alias("found"))


def numbered(df: DataFrame, column: str, name: str = "code", pieces: int = 64) -> DataFrame:
    """Rows with distinct values numbered from 1 in order of a column, in ``pieces`` windows.

    The pieces begin at values of the column, the first ones by hash, so a row's piece and number follow from the values alone and are the same
    when a lost task runs again. The driver sees the bounds, long texts cut, and one count a piece.
    """
    value = F.col(column)
    kind = df.schema[column].dataType
    bound = F.substring(value, 1, 64) if isinstance(kind, StringType) else value
    drawn = df.where(value.isNotNull()).select(bound.alias("b"), F.xxhash64(value).alias("h")).orderBy("h", "b").limit(pieces - 1)
    bounds = F.array(*[F.lit(r["b"]).cast(kind) for r in drawn.select("b").distinct().collect()])
    placed = df.withColumn("_p", F.coalesce(F.size(F.filter(bounds, lambda b: b <= value)), F.lit(0)))
    sizes = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(F.lit(total).cast("bigint"))
        total += sizes.get(p, 0)
    start = F.get(F.array(*before), F.col("_p")) if before else F.lit(0).cast("bigint")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(value.asc_nulls_first()))
    return placed.select(*df.columns, (start + inside).alias(name))


def dictionary(df: DataFrame, r: Resolver, field: str) -> DataFrame:
    """``(code, value)``: the field's distinct values numbered in order; a code is found by a filter."""
    return numbered(browse(df, r, field), "value").select("code", "value")


def template_dictionary(df: DataFrame, r: Resolver, field: str) -> DataFrame:
    """``(template, n)`` of a text field."""
    f = r.find(field)[0]
    made = timestamp_template(f.col()) if f.type == "timestamp" else log_template(f.col())
    return df.where(f.col().isNotNull()).groupBy(made.alias("template")).agg(F.count(F.lit(1)).alias("n"))


def template_codes(df: DataFrame, r: Resolver, field: str) -> DataFrame:
    """``(code, template, n)``: the templates of a text field numbered in order; a filter on the code is the access by code."""
    return numbered(template_dictionary(df, r, field), "template").select("code", "template", "n")


def variable_codes(df: DataFrame, r: Resolver, field: str) -> DataFrame:
    """``(code, variable, n)``: what the templates' stars stand for, numbered in order."""
    found = template_variables(df, r, field).select(F.explode("variables").alias("variable"))
    return numbered(found.groupBy("variable").agg(F.count(F.lit(1)).alias("n")), "variable").select("code", "variable", "n")


def template_variables(df: DataFrame, r: Resolver, field: str, keep: Sequence[str] = ()) -> DataFrame:
    """Each text's template and variables."""
    f = r.find(field)[0]
    cut, took = (timestamp_template, timestamp_variables) if f.type == "timestamp" else (log_template, log_variables)
    return df.select(*keep, cut(f.col()).alias("template"), took(f.col()).alias("variables"))


# --- statistics --------------------------------------------------------------------------------------


def cells(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """``(name, type, value)`` of every cell that is there, values as text."""
    parts = [F.struct(F.lit(f.name).alias("name"), F.lit(f.type).alias("type"), f.col().cast("string").alias("value")) for f in fields]
    return df.select(F.explode(F.array(*parts)).alias("c")).select("c.*").where("value is not null")


#: Texts longer than this are counted by their SHA-256, so that whole texts are not shuffled.
LONG = 64


def value_counts(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    short = F.when(F.length("value") > LONG, F.sha2(F.col("value").cast("binary"), 256)).otherwise(F.col("value"))
    return cells(df, fields).withColumn("value", short).groupBy("name", "type", "value").agg(F.count(F.lit(1)).alias("n"))


def field_stats(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Occurrences, distinct values, frequency (share of records), uniqueness (distinct/occurrences) and Shannon entropy with its redundancy."""
    records = df.agg(F.count(F.lit(1))).scalar()
    n = F.col("n").cast("double")
    sums = (
        value_counts(df, fields)
        .groupBy("name", "type")
        .agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("distinct_values"), F.sum(n * F.log2(n)).alias("nlogn"))
    )
    entropy = F.log2("occurrences") - F.col("nlogn") / F.col("occurrences")
    most = F.log2(F.col("distinct_values"))
    return sums.select(
        "name",
        "type",
        "occurrences",
        "distinct_values",
        (F.col("occurrences") / records).alias("frequency"),
        (F.col("distinct_values") / F.col("occurrences")).alias("uniqueness"),
        F.greatest(entropy, F.lit(0.0)).alias("entropy"),
        F.when(F.col("distinct_values") > 1, (1 - F.greatest(entropy, F.lit(0.0)) / most) * F.col("occurrences")).otherwise(F.col("occurrences").cast("double")).alias("redundancy"),
    )


#: Limits of the groups of fields, and the order of types within group B.
UNIQUE, FREQUENT = 0.95, 0.80
TYPE_ORDER = {"string": 0, "int": 1, "double": 1, "bool": 1, "logtype": 2, "timestamp": 3, "array": 4}


def field_order(stats: DataFrame) -> DataFrame:
    """Fields in groups: A frequent with one value, B frequent, C rare or nearly unique; with the rank within each group."""
    kind = (
        F.when(F.col("uniqueness") >= UNIQUE, "C")
        .when((F.col("frequency") > FREQUENT) & (F.col("distinct_values") == 1), "A")
        .when(F.col("frequency") > FREQUENT, "B")
        .otherwise("C")
    )
    rank = F.lit(5)
    for t, i in TYPE_ORDER.items():
        rank = F.when(F.col("type") == t, i).otherwise(rank)
    grouped = stats.select("*", kind.alias("field_group"), rank.alias("type_rank"))
    b = F.col("field_group") == "B"
    keys = [F.when(b, F.col("type_rank")).asc(), F.when(b, F.col("distinct_values")).asc(), F.when(~b, F.col("frequency")).desc(), F.asc("name"), F.asc("type")]
    # One row a field: the window is as small as the catalog.
    place = F.row_number().over(Window.partitionBy("field_group").orderBy(*keys))
    return grouped.withColumn("position", place).drop("type_rank")


def type_stats(stats: DataFrame) -> DataFrame:
    """Per type: fields, occurrences and distinct values, with the share of all occurrences in percent."""
    sums = stats.groupBy("type").agg(
        F.count(F.lit(1)).alias("fields"), F.sum("occurrences").alias("occurrences"), F.sum("distinct_values").alias("distinct_values")
    )
    return sums.withColumn("percent", 100.0 * F.col("occurrences") / F.sum("occurrences").over(Window.partitionBy()))


def top_fields(stats: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` fields with most occurrences."""
    return stats.select("name", "type", "occurrences", "distinct_values").orderBy(F.desc("occurrences"), "name", "type").limit(n)


def overall_indexes(df: DataFrame, stats: DataFrame) -> DataFrame:
    """fi: filled share of the table of records and fields; ui: sum of uniqueness."""
    records = df.agg(F.count(F.lit(1))).scalar()
    sums = stats.agg(F.sum("occurrences").alias("occ"), F.count(F.lit(1)).alias("fields"), F.sum("uniqueness").alias("ui"))
    return sums.select((F.col("occ") / (records * F.col("fields"))).alias("fi"), "ui")


def missing_ratio(df: DataFrame, fields: Sequence[Field], block: str | None = None, limit: float = 0.05) -> DataFrame:
    """Share of missing cells, over all or per block, and whether it is below ``limit``."""
    missing = sum((f.col().isNull().cast("bigint") for f in fields[1:]), fields[0].col().isNull().cast("bigint"))
    grouped = df.groupBy(*([F.col(block)] if block else []))
    out = grouped.agg((F.sum(missing) / (F.count(F.lit(1)) * len(fields))).alias("missing_ratio"))
    return out.withColumn("appropriate", F.col("missing_ratio") < limit)


def block_stats(df: DataFrame, block: str, columns: Sequence[str]) -> DataFrame:
    """Per block: records, bytes of the records as JSON over ``columns``, and their average."""
    from .relational import row_json

    size = F.octet_length(row_json(df, columns))
    return df.groupBy(block).agg(F.count(F.lit(1)).alias("records"), F.sum(size).cast("bigint").alias("json_bytes"), F.avg(size).alias("avg_bytes"))
