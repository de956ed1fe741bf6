"""Newline-delimited JSON: scan, block numbers, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 5000


def read_lines(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """``value``: the lines that are not blank. ``limit`` is the caller's wish for fewer."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines if limit is None else lines.limit(limit)


def split_malformed(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Records, and the lines that are no JSON object."""
    good = is_record(F.col(column))
    return lines.where(good), lines.where(~good)


def is_record(line: Column) -> Column:
    """Whether a line is one JSON object and nothing else."""
    return F.coalesce(F.ltrim(line).startswith("{") & _marked(line, _with_mark(line)), F.lit(False))


def _with_mark(line: Column) -> Column:
    """The line as the first of two elements; the parser does not look at what follows a value, so the second, a hash of the line, must
    stand where it was put."""
    return F.try_parse_json(F.concat(F.lit("["), line, F.lit(","), F.xxhash64(line).cast("string"), F.lit("]")))


def _marked(line: Column, both: Column) -> Column:
    return F.try_variant_get(both, "$[1]", "bigint") == F.xxhash64(line)


def records(lines: DataFrame, column: str = "value", name: str = "_v") -> DataFrame:
    """The lines that are records, with the record as a VARIANT column ``name``, parsed once.

    Filters that come later cannot be pushed below the explode of one element, so they do not parse again.
    """
    line = F.col(column)
    parsed = lines.where(F.ltrim(line).startswith("{")).withColumn(name, F.explode(F.array(_with_mark(line))))
    return parsed.where(_marked(line, F.col(name))).withColumn(name, F.try_variant_get(name, "$[0]", "variant"))


def with_blocks(df: DataFrame, size: int = BLOCK, name: str = "block_id") -> DataFrame:
    """Rows with the number of their block of ``size`` rows, in the order in which they are read.

    The driver sees one count a partition. Numbers follow partition and place, so they are the same again for the same files.
    """
    placed = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(F.lit(total).cast("bigint"))
        total += sizes.get(p, 0)
    start = F.get(F.array(*starts), F.col("_p")) if starts else F.lit(0).cast("bigint")
    return placed.select(*df.columns, F.floor((start + F.col("_i")) / size).cast("bigint").alias(name))


def write_lines(df: DataFrame, path: str, column: str = "record", mode: str = "errorifexists") -> None:
    df.select(column).write.mode(mode).text(path)


def nested_json(df: DataFrame, fields):
    """A column with each row's JSON, nested objects and literal dotted keys put back; missing values are left out."""
    tree: dict = {}
    for f in fields:
        *above, last = f.name[1:].split(".") if f.name.startswith("~") else [f.name]
        node = tree
        for p in above:
            node = node.setdefault(("object", p), {})
        node.setdefault(("value", last), []).append(f)

    def text(v):
        """One value's JSON."""
        if v.type in ("array", "object"):
            return v.col()
        wrapped = F.to_json(F.struct(v.col().alias("x")))
        return F.when(v.col().isNotNull(), F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))

    def build(node: dict):
        parts = []
        for (_, key), value in node.items():
            inner = build(value) if isinstance(value, dict) else F.coalesce(*[text(v) for v in value])
            quoted = F.substring(F.to_json(F.array(F.lit(key))), F.lit(2), F.length(F.to_json(F.array(F.lit(key)))) - 2)
            parts.append(F.concat(quoted, F.lit(":"), inner))  # null where the value is
        body = F.concat_ws(",", *parts)
        if node is not tree:
            # Null where nothing is inside; each level names the one below once, or the expression would double with every level.
            body = F.get(F.regexp_extract_all(body, F.lit("(?s)^.+$"), F.lit(0)), 0)
        return F.concat(F.lit("{"), body, F.lit("}"))

    return build(tree)
