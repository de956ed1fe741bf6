"""A store of blocks: Parquet partitioned by block, a field list, and a catalog of blocks.

Layout below the root: ``data/block_id=N/*.parquet``, ``fields`` and ``catalog/batch=X`` as Parquet. Data columns are called ``c0``, ``c1`` and so on; the
field list tells their names and types, so names that Spark cannot tell apart, and blocks that hold a name in different
types, do not get in each other's way. Each write adds the catalog of what it wrote; batches that share a block are merged when the catalog is read.
A selective load is a filter on the block and a selection of columns; Parquet reads no more than that.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructType

from ..operators.pruning import block_catalog, merged
from ..plans.resolver import Field, physical_names, quoted

_FIELDS = "position int, name string, type string, native boolean, ddl string"


def save(
    df: DataFrame, fields: Sequence[Field], root: str, block: str = "block_id", codec: str = "zstd", mode: str = "errorifexists", bloom: Sequence[str] = ()
) -> None:
    """Write a store; ``mode="append"`` adds blocks, with fields of their own. ``codec``: zstd, snappy, lz4, gzip, brotli or none.

    ``bloom`` names fields that get a Bloom filter in each file, so that a look-up of one value skips the files without it.
    """
    stored = _stored(df, fields, root, block, add=mode == "append")
    chosen = [f for f in fields if f.column in df.columns and f.column != block]
    # What is written is also catalogued; it is computed once. Both want whole blocks one after the other: one shuffle and one sort do for both.
    rows = df.select(*[F.col(quoted(c)) for c in dict.fromkeys([*(f.column for f in chosen), block])])
    kept = rows.repartition(F.col(quoted(block))).sortWithinPartitions(F.col(quoted(block))).persist()
    try:
        out = kept.select(*[f.col().alias(stored[f]) for f in chosen], F.col(quoted(block)).alias(block))
        writer = out.write.mode(mode).option("compression", codec).partitionBy(block)
        for f in chosen:
            if f.name in bloom:
                writer = writer.option(f"parquet.bloom.filter.enabled#{stored[f]}", "true")
        writer.parquet(f"{root}/data")
        # Gathered again, so that the catalog has few files.
        block_catalog(kept, chosen, block).hint("rebalance").write.mode("overwrite").parquet(f"{root}/catalog/batch={uuid.uuid4().hex}")
    finally:
        kept.unpersist()


def write_block(df: DataFrame, fields: Sequence[Field], root: str, number: int, codec: str = "zstd") -> None:
    """Write one block and its catalog, in place of what an earlier attempt at it left."""
    stored = _stored(df, fields, root, "block_id", add=True)
    df.select(*[f.col().alias(stored[f]) for f in fields]).write.mode("overwrite").option("compression", codec).parquet(f"{root}/data/block_id={number}")
    written = load(df.sparkSession, root, blocks=[number])
    block_catalog(written, load_fields(df.sparkSession, root), "block_id", number).write.mode("overwrite").parquet(f"{root}/catalog/batch=block-{number}")


def _stored(df: DataFrame, fields: Sequence[Field], root: str, block: str, add: bool) -> dict[Field, str]:
    """The data column of each field; fields that are new go to the end of the field list."""
    spark = df.sparkSession
    listed = [tuple(r)[1:] for r in _listed(spark, root)] if add else []
    before = len(listed)
    out = {}
    for f in fields:
        if f.column in df.columns and f.column != block:
            row = (f.name, f.type, f.native, df.schema[f.column].dataType.simpleString())
            if row not in listed:
                listed.append(row)
            out[f] = f"c{listed.index(row)}"
    if len(listed) > before or not add:
        spark.createDataFrame([(i, *r) for i, r in enumerate(listed)], _FIELDS).coalesce(1).write.mode("overwrite").parquet(f"{root}/fields")
    return out


def _listed(spark: SparkSession, root: str) -> list:
    try:
        return spark.read.schema(_FIELDS).parquet(f"{root}/fields").orderBy("position").collect()
    except AnalysisException:  # a store without a list yet
        return []


def _columns(rows: Sequence, block: str) -> list[str]:
    return physical_names([(r["name"], r["type"]) for r in rows], [block])


def load_fields(spark: SparkSession, root: str, block: str = "block_id") -> list[Field]:
    rows = _listed(spark, root)
    return [Field(r["name"], r["type"], column, r["native"]) for r, column in zip(rows, _columns(rows, block))]


def load(spark: SparkSession, root: str, blocks: Sequence[int] | None = None, columns: Sequence[str] | None = None, block: str = "block_id") -> DataFrame:
    """All of a store, or chosen blocks and columns of it.

    The schema is that of the field list, so blocks may differ in their fields and no footer is read to find out.
    """
    rows = _listed(spark, root)
    schema = StructType()
    for r in rows:
        schema = schema.add(f"c{r['position']}", DataType.fromDDL(r["ddl"]))
    df = spark.read.schema(schema.add(block, LongType())).parquet(f"{root}/data")
    if blocks is not None:
        df = df.where(F.col(block).isin(*blocks))
    df = df.select(*[F.col(f"c{r['position']}").alias(c) for r, c in zip(rows, _columns(rows, block))], block)
    return df if columns is None else df.select(*[F.col(quoted(c)) for c in columns])


def catalog(spark: SparkSession, root: str, block: str = "block_id") -> DataFrame:
    return merged(spark.read.parquet(f"{root}/catalog"), block)


def compression_stats(spark: SparkSession, root: str, columns: Sequence[str], block: str = "block_id") -> DataFrame:
    """One row: records, blocks, JSON bytes, stored bytes and their ratio."""
    from ..operators.catalog import block_stats

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/data")
    stored = files.agg(F.sum("length")).scalar()
    data = block_stats(load(spark, root, block=block), block, columns).agg(
        F.sum("records").alias("records"), F.count(F.lit(1)).alias("blocks"), F.sum("json_bytes").alias("json_bytes")
    )
    return data.withColumn("stored_bytes", stored).withColumn("ratio", F.col("json_bytes") / F.col("stored_bytes"))
