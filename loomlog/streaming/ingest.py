"""Micro-batch ingest: JSON lines that arrive in a folder become blocks of a store.

The fields are fixed by a sample or a list of leaves, as a stream's schema must be. What these do not hold is not lost: a line that is
no JSON object, or that has fields, types, empty objects or nulls which its columns do not give back, is kept whole in the field ``_rest``. Each micro-batch is one
block, numbered by its batch id, so a batch that runs twice after a failure overwrites its own block and catalog and nothing is doubled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.flatten import Leaf, discover, flatten, parse_json
from ..plans.resolver import Field, quoted
from ..sources import store
from ..sources.ndjson import is_record, nested_json


def learn(lines: DataFrame, column: str = "value", timestamp_fields: Sequence[str] = ()) -> list[Leaf]:
    """The leaves of a batch of lines, to be the stream's fields."""
    return discover(lines.select(parse_json(F.col(column)).alias("_v")), "_v", timestamp_fields)


#: The field of lines that the listed leaves do not give back.
REST = "_rest"


def flattened(lines: DataFrame, leaves: list[Leaf], column: str = "value", timestamp_fields: Sequence[str] = (), keep: Sequence[str] = ()) -> tuple[DataFrame, list[Field]]:
    """The typed columns of ``leaves``, and ``REST``: the line where it says more than they do."""
    named = lines.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(column)).alias(REST))
    df, fields, _ = flatten(named, REST, [*keep, REST], timestamp_fields, leaves=leaves)
    same = F.to_json(parse_json(nested_json(df, fields))) == F.to_json(parse_json(F.col(REST)))
    rest = F.when(~F.coalesce(same & is_record(F.col(REST)), F.lit(False)), F.col(REST))
    return df.withColumn(REST, rest), [*fields, Field(REST, "string", REST)]


def ingest(spark: SparkSession, source: str, root: str, leaves: list[Leaf], checkpoint: str, timestamp_fields: Sequence[str] = (), codec: str = "zstd") -> StreamingQuery:
    """Starts a query that takes all that is there and stops; call it again for what comes later. The store can be opened after every batch."""
    lines = spark.readStream.text(source).where("trim(value) <> ''")

    def block(batch: DataFrame, batch_id: int) -> None:
        df, fields = flattened(batch, leaves, timestamp_fields=timestamp_fields)
        store.write_block(df, fields, root, batch_id, codec)

    return lines.writeStream.foreachBatch(block).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key of a stream (or a table); rows later than ``late`` are left out of a stream."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")
    )
