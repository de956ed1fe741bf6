"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Byte table: A-Z to a-z, every other ASCII byte outside 0-9 and a-z to a space.
#: Bytes of 0x80 and above stay, so every non-ASCII code point is part of a word.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a folder of this machine only where all tasks run on it as well."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return str(set_dir.get())
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomlog-")
        spark.sparkContext.setCheckpointDir(root)
        root = str(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return root


_WITHIN: ContextVar[str | None] = ContextVar("within", default=None)


@contextmanager
def working_in(spark: SparkSession, folder: str):
    """Operators keep their tables below ``folder``, which is removed at the end: results must be written by then."""
    token = _WITHIN.set(folder)
    try:
        yield
    finally:
        _WITHIN.reset(token)
        drop_folder(spark, folder)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, for tables and files of one operator run. Whoever needs the room drops it with ``drop_folder``."""
    base = _WITHIN.get() or f"{checkpoint_root(spark).rstrip('/')}/loomlog"
    return f"{base}/{label}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, computes the frame once, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{folder}/{label}" if folder else new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_share(total, pieces: int = 4096, least: int = 1000):
    """The number of rows from which on a key is hot: at most ``pieces`` keys can hold more than one in ``pieces`` of all rows."""
    return F.greatest(F.lit(least).cast("bigint"), (total / pieces).cast("bigint"))


def lower_ascii(col):
    """A-Z to a-z and nothing else (``lower`` would also change É)."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def map_rows(
    df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, columns: list[str], setup: Callable | None = None
) -> DataFrame:
    """Row tuples in, row tuples out, carried in Arrow batches of bounded size.

    ``fn`` sees the rows of one batch at a time, so memory follows the batch, not the partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    struct: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    names = [f.name for f in struct.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup() if setup else fn
        for batch in batches:
            yield from pack(work(python_rows(batch)), names, arrow)

    return df.select(*columns).mapInArrow(run, schema)


def python_rows(batch: pa.RecordBatch, step: int = 512) -> Iterator[tuple]:
    """The rows of a batch as tuples, made a few at a time."""
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        yield from zip(*(part.column(i).to_pylist() for i in range(part.num_columns)))


def pack(rows: Iterable[tuple], names: list[str], arrow: pa.Schema, size: int = 4096, budget: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows and about ``budget`` bytes of text."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= size or weight >= budget:
            yield _batch(held, names, arrow)
            held, weight = [], 0
    if held:
        yield _batch(held, names, arrow)


def _batch(rows: list[tuple], names: list[str], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], names=names)


def segments(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Runs of rows with about ``size`` characters of text (the last column)."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[-1] or "")
        if weight >= size:
            yield held
            held, weight = [], 0
    if held:
        yield held
