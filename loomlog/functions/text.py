"""Text forms of values, for outputs that must look as C programs print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_text(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Seconds since 1970 as formatted text, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), pattern)


def double_text(value: Column) -> Column:
    """A double with six decimals; nulls stay null."""
    return F.when(value.isNotNull(), F.format_string("%f", value.cast("double")))


def aggregate_text(label: str, value: Column) -> Column:
    """``SUM(pid) = 12.000000``"""
    return F.concat(F.lit(f"{label} = "), double_text(value))
