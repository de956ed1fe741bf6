"""Type detection of string values, as columns.

A string that is a timestamp by pattern (or by the name of its field) is TIMESTAMP, one with a space is LOGTYPE, any
other is STRING.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-match patterns of timestamps. The second group can be left out with ``extended=False``.
TIMESTAMPS = (
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3} \w+",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} \w+",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z",
    r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}",
)
EXTENDED_TIMESTAMPS = (
    r"\d{4}\.\d{2}\.\d{2}",
    r"\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}\.\d{3,6}",
)


def timestamp_pattern(extended: bool = True) -> str:
    return "^(?:" + "|".join(TIMESTAMPS + (EXTENDED_TIMESTAMPS if extended else ())) + ")$"


def is_timestamp(value: Column, extended: bool = True) -> Column:
    return value.rlike(timestamp_pattern(extended))


def is_logtype(value: Column, extended: bool = True) -> Column:
    return value.contains(" ") & ~is_timestamp(value, extended)


def string_type(value: Column, field: str | None = None, timestamp_fields: Iterable[str] = (), extended: bool = True) -> Column:
    """The type name of a string value; null for null."""
    if field is not None and field in set(timestamp_fields):
        return F.when(value.isNotNull(), F.lit("timestamp"))
    return (
        F.when(is_timestamp(value, extended), "timestamp").when(value.contains(" "), "logtype").when(value.isNotNull(), "string")
    )
