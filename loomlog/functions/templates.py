"""Timestamp and log templates: variable parts become ``*`` and are listed in order.

The raw text stays the source of truth; ``refill`` puts variables back and is the test of a template.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a variable, alternatives in order of preference.
TIMESTAMP_VARIABLE = r"\d{4}|\d{2}"
LOG_VARIABLE = r"\b\d+\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"


#: The same for Java: no ``@`` is in the run before it, so nothing is to be tried again once the run has ended.
_LOG = LOG_VARIABLE.replace("]+@", "]++@")


def _variables(value: Column, pattern: str) -> Column:
    return F.regexp_extract_all(value, F.lit(f"({pattern})"), F.lit(1))


def timestamp_template(value: Column) -> Column:
    return F.regexp_replace(value, TIMESTAMP_VARIABLE, "*")


def timestamp_variables(value: Column) -> Column:
    return _variables(value, TIMESTAMP_VARIABLE)


def log_template(value: Column) -> Column:
    return F.regexp_replace(value, _LOG, "*")


def log_variables(value: Column) -> Column:
    return _variables(value, _LOG)


def log_stars(value: Column) -> Column:
    """What each star of the log template stands for, in order: a variable, or a star of the text itself."""
    return _variables(value, _LOG + r"|\*")


def refill(template: Column, variables: Column) -> Column:
    """Variables in place of the stars, from the left; stars beyond the variables stay.

    Where a text has stars of its own, ``log_stars`` gives the whole text again; its variables alone do not tell which star is one.
    """
    # Zipped, so that the variables are made once a text and not once a star.
    before = F.concat(F.array(F.lit("")), F.coalesce(variables, F.array().cast("array<string>")))
    return F.array_join(F.zip_with(F.split(template, r"\*", -1), before, lambda x, v: F.concat(F.coalesce(v, F.lit("*")), x)), "")
