"""Choosing blocks by what the catalog says of them, before their data are read."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import parser as P
from ..plans.resolver import Field

FULL_SCAN = 0.8
#: Bounds of texts are kept to this length. A cut text is no larger than the text, and order survives the cut.
PREFIX = 64
#: Fields that are catalogued in one pass over the rows.
WIDTH = 200
_CELLS = {"occurrences": "bigint", "low": "double", "high": "double", "first": "string", "last": "string"}


def block_catalog(df: DataFrame, fields: Sequence[Field], block: str = "block_id", number: int | None = None) -> DataFrame:
    """``(block, name, type, occurrences, low, high, first, last)``: per block and field, with bounds as numbers for numbers and native times (in
    microseconds), and as text, cut to ``PREFIX``, for texts.

    Bounds of texts are aggregated in order of the block. Rows that come in that order (``store.save`` puts them so) are read as a stream; others are
    sorted, as they are and not once a field. With a ``number`` all rows are that block's, and nothing is sorted or held.
    """
    keys = [block] if number is None else []
    key = F.col(block) if number is None else F.lit(number).cast("bigint").alias(block)
    parts = []
    for at in range(0, len(fields), WIDTH):
        chosen = fields[at : at + WIDTH]
        made, rows = [], []
        for i, f in enumerate(chosen):
            number, text = None, None
            if f.type in ("int", "double"):
                number = f.col().cast("double")
            elif f.native:
                number = F.unix_micros(f.col().cast("timestamp")).cast("double")
            elif f.type in ("string", "logtype", "timestamp"):
                text = F.substring(f.col().cast("string"), 1, PREFIX)
            bounds = {"occurrences": F.count(f.col())}
            if number is not None:
                bounds |= {"low": F.min(number), "high": F.max(number)}
            if text is not None:
                bounds |= {"first": F.min(text), "last": F.max(text)}
            made += [c.alias(f"_{k}{i}") for k, c in bounds.items()]
            cells = [(F.col(f"_{k}{i}") if k in bounds else F.lit(None).cast(kind)).alias(k) for k, kind in _CELLS.items()]
            rows.append(F.struct(F.lit(f.name).alias("name"), F.lit(f.type).alias("type"), *cells))
        sums = df.groupBy(*keys).agg(*made)
        parts.append(sums.select(key, F.explode(F.array(*rows)).alias("_c")).select(block, "_c.*").where("occurrences > 0"))
    return reduce(DataFrame.union, parts)


def merged(catalogs: DataFrame, block: str = "block_id") -> DataFrame:
    """One row a block and field, from the catalogs of several writes."""
    return catalogs.groupBy(block, "name", "type").agg(
        F.sum("occurrences").alias("occurrences"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last")
    )


def with_fields(catalog: DataFrame, names: Sequence[str], block: str = "block_id") -> DataFrame:
    """Blocks that hold all the fields."""
    wanted = [*dict.fromkeys(names)]
    spelled = F.regexp_replace("name", "^~", "")
    plain = [w.lstrip("~") for w in wanted]
    return catalog.where(spelled.isin(*plain)).groupBy(block).agg(F.count_distinct(spelled).alias("_n")).where(F.col("_n") == len(set(plain))).select(block)


def with_types(catalog: DataFrame, types: dict[str, str], block: str = "block_id") -> DataFrame:
    """Blocks that hold all the fields in the given types."""
    pairs = [f"{n.lstrip('~')}:{t}" for n, t in types.items()]
    pair = F.concat(F.regexp_replace("name", "^~", ""), F.lit(":"), F.col("type"))
    return catalog.where(pair.isin(*pairs)).groupBy(block).agg(F.count_distinct(pair).alias("_n")).where(F.col("_n") == len(set(pairs))).select(block)


def with_range(catalog: DataFrame, name: str, low, high, block: str = "block_id") -> DataFrame:
    """Blocks whose bounds of a field overlap the range: numbers and times by value, texts by text."""
    return catalog.where(_may_match(P.Predicate(name, "range", (str(low), str(high))))).select(block).distinct()


_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def _may_match(p: P.Predicate) -> Column:
    """Whether a block may hold a match, by a row of its catalog. Bounds are compared without strictness, which rounding cannot make wrong."""
    here = F.regexp_replace("name", "^~", "") == p.field.lstrip("~")
    if p.type is not None and p.type not in ("template", "dict"):
        here = here & (F.col("type") == p.type)
    if p.type == "template" or p.op not in ("=", "range", "<", "<=", ">", ">="):
        return here
    low = p.values[0] if p.op in ("=", "range", ">", ">=") else None
    high = p.values[-1] if p.op in ("=", "range", "<", "<=") else None

    def within(least: str, most: str, value) -> Column:
        sides = [F.col(most) >= value(low)] if low is not None else []
        sides += [F.col(least) <= value(high)] if high is not None else []
        return reduce(lambda a, b: a & b, sides)

    texts = within("first", "last", lambda v: F.lit(v[:PREFIX]))
    times = within("low", "high", lambda v: F.unix_micros(F.lit(v).try_cast("timestamp")).cast("double"))
    numbers = within("low", "high", lambda v: F.lit(float(v))) if all(_NUMBER.fullmatch(v) for v in p.values) else F.lit(False)
    fits = F.when(F.col("type").isin("int", "double"), numbers).when(F.col("first").isNotNull(), texts)
    fits = fits.when((F.col("type") == "timestamp") & F.col("low").isNotNull(), times).otherwise(True)
    return F.coalesce(here & fits, F.lit(False))


def required_fields(node, null_is_different: bool = False, outcome: bool = True) -> set[str] | None:
    """Fields without which a condition cannot come to ``outcome``; None if it needs none.

    Most predicates are neither true nor false on a missing value. An existence test is false there, so are ``!=`` and
    ``!~`` on a name of several types, and ``!=`` is true where ``null_is_different``.
    """
    if isinstance(node, P.Predicate):
        met = node.op == "!=" and null_is_different if outcome else node.op in ("exists", "!=", "!~")
        return None if met else {node.field}
    if isinstance(node, (P.And, P.Or)):
        left = required_fields(node.left, null_is_different, outcome)
        right = required_fields(node.right, null_is_different, outcome)
        if isinstance(node, P.And) == outcome:  # both sides must come to it
            return left if right is None else right if left is None else left | right
        return None if left is None or right is None else (left & right) or None
    if isinstance(node, P.Not):
        return required_fields(node.child, null_is_different, not outcome)
    return None


def select_blocks(catalog: DataFrame, text: str, block: str = "block_id", null_is_different: bool = False) -> DataFrame | None:
    """Blocks that a query can match by its fields, types, values, ranges and times; None for all of them.

    One aggregation over the catalog tells for each block which of the query's predicates something in it may fulfil. No block is left out that may hold a match.
    """
    tree = P.parse(text)
    asked: list[Column] = []

    def may(node, outcome: bool) -> Column | None:
        """Whether a block may hold a row for which the node comes to ``outcome``; None where any block may."""
        if isinstance(node, P.Predicate):
            if "*" in node.field or required_fields(node, null_is_different, outcome) is None:
                return None
            # Most predicates are false only on values that are there, of whatever size.
            asked.append(_may_match(node if outcome else P.Predicate(node.field, "exists", (), node.type)))
            return F.col(f"_m{len(asked) - 1}")
        if isinstance(node, (P.And, P.Or)):
            left, right = may(node.left, outcome), may(node.right, outcome)
            if isinstance(node, P.And) == outcome:
                return left if right is None else right if left is None else left & right
            return None if left is None or right is None else left | right
        if isinstance(node, P.Not):
            return may(node.child, not outcome)
        return None

    chosen = may(tree.child if isinstance(tree, P.GroupBy) else tree, True)
    if chosen is None:
        return None
    return catalog.groupBy(block).agg(*[F.bool_or(c).alias(f"_m{i}") for i, c in enumerate(asked)]).where(chosen).select(block)


def prune(df: DataFrame, blocks: DataFrame | None, block: str = "block_id") -> DataFrame:
    """Rows of the chosen blocks. The list is turned into a partition filter while it is small, else it is joined."""
    if blocks is None:
        return df
    few = [r[0] for r in blocks.limit(10_001).collect()]
    return df.where(F.col(block).isin(*few)) if len(few) <= 10_000 else df.join(blocks, block, "left_semi")


def strategy(catalog: DataFrame, blocks: DataFrame, block: str = "block_id") -> DataFrame:
    """One row: blocks in all, blocks chosen, their ratio, and whether a full scan is as good."""
    total = catalog.agg(F.count_distinct(block).alias("blocks"))
    both = total.withColumn("chosen", blocks.agg(F.count_distinct(block)).scalar())
    ratio = F.col("chosen") / F.col("blocks")
    return both.select("blocks", "chosen", ratio.alias("ratio"), (ratio > FULL_SCAN).alias("full_scan"))
