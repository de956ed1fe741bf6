"""The engine: records with catalogued fields, and every operator over them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, flatten, pruning, relational
from .plans import parser
from .plans.resolver import Field, Resolver, fields_of
from .sources import ndjson, store


class Engine:
    """Operators return lazy DataFrames; building an engine from JSON reads it once for every three levels of nesting, for its fields."""

    def __init__(self, df: DataFrame, fields: Iterable[Field] | None = None, null_is_different: bool = False, block: str = "block_id"):
        self.df = df
        self.block = block
        self.resolver = Resolver(fields_of(df) if fields is None else fields, null_is_different)

    # --- sources -------------------------------------------------------------------------------

    @classmethod
    def from_dataframe(cls, df: DataFrame, json: Iterable[str] = (), timestamp_fields: Sequence[str] = (), **kw) -> Engine:
        """A plain frame; leaves of its JSON text columns named in ``json`` become fields ``column.leaf``."""
        fields = fields_of(df)
        base = df
        for column in json:
            kept = base.columns
            base, found, _ = flatten.flatten(base, column, kept, timestamp_fields, prefix=f"{column}.")
            fields = fields + found
        return cls(base, fields, **kw)

    @classmethod
    def from_json(
        cls, lines: DataFrame, column: str = "value", timestamp_fields: Sequence[str] = (), structured: bool = False, keep: Sequence[str] = (), **kw
    ) -> Engine:
        """Lines of JSON objects; lines that are none are left out (``ndjson.split_malformed`` gives them)."""
        df, fields, _ = flatten.flatten(ndjson.records(lines, column, "_v"), "_v", keep, timestamp_fields, structured)
        return cls(df, fields, **kw)

    @classmethod
    def from_files(cls, spark: SparkSession, path: str | list[str], block_size: int | None = None, limit: int | None = None, **kw) -> Engine:
        lines = ndjson.read_lines(spark, path, limit)
        if block_size is not None:
            lines = ndjson.with_blocks(lines, block_size)
            kw["keep"] = [*kw.get("keep", ()), "block_id"]
        return cls.from_json(lines, **kw)

    @classmethod
    def from_store(cls, spark: SparkSession, root: str, blocks: Sequence[int] | None = None, **kw) -> Engine:
        block = kw.get("block", "block_id")
        return cls(store.load(spark, root, blocks, block=block), store.load_fields(spark, root, block), **kw)

    def save(self, root: str, **kw) -> None:
        store.save(self.df, self.resolver.fields, root, self.block, **kw)

    # --- catalog -------------------------------------------------------------------------------

    @property
    def fields(self) -> list[Field]:
        return self.resolver.fields

    def field_exists(self, *asked: str | tuple[str, str | None]) -> DataFrame:
        pairs = [(a, None) if isinstance(a, str) else a for a in asked]
        return catalog.field_exists(self.df.sparkSession, self.resolver, pairs)

    def browse(self, field: str, templates: bool = False, scope: str = "field") -> DataFrame:
        return catalog.browse_all(self.df, self.resolver) if scope == "global" else catalog.browse(self.df, self.resolver, field, templates)

    def lookup(self, field: str, value: str) -> DataFrame:
        return catalog.lookup(self.df, self.resolver, field, value)

    def dictionary(self, field: str) -> DataFrame:
        return catalog.dictionary(self.df, self.resolver, field)

    def templates(self, field: str) -> DataFrame:
        return catalog.template_dictionary(self.df, self.resolver, field)

    def field_stats(self, fields: Sequence[str] | None = None) -> DataFrame:
        chosen = [f for f in self.fields if f.type != "null" and (fields is None or f.name in fields)]
        return catalog.field_stats(self.df, chosen)

    def field_order(self) -> DataFrame:
        return catalog.field_order(self.field_stats())

    def type_stats(self) -> DataFrame:
        return catalog.type_stats(self.field_stats())

    def missing_ratio(self, by_block: bool = False) -> DataFrame:
        return catalog.missing_ratio(self.df, [f for f in self.fields if f.column != self.block], self.block if by_block else None)

    def block_stats(self) -> DataFrame:
        return catalog.block_stats(self.df, self.block, [f.column for f in self.fields if f.column != self.block])

    # --- queries -------------------------------------------------------------------------------

    def _condition(self, where: str | None):
        return None if where is None else self.resolver.condition(parser.parse(where))

    def point(self, field: str, value: str, kind: str | None = None, as_text: bool = False) -> DataFrame:
        if as_text:
            return relational.text_point(self.df, self.resolver, field, value)
        return relational.point(self.df, self.resolver, field, value, kind)

    def range(self, field: str, low: str, high: str, kind: str | None = None, as_text: bool = False) -> DataFrame:
        if as_text:
            return relational.lexicographic_between(self.df, self.resolver, field, low, high)
        return relational.between(self.df, self.resolver, field, low, high, kind)

    def aggregate(self, function: str, field: str | None = None, where: str | None = None, skip_empty: bool = False) -> DataFrame:
        return relational.aggregate(self.df, self.resolver, [parser.Aggregate(function, field)], self._condition(where), skip_empty)

    def group(
        self, fields: Sequence[str], aggregates: Sequence[tuple[str, str | None]] = (), where: str | None = None, drop_missing: bool = False
    ) -> DataFrame:
        made = [parser.Aggregate(f, x) for f, x in aggregates]
        return relational.group(self.df, self.resolver, fields, made, self._condition(where), drop_missing)

    def group_records(self, fields: Sequence[str], sample: int = 5, where: str | None = None) -> DataFrame:
        return relational.group_records(self.df, self.resolver, fields, sample, self._condition(where))

    def query(self, text: str) -> DataFrame:
        return relational.run(self.df, self.resolver, text)

    def analyse(self, text: str) -> dict:
        """What a query reads: its fields with their types, the fields that a match needs, and its number of predicates."""
        tree = parser.parse(text)
        names = sorted(parser.fields_of(tree))
        needed = pruning.required_fields(tree.child if isinstance(tree, parser.GroupBy) else tree, self.resolver.null_is_different)
        types = {n: sorted({f.type for f in self.resolver.find(n)}) for n in names}
        return {"tree": tree, "fields": types, "required": sorted(needed or ()), "predicates": parser.count_predicates(tree)}

    def pruned(self, text: str, block_catalog: DataFrame) -> Engine:
        """This engine over the blocks that the query can match."""
        blocks = pruning.select_blocks(block_catalog, text, self.block, self.resolver.null_is_different)
        return Engine(pruning.prune(self.df, blocks, self.block), self.fields, self.resolver.null_is_different, self.block)

    # --- caching -------------------------------------------------------------------------------

    def cache(self) -> Engine:
        """Keeps the flattened records, in memory and on disk, for several queries."""
        return Engine(self.df.persist(), self.fields, self.resolver.null_is_different, self.block)

    def uncache(self) -> None:
        self.df.unpersist()

    # --- rows ----------------------------------------------------------------------------------

    def distinct(self, by_block: bool = False) -> Engine:
        return Engine(relational.distinct_records(self.df, self.block if by_block else None), self.fields, self.resolver.null_is_different, self.block)

    def project(self, *fields: str) -> DataFrame:
        return relational.project(self.df, self.resolver, fields)

    def rebuild(self, required: Sequence[str] = (), columns: Sequence[str] | None = None, descending: bool | None = None, limit: int | None = None) -> DataFrame:
        return relational.rebuild(self.df, self.resolver, required, columns, descending, limit)

    def to_json(self) -> DataFrame:
        """Each row as the JSON it came from: nested objects and types put back, missing values left out."""
        return self.df.select(ndjson.nested_json(self.df, [f for f in self.fields if f.type != "null" and f.column != self.block]).alias("record"))

    def count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("count"))
