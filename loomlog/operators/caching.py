"""Frames kept under names, for queries that come back to the same records.

Spark keeps the partitions, in memory and on disk; this is the list of what is kept, with how often each was asked for. Past ``capacity`` names
the one that was asked for longest ago is let go.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


class NamedCache:
    def __init__(self, capacity: int = 16):
        self.capacity = capacity
        self._kept: OrderedDict[str, DataFrame] = OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Keeps the frame under the name, in place of what was there."""
        self.remove(name)
        self._kept[name] = df.persist()
        while len(self._kept) > self.capacity:
            self._kept.popitem(last=False)[1].unpersist()
            self.evictions += 1
        return self._kept.get(name, df)

    def put_all(self, frames: dict[str, DataFrame]) -> None:
        for name, df in frames.items():
            self.put(name, df)

    def get(self, name: str) -> DataFrame | None:
        if name not in self._kept:
            self.misses += 1
            return None
        self.hits += 1
        self._kept.move_to_end(name)
        return self._kept[name]

    def get_all(self, names: Iterable[str]) -> dict[str, DataFrame]:
        """Those of the names that are kept."""
        return {name: df for name in names if (df := self.get(name)) is not None}

    def __contains__(self, name: str) -> bool:
        return name in self._kept

    def remove(self, name: str) -> bool:
        df = self._kept.pop(name, None)
        if df is not None:
            df.unpersist()
        return df is not None

    def clear(self) -> None:
        for name in list(self._kept):
            self.remove(name)

    def warm(self, *names: str) -> None:
        """Computes the named frames, or all, so that the next query finds them."""
        for name in names or list(self._kept):
            self._kept[name].count()

    def stats(self, spark: SparkSession) -> DataFrame:
        """One row: names kept, room for how many, hits, misses, share of hits and evictions."""
        asked = self.hits + self.misses
        row = (len(self._kept), self.capacity, self.hits, self.misses, self.hits / asked if asked else None, self.evictions)
        return spark.createDataFrame([row], "kept int, capacity int, hits long, misses long, hit_ratio double, evictions long")
