"""Materialised views: rows kept under hash keys, ordered within them, plain or aggregated before they are stored."""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmill.sources.storage import shared_path


@dataclass(frozen=True)
class View:
    """``hash_by`` places a row, ``order_by`` orders the rows of a place, ``extra`` comes along.

    ``sums``, ``counts`` and ``maxima`` make it an aggregated view over ``hash_by`` and ``order_by``: partial results of
    which coarser ones follow (sums of sums and of counts, maxima of maxima, and averages as a sum over a count).
    """

    name: str
    hash_by: tuple[str, ...]
    order_by: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    maxima: tuple[str, ...] = ()
    distinct: bool = field(default=False)

    def __post_init__(self):
        if not self.hash_by:
            raise ValueError(f"view {self.name} has no column that places its rows")
        if len(set(self.keys) | set(self.extra)) < len(self.keys) + len(self.extra):
            raise ValueError(f"view {self.name} names a column twice")
        if self.aggregated and self.extra:
            raise ValueError(f"the aggregated view {self.name} can keep no extra columns")

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.hash_by, *self.order_by)

    @property
    def aggregated(self) -> bool:
        return bool(self.sums or self.counts or self.maxima)

    @property
    def identity(self) -> str:
        """A name that follows from the view's columns."""
        return f"i{zlib.crc32(repr((self.hash_by, self.order_by, self.extra, self.sums, self.counts, self.maxima)).encode())}"

    def rows(self, df: DataFrame) -> DataFrame:
        """The view's rows, from the join that it is of."""
        if self.aggregated:
            parts = [F.sum(c).alias(f"sum_{c}") for c in self.sums] + [F.count(c).alias(f"count_{c}") for c in self.counts] + [F.max(c).alias(f"max_{c}") for c in self.maxima]
            return df.groupBy(*self.keys).agg(*parts)
        out = df.select(*self.keys, *self.extra)
        return out.distinct() if self.distinct else out

    def merged(self, rows: DataFrame) -> DataFrame:
        """Rows of the view from several sources as one: partial results are added up."""
        if self.aggregated:
            return coarser(rows, self, list(self.keys))
        return rows.distinct() if self.distinct else rows

    def touched_by(self, columns: Iterable[str]) -> bool:
        """Whether a statement that sets ``columns`` changes the view."""
        return bool(set(columns) & {*self.keys, *self.extra, *self.sums, *self.counts, *self.maxima})

    def moved_by(self, columns: Iterable[str]) -> bool:
        """Whether such a statement changes keys, so that the rows under the old keys must be deleted."""
        return bool(set(columns) & set(self.keys))

    def materialize(self, df: DataFrame) -> DataFrame:
        """Stores the view under a new path and returns a reader of it. Rows are placed in ranges of the keys and sorted, so
        that row groups hold narrow ranges, scans with a condition on the keys skip the others, and a hot key is shared."""
        path = shared_path(df.sparkSession, f"views/{self.name}-{self.identity}")
        rows = self.rows(df)
        rows.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(rows.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, buckets: int, table: str | None = None) -> DataFrame:
        """Stores the view as a bucketed table in shared storage: joins of two such views on ``hash_by`` need no shuffle."""
        rows, spark = self.rows(df), df.sparkSession
        rows.write.mode("overwrite").option("path", shared_path(spark, f"tables/{self.name}")).bucketBy(buckets, *self.hash_by).sortBy(*self.keys).saveAsTable(table or self.name)
        return spark.table(table or self.name)


def coarser(stored: DataFrame, view: View, keys: list[str], averages: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates of an aggregated view by fewer of its keys; an average needs the column's sum and count in the view."""
    if not set(keys) <= set(view.keys):
        raise ValueError(f"{view.name} does not keep {set(keys) - set(view.keys)}")
    parts = [F.sum(f"sum_{c}").alias(f"sum_{c}") for c in view.sums] + [F.sum(f"count_{c}").alias(f"count_{c}") for c in view.counts] + [F.max(f"max_{c}").alias(f"max_{c}") for c in view.maxima]
    parts += [(F.sum(f"sum_{c}") / F.sum(f"count_{c}")).alias(f"avg_{c}") for c in averages]
    return stored.groupBy(*keys).agg(*parts)
