"""Samples of views: parameters for queries, and the middle of each partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathmill.sources.storage import shared_path

#: Keys with fewer rows stay whole.
WHOLE_BELOW = 100


def interquartile(df: DataFrame, keys: list[str], order: list[str], low: float = 0.25, high: float = 0.75, whole_below: int = WHOLE_BELOW) -> DataFrame:
    """The rows of each key whose place in ``order``, from 0, is from floor(n low) to before floor(n high) of the key's n
    rows; keys with few rows stay whole.

    A key may hold any share of the rows: the table is dealt to ranges of key and order, written in them, numbered inside
    each range, and shifted by the counts of the ranges before it. No task sees a whole key.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "ranges")
    dealt = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    ranged = spark.read.schema(dealt.schema).parquet(path)
    counts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_in"))  # for each key as many rows as it has ranges
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of"), F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_first"), F.sum("_in").over(by_key).alias("_n"))
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    on = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    at = F.col("_first") + F.col("_at")
    inside = (at >= F.floor(F.col("_n") * low)) & (at < F.floor(F.col("_n") * high))
    return placed.join(counts, on).where((F.col("_n") < whole_below) | inside).select(*df.columns)


def sample_rows(df: DataFrame, share: float = 0.05, seed: int = 42, columns: list[str] | None = None) -> DataFrame:
    """A seeded sample of complete rows."""
    return df.na.drop(subset=columns).sample(share, seed)
