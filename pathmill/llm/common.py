"""Helpers that the corpus operators share: reading tables, cutting lineage, numbering rows, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathmill.sources.storage import remove, shared_folder

#: Lists of row ids up to this number (some 16 bytes each) are broadcast, longer ones are joined by a shuffle.
BROADCAST_IDS = 1 << 20
_scratch: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns a reader of it, so that lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/pathmill/{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written by ``materialize`` inside are removed at the end, but for those handed to ``keep``."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """A written copy of ``df`` that outlives the innermost ``scratch``."""
    own = _scratch.pop()
    try:
        return materialize(df)
    finally:
        _scratch.append(own)


def by_ids(df: DataFrame, ids: DataFrame, column: str | list[str], how: str) -> DataFrame:
    """``df`` joined with a written table of ids (and little beside them), which is broadcast if it is short."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def release_memory() -> None:
    """Gives freed memory back to the system where the C library can: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def number_within(df: DataFrame, keys: list[str], order: Column, out: str, rows_per_bucket: int = 20_000) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... without gaps within each combination of ``keys``.

    A key may hold any share of the rows. Each key's rows are spread over hash buckets of ``order``, numbered inside
    a bucket, and shifted by the sizes of the buckets before it; no task sees a whole key.
    """
    total = df.count()
    buckets = max(1, -(-total // rows_per_bucket))
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_kb"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    numbered = spread.withColumn("_at", F.row_number().over(inside) - 1)
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bucket") == F.col("_kb")]
    on = match[0]
    for m in match[1:]:
        on = on & m
    return numbered.join(starts, on).withColumn(out, (F.col("_start") + F.col("_at")).cast("long")).select(*df.columns, out)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges of longs to (node, root): root is the smallest node that can be reached; only nodes with an edge appear.

    Alternating large-star and small-star steps; each is a grouped minimum (combined before the shuffle) and a join on
    the node of two written tables, by broadcast for a short list of nodes, else by a shuffle in which adaptive execution
    can split a node with very many edges. Nothing but counts and two sums a round reaches the driver.
    """
    with scratch(edges.sparkSession):
        cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        last = None
        for _ in range(max_rounds):
            both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
            large = by_ids(both, low, "a", "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            large = materialize(large)
            low = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
            ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
            small = by_ids(large, low, "a", "inner").select(F.explode(ends).alias("e")).select("e.*").where("a <> b").distinct()
            cur = materialize(small)
            state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == last:
                break
            last = state
        else:
            raise RuntimeError("connected components did not settle")
        out = cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        return keep(out)
