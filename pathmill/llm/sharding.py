"""Sharding by a k-d tree: nodes are split at distributed weighted medians along their widest metadata dimension.

Points are groups of equal texts, so that copies stay together; only a group larger than a whole shard, which no shard
could hold, is dealt into salted pieces. Coordinates of a point, each in [0, 1): the logarithm of its text's size, hashes
of the source and of the language, and its smallest doc_id. Ties along a dimension are ordered by a hash of the point, so
a median always divides. A node of k leaves is split into k // 2 and the rest, at the weight in that proportion. Points
over a fiftieth of a shard would make medians coarse, so at each split they are placed first, the heaviest to the side
with more room, and the median of the others fills both sides up. The median is found in histograms that are refined
digit by digit. Splits, histograms and medians are tables; the driver sees no point, node or cell.

Law `bytes`: the shards' sizes are near equal. Defined results: a null text has size 1 and the checksum of no bytes, and
counts as equal to an empty one; null sources, languages and ids are values of their own; repeated rows stay separate
rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathmill.llm.common import keep, materialize, number_within, scratch, table

SHARDS = 8
#: Points over this share of a shard are placed before the median of the others; a tree has at most 1 / POINT_SHARE such points a shard.
POINT_SHARE = 1 / 50
#: A cell of the histogram with at most this share of its node is not refined any further.
TOLERANCE = 1 / 2000
KEY_BITS, CELL_BITS = 62, 14
#: Nodes up to this number (some 40 bytes each) are broadcast to the points, more are joined by a shuffle.
BROADCAST_NODES = 1 << 16
DIMENSIONS = ("size", "source", "lang", "id")
POINT = ("text_hash", "text_crc32", "piece")


def _unit(c: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(c), 11) / F.lit(float(1 << 53))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has = set(docs.columns)
    meta = [(F.col(c) if c in has else F.lit(None)).cast("string").alias(c) for c in ("source", "lang")]
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
        *meta,
    )


def key(dimension: str) -> Column:
    """Order of the points along a dimension: 31 bits of the coordinate, then 31 bits of a hash of the point."""
    high = F.least(F.floor(F.col(dimension) * float(1 << 31)), F.lit((1 << 31) - 1)).cast("long")
    low = F.shiftrightunsigned(F.xxhash64(*POINT), 33)
    return F.shiftleft(high, 31).bitwiseOR(low)


def points_of(rows: DataFrame, shard_bytes: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the piece of each, and the points (POINT, w, coordinates, big)."""
    group = ["text_hash", "text_crc32"]
    hot = rows.groupBy(*group).agg(F.sum("size").alias("w")).where(F.col("w") > shard_bytes)  # fewer groups than shards
    hot = materialize(hot.select(*group, F.ceil(F.col("w") / (shard_bytes * POINT_SHARE)).alias("pieces")))
    rows = rows.join(F.broadcast(hot), group, "left").withColumn("piece", F.coalesce(F.pmod("salt", "pieces"), F.lit(0).cast("long")))
    first, last = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    place = F.lit(0.0)
    if first is not None and not isinstance(first, str):
        place = (F.coalesce(F.min("doc_id"), F.lit(first)) - F.lit(first)) / F.lit(float(last - first + 1))
    points = rows.groupBy(*POINT).agg(
        F.sum("size").alias("w"),
        (F.log2(F.min("size").cast("double")) / 40).alias("size"),
        _unit(F.min("source")).alias("source"),
        _unit(F.min("lang")).alias("lang"),
        place.cast("double").alias("id"),
    )
    return rows, points.withColumn("big", F.col("w") > shard_bytes * POINT_SHARE)


def _deal(node: pd.DataFrame) -> pd.DataFrame:
    """The sides (0 left, 1 right) of a node's big points: the heaviest first, each to the side with more room a leaf."""
    left, right = int(node["k"].iloc[0]) // 2, int(node["k"].iloc[0]) - int(node["k"].iloc[0]) // 2
    loads, sides = [0, 0], []
    node = node.sort_values(["w", *POINT], ascending=False)
    for w in node["w"].tolist():
        side = int((loads[0] + w) * right > (loads[1] + w) * left)
        loads[side] += w
        sides.append(side)
    return node[["node", *POINT, "w"]].assign(side=sides)


def _split_level(points: DataFrame, nodes: int, any_big: bool) -> DataFrame:
    """Splits every node of several leaves (node: its first leaf, k: how many) once."""

    def of_node(df: DataFrame, other: DataFrame) -> DataFrame:
        return df.join(F.broadcast(other) if nodes <= BROADCAST_NODES else other, "node")

    busy = points.where("k > 1")
    small = F.when(~F.col("big"), F.col("w")).otherwise(0)
    spans = busy.groupBy("node", "k").agg(F.sum("w").alias("w"), F.sum(small).alias("small"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS])
    widest = F.greatest(*DIMENSIONS)
    state = spans.select("node", F.floor(F.col("k") / 2).cast("int").alias("half"), "w", "small", F.coalesce(*[F.when(F.col(d) == widest, F.lit(i)) for i, d in enumerate(DIMENSIONS)]).alias("dim"))
    share = F.expr("w * half / k")
    sides = None
    if any_big:
        sides = materialize(busy.where("big").select("node", "k", *POINT, "w").groupBy("node").applyInPandas(_deal, "node int, text_hash long, text_crc32 long, piece long, w long, side int"))
        taken = sides.where("side = 0").groupBy("node").agg(F.sum("w").alias("taken"))
        state = state.join(taken, "node", "left").join(spans.select("node", "k"), "node")
        share = share - F.coalesce("taken", F.lit(0))
    else:
        state = state.join(spans.select("node", "k"), "node")
    left = F.least(F.greatest(share, F.lit(0.0)), F.col("small").cast("double")).alias("left")
    state = materialize(state.select("node", "half", "dim", left, "small", F.lit(0).cast("long").alias("prefix"), F.lit(KEY_BITS).alias("shift"), F.lit(True).alias("open")))
    keyed = of_node(busy.where("not big").select("node", *POINT, *DIMENSIONS, "w"), state.select("node", "dim"))
    keyed = keyed.select("node", "w", F.element_at(F.array(*[key(d) for d in DIMENSIONS]), F.col("dim") + 1).alias("key"))
    shift = KEY_BITS
    while shift:
        after = max(0, shift - CELL_BITS)
        inside = of_node(keyed, state.where("open").select("node", "prefix")).where(F.shiftright("key", shift) == F.col("prefix"))
        cells = inside.groupBy("node", F.shiftright("key", after).alias("cell")).agg(F.sum("w").alias("cell_w"))  # at most 2^CELL_BITS a node
        so_far = F.sum("cell_w").over(Window.partitionBy("node").orderBy("cell")) - F.col("cell_w")
        found = cells.withColumn("before", so_far).join(state.where("open"), "node").where("before + cell_w >= left or cell_w is null")
        found = found.groupBy("node", "half", "dim", "left", "small").agg(F.min(F.struct("cell", "before", "cell_w")).alias("at"))
        rest = F.col("left") - F.col("at.before")
        refined = (F.col("at.cell_w") > F.col("small") * TOLERANCE) & F.lit(after > 0)
        # The last cell goes to the side where it leaves less between the two.
        prefix = F.col("at.cell") - F.when(~refined & (rest < F.col("at.cell_w") / 2), 1).otherwise(0)
        found = found.select("node", "half", "dim", rest.alias("left"), "small", prefix.alias("prefix"), F.lit(after).alias("shift"), refined.alias("open"))
        state = materialize(state.where("not open").unionByName(found))
        shift = after
        if state.where("open").isEmpty():
            break
    ends = state.select("node", "dim", "prefix", "shift")
    lasts = of_node(busy.where("not big"), ends).withColumn("key", F.element_at(F.array(*[key(d) for d in DIMENSIONS]), F.col("dim") + 1))
    parts = [points.where("k = 1"), lasts.withColumn("side", F.expr("cast(shiftright(key, shift) > prefix as int)"))]
    if any_big:
        parts.append(busy.where("big").join(sides.select("node", *POINT, "side"), ["node", *POINT]))
    half = F.floor(F.col("k") / 2).cast("int")
    moved = [p.withColumn("node", F.col("node") + F.col("side") * half).withColumn("k", F.when(F.col("side") == 0, half).otherwise(F.col("k") - half)) for p in parts[1:]]
    return reduce(DataFrame.unionByName, [p.select(*points.columns) for p in (parts[0], *moved)])


def kd_leaves(points: DataFrame, shards: int) -> DataFrame:
    """(POINT, shard) for every point."""
    with scratch(points.sparkSession):
        points = materialize(points.withColumn("node", F.lit(0)).withColumn("k", F.lit(shards)))
        any_big, nodes = not points.where("big").isEmpty(), 1
        while nodes < shards:
            points = materialize(_split_level(points, nodes, any_big))
            nodes *= 2
        return keep(points.select(*POINT, F.col("node").alias("shard")))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row: ``shards`` shards, or as many as reach ``target_bytes`` each."""
    rows = materialize(_rows(docs))
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    shards = shards or -(-total // target_bytes)
    rows, points = points_of(rows, total / shards)
    placed = rows.join(kd_leaves(points, shards), list(POINT))
    return number_within(placed.select("doc_id", "size", "text_crc32", "salt", "shard"), ["shard"], F.col("salt"), "slot").drop("salt")


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"), shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
