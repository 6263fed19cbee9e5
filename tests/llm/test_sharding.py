"""The k-d tree against a plain recursive one over the same points, and groups of equal texts."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathmill.llm import sharding


def plain_tree(points, shards):
    """{point: shard}: exact weighted medians along the widest dimension, the big points placed first."""
    out = {}

    def split(rows, first, k):
        if k == 1:
            out.update({tuple(r[p] for p in sharding.POINT): first for r in rows})
            return
        half = k // 2
        dim = max(sharding.DIMENSIONS, key=lambda d: (max(r[d] for r in rows) - min(r[d] for r in rows), -sharding.DIMENSIONS.index(d)))
        sides, loads = ([], []), [0, 0]
        for r in sorted((r for r in rows if r["big"]), key=lambda r: (r["w"], *(r[p] for p in sharding.POINT)), reverse=True):
            side = int((loads[0] + r["w"]) * (k - half) > (loads[1] + r["w"]) * half)
            loads[side] += r["w"]
            sides[side].append(r)
        small = sorted((r for r in rows if not r["big"]), key=lambda r: r[f"key_{dim}"])
        left = min(max(sum(r["w"] for r in rows) * half / k - loads[0], 0), sum(r["w"] for r in small))
        over = False
        for r in small:
            if not over and r["w"] >= left:  # the point that reaches the target: to the nearer side
                over = True
                sides[int(left < r["w"] / 2)].append(r)
            else:
                sides[int(over)].append(r)
                left -= r["w"]
        split(sides[0], first, half)
        split(sides[1], first + half, k - half)

    split(points, 0, shards)
    return out


@pytest.mark.parametrize("shards", [8, 5, 1])
def test_tree_is_the_plain_one(spark, folder, monkeypatch, shards):
    monkeypatch.setattr(sharding, "TOLERANCE", 0)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sharding._rows(docs).cache()
    total = rows.agg(F.sum("size")).first()[0]
    _, points = sharding.points_of(rows, total / shards)
    points = points.cache()
    held = [r.asDict() for r in points.select("*", *[sharding.key(d).alias(f"key_{d}") for d in sharding.DIMENSIONS]).collect()]
    got = {tuple(r[p] for p in sharding.POINT): r["shard"] for r in sharding.kd_leaves(points, shards).collect()}
    assert got == plain_tree(held, shards)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_equal_texts_share_a_shard_and_sizes_are_near(spark, table):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet").select("doc_id", "text", "lang", "source")
    copies = docs.where("length(text) between 300 and 400").orderBy("doc_id").limit(1).select("text", "lang", "source").crossJoin(spark.range(40)).selectExpr("1000000 + id AS doc_id", "text", "lang", "source")
    got = sharding.kd_shards(docs.unionByName(copies), shards=8).join(docs.unionByName(copies).select("doc_id", "text"), "doc_id").toPandas()
    assert got.groupby("text").shard.nunique().max() == 1
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 0.02 * sizes.mean()


def test_a_group_over_a_shard_is_dealt_and_balance_stays(spark):
    rows = [(i, "copy " * 40) for i in range(300)] + [(1000 + i, f"own text {i} " * (1 + i % 30)) for i in range(600)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 900 and len(sizes) == 6 and sizes.max() - sizes.min() <= 0.05 * sizes.mean()


def test_sides_go_by_room():
    node = pd.DataFrame({"node": 0, "k": 3, "w": [9, 6, 3], "text_hash": [1, 2, 3], "text_crc32": 0, "piece": 0})
    assert dict(zip(*[sharding._deal(node)[c].tolist() for c in ("text_hash", "side")])) == {1: 1, 2: 0, 3: 1}
