"""Unions and differences of rows, and comparisons of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a``, each as many times as ``b`` lacks it."""
    return a.exceptAll(b)


def compare(a: DataFrame, b: DataFrame, digits: int = 3) -> DataFrame:
    """(missing, extra, rows_a, rows_b, verdict) of two tables: rows of ``a`` that ``b`` lacks and the reverse, numbers with
    fractions rounded. Tables are `equal`, `approximate` if at most 1 % of the rows differ, or else `different`."""
    kinds = dict(a.dtypes)
    columns = [F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in a.columns]
    signed = a.select(*columns, F.lit(1).alias("_side")).unionByName(b.select(*columns, F.lit(-1).alias("_side")))
    net = signed.groupBy(*a.columns).agg(F.sum("_side").alias("net"), F.sum(F.expr("int(_side > 0)")).alias("ours"), F.sum(F.expr("int(_side < 0)")).alias("theirs"))
    sums = net.agg(
        *[F.coalesce(F.sum(e), F.lit(0)).alias(n) for e, n in ((F.greatest("net", F.lit(0)), "missing"), (F.greatest(-F.col("net"), F.lit(0)), "extra"), (F.col("ours"), "rows_a"), (F.col("theirs"), "rows_b"))]
    )
    share = F.greatest("missing", "extra") / F.greatest("rows_a", "rows_b", F.lit(1))
    return sums.withColumn("verdict", F.when(share == 0, "equal").when(share <= 0.01, "approximate").otherwise("different"))


def compare_columns(a: DataFrame, b: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """(column, equal, different, only_a, only_b) for each column that is no key: rows are matched by unique keys, numbers
    with fractions are compared rounded, and nulls are equal to nulls."""
    kinds, columns = dict(a.dtypes), [c for c in a.columns if c not in keys]
    ours = a.select(*keys, F.struct(*[(F.round(c, digits) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in columns]).alias("_a"))
    theirs = b.select(*keys, F.struct(*[(F.round(c, digits) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in columns]).alias("_b"))
    both = ours.join(theirs, keys, "full")
    sides = [F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("_both")]
    same = [F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(f"_same_{i}") for i, c in enumerate(columns)]
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_same_{i}").alias("equal")) for i, c in enumerate(columns)])
    out = both.agg(*sides, *same).select(F.explode(entries).alias("_e"), "only_a", "only_b", "_both")
    return out.select("_e.column", "_e.equal", (F.col("_both") - F.col("_e.equal")).alias("different"), "only_a", "only_b")
