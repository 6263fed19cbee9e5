"""Conditions, aggregates and row hashes as columns."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}

#: (column, operator, value): all conditions of a list must hold, also several on one column.
Condition = tuple[str, str, object]


def condition(column: str, op: str, value: object) -> Column:
    """A comparison of a column with a value; a null column never fits."""
    return COMPARE[op](F.col(column), F.lit(value))


def conjunction(conditions: Iterable[Condition]) -> Column:
    return reduce(operator.and_, (condition(*c) for c in conditions), F.lit(True))


def keep(df: DataFrame, conditions: Iterable[Condition]) -> DataFrame:
    """Rows that fit all conditions. Each is a filter of its own, so those that a scan can take reach it."""
    for c in conditions:
        df = df.where(condition(*c))
    return df


def aggregate_column(function: str, column: str, digits: int | None = None) -> Column:
    """``sum``, ``count``, ``avg`` or ``max`` of a column, named ``<function>_<column>``; ``digits`` rounds it.

    Nulls do not count and do not lower averages; the count of ``*``, named ``count_rows``, is the size of the group.
    """
    if (function, column) == ("count", "*"):
        return F.count(F.lit(1)).alias("count_rows")
    out = {"sum": F.sum, "count": F.count, "avg": F.avg, "max": F.max}[function](column)
    return (out if digits is None else F.round(out, digits)).alias(f"{function}_{column}")


def row_hash(columns: Iterable[str]) -> Column:
    """CRC-32 of the columns' texts in the order of their names, joined by commas; nulls count as empty."""
    return F.crc32(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(columns)]).cast("binary"))


def rest_map(df: DataFrame, named: Iterable[str]) -> DataFrame:
    """The named columns, and ``rest``: a map of all other columns' names to their values as text, without nulls."""
    named = list(named)
    others = [c for c in df.columns if c not in named]
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in others]), lambda x: x["value"].isNotNull())
    return df.select(*named, F.map_from_entries(pairs).alias("rest"))


def without_empty_rows(df: DataFrame) -> DataFrame:
    """Rows of which at least one column has a value."""
    return df.na.drop(how="all")


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of which all of ``columns`` (all columns if none are given) have a value."""
    return df.na.drop(how="any", subset=columns)
