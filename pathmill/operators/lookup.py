"""Lookup joins: rows that are there already fetch what views hold under their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of at most so many bytes, measured, is sent to all executors; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def measured_broadcast(df: DataFrame, rows_at_most: int = 100_000, bytes_at_most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has few rows and few bytes (as text); counting stops at the bound of rows."""
    width = F.octet_length(F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in df.columns])) + 8 * len(df.columns)
    rows, size = df.limit(rows_at_most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= rows_at_most and size <= bytes_at_most else df


def lookup(rows: DataFrame, view: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows joined with what ``view`` holds under ``keys``; on equal names the view's column wins. Rows with a null key drop."""
    if columns is not None:
        view = view.select(*dict.fromkeys([*keys, *columns]))
    own = [c for c in rows.columns if c in keys or c not in view.columns]
    return rows.select(*own).na.drop(subset=keys).join(view, keys, "inner")


def lookup_chain(rows: DataFrame, steps: list[tuple[DataFrame, list[str], list[str] | None]]) -> DataFrame:
    """One lookup after the other: (view, keys, columns) each."""
    for view, keys, columns in steps:
        rows = lookup(rows, view, keys, columns)
    return rows


def combine(parts: list[DataFrame]) -> DataFrame:
    """Every combination of the rows of small results of different lookups. Each but the first must be small enough to
    broadcast, which is measured; more rows than that are an error, since the result would be their product."""
    out = parts[0]
    for part in parts[1:]:
        if part.limit(10_001).count() > 10_000:
            raise ValueError("a result of over 10000 rows is not combined; join it on a key")
        out = out.crossJoin(F.broadcast(part))
    return out
