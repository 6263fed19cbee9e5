"""Joins along foreign-key paths, and path queries: select, filter, group, order and limit over them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmill.functions.expressions import Condition, aggregate_column, keep
from pathmill.plans.model import Model


class Path:
    """A join tree that grows along foreign keys. An entity occurs at most once; a path may branch."""

    def __init__(self, model: Model, tables: dict[str, DataFrame], start: str):
        self.model, self.tables = model, tables
        self.entities, self.df = [start], tables[start]

    def follow(self, *edges: str, how: str = "inner") -> Path:
        """Follows each edge from the last entity reached so far that it touches."""
        out = self
        for edge in edges:
            out = out._step(edge, how)
        return out

    def _step(self, edge: str, how: str) -> Path:
        fk = self.model.edges[edge]
        here = [e for e in self.entities if e in (fk.entity, fk.target)]
        if len(here) != 1:
            raise ValueError(f"{edge} must lead from the path to one new entity; it touches {here or 'none of it'}")
        there, pairs = self.model.across(here[0], edge)
        other = self.tables[there]
        clash = (set(self.df.columns) & set(other.columns)) - {a for a, b in pairs if a == b}
        if clash:
            raise ValueError(f"columns {sorted(clash)} are on both sides of {edge}; rename them first")
        if all(a == b for a, b in pairs):
            joined = self.df.join(other, [a for a, _ in pairs], how)
        else:
            on = [self.df[a] == other[b] for a, b in pairs]
            joined = self.df.join(other, on, how)
        out = Path.__new__(Path)
        out.model, out.tables, out.entities, out.df = self.model, self.tables, [*self.entities, there], joined
        return out

    def where(self, *conditions: Condition) -> Path:
        out = Path.__new__(Path)
        out.model, out.tables, out.entities, out.df = self.model, self.tables, self.entities, keep(self.df, conditions)
        return out


def grouped(df: DataFrame, keys: Iterable[str], aggregates: Iterable[tuple], conditions: Iterable[Condition] = ()) -> DataFrame:
    """Aggregates (function, column[, digits]) by ``keys``, after the conditions; no key gives one row, also of no rows."""
    return keep(df, conditions).groupBy(*keys).agg(*[aggregate_column(*a) for a in aggregates])


def ordered(df: DataFrame, by: Iterable[str], limit: int | None = None) -> DataFrame:
    """Ascending order, and the first ``limit`` rows of it: a top-k that needs no global sort."""
    out = df.orderBy(*[F.col(c).asc() for c in by])
    return out if limit is None else out.limit(limit)
