"""Statements that change rows, and what they change in views.

A statement gives the changed rows as a DataFrame; a view keeps the rows that are not affected and takes the new ones of
the affected keys, which are computed again from the changed tables restricted to those keys. Nothing else is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmill.functions.expressions import Condition, conjunction
from pathmill.plans.model import Model
from pathmill.plans.store import ViewStore


def insert(df: DataFrame, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``df`` with new rows; rows that have the keys of new ones are replaced. Columns that the new rows lack are null."""
    kept = df if keys is None else df.join(rows.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True).select(*df.columns)


def update(df: DataFrame, settings: dict[str, object], conditions: Iterable[Condition] = ()) -> DataFrame:
    """Sets columns of the rows that fit. Conditions that are null do not fit."""
    fits = F.coalesce(conjunction(conditions), F.lit(False))
    kinds = dict(df.dtypes)
    return df.select(*[F.when(fits, F.lit(settings[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in settings else F.col(c) for c in df.columns])


def update_over(df: DataFrame, settings: dict[str, object], reached: DataFrame, keys: list[str]) -> DataFrame:
    """Sets columns of the rows whose keys are among those of ``reached``: an update over a path."""
    kinds = dict(df.dtypes)
    hit = df.join(reached.select(*keys).distinct().withColumn("_reached", F.lit(True)), keys, "left")
    fits = F.col("_reached").isNotNull()
    return hit.select(*[F.when(fits, F.lit(settings[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in settings else F.col(c) for c in df.columns])


def insert_connected(model: Model, tables: dict[str, DataFrame], entity: str, row: dict[str, object], connections: dict[str, object]) -> dict[str, DataFrame]:
    """The tables with a new row of ``entity`` that is connected over foreign keys, named with the key of the row at the
    other end. A key that the entity holds is set in the new row; one that the other entity holds is set there."""
    row, changed = dict(row), tables | {}
    for edge, target in connections.items():
        fk = model.edges[edge]
        if fk.entity == entity:
            row |= dict(zip(fk.columns, target if isinstance(target, tuple) else (target,), strict=True))
        elif fk.target == entity:
            own = {c: row[k] for c, k in zip(fk.columns, fk.target_columns, strict=True)}
            at = target if isinstance(target, tuple) else (target,)
            changed[fk.entity] = update(changed[fk.entity], own, [(k, "=", v) for k, v in zip(model.keys[fk.entity], at, strict=True)])
        else:
            raise ValueError(f"{edge} does not touch {entity}")
    held = tables[entity]
    new = held.sparkSession.range(1).select(*[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in held.schema.fields])
    changed[entity] = insert(changed[entity], new, list(model.keys[entity]))
    return changed


def delete(df: DataFrame, conditions: Iterable[Condition] = ()) -> DataFrame:
    return df.where(~F.coalesce(conjunction(conditions), F.lit(False)))


def delete_keys(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among those of ``rows``; for statements that reach the entity over a path."""
    return df.join(rows.select(*keys), keys, "left_anti")


def connect(df: DataFrame, key: str, key_value: object, foreign_key: str, target: object) -> DataFrame:
    """Points one row's foreign key to a target."""
    return update(df, {foreign_key: target}, [(key, "=", key_value)])


def disconnect(df: DataFrame, key: str, key_value: object, foreign_key: str, target: object) -> DataFrame:
    """Clears one row's foreign key, if it points to the target."""
    return update(df, {foreign_key: None}, [(key, "=", key_value), (foreign_key, "=", target)])


def under(df: DataFrame, rows: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose keys are among those of ``rows`` (left_anti: are not); a null key is a key like any other."""
    named = rows.select(*[F.col(k).alias(f"_under_{k}") for k in keys])
    return df.join(named, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_under_{k}")) for k in keys]), how)


def refresh(view: DataFrame, affected: DataFrame, keys: list[str], define: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A view after a change: rows under the affected keys go, and what ``define`` gives for those keys comes.

    ``define`` gets the distinct affected keys and returns the view's rows of the changed tables under them.
    """
    touched = affected.select(*keys).distinct()
    return under(view, touched, keys, "left_anti").unionByName(define(touched).select(*view.columns))


def carry_over(store: ViewStore, columns: Iterable[str], changes: dict[str, tuple[DataFrame, DataFrame]]) -> list[str]:
    """Brings stored views up to date after a statement that set ``columns``, and names those that it touches.

    ``changes`` has for each view its rows of the changed rows before and after the statement. Old rows are deleted only
    where a key changes; elsewhere the new ones take their place.
    """
    touched = []
    for name, (before, after) in changes.items():
        view = store.view(name)
        if not view.touched_by(columns):
            continue
        touched.append(name)
        if view.moved_by(columns):
            store.delete(name, before.select(*view.keys))
        store.upsert(name, after)
    return touched
