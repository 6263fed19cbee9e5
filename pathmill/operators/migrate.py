"""Moving from one set of views to another: new views from stored ones by outer joins, and the old ones dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from pathmill.plans.store import ViewStore
from pathmill.plans.views import View


def full_outer(views: list[DataFrame], keys: list[str], distinct: bool = False) -> DataFrame:
    """Views joined on their shared keys, one after the other, keeping the rows of every side."""
    out = reduce(lambda a, b: a.join(b, keys, "full"), views)
    return out.distinct() if distinct else out


def left_outer(a: DataFrame, b: DataFrame, keys: list[str], distinct: bool = False) -> DataFrame:
    out = a.join(b, keys, "left")
    return out.distinct() if distinct else out


def under_construction(now: set[str], then: set[str]) -> set[str]:
    """Views of the next timestep that must be prepared in this one."""
    return then - now


def obsolete(now: set[str], then: set[str]) -> set[str]:
    return now - then


def prepare(store: ViewStore, view: View, sources: list[str], keys: list[str]) -> DataFrame:
    """Stores a new view from stored ones, joined on their shared keys; the base tables are not read."""
    return store.save(view, full_outer([store.open(s) for s in sources], keys, distinct=not view.aggregated))


def step(store: ViewStore, then: dict[str, tuple[View, list[str], list[str]]]) -> tuple[set[str], set[str]]:
    """Brings the store to the views of ``then`` (name: view, sources, keys): prepares those that lack, validates nothing,
    and drops those that are not used any more. Returns the names of the prepared and of the dropped views."""
    now = set(store.names())
    made, gone = under_construction(now, set(then)), obsolete(now, set(then))
    for name in sorted(made):
        view, sources, keys = then[name]
        prepare(store, view, sources, keys)
    for name in gone:
        store.drop(name)
    return made, gone
