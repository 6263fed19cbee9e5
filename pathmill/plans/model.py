"""Entities, their keys and the foreign keys between them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ForeignKey:
    """An edge that can be followed both ways; a composite key has several columns on each side."""

    name: str
    entity: str
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]


@dataclass
class Model:
    """Entities by name with their key columns, and the foreign keys by name."""

    keys: dict[str, tuple[str, ...]]
    edges: dict[str, ForeignKey] = field(default_factory=dict)

    def link(self, name: str, entity: str, target: str, columns: tuple[str, ...] | None = None) -> Model:
        """Adds the foreign key ``name`` from ``entity`` to the key of ``target``."""
        if name in self.edges:
            raise ValueError(f"foreign key {name} is there already")
        for e in (entity, target):
            if e not in self.keys:
                raise KeyError(f"no entity {e}")
        self.edges[name] = ForeignKey(name, entity, columns or (name,), target, self.keys[target])
        return self

    def across(self, entity: str, edge: str) -> tuple[str, list[tuple[str, str]]]:
        """The entity that ``edge`` leads to from ``entity``, and the pairs of columns (here, there) that must be equal."""
        fk = self.edges[edge]
        if entity == fk.entity:
            return fk.target, list(zip(fk.columns, fk.target_columns, strict=True))
        if entity == fk.target:
            return fk.entity, list(zip(fk.target_columns, fk.columns, strict=True))
        raise ValueError(f"{edge} does not touch {entity}")


def statistics(tables: dict[str, DataFrame], exact: bool = False) -> DataFrame:
    """(entity, column, rows, distinct_values, mean_bytes) of every column: what sizes of views are judged from. Distinct
    values are estimated in one pass unless ``exact``."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    out = None
    for name, df in tables.items():
        sums = [F.count(F.lit(1)).alias("rows")]
        for c in df.columns:
            sums += [distinct(F.col(c)).alias(f"d_{c}"), F.avg(F.octet_length(F.col(c).cast("string"))).alias(f"b_{c}")]
        one = df.agg(*sums)
        entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("distinct_values"), F.col(f"b_{c}").alias("mean_bytes")) for c in df.columns])
        part = one.select(F.lit(name).alias("entity"), "rows", F.explode(entries).alias("e")).select("entity", "e.column", "rows", "e.distinct_values", "e.mean_bytes")
        out = part if out is None else out.unionAll(part)
    return out


def infer_model(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]]) -> Model:
    """A model of tables with known keys; a column of another table with a key's name is a foreign key."""
    found = Model(dict(keys))
    for name, df in tables.items():
        for target, key in keys.items():
            if target != name and set(key) <= set(df.columns):
                found.link(f"{name}_{'_'.join(key)}", name, target, key)
    return found


def trade_model() -> Model:
    """The model of the test tables. lineitem and events have no key of their own that is unique."""
    model = Model({
        "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
        "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",),
    })
    for name, entity, target in (
        ("l_orderkey", "lineitem", "orders"), ("l_partkey", "lineitem", "part"), ("l_suppkey", "lineitem", "supplier"), ("o_custkey", "orders", "customer"),
        ("c_nationkey", "customer", "nation"), ("s_nationkey", "supplier", "nation"), ("n_regionkey", "nation", "region"), ("user_id", "events", "customer"),
    ):
        model.link(name, entity, target)
    return model
