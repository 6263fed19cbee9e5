"""Stored views that live: opened by name, appended to, changed by keys, counted and dropped.

A view's rows are spread over a fixed number of buckets by a hash of ``hash_by``; a bucket is a folder of its own, and a
change rewrites the buckets that hold its keys and no others. The new content of those is written aside before it
replaces the old, so that a job that fails leaves the view as it was.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathmill.plans.views import View
from pathmill.sources.storage import children, exists, remove, shared_path

BUCKET = "_view_bucket"


class ViewStore:
    """Views in one folder of shared storage."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder or shared_path(spark, "views"), buckets

    def _data(self, name: str) -> str:
        return f"{self.folder}/data/{name}"

    def _definition(self, name: str) -> str:
        return f"{self.folder}/definitions/{name}"

    def _bucket(self, view: View, buckets: int):
        return F.pmod(F.xxhash64(*view.hash_by), F.lit(buckets)).cast("int")

    def _held(self, name: str) -> tuple[View, T.StructType, int]:
        if not self.exists(name):
            raise KeyError(f"no stored view {name}")
        held = json.loads(self.spark.read.text(self._definition(name)).first()[0])
        view = View(**{k: tuple(v) if isinstance(v, list) else v for k, v in held["view"].items()})
        return view, T.StructType.fromJson(held["schema"]), held["buckets"]

    def view(self, name: str) -> View:
        return self._held(name)[0]

    def _write(self, view: View, rows: DataFrame, buckets: int, path: str, mode: str) -> None:
        placed = rows.withColumn(BUCKET, self._bucket(view, buckets))
        # Ranges, not hashes: a bucket with a hot key is written by several tasks.
        placed.repartitionByRange(BUCKET, *view.keys).sortWithinPartitions(BUCKET, *view.keys).write.partitionBy(BUCKET).mode(mode).option("partitionOverwriteMode", "dynamic").parquet(path)

    def save(self, view: View, df: DataFrame) -> DataFrame:
        """Stores the view of the join ``df`` anew under its name."""
        rows = view.rows(df)
        remove(self.spark, self._data(view.name))
        held = {"view": asdict(view), "schema": json.loads(rows.schema.json()), "buckets": self.buckets}
        self.spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(self._definition(view.name))
        self._write(view, rows, self.buckets, self._data(view.name), "overwrite")
        return self.open(view.name)

    def open(self, name: str) -> DataFrame:
        _, schema, _ = self._held(name)
        whole = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(whole).parquet(self._data(name)).drop(BUCKET)

    def lookup(self, name: str, rows: DataFrame) -> DataFrame:
        """What the view holds under the ``hash_by`` values of a few rows: only their buckets are read."""
        view, schema, buckets = self._held(name)
        wanted = rows.select(*view.hash_by).distinct()
        at = [r[0] for r in wanted.select(self._bucket(view, buckets)).distinct().collect()]  # at most as many as there are buckets
        whole = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        held = self.spark.read.schema(whole).parquet(self._data(name)).where(F.col(BUCKET).isin(at))
        return held.drop(BUCKET).join(wanted, list(view.hash_by), "left_semi")

    def append(self, name: str, df: DataFrame) -> None:
        """Adds the view's rows of ``df``; partial results of an aggregated view are merged, rows of a distinct one stay distinct."""
        view, _, buckets = self._held(name)
        rows = view.rows(df)
        if not view.aggregated and not view.distinct:
            self._write(view, rows, buckets, self._data(name), "append")
            return
        self._replace(name, rows, lambda old, new: view.merged(old.unionByName(new)))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Puts rows (of the view's columns) in the place of those with equal keys, or beside the others."""
        view, schema, _ = self._held(name)
        self._replace(name, rows.select(*schema.names), lambda old, new: old.join(new.select(*view.keys).distinct(), list(view.keys), "left_anti").unionByName(new))

    def delete(self, name: str, keys: DataFrame) -> None:
        """Takes out the rows whose keys (``hash_by`` and as many of ``order_by`` as ``keys`` has) are among ``keys``."""
        view, _, _ = self._held(name)
        by = [k for k in view.keys if k in keys.columns]
        if not set(view.hash_by) <= set(by):
            raise ValueError(f"rows of {name} are found by {view.hash_by}")
        self._replace(name, keys.select(*by).distinct(), lambda old, gone: old.join(gone, by, "left_anti"))

    def _replace(self, name: str, change: DataFrame, content) -> None:
        view, schema, buckets = self._held(name)
        aside = shared_path(self.spark, "changes")
        change.write.parquet(f"{aside}/change")
        change = self.spark.read.schema(change.schema).parquet(f"{aside}/change")
        touched = [r[0] for r in change.select(self._bucket(view, buckets)).distinct().collect()]  # at most as many as there are buckets
        if touched:
            whole = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
            old = self.spark.read.schema(whole).parquet(self._data(name)).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
            content(old, change).select(*schema.names).write.parquet(f"{aside}/content")
            new = self.spark.read.schema(schema).parquet(f"{aside}/content")
            left = {r[0] for r in new.select(self._bucket(view, buckets)).distinct().collect()}
            self._write(view, new, buckets, self._data(name), "overwrite")
            for b in set(touched) - left:
                remove(self.spark, f"{self._data(name)}/{BUCKET}={b}")
        remove(self.spark, aside)

    def names(self) -> list[str]:
        return children(self.spark, f"{self.folder}/definitions")

    def exists(self, name: str) -> bool:
        return exists(self.spark, self._definition(name))

    def count(self, name: str) -> int:
        return self.open(name).count()

    def empty(self, name: str) -> bool:
        return self.open(name).isEmpty()

    def drop(self, name: str) -> bool:
        found = remove(self.spark, self._definition(name))
        remove(self.spark, self._data(name))
        return found

    def clear(self) -> None:
        for name in self.names():
            self.drop(name)
