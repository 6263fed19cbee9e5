"""Queries over the trade tables against their SQL where keys are null, zero or held twice."""

import duckdb
import pandas as pd

from pathmill.operators import maintain
from pathmill.queries import ORACLE_SQL, QUERIES


def compare(spark, folder, name, **tables):
    duck = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, expected = QUERIES[name](spark, str(folder)).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    pd.testing.assert_frame_equal(*[df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True).astype("float64", errors="ignore") for df in (got, expected)], check_dtype=False)


def test_inserted_rows_are_added_whatever_their_keys(spark, tmp_path):
    customers = [(0, "BUILDING"), (1, "BUILDING"), (1, "BUILDING"), (2, "MACHINERY"), (None, "BUILDING"), (-5, "BUILDING")]
    orders = [(0, 2), (5, 1), (-1, 2), (7, None), (None, 0)]
    compare(spark, tmp_path, "maint_insert", customer=(customers, "c_custkey long, c_mktsegment string"), orders=(orders, "o_orderkey long, o_custkey long"))


def test_a_deletion_over_a_path_reads_and_sorts_its_rows_once(spark, folder):
    plan = QUERIES["maint_delete_over_path"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") == 1  # one relation of the lines, all columns named
    assert plan.count("Aggregate") == 1  # the count alone: keys need not be distinct to be looked up


def test_deletion_by_keys_held_twice_or_null(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    gone = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert sorted(r.v for r in maintain.delete_keys(rows, gone, ["k"]).collect()) == ["c", "d"]
