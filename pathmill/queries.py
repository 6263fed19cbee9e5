"""Queries over the trade tables, one for each operator, and the same in SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathmill.functions.expressions import complete_rows, keep, rest_map, row_hash, without_empty_rows
from pathmill.operators import maintain, migrate, sets
from pathmill.operators.lookup import combine, lookup, lookup_chain, measured_broadcast
from pathmill.operators.paths import Path, grouped, ordered
from pathmill.operators.sampling import interquartile
from pathmill.plans.model import Model, infer_model, statistics, trade_model
from pathmill.plans.store import ViewStore
from pathmill.plans.views import View, coarser
from pathmill.sources.readers import DERBY, FACTOR, MODULUS, csv_table, derby_archive, jdbc_table, parquet_tables, random_rows, write_csv
from pathmill.sources.storage import shared_path
from pathmill.streaming.timesteps import frequencies, mix, reset_interval, run_frequencies

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of the tables under its own name, with its SQL."""

    def add(f: Callable[[dict[str, DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(parquet_tables(spark, sf_dir, TABLES))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def path(t: dict[str, DataFrame], start: str, *edges: str) -> DataFrame:
    return Path(trade_model(), t, start).follow(*edges).df


def day(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


LINES_TO_REGION = ("l_orderkey", "o_custkey", "c_nationkey", "n_regionkey")
FROM_LINES = {
    2: "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey",
    3: "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey",
    4: "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey",
}
FROM_LINES[5] = FROM_LINES[4] + " JOIN region r ON n.n_regionkey = r.r_regionkey"


# paths and branches


@query(f"SELECT l_linenumber, o_orderkey, o_orderpriority FROM {FROM_LINES[2]} WHERE o_orderstatus = 'F' AND l_quantity > 45")
def path_join_2(t):
    return keep(path(t, "lineitem", "l_orderkey"), [("o_orderstatus", "=", "F"), ("l_quantity", ">", 45)]).select("l_linenumber", "o_orderkey", "o_orderpriority")


@query(f"SELECT o_orderpriority, count(l_linenumber) AS count_l_linenumber FROM {FROM_LINES[3]} WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderpriority")
def path_join_3(t):
    return grouped(path(t, "lineitem", "l_orderkey", "o_custkey"), ["o_orderpriority"], [("count", "l_linenumber")], [("c_mktsegment", "=", "BUILDING")])


@query(f"SELECT n_name, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM {FROM_LINES[4]} WHERE l_returnflag = 'R' GROUP BY n_name")
def path_join_4(t):
    return grouped(path(t, "lineitem", "l_orderkey", "o_custkey", "c_nationkey"), ["n_name"], [("sum", "l_extendedprice", 2)], [("l_returnflag", "=", "R")])


@query(f"SELECT l_linenumber, o_orderkey, c_name, n_name, r_name FROM {FROM_LINES[5]} WHERE r_name = 'ASIA' AND l_quantity > 45")
def path_join_5(t):
    df = keep(path(t, "lineitem", *LINES_TO_REGION), [("r_name", "=", "ASIA"), ("l_quantity", ">", 45)])
    return df.select("l_linenumber", "o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT r_name, count(c_custkey) AS count_c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def path_reversed(t):
    return grouped(path(t, "region", "n_regionkey", "c_nationkey"), ["r_name"], [("count", "c_custkey")])


@query("SELECT o_orderpriority, p_brand, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_type = 'ECONOMY' GROUP BY o_orderpriority, p_brand")
def branch_join(t):
    return grouped(path(t, "lineitem", "l_orderkey", "l_partkey"), ["o_orderpriority", "p_brand"], [("sum", "l_extendedprice", 2)], [("p_type", "=", "ECONOMY")])


@query("SELECT l.l_returnflag, count(*) AS n FROM lineitem l JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O') v ON l.l_orderkey = v.l_orderkey AND l.l_linenumber = v.l_linenumber GROUP BY l.l_returnflag")
def composite_join(t):
    view = keep(t["lineitem"], [("l_linestatus", "=", "O")]).select("l_orderkey", "l_linenumber").distinct()
    return t["lineitem"].join(view, ["l_orderkey", "l_linenumber"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l.l_returnflag, count(*) AS n FROM lineitem l JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O') v ON l.l_orderkey = v.l_orderkey AND l.l_linenumber = v.l_linenumber GROUP BY l.l_returnflag")
def composite_path(t):
    key = ("l_orderkey", "l_linenumber")
    model = Model({"lineitem": key, "open": key}).link("of_open", "lineitem", "open", key)
    tables = {"lineitem": t["lineitem"], "open": keep(t["lineitem"], [("l_linestatus", "=", "O")]).select(*key).distinct()}
    return Path(model, tables, "lineitem").follow("of_open").df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


# filters


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")
def filter_eq(t):
    return keep(t["orders"], [("o_orderpriority", "=", "1-URGENT"), ("o_orderstatus", "=", "O")]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '5-LOW'")
def filter_neq(t):
    return keep(t["orders"], [("o_orderstatus", "!=", "F"), ("o_orderpriority", "=", "5-LOW")]).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 49")
def filter_range(t):
    return keep(t["lineitem"], [("l_quantity", ">=", 49)]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT l_orderkey, l_partkey, l_discount, l_tax FROM lineitem WHERE l_discount > 0.08 AND l_tax <= 0.01 AND l_quantity < 10")
def filter_multi_range(t):
    return keep(t["lineitem"], [("l_discount", ">", 0.08), ("l_tax", "<=", 0.01), ("l_quantity", "<", 10)]).select("l_orderkey", "l_partkey", "l_discount", "l_tax")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= timestamp '1996-03-01' AND o_orderdate < timestamp '1996-04-01'")
def filter_two_sided(t):
    return keep(t["orders"], [("o_orderdate", ">=", day("1996-03-01")), ("o_orderdate", "<", day("1996-04-01"))]).select("o_orderkey", "o_orderdate")


@query("SELECT * FROM customer WHERE c_custkey = 42")
def select_star(t):
    return keep(t["customer"], [("c_custkey", "=", 42)])


@query("SELECT c_custkey, key, value FROM (SELECT c_custkey, c_name, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer) UNPIVOT (value FOR key IN (c_name, c_mktsegment, c_nationkey))")
def select_rest(t):
    rest = rest_map(t["customer"].drop("c_acctbal"), ["c_custkey"])
    return rest.select("c_custkey", F.explode("rest"))


# aggregates


@query("SELECT l_returnflag, count(l_orderkey) AS count_l_orderkey FROM lineitem GROUP BY l_returnflag")
def agg_count(t):
    return grouped(t["lineitem"], ["l_returnflag"], [("count", "l_orderkey")])


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem GROUP BY l_returnflag")
def agg_sum(t):
    return grouped(t["lineitem"], ["l_returnflag"], [("sum", "l_quantity", 2)])


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS avg_l_extendedprice FROM lineitem GROUP BY l_returnflag")
def agg_avg(t):
    return grouped(t["lineitem"], ["l_returnflag"], [("avg", "l_extendedprice", 4)])


@query("SELECT l_returnflag, max(l_tax) AS max_l_tax FROM lineitem GROUP BY l_returnflag")
def agg_max(t):
    return grouped(t["lineitem"], ["l_returnflag"], [("max", "l_tax")])


@query("SELECT o_orderpriority, max(o_orderdate) AS max_o_orderdate FROM orders GROUP BY o_orderpriority")
def max_date(t):
    return grouped(t["orders"], ["o_orderpriority"], [("max", "o_orderdate")])


@query("SELECT count(l_orderkey) AS count_l_orderkey, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_quantity), 4) AS avg_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem")
def agg_global(t):
    return grouped(t["lineitem"], [], [("count", "l_orderkey"), ("sum", "l_quantity", 2), ("avg", "l_quantity", 4), ("max", "l_quantity")])


@query("SELECT count(l_orderkey) AS count_l_orderkey, round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem WHERE l_orderkey = -1")
def agg_global_empty(t):
    return grouped(t["lineitem"], [], [("count", "l_orderkey"), ("sum", "l_quantity", 2)], [("l_orderkey", "=", -1)])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_extendedprice), 4) AS avg_l_extendedprice, round(avg(l_discount), 4) AS avg_l_discount, max(l_tax) AS max_l_tax, count(l_orderkey) AS count_l_orderkey FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def tpch_q1_like(t):
    aggregates = [("sum", "l_quantity", 2), ("avg", "l_extendedprice", 4), ("avg", "l_discount", 4), ("max", "l_tax"), ("count", "l_orderkey")]
    return grouped(t["lineitem"], ["l_returnflag", "l_linestatus"], aggregates, [("l_shipdate", "<=", day("1998-09-02"))])


@query(f"SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(sum(l_discount), 2) AS sum_l_discount FROM {FROM_LINES[3]} WHERE c_mktsegment = 'BUILDING' AND o_orderdate < timestamp '1998-03-15' AND l_shipdate > timestamp '1998-03-15' GROUP BY o_orderkey, o_orderdate")
def tpch_q3_like(t):
    when = day("1998-03-15")
    return grouped(path(t, "lineitem", "l_orderkey", "o_custkey").withColumnRenamed("l_orderkey", "_l"), ["o_orderkey", "o_orderdate"], [("sum", "l_extendedprice", 2), ("sum", "l_discount", 2)], [("c_mktsegment", "=", "BUILDING"), ("o_orderdate", "<", when), ("l_shipdate", ">", when)])


@query("SELECT o_orderpriority, count(o_orderkey) AS count_o_orderkey FROM orders WHERE o_orderdate >= timestamp '1997-01-01' AND o_orderdate < timestamp '1997-04-01' GROUP BY o_orderpriority")
def tpch_q4_like(t):
    return grouped(t["orders"], ["o_orderpriority"], [("count", "o_orderkey")], [("o_orderdate", ">=", day("1997-01-01")), ("o_orderdate", "<", day("1997-04-01"))])


@query(f"SELECT n_name, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM {FROM_LINES[5]} WHERE r_name = 'ASIA' AND o_orderdate >= timestamp '1996-01-01' AND o_orderdate < timestamp '1997-01-01' GROUP BY n_name")
def tpch_q5_like(t):
    return grouped(path(t, "lineitem", *LINES_TO_REGION), ["n_name"], [("sum", "l_extendedprice", 2)], [("r_name", "=", "ASIA"), ("o_orderdate", ">=", day("1996-01-01")), ("o_orderdate", "<", day("1997-01-01"))])


@query("SELECT round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(sum(l_discount), 2) AS sum_l_discount FROM lineitem WHERE l_shipdate >= timestamp '1996-01-01' AND l_shipdate < timestamp '1997-01-01' AND l_discount > 0.04 AND l_discount < 0.07 AND l_quantity < 24")
def tpch_q6_like(t):
    conditions = [("l_shipdate", ">=", day("1996-01-01")), ("l_shipdate", "<", day("1997-01-01")), ("l_discount", ">", 0.04), ("l_discount", "<", 0.07), ("l_quantity", "<", 24)]
    return grouped(t["lineitem"], [], [("sum", "l_extendedprice", 2), ("sum", "l_discount", 2)], conditions)


@query("SELECT n_name, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(avg(l_discount), 4) AS avg_l_discount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_shipdate >= timestamp '1995-01-01' AND l_shipdate <= timestamp '1996-12-31' GROUP BY n_name")
def tpch_q7_like(t):
    return grouped(path(t, "lineitem", "l_suppkey", "s_nationkey"), ["n_name"], [("sum", "l_extendedprice", 2), ("avg", "l_discount", 4)], [("l_shipdate", ">=", day("1995-01-01")), ("l_shipdate", "<=", day("1996-12-31"))])


@query(f"SELECT c_custkey, c_name, n_name, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM {FROM_LINES[4]} WHERE l_returnflag = 'R' AND o_orderdate < timestamp '1996-01-01' GROUP BY c_custkey, c_name, n_name")
def tpch_q10_like(t):
    return grouped(path(t, "lineitem", "l_orderkey", "o_custkey", "c_nationkey"), ["c_custkey", "c_name", "n_name"], [("sum", "l_extendedprice", 2)], [("l_returnflag", "=", "R"), ("o_orderdate", "<", day("1996-01-01"))])


@query("SELECT c_custkey, count(o_orderkey) AS count_o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def tpch_q13_like(t):
    return grouped(Path(trade_model(), t, "customer").follow("o_custkey", how="left").df, ["c_custkey"], [("count", "o_orderkey")])


@query("SELECT p_type, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(sum(l_discount), 2) AS sum_l_discount FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= timestamp '1996-09-01' AND l_shipdate < timestamp '1996-10-01' GROUP BY p_type")
def tpch_q14_like(t):
    return grouped(path(t, "lineitem", "l_partkey"), ["p_type"], [("sum", "l_extendedprice", 2), ("sum", "l_discount", 2)], [("l_shipdate", ">=", day("1996-09-01")), ("l_shipdate", "<", day("1996-10-01"))])


@query(f"SELECT o_orderdate, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(sum(l_discount), 2) AS sum_l_discount FROM {FROM_LINES[5]} JOIN part ON l_partkey = p_partkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate < timestamp '1996-01-01' GROUP BY o_orderdate")
def tpch_q8_like(t):
    rows = path(t, "lineitem", "l_partkey", *LINES_TO_REGION)
    return grouped(rows, ["o_orderdate"], [("sum", "l_extendedprice", 2), ("sum", "l_discount", 2)], [("r_name", "=", "AMERICA"), ("p_type", "=", "ECONOMY"), ("o_orderdate", "<", day("1996-01-01"))])


@query("SELECT l_linestatus, count(o_orderpriority) AS count_o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' AND l_shipdate < timestamp '1997-01-01' GROUP BY l_linestatus")
def tpch_q12_like(t):
    return grouped(path(t, "lineitem", "l_orderkey"), ["l_linestatus"], [("count", "o_orderpriority")], [("l_returnflag", "=", "A"), ("l_shipdate", "<", day("1997-01-01"))])


@query("SELECT round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(sum(l_discount), 2) AS sum_l_discount FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#23' AND p_type = 'PROMO' AND l_returnflag = 'N' AND p_size > 10 AND l_quantity < 30")
def tpch_q19_like(t):
    conditions = [("p_brand", "=", "Brand#23"), ("p_type", "=", "PROMO"), ("l_returnflag", "=", "N"), ("p_size", ">", 10), ("l_quantity", "<", 30)]
    return grouped(path(t, "lineitem", "l_partkey"), [], [("sum", "l_extendedprice", 2), ("sum", "l_discount", 2)], conditions)


@query("SELECT s_name, count(o_orderkey) AS count_o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' AND r_name = 'EUROPE' GROUP BY s_name ORDER BY s_name")
def tpch_q21_like(t):
    rows = path(t, "orders", "l_orderkey", "l_suppkey", "s_nationkey", "n_regionkey")
    return ordered(grouped(rows, ["s_name"], [("count", "o_orderkey")], [("o_orderstatus", "=", "F"), ("r_name", "=", "EUROPE")]), ["s_name"])


@query("SELECT p_brand, round(avg(l_quantity), 4) AS avg_l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40 GROUP BY p_brand")
def tpch_q17_like(t):
    return grouped(path(t, "lineitem", "l_partkey"), ["p_brand"], [("avg", "l_quantity", 4)], [("p_size", ">", 40)])


@query(f"SELECT c_name, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS sum_l_quantity FROM {FROM_LINES[3]} WHERE o_totalprice > 400000 GROUP BY c_name, o_orderkey, o_totalprice")
def tpch_q18_like(t):
    return grouped(path(t, "lineitem", "l_orderkey", "o_custkey"), ["c_name", "o_orderkey", "o_totalprice"], [("sum", "l_quantity", 2)], [("o_totalprice", ">", 400000)])


@query("SELECT c_mktsegment, count(c_custkey) AS count_c_custkey, round(sum(c_acctbal), 2) AS sum_c_acctbal FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def tpch_q22_like(t):
    return grouped(t["customer"], ["c_mktsegment"], [("count", "c_custkey"), ("sum", "c_acctbal", 2)], [("c_acctbal", ">", 0)])


# order and limit


@query("SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders WHERE o_custkey < 50 ORDER BY o_orderstatus, o_orderpriority, o_orderkey")
def sort_multi(t):
    return ordered(keep(t["orders"], [("o_custkey", "<", 50)]).select("o_orderstatus", "o_orderpriority", "o_orderkey"), ["o_orderstatus", "o_orderpriority", "o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 25")
def limit_topk(t):
    return ordered(keep(t["orders"], [("o_orderstatus", "=", "F")]).select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 25)


@query("SELECT o_custkey, count(o_orderkey) AS count_o_orderkey FROM orders GROUP BY o_custkey ORDER BY count_o_orderkey, o_custkey LIMIT 40")
def sort_after_agg(t):
    return ordered(grouped(t["orders"], ["o_custkey"], [("count", "o_orderkey")]), ["count_o_orderkey", "o_custkey"], 40)


# views and lookups

ORDERS_BY_CUSTOMER = View("orders_by_customer", ("o_custkey",), ("o_orderdate", "o_orderkey"), ("o_totalprice",))
LINES_BY_ORDER = View("lines_by_order", ("o_orderkey",), ("l_linenumber",), ("l_partkey", "l_quantity", "l_extendedprice"))
FLAG_TOTALS = View("flag_totals", ("l_returnflag",), ("l_linestatus",), sums=("l_quantity",), counts=("l_quantity",), maxima=("l_tax",))


def lines_of_orders(t):
    return t["orders"].join(t["lineitem"].withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey < 500")
def view_inner(t):
    return keep(LINES_BY_ORDER.materialize(lines_of_orders(t)), [("o_orderkey", "<", 500)])


@query("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'")
def view_left_outer(t):
    return keep(Path(trade_model(), t, "orders").follow("l_orderkey", how="left").df, [("o_orderstatus", "=", "O")]).select("o_orderkey", "l_linenumber")


@query("SELECT coalesce(a.o_orderkey, b.l_orderkey) AS orderkey, a.o_totalprice, b.cnt FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') a FULL OUTER JOIN (SELECT l_orderkey, count(*) AS cnt FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) b ON a.o_orderkey = b.l_orderkey")
def view_full_outer(t):
    a = keep(t["orders"], [("o_orderstatus", "=", "F")]).select(F.col("o_orderkey").alias("orderkey"), "o_totalprice")
    b = keep(t["lineitem"], [("l_returnflag", "=", "R")]).groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.count(F.lit(1)).alias("cnt"))
    return migrate.full_outer([a, b], ["orderkey"])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity, count(l_quantity) AS count_l_quantity, max(l_tax) AS max_l_tax FROM lineitem GROUP BY l_returnflag, l_linestatus")
def view_preagg(t):
    return FLAG_TOTALS.materialize(t["lineitem"]).withColumn("sum_l_quantity", F.round("sum_l_quantity", 2))


@query("SELECT l_returnflag, count(l_quantity) AS count_l_quantity, round(sum(l_quantity), 2) AS sum_l_quantity, max(l_tax) AS max_l_tax, round(avg(l_quantity), 4) AS avg_l_quantity FROM lineitem GROUP BY l_returnflag")
def view_two_phase(t):
    out = coarser(FLAG_TOTALS.materialize(t["lineitem"]), FLAG_TOTALS, ["l_returnflag"], averages=("l_quantity",))
    return out.withColumn("sum_l_quantity", F.round("sum_l_quantity", 2)).withColumn("avg_l_quantity", F.round("avg_l_quantity", 4))


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 5000")
def lookup_join(t):
    rows = keep(t["customer"], [("c_mktsegment", "=", "MACHINERY"), ("c_acctbal", ">", 5000)]).select("c_custkey", "c_name", F.col("c_custkey").alias("o_custkey"))
    return lookup(measured_broadcast(rows), ORDERS_BY_CUSTOMER.materialize(t["orders"]), ["o_custkey"], ["o_orderkey", "o_totalprice"]).drop("o_custkey")


@query("SELECT c_custkey, o_orderkey, l_linenumber, l_partkey, l_quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_acctbal > 9000")
def lookup_chain_2(t):
    rows = keep(t["customer"], [("c_acctbal", ">", 9000)]).select("c_custkey", F.col("c_custkey").alias("o_custkey"))
    steps = [(ORDERS_BY_CUSTOMER.materialize(t["orders"]), ["o_custkey"], ["o_orderkey"]), (LINES_BY_ORDER.materialize(lines_of_orders(t)), ["o_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"])]
    return lookup_chain(rows, steps).drop("o_custkey")


@query("SELECT n_name, r_name FROM (SELECT n_name FROM nation WHERE n_regionkey = 1) a, (SELECT r_name FROM region) b")
def combined_lookups(t):
    return combine([keep(t["nation"], [("n_regionkey", "=", 1)]).select("n_name"), t["region"].select("r_name")])


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')")
def view_append(t):
    store = ViewStore(t["orders"].sparkSession)
    store.save(ORDERS_BY_CUSTOMER, keep(t["orders"], [("o_orderstatus", "=", "F")]))
    store.append("orders_by_customer", keep(t["orders"], [("o_orderstatus", "=", "O")]))
    return store.open("orders_by_customer")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity, count(l_quantity) AS count_l_quantity, max(l_tax) AS max_l_tax FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus")
def view_append_aggregated(t):
    store = ViewStore(t["lineitem"].sparkSession)
    store.save(FLAG_TOTALS, keep(t["lineitem"], [("l_quantity", ">", 30)]))
    store.append("flag_totals", keep(t["lineitem"], [("l_quantity", ">", 10), ("l_quantity", "<=", 30)]))
    return store.open("flag_totals").withColumn("sum_l_quantity", F.round("sum_l_quantity", 2))


@query("SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders")
def view_upsert_stored(t):
    store = ViewStore(t["orders"].sparkSession)
    store.save(ORDERS_BY_CUSTOMER, t["orders"])
    before = keep(t["orders"], [("o_orderstatus", "=", "P")])
    maintain.carry_over(store, ["o_totalprice"], {"orders_by_customer": (before, before.withColumn("o_totalprice", F.lit(1.5)))})
    return store.open("orders_by_customer")


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 7 ELSE o_custkey END AS o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders")
def view_moved_keys(t):
    store = ViewStore(t["orders"].sparkSession)
    store.save(ORDERS_BY_CUSTOMER, t["orders"])
    before = keep(t["orders"], [("o_orderstatus", "=", "P")])
    maintain.carry_over(store, ["o_custkey"], {"orders_by_customer": (before, before.withColumn("o_custkey", F.lit(7).cast("long")))})
    return store.open("orders_by_customer")


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def view_delete_stored(t):
    store = ViewStore(t["orders"].sparkSession)
    store.save(ORDERS_BY_CUSTOMER, t["orders"])
    store.delete("orders_by_customer", keep(t["customer"], [("c_mktsegment", "=", "BUILDING")]).select(F.col("c_custkey").alias("o_custkey")))
    return store.open("orders_by_customer")


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9900)")
def view_lookup_stored(t):
    store = ViewStore(t["orders"].sparkSession)
    store.save(ORDERS_BY_CUSTOMER, t["orders"])
    return store.lookup("orders_by_customer", keep(t["customer"], [("c_acctbal", ">", 9900)]).select(F.col("c_custkey").alias("o_custkey")))


@query("SELECT 'orders_by_customer' AS name, (SELECT count(*) FROM orders) AS rows, false AS empty, true AS found UNION ALL SELECT 'no_orders', 0, true, true UNION ALL SELECT 'dropped', 0, true, false")
def view_states(t):
    spark = t["orders"].sparkSession
    store = ViewStore(spark)
    store.save(ORDERS_BY_CUSTOMER, t["orders"])
    for name in ("no_orders", "dropped"):
        store.save(View(name, ("o_custkey",)), t["orders"].where("false"))
    store.drop("dropped")
    found = [(n, store.count(n) if store.exists(n) else 0, store.empty(n) if store.exists(n) else True, store.exists(n)) for n in ("orders_by_customer", "no_orders", "dropped")]
    return spark.createDataFrame(found, "name string, rows long, empty boolean, found boolean")


@query("SELECT o_custkey, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def view_bucketed_join(t):
    tag = uuid.uuid4().hex
    left = View(f"b_orders_{tag}", ("o_orderkey",), (), ("o_custkey",)).save_bucketed(t["orders"], 8)
    right = View(f"b_lines_{tag}", ("o_orderkey",), ("l_linenumber",), ("l_extendedprice",)).save_bucketed(t["lineitem"].withColumnRenamed("l_orderkey", "o_orderkey"), 8)
    return left.join(right, "o_orderkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"))


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def view_distinct(t):
    rows = keep(path(t, "orders", "o_custkey"), [("c_nationkey", "=", 3)])
    return View("priorities", ("o_orderpriority",), ("o_orderstatus",), distinct=True).materialize(rows)


# maintenance


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def maint_update_over_path(t):
    reached = keep(path(t, "orders", "o_custkey", "c_nationkey", "n_regionkey"), [("r_name", "=", "ASIA")])
    return maintain.update_over(t["orders"], {"o_orderstatus": "X"}, reached, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN (SELECT o_orderkey, o_custkey, o_totalprice FROM orders UNION ALL SELECT -1, 11, 5.0) ON o_custkey = c_custkey WHERE c_custkey < 20")
def maint_insert_connect(t):
    changed = maintain.insert_connected(trade_model(), t, "orders", {"o_orderkey": -1, "o_totalprice": 5.0}, {"o_custkey": 11})
    return keep(path(changed, "customer", "o_custkey"), [("c_custkey", "<", 20)]).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT CASE WHEN c_custkey IN (3, 5) THEN 99 ELSE c_nationkey END AS c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def maint_insert_connect_many(t):
    changed = t
    for customer in (3, 5):
        changed = maintain.insert_connected(trade_model(), changed, "nation", {"n_nationkey": 99, "n_name": "NOWHERE", "n_regionkey": 0}, {"c_nationkey": customer})
    return path(changed, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey")
def maint_insert(t):
    new = keep(t["customer"], [("c_mktsegment", "=", "BUILDING")]).select(F.col("c_custkey").alias("o_custkey"), (-F.col("c_custkey")).alias("o_orderkey"))
    view = t["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    changed = maintain.insert(t["orders"], new)  # each new row is one more, also where an order has its key
    return maintain.refresh(view, new, ["o_custkey"], lambda keys: maintain.under(changed, keys, ["o_custkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT o_orderkey, CASE WHEN o_custkey = 42 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def maint_update(t):
    return maintain.update(t["orders"], {"o_orderstatus": "X"}, [("o_custkey", "=", 42)]).select("o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'P') GROUP BY o_custkey")
def maint_delete(t):
    return maintain.delete(t["orders"], [("o_orderstatus", "=", "P")]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') GROUP BY l_returnflag")
def maint_delete_over_path(t):
    # The path from the lines' orders on: the lines themselves are read once, by the deletion.
    reached = keep(path(t, "orders", "o_custkey"), [("c_mktsegment", "=", "BUILDING")]).select(F.col("o_orderkey").alias("l_orderkey"))
    return maintain.delete_keys(t["lineitem"], reached, ["l_orderkey"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 11 ELSE o_custkey END AS o_custkey FROM orders")
def maint_connect(t):
    return maintain.connect(t["orders"], "o_orderkey", 7, "o_custkey", 11).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey = 7 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 7) THEN NULL ELSE o_custkey END AS o_custkey FROM orders) ON o_custkey = c_custkey GROUP BY c_custkey")
def maint_disconnect(t):
    owner = keep(t["orders"], [("o_orderkey", "=", 7)]).select("o_custkey").first()
    changed = t | {"orders": maintain.disconnect(t["orders"], "o_orderkey", 7, "o_custkey", owner[0])} if owner else t
    return Path(trade_model(), changed, "customer").follow("o_custkey", how="left").df.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


# migration, sets, samples, timesteps, sources


@query("SELECT coalesce(a.k, b.k, c.k) AS o_custkey, a.n_f, b.n_o, c.n_p FROM (SELECT o_custkey AS k, count(*) AS n_f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n_o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k FULL JOIN (SELECT o_custkey AS k, count(*) AS n_p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) c ON coalesce(a.k, b.k) = c.k")
def migrate_full_outer(t):
    parts = [keep(t["orders"], [("o_orderstatus", "=", s)]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias(f"n_{s.lower()}")) for s in "FOP"]
    return migrate.full_outer(parts, ["o_custkey"])


@query("SELECT coalesce(a.k, b.k) AS o_custkey, a.n AS sum_f, b.n AS sum_o FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k")
def migrate_stored(t):
    store = ViewStore(t["orders"].sparkSession)
    for s in "FO":
        counted = keep(t["orders"], [("o_orderstatus", "=", s)]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias(f"sum_{s.lower()}"))
        store.save(View(f"orders_{s}", ("o_custkey",), (), (f"sum_{s.lower()}",)), counted)
    both = View("orders_both", ("o_custkey",), (), ("sum_f", "sum_o"))
    made, gone = migrate.step(store, {"orders_both": (both, ["orders_F", "orders_O"], ["o_custkey"])})
    if (made, gone, store.names()) != ({"orders_both"}, {"orders_F", "orders_O"}, ["orders_both"]):
        raise RuntimeError("the migration left other views than those of the next timestep")
    return store.open("orders_both")


@query("SELECT DISTINCT c_custkey, c_mktsegment, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def migrate_left_outer(t):
    counted = keep(t["orders"], [("o_orderstatus", "=", "P")]).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return migrate.left_outer(t["customer"].select("c_custkey", "c_mktsegment"), counted, ["c_custkey"], distinct=True)


@query("SELECT 'o_orderstatus' AS \"column\", count(*) FILTER (o_orderstatus <> 'P') AS equal, count(*) FILTER (o_orderstatus = 'P') AS different, (SELECT count(*) FROM orders WHERE o_custkey >= 1000) AS only_a, 0 AS only_b FROM orders WHERE o_custkey < 1000 UNION ALL SELECT 'o_totalprice', count(*), 0, (SELECT count(*) FROM orders WHERE o_custkey >= 1000), 0 FROM orders WHERE o_custkey < 1000")
def migrate_validate_columns(t):
    ours = t["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice")
    theirs = maintain.update(keep(t["orders"], [("o_custkey", "<", 1000)]), {"o_orderstatus": "X"}, [("o_orderstatus", "=", "P")])
    return sets.compare_columns(ours, theirs.select(*ours.columns), ["o_orderkey"])


@query("SELECT cast(count(*) AS BIGINT) AS missing, cast(0 AS BIGINT) AS extra, (SELECT count(*) FROM orders) AS rows_a, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS rows_b, CASE WHEN count(*) = 0 THEN 'equal' WHEN count(*) <= 0.01 * (SELECT count(*) FROM orders) THEN 'approximate' ELSE 'different' END AS verdict FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem))")
def migrate_validate(t):
    return sets.compare(t["orders"].select("o_orderkey"), t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey")).distinct())


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def union_distinct(t):
    return sets.union_distinct(*[keep(t["orders"], [c]).select("o_custkey") for c in (("o_orderstatus", "=", "F"), ("o_orderpriority", "=", "1-URGENT"))])


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def multiset_diff(t):
    return sets.multiset_difference(*[keep(t["orders"], [c]).select("o_custkey") for c in (("o_orderstatus", "=", "F"), ("o_orderpriority", "=", "1-URGENT"))])


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS s FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rn, count(*) OVER (PARTITION BY l_returnflag) AS cnt FROM lineitem) WHERE cnt < 100 OR (rn >= floor(cnt * 0.25) AND rn < floor(cnt * 0.75)) GROUP BY l_returnflag")
def sample_interquartile(t):
    middle = interquartile(t["lineitem"], ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return middle.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("s"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn, count(*) OVER (PARTITION BY o_custkey) AS cnt FROM orders WHERE o_custkey < 300) WHERE cnt < 12 OR (rn >= floor(cnt * 0.25) AND rn < floor(cnt * 0.75)) GROUP BY o_orderstatus")
def sample_interquartile_small(t):
    middle = interquartile(keep(t["orders"], [("o_custkey", "<", 300)]), ["o_custkey"], ["o_orderkey"], whole_below=12)
    return middle.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS freq FROM events GROUP BY event_type, date_trunc('day', ts)")
def timestep_frequency(t):
    return frequencies(t["events"], "event_type", "ts").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, round(count(*) / (SELECT count(DISTINCT date_trunc('day', ts)) FROM events), 6) AS freq FROM events GROUP BY event_type")
def timestep_static(t):
    return mix(frequencies(t["events"], "event_type", "ts"), "event_type", "static").withColumn("freq", F.round("freq", 6))


@query("SELECT event_type, count(*) AS freq FROM events WHERE date_trunc('day', ts) = (SELECT min(date_trunc('day', ts)) FROM events) GROUP BY event_type")
def timestep_first(t):
    return mix(frequencies(t["events"], "event_type", "ts"), "event_type", "first")


@query("SELECT event_type, count(*) AS freq FROM events WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events) GROUP BY event_type")
def timestep_last(t):
    return mix(frequencies(t["events"], "event_type", "ts"), "event_type", "last")


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) * (3600.0 / 86400.0) AS freq FROM events GROUP BY event_type, date_trunc('day', ts)")
def timestep_reset(t):
    return reset_interval(frequencies(t["events"], "event_type", "ts"), 86400.0, 3600.0).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS freq FROM events GROUP BY event_type, date_trunc('day', ts)")
def timestep_stream(t):
    spark = t["events"].sparkSession
    folder, file = t["events"].inputFiles()[0].rsplit("/", 1)
    # The table is a file beside other tables, or a folder of its own.
    stream = spark.readStream.schema(t["events"].schema).option("pathGlobFilter", "*" if folder.endswith(".parquet") else file).parquet(folder)
    return run_frequencies(stream.select("event_type", "ts"), "event_type", "ts", shared_path(spark, "stream")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def complete_view_rows(t):
    rows = keep(Path(trade_model(), t, "orders").follow("l_orderkey", how="left").df, [("o_orderstatus", "=", "P")]).select("o_orderkey", "l_linenumber")
    return complete_rows(without_empty_rows(rows))


@query(None)
def value_hash(t):
    return t["customer"].select("c_custkey", row_hash(["c_name", "c_mktsegment", "c_nationkey"]).alias("value_hash"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(t):
    folder = shared_path(t["customer"].sparkSession, "csv")
    write_csv(t["customer"], folder, "customer")
    return csv_table(t["customer"].sparkSession, folder, "customer", t["customer"].schema)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def jdbc_round_trip(t):
    spark, schema = t["customer"].sparkSession, t["customer"].schema
    url = derby_archive(t["customer"], shared_path(spark, "jdbc"), "customer")
    low, high = t["customer"].agg(F.min("c_custkey"), F.max("c_custkey")).first()
    ranges = () if low is None or low == high else ("c_custkey", low, high, 4)
    read = jdbc_table(spark, url, "customer", *ranges, driver=DERBY)
    return read.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


@query(f"SELECT range AS id, 'name_' || (f1 * f1 % {MODULUS} % 10) AS name, f2 * f2 % {MODULUS} % 10 AS score FROM (SELECT range, ((range + 1) * {FACTOR} + 7919 * 42 + 104729) % {MODULUS} AS f1, ((range + 1) * {FACTOR} + 7919 * 42 + 104729 * 2) % {MODULUS} AS f2 FROM range(1000))")
def random_source(t):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("score", T.LongType())])
    return random_rows(t["nation"].sparkSession, schema, 1000)


@query("SELECT 'nation' AS entity, 'n_nationkey' AS \"column\", count(*) AS rows, count(DISTINCT n_nationkey) AS distinct_values, avg(strlen(n_nationkey::VARCHAR)) AS mean_bytes FROM nation UNION ALL SELECT 'nation', 'n_name', count(*), count(DISTINCT n_name), avg(strlen(n_name)) FROM nation UNION ALL SELECT 'nation', 'n_regionkey', count(*), count(DISTINCT n_regionkey), avg(strlen(n_regionkey::VARCHAR)) FROM nation UNION ALL SELECT 'region', 'r_regionkey', count(*), count(DISTINCT r_regionkey), avg(strlen(r_regionkey::VARCHAR)) FROM region UNION ALL SELECT 'region', 'r_name', count(*), count(DISTINCT r_name), avg(strlen(r_name)) FROM region")
def model_statistics(t):
    return statistics({n: t[n] for n in ("nation", "region")}, exact=True)


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def model_inferred(t):
    spark = t["nation"].sparkSession
    tables = {"nation": t["nation"].withColumnRenamed("n_regionkey", "r_regionkey"), "region": t["region"]}
    model = infer_model(spark, tables, {"nation": ("n_nationkey",), "region": ("r_regionkey",)})
    return Path(model, tables, "nation").follow(*model.edges).df.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["tpch_q5_like"](spark, sf_dir)
