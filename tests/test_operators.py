"""Operators on literal rows."""

import datetime as dt
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathmill.functions.expressions import complete_rows, keep, rest_map, row_hash, without_empty_rows
from pathmill.operators import maintain, migrate, sets
from pathmill.operators.lookup import combine, lookup
from pathmill.operators.paths import Path, grouped, ordered
from pathmill.operators.sampling import interquartile, sample_rows
from pathmill.plans.model import Model, infer_model, statistics
from pathmill.plans.store import ViewStore
from pathmill.plans.views import View, coarser
from pathmill.sources.readers import csv_table, parquet_tables, random_rows, write_csv
from pathmill.streaming.timesteps import mix, stream_frequencies


@pytest.fixture(scope="module")
def tweets(spark):
    return spark.createDataFrame([(0, "tweet1", 0), (1, "tweet1", 0), (2, "tweet2", 1), (3, "tweet2", 1), (4, "tweet2", 2)], "TweetId int, Body string, Retweets int")


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([("Bob", 1), ("Alice", 2), (None, 3)], "Username string, UserId int")


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_filters(users):
    assert values(keep(users, [("Username", "=", "Bob")])) == [("Bob", 1)]
    assert values(keep(users, [("Username", "<", "B")])) == [("Alice", 2)]
    assert values(keep(users, [("Username", "!=", "Bob"), ("UserId", ">=", 1), ("UserId", "<", 3)])) == [("Alice", 2)]


def test_order_and_limit(users):
    assert [r[0] for r in ordered(users.na.drop(), ["Username"]).collect()] == ["Alice", "Bob"]
    assert len(ordered(users, ["UserId"], 1).collect()) == 1 and not ordered(users, ["UserId"], 0).collect()


def test_aggregates(tweets):
    got = values(grouped(tweets, ["Body"], [("count", "TweetId"), ("sum", "Retweets"), ("max", "TweetId"), ("avg", "Retweets", 2)]))
    assert got == [("tweet1", 2, 0, 1, 0.0), ("tweet2", 3, 4, 4, 1.33)]
    assert values(grouped(tweets, [], [("count", "TweetId")], [("TweetId", "<", 0)])) == [(0,)]


def test_coarser_view_is_the_direct_aggregate(tweets):
    view = View("v", ("Body",), ("Retweets",), sums=("TweetId",), counts=("TweetId",), maxima=("TweetId",))
    stored = view.materialize(tweets)
    assert stored.count() == 3
    assert values(coarser(stored, view, ["Body"], ("TweetId",)).select("Body", "sum_TweetId", "count_TweetId", "max_TweetId", "avg_TweetId")) == [("tweet1", 1, 2, 1, 0.5), ("tweet2", 9, 3, 4, 3.0)]
    with pytest.raises(ValueError):
        coarser(stored, view, ["TweetId"])
    for wrong in (dict(hash_by=()), dict(hash_by=("a",), order_by=("a",)), dict(hash_by=("a",), extra=("b",), sums=("c",))):
        with pytest.raises(ValueError):
            View("w", **wrong)


def test_full_outer_keeps_both_sides(spark):
    parent = spark.createDataFrame([(10, 0, 100), (10, 0, 101), (0, 1, 200)], "v int, k int, c int")
    child = spark.createDataFrame([(0, 100, "x"), (2, 100, "y")], "k int, c int, w string")
    assert values(migrate.full_outer([parent, child], ["k", "c"])) == sorted([(0, 100, 10, "x"), (0, 101, 10, None), (1, 200, 0, None), (2, 100, None, "y")], key=str)
    assert migrate.left_outer(parent, child, ["k", "c"]).count() == 3
    assert migrate.under_construction({"a"}, {"a", "b"}) == {"b"} and migrate.obsolete({"a", "c"}, {"a"}) == {"c"}


def test_compare_verdicts(spark):
    a = spark.range(200).withColumn("x", F.col("id") / 7.0)
    assert sets.compare(a, a.withColumn("x", F.col("x") + 1e-6)).first()["verdict"] == "equal"
    assert tuple(sets.compare(a, a.where("id <> 5")).first()) == (1, 0, 200, 199, "approximate")
    assert sets.compare(a, a.where("id < 100")).first()["verdict"] == "different"
    assert sets.compare(a.limit(0), a.limit(0)).first()["verdict"] == "equal"


def test_interquartile_takes_the_middle_half(spark):
    df = spark.range(1000).withColumn("k", F.lit(1))
    got = [r["id"] for r in interquartile(df, ["k"], ["id"]).collect()]
    assert sorted(got) == list(range(250, 750))
    assert sorted(r["id"] for r in interquartile(df.where("id < 101"), ["k"], ["id"]).collect()) == list(range(25, 75))
    mixed = spark.range(500).withColumn("k", F.when(F.col("id") < 99, F.lit(None)).otherwise(F.lit(1)))  # 99 rows stay whole
    assert sorted(r["id"] for r in interquartile(mixed, ["k"], ["id"]).collect()) == [*range(99), *range(99 + 100, 99 + 300)]
    assert interquartile(df.limit(0), ["k"], ["id"]).collect() == []


def test_samples_are_complete_rows_of_about_the_share(spark):
    df = spark.range(4000).withColumn("v", F.when(F.col("id") % 2 == 0, F.col("id")))
    got = {r["id"] for r in sample_rows(df, 0.5).collect()}
    assert 850 < len(got) < 1150 and all(i % 2 == 0 for i in got)
    assert got == {r["id"] for r in sample_rows(df, 0.5).collect()} != {r["id"] for r in sample_rows(df, 0.5, seed=1).collect()}
    assert any(i % 2 for i in (r["id"] for r in sample_rows(df, 0.5, columns=["id"]).collect()))


def test_stored_views(spark, tmp_path):
    store = ViewStore(spark, str(tmp_path / "views"), buckets=3)
    view = View("v", ("k",), ("o",), ("x",))
    df = spark.createDataFrame([(i % 5, i, f"x{i}") for i in range(20)] + [(None, 99, "n")], "k int, o int, x string")
    assert values(store.save(view, df)) == values(df) and store.view("v") == view
    again = ViewStore(spark, str(tmp_path / "views"))  # opened by name, with the buckets it was written with
    again.append("v", spark.createDataFrame([(7, 1, "new")], df.schema))
    assert again.count("v") == 22 and values(again.lookup("v", spark.createDataFrame([(7,)], "k int"))) == [(7, 1, "new")]
    again.upsert("v", spark.createDataFrame([(7, 1, "newer"), (8, 2, "other")], df.schema))
    assert values(again.open("v").where("k > 6")) == [(7, 1, "newer"), (8, 2, "other")] and again.count("v") == 23
    again.delete("v", spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 7)], "k int"))
    assert values(again.open("v")) == [(8, 2, "other"), (None, 99, "n")]
    again.delete("v", spark.createDataFrame([(8, 1)], "k int, o int"))
    assert again.count("v") == 2
    again.delete("v", spark.createDataFrame([(8, 2)], "k int, o int"))
    assert again.count("v") == 1 and not again.empty("v")
    with pytest.raises(ValueError):
        again.delete("v", spark.createDataFrame([(2,)], "o int"))
    store.save(View("w", ("k",), distinct=True), df)
    store.append("w", df)
    assert store.names() == ["v", "w"] and store.count("w") == 6
    store.drop("v")
    assert not store.exists("v") and store.names() == ["w"]
    store.clear()
    assert store.names() == []
    with pytest.raises(KeyError):
        store.open("v")


def test_views_that_a_statement_touches(spark, tmp_path):
    store = ViewStore(spark, str(tmp_path), buckets=2)
    df = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, o int, x string")
    store.save(View("by_k", ("k",), ("o",), ("x",)), df)
    store.save(View("no_x", ("k",), ("o",)), df)
    before = df.where("k = 1")
    after = before.withColumn("x", F.lit("z"))
    assert maintain.carry_over(store, ["x"], {"by_k": (before, after), "no_x": (before, after)}) == ["by_k"]
    after = before.withColumn("o", F.lit(11))
    assert maintain.carry_over(store, ["o"], {"by_k": (before, after), "no_x": (before, after)}) == ["by_k", "no_x"]
    assert values(store.open("by_k")) == [(1, 11, "a"), (2, 20, "b")] and values(store.open("no_x")) == [(1, 11), (2, 20)]


def test_nulls_in_aggregates_and_the_size_of_a_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None)], "g string, v int")
    assert values(grouped(df, ["g"], [("count", "v"), ("count", "*"), ("avg", "v"), ("sum", "v")])) == [("a", 1, 2, 1.0, 1), ("b", 0, 1, None, None)]


def test_rest_is_a_map_without_nulls(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, 3.5)], "k int, s string, d double")
    assert sorted((r["k"], r["rest"]) for r in rest_map(df, ["k"]).collect()) == [(1, {"s": "x"}), (2, {"d": "3.5"})]


def test_columns_are_compared_one_by_one(spark):
    a = spark.createDataFrame([(1, 1.001, None), (2, 2.0, "x"), (3, 3.0, "y")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0, None), (2, 2.5, "x"), (4, 3.0, "y")], "k int, v double, s string")
    assert values(sets.compare_columns(a, b, ["k"])) == [("s", 2, 0, 1, 1), ("v", 1, 1, 1, 1)]


def test_shared_folder_needs_a_setting_on_a_cluster(spark):
    from pathmill.sources.storage import shared_folder

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "local-cluster[3,2,1000]"})

    with pytest.raises(ValueError):
        shared_folder(Session)
    Session.conf = Conf({"spark.master": "local[2]"})
    assert shared_folder(Session) == Session.conf["spark.checkpoint.dir"] == shared_folder(Session)


def test_lookup_right_side_wins_and_null_keys_drop(spark):
    rows = spark.createDataFrame([(1, "old"), (None, "none")], "k int, v string")
    view = spark.createDataFrame([(1, "new", 5), (1, "newer", 6)], "k int, v string, w int")
    assert values(lookup(rows, view, ["k"])) == [(1, "new", 5), (1, "newer", 6)]
    with pytest.raises(ValueError):
        combine([rows, spark.range(10_001)])


def test_maintenance_equals_recomputation(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "b", 7)], "id int, g string, v int")
    define = lambda df: df.groupBy("g").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    new = spark.createDataFrame([(3, "c", 9), (4, "a", 1)], "id int, g string, v int")
    changed = maintain.insert(t, new, ["id"])
    touched = new.select("g").union(t.join(new, "id", "left_semi").select("g"))
    assert values(maintain.refresh(define(t), touched, ["g"], lambda keys: define(changed.join(keys, "g", "left_semi")))) == values(define(changed))
    assert values(maintain.update(t, {"v": 0}, [("v", ">", 5)])) == [(1, "a", 5), (2, "a", None), (3, "b", 0)]
    assert values(maintain.delete(t, [("v", "<", 6)])) == [(2, "a", None), (3, "b", 7)]
    assert values(maintain.delete_keys(t, t.where("v = 7"), ["id"])) == [(1, "a", 5), (2, "a", None)]
    assert values(maintain.disconnect(maintain.connect(t, "id", 1, "v", 8), "id", 1, "v", 8)) == [(1, "a", None), (2, "a", None), (3, "b", 7)]
    assert maintain.disconnect(t, "id", 1, "v", 99).where("id = 1").first()["v"] == 5


def test_paths_with_composite_keys_and_branches(spark):
    model = Model({"line": ("o", "n"), "part": ("p",), "note": ("id",)})
    model.link("p", "line", "part").link("on_line", "note", "line", ("o", "n"))
    tables = {
        "line": spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "o int, n int, p int"),
        "part": spark.createDataFrame([(7, "x"), (8, "y")], "p int, name string"),
        "note": spark.createDataFrame([(0, 1, 2)], "id int, o int, n int"),
    }
    got = Path(model, tables, "note").follow("on_line", "p")
    assert got.entities == ["note", "line", "part"] and got.df.select("id", "name").collect()[0][:] == (0, "y")
    assert Path(model, tables, "line").follow("p", "on_line", how="left").df.count() == 2
    with pytest.raises(ValueError):
        got.follow("p")
    with pytest.raises(ValueError):
        model.link("p", "line", "part")
    assert set(infer_model(spark, tables, {"part": ("p",), "line": ("o", "n"), "note": ("id",)}).edges) == {"line_p", "note_o_n"}
    assert {r["column"]: r["distinct_values"] for r in statistics({"part": tables["part"]}).collect()} == {"p": 2, "name": 2}


def test_nulls_and_hash(spark):
    df = spark.createDataFrame([(None, None), (1, None), (1, "b")], "x int, y string")
    assert without_empty_rows(df).count() == 2 and complete_rows(df).count() == 1
    assert df.where("y = 'b'").select(row_hash(["y", "x"])).first()[0] == zlib.crc32(b"1,b")


def test_csv_and_random_sources(spark, tmp_path):
    schema = T.StructType([T.StructField("UserId", T.IntegerType()), T.StructField("Username", T.StringType()), T.StructField("City", T.StringType())])
    write_csv(spark.createDataFrame([(1, "Alice", "Chicago")], schema), str(tmp_path), "User")
    assert values(csv_table(spark, str(tmp_path), "User", schema)) == [(1, "Alice", "Chicago")]
    kinds = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.BooleanType()), T.StructField("c", T.DateType()), T.StructField("d", T.DoubleType())])
    assert values(random_rows(spark, kinds, 20)) == values(random_rows(spark, kinds, 20))


def test_stream_of_timesteps_drops_late_events(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "name string, ts timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = stream_frequencies(stream, "name", "ts").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    step([("a", day(1)), ("a", day(1, 5)), ("b", day(1, 9))])
    step([("a", day(3))])
    step([("a", day(1, 1)), ("a", day(5))])
    got = values(spark.read.parquet(out))
    assert ("a", day(1), 2) in got and ("b", day(1), 1) in got and ("a", day(1), 3) not in got
    freq = spark.createDataFrame([("a", day(1), 2), ("a", day(2), 4), ("b", day(2), 1)], "name string, start timestamp, freq long")
    assert values(mix(freq, "name", "static")) == [("a", 3.0), ("b", 0.5)] and values(mix(freq, "name", "last")) == [("a", 4), ("b", 1)]


def test_tables_are_opened_when_asked_for(spark, folder):
    tables = parquet_tables(spark, folder, ("nation", "region"))
    assert not tables and tables["nation"].count() == 25 and list(tables) == ["nation"]
    changed = tables | {"nation": tables["nation"].limit(1)}
    assert changed["nation"].count() == 1 and changed["region"].count() == 5 and "region" not in tables
    with pytest.raises(KeyError):
        tables["planet"]
