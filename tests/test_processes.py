"""A query whose executors are processes of their own, as on a cluster: they share files, not memory."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

from pathmill.sources.readers import DERBY, derby_archive, jdbc_table

RUN = """
from pyspark.sql import SparkSession
from pathmill.queries import QUERIES
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false")
    .config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "{shared}").getOrCreate())
QUERIES["jdbc_round_trip"](spark, "{folder}").write.parquet("{shared}/out")
spark.stop()
"""


def test_a_database_is_read_by_several_processes(spark, folder, tmp_path):
    home = tmp_path / "home"  # executors write their logs to Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(Path(__file__).parent.parent)}
    subprocess.run([sys.executable, "-c", RUN.format(shared=tmp_path, folder=folder)], env=env, cwd=tmp_path, check=True, timeout=300)
    held = spark.read.parquet(f"{folder}/customer.parquet")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.dtypes == held.dtypes and got.count() == held.count() and got.exceptAll(held).isEmpty()


def test_odd_values_come_back_from_a_database(spark, tmp_path):
    texts = [" a ", "", None, 'x"y', "a,b", "l\nb\r\nc", "\\", '"', '""', 'x\\"', " ", "\t", "ü€😀", "NULL"]
    rows = [(i if i else None, s, i / 3 if i % 4 else None) for i, s in enumerate(texts)]
    url = derby_archive(spark.createDataFrame(rows, "k long, s string, d double").repartition(3), f"{tmp_path}/odd", "odd")
    assert sorted(map(tuple, jdbc_table(spark, url, "odd", "k", 1, 13, 4, driver=DERBY).collect()), key=str) == sorted(rows, key=str)
