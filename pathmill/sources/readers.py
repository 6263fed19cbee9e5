"""Tables from Parquet, CSV and JDBC, and generated rows."""

from __future__ import annotations

import os
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathmill.sources.storage import remove, shared_file

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


class Tables(dict):
    """Tables by name, each opened when it is first asked for: a query reads the footers of its own tables only."""

    def __init__(self, spark: SparkSession, folder: str, names: tuple[str, ...], held: dict[str, DataFrame] | None = None):
        super().__init__(held or {})
        self.spark, self.folder, self.names = spark, folder, names

    def __missing__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        self[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self[name]

    def __or__(self, changed: dict[str, DataFrame]) -> Tables:
        return Tables(self.spark, self.folder, self.names, {**self, **changed})


def parquet_tables(spark: SparkSession, folder: str, names: tuple[str, ...]) -> Tables:
    return Tables(spark, folder, names)


def csv_table(spark: SparkSession, folder: str, entity: str, schema: T.StructType) -> DataFrame:
    """``<folder>/<entity>.csv`` with a header line; values that do not parse are an error."""
    return spark.read.csv(f"{folder}/{entity}.csv", header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def write_csv(df: DataFrame, folder: str, entity: str) -> None:
    df.write.mode("overwrite").csv(f"{folder}/{entity}.csv", header=True)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, partitions: int = 1, **options: str) -> DataFrame:
    """A table of a database; with a numeric key it is read in ranges, side by side."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("overwrite").save()


def derby_archive(df: DataFrame, folder: str, table: str) -> str:
    """URL of a Derby database in ``folder`` with the rows of ``df`` as its only table.

    An embedded Derby database belongs to one process, in memory as in files; executors see neither the driver's nor each
    other's. Several processes can read one that is closed and packed. So the executors write the rows side by side, the
    database loads their files itself, one after the other, and its archive is what the executors read.
    """
    spark, at = df.sparkSession, shared_file(df.sparkSession, folder)
    url, driver = f"jdbc:derby:{at}/database", spark._jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver()
    write_jdbc(spark.createDataFrame([], df.schema), f"{url};create=true", table, driver=DERBY)  # the definition, no rows
    # A null is a field of nothing, an empty string one of two quotes.
    texts = [F.concat(F.lit('"'), F.replace(f.name, F.lit('"'), F.lit('""')), F.lit('"')) if isinstance(f.dataType, T.StringType) else F.col(f.name).cast("string") for f in df.schema.fields]
    df.select(F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in texts])).write.text(f"{folder}/rows")
    connection = driver.connect(url, spark._jvm.java.util.Properties())
    load = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
    load.setString(1, table.upper())
    for part in sorted(f for f in os.listdir(f"{at}/rows") if f.startswith("part-")):
        load.setString(2, f"{at}/rows/{part}")
        load.execute()
    connection.close()
    try:
        driver.connect(f"{url};shutdown=true", spark._jvm.java.util.Properties())
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # that of a database that was closed in order
            raise
    with zipfile.ZipFile(f"{at}/database.jar", "w") as packed:
        for where, _, files in os.walk(f"{at}/database"):
            for file in files:
                packed.write(f"{where}/{file}", os.path.relpath(f"{where}/{file}", at))
    remove(spark, f"{folder}/rows")
    remove(spark, f"{folder}/database")
    return f"jdbc:derby:jar:({at}/database.jar)database"


#: Modulus and multiplier of the generated values, a prime and a primitive root of it.
MODULUS, FACTOR = 2**31 - 1, 48271


def random_rows(spark: SparkSession, schema: T.StructType, rows: int, seed: int = 42, distinct_values: int = 10) -> DataFrame:
    """Generated rows: the first column counts up, the others hold seeded values of their type.

    A value's number is (((id + 1) FACTOR + 7919 seed + 104729 place) mod MODULUS) squared mod MODULUS, by the number of values.
    """
    out = [F.col("id").cast(schema.fields[0].dataType).alias(schema.fields[0].name)]
    for i, f in enumerate(schema.fields[1:], 1):
        first = (F.pmod(F.col("id") + 1, F.lit(MODULUS)) * FACTOR + F.lit(7919 * seed + 104729 * i)) % MODULUS
        pick = (first * first) % MODULUS % distinct_values
        kind = f.dataType
        if isinstance(kind, T.StringType):
            value = F.concat(F.lit(f"{f.name}_"), pick.cast("string"))
        elif isinstance(kind, T.BooleanType):
            value = pick % 2 == 0
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            value = F.timestamp_seconds(pick * 86400)
        else:
            value = pick
        out.append(value.cast(kind).alias(f.name))
    return spark.range(rows).select(*out)
