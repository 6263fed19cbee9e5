"""Every trade query against its SQL in DuckDB on the same files."""

import zlib

import duckdb
import pytest

from pathmill.queries import ORACLE_SQL, QUERIES, TABLES


def rows(frame, columns):
    def plain(v):
        if v is None or v != v:
            return ""
        return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in row) for row in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck(folder):
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, folder, duck, name):
    got = QUERIES[name](spark, folder).toPandas()
    if name == "value_hash":  # DuckDB has no CRC-32
        held = spark.read.parquet(f"{folder}/customer.parquet").collect()
        expected = {r["c_custkey"]: zlib.crc32(f"{r['c_mktsegment']},{r['c_name']},{r['c_nationkey']}".encode()) for r in held}
        assert dict(zip(got["c_custkey"], got["value_hash"], strict=True)) == expected
        return
    expected = duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert rows(got, columns) == rows(expected, columns)
