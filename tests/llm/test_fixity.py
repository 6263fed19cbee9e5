"""Layout of records in files of any size, and records that are cut short."""

from pyspark.sql import functions as F

from pathmill.llm import fixity


def test_offsets_follow_each_other_whatever_a_file_holds(spark):
    pages = spark.range(900).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 7 * 1000).alias("page_id"), F.lit("http://a").alias("url"), F.repeat(F.lit("x"), (F.col("id") % 11).cast("int")).alias("html")
    )  # a third without an id, repeated ids and repeated rows
    got = fixity.to_records(pages.repartition(5)).toPandas()
    assert len(got) == 900 and got.file.nunique() == 8
    for _, g in got.groupby("file"):
        g = g.sort_values("offset")
        assert (g.length.cumsum() - g.length == g.offset).all()
        assert g.sha256[g.page_id.isna()].is_monotonic_increasing
        assert [*map(tuple, g[["page_id", "sha256"]].dropna().values)] == sorted(map(tuple, g[["page_id", "sha256"]].dropna().values))
    again = fixity.to_records(pages.repartition(3))
    roots, damage = fixity.audit(fixity.to_records(pages), again)
    assert damage.count() == 0 and roots.where("root <> replica_root").count() == 0


def test_records_cut_short_are_returned():
    whole = b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    for cut in range(1, len(whole)):
        got = list(fixity.parse_records(whole + whole[:cut]))
        assert [r["offset"] for r in got] == [0, len(whole)] and got[1]["record"] == whole[:cut] and got[1]["length"] == cut
        assert got[1]["payload"] == whole[:cut].partition(b"\r\n\r\n")[2][:4]
