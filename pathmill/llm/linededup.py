"""Line deduplication by site-relative frequency.

Pages are grouped by host (``source``). For each host, the number of its pages that contain a line is divided by the
number of its pages; a line over the boilerplate ratio goes from every page of that host. With ``copies_once`` the pages
of equal text on a host count as one, so that copies of a page do not make its lines boilerplate; the pipeline counts so,
op5 counts rows as its SQL does. Lines are compared without
spaces and tabs at their ends; blank lines never count and always stay. A line must also stand on a few pages, so that
hosts of one or two pages keep their text.

Defined results: a null text stays null with no lines; an empty one stays empty; null hosts are one host; a line that a
page repeats counts once for that page; repeated rows are pages of their own, but for ``copies_once``; a page may lose all its lines and is then
empty; an empty table gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmill.llm.common import by_ids, materialize, table

#: A line on more than this share of a host's pages is boilerplate, if at least MIN_PAGES pages have it.
MAX_RATIO = 0.05
MIN_PAGES = 4
#: Boilerplate lists up to this size are broadcast; beyond it hosts are joined by a shuffle, salted.
BROADCAST_BYTES = 32 << 20
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hash(line: Column) -> Column:
    """128 bits that stand for a line; null for blank lines."""
    bare = F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("h"), F.xxhash64(F.lit("second"), bare).alias("g")))


def boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(site, lines): hashes of each host's boilerplate lines. A host has fewer than its mean lines a page / max_ratio."""
    site, text = F.col("source").cast("string"), F.col("text").cast("string")
    parts = [site.isNull(), site, text.isNull(), text]
    rows = docs.select(site.alias("site"), text.alias("text"), F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit("second"), *parts).alias("g"))
    if copies_once:
        groups = materialize(rows.groupBy("site", "h", "g").agg(F.count(F.lit(1)).alias("copies")))
        pages = groups.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
        # Of a text with c copies each row counts 1 / c, so that no text needs to be gathered; the sums are whole numbers.
        weighed = by_ids(rows, materialize(groups.where("copies > 1").select("h", "g", "copies")), ["h", "g"], "left")
        weighed = weighed.select("site", "text", (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("weight"))
    else:
        pages = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
        weighed = rows.select("site", "text", F.lit(1).alias("weight"))
    seen = weighed.select("site", "weight", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _hash))).alias("line")).where("line is not null")
    counts = seen.groupBy("site", "line").agg(F.round(F.sum("weight")).cast("long").alias("pages")).where(F.col("pages") >= min_pages)
    n = pages.select(F.col("site").alias("__pathmill_site"), "n")
    over = counts.join(n, F.col("site").eqNullSafe(F.col("__pathmill_site"))).where(F.col("pages") > F.col("n") * max_ratio)
    return over.groupBy("site").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """``docs`` with its boilerplate lines taken out of ``text``, and ``__pathmill_lines`` and ``__pathmill_dropped``: how many it had and lost."""
    spark = docs.sparkSession
    found = materialize(boilerplate(docs, max_ratio, min_pages, copies_once))
    total = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    site = F.col("source").cast("string")
    if total * 32 <= BROADCAST_BYTES:
        found = F.broadcast(found.withColumnRenamed("lines", "__pathmill_boiler").withColumnRenamed("site", "__pathmill_site"))
        joined = docs.join(found, site.eqNullSafe(F.col("__pathmill_site")), "left")
    else:
        salted = found.select(F.col("site").alias("__pathmill_site"), F.col("lines").alias("__pathmill_boiler"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__pathmill_salt"))
        joined = docs.join(salted, site.eqNullSafe(F.col("__pathmill_site")) & (F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(SALTS)) == F.col("__pathmill_salt")), "left")
    lines = _lines(F.col("text").cast("string"))
    kept = F.filter(lines, lambda x: F.coalesce(~F.array_contains(F.coalesce(F.col("__pathmill_boiler"), F.array().cast("array<struct<h:bigint,g:bigint>>")), _hash(x)), F.lit(True)))
    out = joined.withColumn("__pathmill_kept", kept)
    new = [F.when(F.col("__pathmill_boiler").isNull(), F.col("text")).otherwise(F.array_join("__pathmill_kept", "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return out.select(*new, n.alias("__pathmill_lines"), (n - F.when(F.col("text").isNull(), 0).otherwise(F.size("__pathmill_kept"))).cast("long").alias("__pathmill_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__pathmill_lines").alias("n_lines"), F.col("__pathmill_dropped").alias("n_dropped"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP5_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, text, i, line, regexp_replace(line, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS bare
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), boiler AS (
  SELECT l.source, l.bare FROM (SELECT source, bare, count(DISTINCT doc_id) AS pages FROM lines WHERE bare <> '' GROUP BY source, bare) l
  JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s ON l.source = s.source
  WHERE l.pages >= {MIN_PAGES} AND l.pages > s.n * CAST({MAX_RATIO} AS DOUBLE)
), left_over AS (
  SELECT l.doc_id, count(*) AS n_lines, count(b.bare) AS n_dropped, coalesce(string_agg(CASE WHEN b.bare IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS text
  FROM lines l LEFT JOIN boiler b ON l.source = b.source AND l.bare = b.bare GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_dropped, CAST(length(text) AS BIGINT) AS n_chars_left, sha256(text) AS text_sha256 FROM left_over
"""
