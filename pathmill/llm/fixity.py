"""Merkle fixity audit of WARC replicas.

Records are hashed one by one; the hashes of the records that start in one range of offsets, in the order of their
offsets, are hashed into a leaf; FANOUT neighbours make a node, up to one root a file. Two replicas are compared root by
root, and only the branches that differ are descended, so what is read of the trees follows the damage. In the ranges
that remain, records are matched by offset. The records of a range are bounded by its bytes, whatever a file's share.

Defined results: a null url or html counts as empty; files missing on one side differ at the root, and all their records
are `missing` or `extra`; several records at one offset are compared as a sorted list; repeated rows are records of
their own; empty replicas give an empty table; other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathmill.llm.common import materialize, table

RANGE_BYTES = 1 << 16
FANOUT = 16
#: Pages of one WARC file of the query.
FILE_PAGES = 1000
#: Levels above the leaves in the query's trees, enough for files of under 16^3 ranges.
HEIGHT = 3


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record with fixed fields, so that equal pages give equal bytes."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def to_records(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """(file, offset, length, page_id, sha256): the records of ``pages`` laid out in files of ``file_pages`` ids, by id and hash.

    A file may hold any share of the rows, such as those without an id: rows are dealt to ranges of file and order, equal
    ones by a salt, and offsets are summed up within a range and shifted by the lengths of the ranges before it.
    """
    text = record_text(F.col("page_id"), F.col("url"), F.col("html"))
    file = F.format_string("pages-%08d.warc", F.coalesce(F.floor(F.col("page_id") / file_pages), F.lit(-1)).cast("long"))
    rows = pages.select(file.alias("file"), "page_id", F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("sha256"))
    order = ["page_id", "sha256", "_salt"]
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = materialize(salted.repartitionByRange("file", *order).withColumn("_part", F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("file", "_part").agg(F.sum("length").alias("_sum"))  # for each file as many rows as it has ranges
    starts = starts.select("file", "_part", F.coalesce(F.sum("_sum").over(before.partitionBy("file").orderBy("_part")), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("length").over(before.partitionBy("file", "_part").orderBy(*order)), F.lit(0))
    placed = dealt.withColumn("_inside", inside).join(starts, ["file", "_part"])
    return placed.select(*rows.columns, (F.col("_start") + F.col("_inside")).alias("offset"))


def leaves(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, node, hash) of the leaves: records are ordered by offset within their range."""
    node = F.floor(F.col("offset") / range_bytes).cast("long").alias("node")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "sha256")))
    return records.groupBy("file", node).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["sha256"]), ""), 256).alias("hash"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("node", "hash")))
    up = F.floor(F.col("node") / fanout).cast("long").alias("node")
    return nodes.groupBy("file", up).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["hash"])), ""), 256).alias("hash"))


def tree(records: DataFrame, height: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to the roots."""
    levels = [materialize(leaves(records, range_bytes))]
    for _ in range(height):
        levels.append(materialize(parents(levels[-1], fanout)))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, node) whose hashes differ or that one side lacks."""
    other = b.select(F.col("file").alias("_file"), F.col("node").alias("_node"), F.col("hash").alias("_hash"))
    both = a.join(other, (F.col("file") == F.col("_file")) & (F.col("node") == F.col("_node")), "full")
    return both.where(~F.col("hash").eqNullSafe(F.col("_hash"))).select(F.coalesce("file", "_file").alias("file"), F.coalesce("node", "_node").alias("node"))


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, least_height: int = 0) -> tuple[DataFrame, DataFrame]:
    """(roots, damage) of two tables of records (file, offset, length, sha256).

    roots: file, root (of the primary), replica_root. damage: file, offset, status (corrupt, missing or extra) and both
    hashes, for the records in mismatching ranges that differ.
    """
    last = max((x.agg(F.max("offset")).first()[0] or 0) for x in (primary, replica)) // range_bytes
    height = 0
    while last:
        last //= fanout
        height += 1
    height = max(height, least_height)
    ours, theirs = tree(primary, height, range_bytes, fanout), tree(replica, height, range_bytes, fanout)
    roots = ours[-1].select("file", F.col("hash").alias("root")).join(theirs[-1].select("file", F.col("hash").alias("replica_root")), "file", "full")
    at = materialize(_differing(ours[-1], theirs[-1]))
    for a, b in zip(ours[:-1][::-1], theirs[:-1][::-1], strict=True):
        up = at.select(F.col("file").alias("_f"), F.col("node").alias("_up"))
        below = [x.join(up, (F.col("file") == F.col("_f")) & (F.floor(F.col("node") / fanout) == F.col("_up")), "left_semi") for x in (a, b)]
        at = materialize(_differing(*below))

    def within(x: DataFrame, name: str) -> DataFrame:
        node = F.floor(F.col("offset") / range_bytes).cast("long").alias("node")
        kept = x.select("file", "offset", "sha256", node).join(at, ["file", "node"], "left_semi")
        return kept.groupBy("file", "offset").agg(F.array_join(F.array_sort(F.collect_list("sha256")), ",").alias(name))

    both = within(primary, "sha256").join(within(replica, "replica_sha256"), ["file", "offset"], "full")
    status = F.when(F.col("replica_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "extra").otherwise("corrupt")
    damage = both.where(~F.col("sha256").eqNullSafe(F.col("replica_sha256"))).select("file", "offset", status.alias("status"), "sha256", "replica_sha256")
    return roots, damage


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A stand-in for the second replica: the same pages, of which some have one character replaced in place."""
    hit = F.col("page_id") % 97 == 13
    broken = F.concat(F.lit("?"), F.expr("substring(html, 2)"))
    return pages.select("page_id", "url", F.when(hit & (F.length("html") > 0), broken).otherwise(F.col("html")).alias("html"))


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the archive with its place, hash, its file's root, and what the audit found of it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    primary = materialize(to_records(pages))
    replica = materialize(to_records(damaged_copy(pages)))
    roots, damage = audit(primary, replica, least_height=HEIGHT)
    found = damage.select("file", "offset", "status", "replica_sha256")
    out = primary.join(roots.select("file", "root", (F.col("root") != F.col("replica_root")).alias("file_differs")), "file").join(found, ["file", "offset"], "left")
    return out.select("page_id", "file", "offset", "length", "sha256", "root", "file_differs", F.coalesce("status", F.lit("ok")).alias("status"), "replica_sha256")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, headers, payload, sha256) of the records of the .warc and .warc.gz files at ``path``.

    Offsets of gzip files are those of the uncompressed stream. A record cut short at the end of a file is returned with
    what is there, in its headers or in its payload. A file is read by one task, which holds it whole: by convention such
    files have about a gigabyte, and the reader takes none over two.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = "file string, offset long, length long, headers map<string,string>, payload binary, record binary"
    parsed = files.mapInArrow(_parse_batches, out)
    return parsed.select("file", "offset", "length", "headers", "payload", F.sha2("record", 256).alias("sha256"))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("record", pa.binary())])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = content.as_py()
            if data[:2] == b"\x1f\x8b":
                data = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
            for row in parse_records(data):
                yield pa.RecordBatch.from_pylist([{"file": path.rsplit("/", 1)[-1], **row}], schema=kinds)


def parse_records(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        end = end if end >= 0 else len(data)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = next((int(v) for k, v in headers.items() if k.lower() == "content-length" and v.isdigit()), 0)
        stop = min(len(data), end + 4 + size + 4)
        yield {"offset": at, "length": stop - at, "headers": list(headers.items()), "payload": data[end + 4 : end + 4 + size], "record": data[at:stop]}
        at = stop


def _sql(height: int = HEIGHT) -> str:
    records = """
  SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM (SELECT page_id, printf('pages-%08d.warc', (page_id // {n})::BIGINT) AS file, strlen(rec)::BIGINT AS length, sha256(rec) AS sha256
    FROM (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
      || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM {t}))"""
    sql = "WITH other AS (SELECT page_id, url, CASE WHEN page_id % 97 = 13 AND length(html) > 0 THEN '?' || substring(html, 2) ELSE html END AS html FROM pages)"
    for side, t in (("a", "pages"), ("b", "other")):
        sql += f", {side} AS ({records.format(n=FILE_PAGES, t=t)})"
        sql += f""", {side}0 AS (SELECT file, "offset" // {RANGE_BYTES} AS node, sha256(string_agg(sha256, '' ORDER BY "offset")) AS hash FROM {side} GROUP BY ALL)"""
        for k in range(1, height + 1):
            sql += f", {side}{k} AS (SELECT file, node // {FANOUT} AS node, sha256(string_agg(node || ':' || hash, '' ORDER BY node)) AS hash FROM {side}{k - 1} GROUP BY ALL)"
    return (
        sql
        + f"""
SELECT a.page_id, a.file, a."offset", a.length, a.sha256, ra.hash AS root, ra.hash <> rb.hash AS file_differs,
  CASE WHEN a.sha256 = b.sha256 THEN 'ok' ELSE 'corrupt' END AS status, CASE WHEN a.sha256 <> b.sha256 THEN b.sha256 END AS replica_sha256
FROM a JOIN b USING (file, "offset") JOIN a{height} ra ON ra.file = a.file JOIN b{height} rb ON rb.file = a.file"""
    )


OP3_SQL = _sql()
