"""Near copies by the Jaccard similarity of five-word shingles: candidates by SimHash and by MinHash bands, each verified
on whole sets.

A text is the set of the hashes of its five-word shingles, lower-cased. Its SimHash fingerprint goes through the
byte-position index of ``simhash``, count filter and Hamming distance included; the sets of a component of fingerprints
are one posting. Three bits are what 64 bits can index for sure, and pairs of 0.8 differ in up to 13, so for the rest
BANDS x BAND_ROWS minima give each distinct set one key a band; sets that share a key meet in a posting too. A pair at
the limit of MIN_JACCARD shares a key with a chance of 1 - (1 - 0.8^4)^32, all but 5e-8 of such pairs, and more similar
pairs miss each other less often still. Postings with the same members are held once. Within a posting the sets
themselves are compared, so no pair under the limit is linked.

Defined results: null and wordless texts are one empty set and link to each other only; texts of one to four words are
one shingle; of each component the row with the smallest doc_id stays, a null doc_id only where all are null, and of
repeated ids one row; an empty table gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmill.llm.common import by_ids, connected_components, keep, materialize, release_memory, scratch
from pathmill.llm.simhash import LOWER, components, majority

WIDTH = 5
MIN_JACCARD = 0.8
BANDS, BAND_ROWS = 32, 4
SEED = 77
#: Distinct sets that are compared inside one task; larger postings are dealt to chunks, and each pair of chunks is a task's.
CHUNK_SETS = 1024
_RANDOM = np.random.default_rng(SEED)
FACTORS = _RANDOM.integers(1, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of WIDTH words; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(WIDTH)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64, len(words) - WIDTH + 1))


def fingerprint(shingles: np.ndarray) -> np.uint64:
    """The SimHash of a set; zero for the empty one."""
    return majority(shingles[at : at + 65536] for at in range(0, len(shingles), 65536))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band, as signed longs; none for the empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(len(FACTORS), ~np.uint64(0))
    for at in range(0, len(shingles), 2048):
        mixed = shingles[at : at + 2048, None] * FACTORS + SHIFTS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _longs(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)), pa.array(flat))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            whole = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
            fps = pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*part.columns, whole, _longs([band_keys(s) for s in sets]), fps], names=[*part.schema.names, "__pathmill_set", "__pathmill_keys", "__pathmill_fp"])


def verified_links(nodes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets of at least MIN_JACCARD; the sets lie one after the other in ``flat``."""
    names, local = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    own = np.repeat(np.arange(len(nodes)), sizes)
    mark = np.zeros(len(names), bool)
    seen = np.zeros(len(nodes), bool)
    out: list[tuple[int, int]] = []
    for first in range(len(nodes)):
        if seen[first]:
            continue
        seen[first], stack = True, [first]
        while stack and not seen.all():
            i = stack.pop()
            mark[local[starts[i] : ends[i]]] = True
            both = np.bincount(own[mark[local]], minlength=len(nodes))
            mark[local[starts[i] : ends[i]]] = False
            near = np.flatnonzero(~seen & (both >= MIN_JACCARD * (sizes + sizes[i] - both) - 1e-9))
            seen[near] = True
            stack += near.tolist()
            out += [(int(nodes[i]), int(nodes[j])) for j in near]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for members in batch.column(0):
            nodes = np.asarray(members.values.field("node"), np.int64)
            sets = [shingle_set(t) for t in members.values.field("text").to_pylist()]
            found += verified_links(nodes, np.concatenate(sets), np.array([len(x) for x in sets]))
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
    release_memory()


def links(sets: DataFrame, texts: DataFrame, chunk: int = CHUNK_SETS) -> DataFrame:
    """(a, b) links of distinct sets given as (node, keys) and (node, text): their components are those of all pairs that
    share a key at the same place and reach MIN_JACCARD. Texts are read for sets that share a key only."""
    postings = materialize(sets.select("node", F.posexplode("keys").alias("band", "key")))
    size = postings.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
    shared = materialize(postings.join(size.where("n > 1"), ["band", "key"]))
    small = shared.where(F.col("n") <= chunk).groupBy("band", "key").agg(F.sort_array(F.collect_set("node")).alias("members"))
    small = small.select("members").distinct()
    small = small.select(F.xxhash64("members", F.lit(SEED)).alias("task"), F.xxhash64(F.lit(SEED), "members").alias("task2"), F.explode("members").alias("node"))
    # A large posting's sets are dealt to chunks by their hash; a task holds two chunks, and every two sets meet in one.
    chunks = F.ceil(F.lit(2.0) * F.col("n") / F.lit(chunk)).cast("int")
    large = shared.where(F.col("n") > chunk).withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    large = large.select("band", "key", "node", "own", other.alias("other"))
    pair = [F.least("own", "other"), F.greatest("own", "other")]
    large = large.select(F.xxhash64("key", "band", *pair).alias("task"), F.xxhash64("band", *pair, "key").alias("task2"), "node")
    tasks = materialize(small.select("task", "task2", "node").unionAll(large))
    held = tasks.join(by_ids(texts, materialize(tasks.select("node").distinct()), "node", "left_semi"), "node")
    groups = held.groupBy("task", "task2").agg(F.collect_list(F.struct("node", "text")).alias("members")).where(F.size("members") > 1)
    return groups.select("members").mapInArrow(_verify, "a long, b long")


def with_simhash(sets: DataFrame) -> DataFrame:
    """(node, keys) of (node, keys, fp): the name of the fingerprint's component within 3 bits is one more key, after the bands'."""
    return sets.join(components(sets), F.col("fp") == F.col("_fp")).select("node", F.concat("keys", F.array("root")).alias("keys"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each component of rows of at least MIN_JACCARD one row stays."""
    spark, row = docs.sparkSession, F.col("__pathmill_row").alias("node")
    numbered = docs.withColumn("__pathmill_row", F.monotonically_increasing_id())
    kinds = numbered.withColumn("__pathmill_set", F.lit(b"")).withColumn("__pathmill_keys", F.array().cast("array<long>")).withColumn("__pathmill_fp", F.lit(0).cast("long")).schema
    rows = materialize(numbered.mapInArrow(_set_rows, kinds))
    with scratch(spark):
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__pathmill_row")).alias("first")
        nodes = materialize(rows.groupBy("__pathmill_set").agg(best).select(F.col("first.__pathmill_row").alias("node"), "first"))
        sets = rows.select(row, F.col("__pathmill_keys").alias("keys"), F.col("__pathmill_fp").alias("fp")).join(nodes.select("node"), "node", "left_semi")
        sets = with_simhash(materialize(sets.where("size(keys) > 0")))
        roots = connected_components(links(sets, rows.select(row, F.col("text").cast("string").alias("text"))))
        named = nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        kept = named.groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first")).select(F.col("first.__pathmill_row").alias("node"))
        gone = keep(rows.select(row).join(kept, "node", "left_anti").select(F.col("node").alias("__pathmill_row")))
    return by_ids(rows, gone, "__pathmill_row", "left_anti").select(*docs.columns)
