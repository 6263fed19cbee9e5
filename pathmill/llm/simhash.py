"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at least 5
positional bytes. The index holds postings under compound positional bytes: families of byte positions of which every
set of 5 positions contains a member, so any linked pair meets in a posting. Within a posting the shared positional
bytes of each pair are tallied, pairs under 5 are dropped, and the rest are verified by Hamming distance.

Defined results: null and wordless texts have fingerprint zero and link to each other like any others; texts of one or
two words are one shingle; repeated rows and rows with equal ids stay separate rows; a null doc_id never is a
component's name unless all ids in it are null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmill.llm.common import connected_components, keep, materialize, scratch, table

SEED = 42
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct fingerprints of one posting that are compared inside one task; larger postings are split by more bytes.
POSTING_ROWS = 2048


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that any 5 of the 8 positions contain one of them."""
    if width == 3:
        return [s for half in (range(4), range(4, 8)) for s in combinations(half, 3)]
    if width == 4:
        pairs = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
        mixed = [(*a, *(x + 4 for x in b)) for kind in pairs for a in kind for b in kind]
        return [(0, 1, 2, 3), (4, 5, 6, 7), *mixed]
    return list(combinations(range(8), 5))


def mask(positions: tuple[int, ...]) -> int:
    """The bytes at ``positions`` as a signed 64-bit mask."""
    value = sum(255 << (8 * p) for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def majority(hashes: Iterable[np.ndarray]) -> np.uint64:
    """The fingerprint of hashes that come in blocks: a bit is 1 if over half of them have it."""
    n, ones = 0, np.zeros(64, np.int64)
    for block in hashes:
        n += len(block)
        ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > n).view(">u8")[0]


def fingerprint_values(texts: list[str | None]) -> np.ndarray:
    """Fingerprints as unsigned 64-bit integers; a bit is 1 if over half of the shingles' hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
        if not words:
            continue
        if len(words) < 3:
            out[i] = digest(b" ".join(words), SEED)
            continue
        parts = (words[at : at + 65536 + 2] for at in range(0, len(words) - 2, 65536))
        out[i] = majority(np.array([digest(b" ".join(t), SEED) for t in zip(part, part[1:], part[2:], strict=False)], np.uint64) for part in parts)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            values = fingerprint_values(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprint_batches, f"doc_id {kind}, fp long")


def posting_links(values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links inside one posting: enough for its components, at most one edge a member."""
    values = np.unique(values)
    seen = np.zeros(len(values), bool)
    out: list[tuple[int, int]] = []
    for start in range(len(values)):
        if seen[start]:
            continue
        seen[start], stack = True, [start]
        while stack:
            i = stack.pop()
            rest = np.flatnonzero(~seen)
            if not len(rest):
                break
            apart = values[rest] ^ values[i]
            shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            rest, apart = rest[shared >= MIN_SHARED], apart[shared >= MIN_SHARED]
            near = rest[np.bitwise_count(apart.view(np.uint64)) <= MAX_BITS]
            seen[near] = True
            stack += near.tolist()
            out += [(int(values[i]), int(values[j])) for j in near]
    return out


def _posting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [edge for values in batch.column(0) for edge in posting_links(np.asarray(values.values, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _postings(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(mask(s)).alias("m"), F.col("fp").bitwiseAND(F.lit(mask(s))).alias("v")) for s in sets])
    return fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.m", "k.v")


def _links_within(postings: DataFrame) -> DataFrame:
    lists = postings.groupBy("m", "v").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return lists.select("fps").mapInArrow(_posting_batches, "a long, b long")


def links(fps: DataFrame, posting_rows: int = POSTING_ROWS) -> DataFrame:
    """(a, b) pairs of distinct fingerprints whose components are those of all pairs within 3 bits.

    Postings of over ``posting_rows`` fingerprints are keyed anew by each set of 5 positions that holds theirs; of those,
    what is still as large is looked up by its fingerprints with 1 to 3 bits flipped, an exact join on equality.
    """
    n = fps.count()
    width = 3 if n < 1 << 25 else 4 if n < 1 << 33 else 5
    postings = materialize(_postings(fps, position_sets(width)))
    large = materialize(postings.groupBy("m", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > posting_rows).select("m", "v"))
    if large.isEmpty():
        return _links_within(postings)
    found = _links_within(postings.join(large, ["m", "v"], "left_anti"))
    wide = [s for s in combinations(range(8), MIN_SHARED)]
    inner = postings.join(large, ["m", "v"], "left_semi").select("fp").distinct()
    again = materialize(_postings(inner, wide))
    large = materialize(again.groupBy("m", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > posting_rows).select("m", "v"))
    found = found.unionAll(_links_within(again.join(large, ["m", "v"], "left_anti")))
    if large.isEmpty():
        return found
    rest = materialize(again.join(large, ["m", "v"], "left_semi"))
    flips = [(mask(s), x) for s in wide for x in flips_outside(s)]  # 56 x 2324 rows, whatever the input
    masks = fps.sparkSession.createDataFrame(flips, "m long, flip long")
    probes = rest.join(F.broadcast(masks), "m").select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("flip")).alias("b"))
    known = rest.select(F.col("fp").alias("b")).distinct()
    return found.unionAll(probes.where("a < b").distinct().join(known, "b").select("a", "b"))


def flips_outside(positions: tuple[int, ...]) -> list[int]:
    """Every pattern of 1 to 3 bits in the bytes not at ``positions``, as signed longs."""
    bits = [8 * p + i for p in range(8) if p not in positions for i in range(8)]
    values = [sum(1 << b for b in c) for k in range(1, MAX_BITS + 1) for c in combinations(bits, k)]
    return np.array(values, np.uint64).view(np.int64).tolist()


def components(rows: DataFrame) -> DataFrame:
    """(_fp, root) of each distinct fingerprint of ``rows`` (fp): root names its component."""
    nodes = materialize(rows.select("fp").distinct())
    roots = connected_components(links(nodes))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; component_id is the smallest doc_id reachable."""
    rows = materialize(fingerprints(docs))
    with scratch(docs.sparkSession):
        named = keep(components(rows))
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    names = first.join(named, F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(names, "root").select("_fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of_fp, F.col("fp") == F.col("_fp")).select("doc_id", hexed.alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
