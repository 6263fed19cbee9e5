"""Removal of repeated byte strings through suffix arrays of shards.

Each byte that lies in a WIDTH-byte string that also starts anywhere else goes. Equal strings must meet in one shard, so
every WIDTH-byte window of a text is named by the least hash of its GRAM-byte strings: equal windows have equal names,
neighbouring windows mostly share one, and a run of windows with one name is a fragment. Before anything is gathered,
equal texts count as one text with copies, fragments whose name stands once in the corpus are left (they cannot repeat),
and equal fragments of one name count as one fragment with copies. A name whose fragments are all equal repeats whole.

Fragments of a name that differ are cut out of their texts and dealt to shards, where their suffix array is induced and
the repeated windows are read from its permuted common prefixes. The fragments of a name that has more bytes than a shard
are split first, where their windows reach further to the left of the gram or to its right; each half is named by the
bytes that all its windows hold then. Each time the bytes held grow by half of what is open, until they are the whole
window, so that no task gathers a name of unbounded size. Within a shard the same halving, SIEVES times, leaves out windows
whose surroundings of the gram no other fragment has, before the suffix array decides on the rest byte by byte. What goes
is judged on the input, and the digest is of what is left.

Defined results: a null text is empty; texts under WIDTH bytes stay whole; repeated rows are texts of their own, so long
ones lose everything; windows never cross texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmill.llm.common import by_ids, keep, materialize, scratch, shuffle_partitions, table
from pathmill.llm.suffixes import repeated_starts, suffix_array

WIDTH = 200
GRAM = 32
#: Windows named at a time; names keep a 20-bit place within them.
CHUNK = 1 << 19
#: A suffix array is closed when it has so many bytes of fragments; names with more are split, so none has twice as many.
SHARD_BYTES = 1 << 20
#: Times that the windows of a shard's pieces are halved before its suffix array is built.
SIEVES = 3
MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    h, base, size = a.astype(np.uint64) + np.uint64(1), MIX, 1
    while size < GRAM:
        h = h[:-size] * base + h[size:]
        base = np.uint64(int(base) * int(base) & 0xFFFFFFFFFFFFFFFF)
        size *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """The least key of each ``width`` neighbouring ones."""
    low, size = key, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return low if size == width else np.minimum(low[: len(key) - width + 1], low[width - size :][: len(key) - width + 1])


def fragments(data: bytes, width: int = WIDTH) -> Iterator[tuple[int, int, int, int]]:
    """(name, start, windows, place of the gram from the start) of the runs of windows with one name, in order."""
    a = np.frombuffer(data, np.uint8)
    for base in range(0, len(a) - width + 1, CHUNK):
        part = a[base : base + CHUNK + width - 1]
        h = gram_hashes(part)
        key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        low = least_in_windows(key, width - GRAM + 1)
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        place = (low[first] & np.uint64((1 << 20) - 1)).astype(np.int64)
        yield from zip(h[place].view(np.int64).tolist(), (first + base).tolist(), np.diff(np.r_[first, len(low)]).tolist(), (place - first).tolist(), strict=True)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("name", pa.int64()), ("body", pa.int64()), ("copies", pa.int64()), ("gram", pa.int32()), ("bytes", pa.int64()), ("piece", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            out = []
            for row in batch.slice(at, 64).to_pylist():
                data = row["text"].encode("utf-8", "surrogatepass")
                for c in row["cuts"]:
                    out.append({"name": c["name"], "body": c["body"], "copies": c["copies"], "gram": c["gram"], "bytes": c["bytes"], "piece": data[c["start"] : c["start"] + c["windows"] + WIDTH - 1]})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)


def halves(gram: int, base: int, windows: int, left: int, right: int) -> list[tuple[int, int, int, int]]:
    """(base, windows, left, right) of the windows from ``base`` that hold more bytes to the left of the gram, and of the rest.

    All windows hold ``left`` bytes before the gram and ``right`` after it; those of the first half hold half of the open
    bytes more on the left, and the others, which start later, the same or one more on the right.
    """
    open_bytes = WIDTH - GRAM - left - right
    more = (open_bytes + 1) // 2
    cut = min(max(gram - left - more + 1, base), base + windows)
    parts = [(base, cut - base, left + more, right), (cut, base + windows - cut, left, right + open_bytes - more + 1)]
    return [p for p in parts if p[1]]


def _halve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the windows to be split -> the halves' windows, what they hold, and their names and bodies."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        name0, body0, copies, gram, piece, base, windows, left, right = (batch.column(c).to_pylist() for c in ("name0", "body0", "copies", "gram", "piece", "base", "windows", "left", "right"))
        row, found, names, bodies = [], [], [], []
        for i in range(batch.num_rows):
            g, data = gram[i], piece[i]
            for b, w, before, after in halves(g, base[i], windows[i], left[i], right[i]):
                row.append(i)
                found.append((b, w, before, after))
                names.append(digest(data[g - before : g + GRAM + after], before * WIDTH + after))
                bodies.append(digest(data[b : b + w + WIDTH - 1], before * WIDTH + after))
        at = pa.array(row, pa.int32())
        kept = [batch.column(c).take(at) for c in ("name0", "body0", "copies")]
        numbers = [pa.array([f[k] for f in found], pa.int32()) for k in range(4)]
        hashes = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (names, bodies)]
        yield pa.RecordBatch.from_arrays([*kept, *numbers, *hashes], names=["name0", "body0", "copies", "base", "windows", "left", "right", "name", "body"])


def _shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole names, as they come sorted, through one suffix array each."""
    rows: list[tuple[int, int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if size >= SHARD_BYTES and row[0] != rows[-1][0]:
                yield shard_repeats(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield shard_repeats(rows)


def shared_windows(rows: list[tuple[int, int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(row, first, last + 1): runs of the pieces' windows whose bytes around the gram another piece of their name holds too.

    Windows are halved as names are that do not fit a shard; halves with nothing in common with another piece go, so that
    the suffix array is spared fragments that share a gram and little else.
    """
    digest = xxhash.xxh3_64_intdigest
    live = [(i, 0, len(row[4]) - WIDTH + 1, 0, 0) for i, row in enumerate(rows)]
    for _ in range(SIEVES):
        found: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = {}
        for i, base, windows, left, right in live:
            name, _, _, gram, piece = rows[i]
            for b, n, before, after in halves(gram, base, windows, left, right):
                held = digest(piece[gram - before : gram + GRAM + after], before * WIDTH + after)
                found.setdefault((name, held), []).append((i, b, n, before, after))
        live = [x for same in found.values() if len(same) > 1 for x in same]
    out: list[tuple[int, int, int]] = []
    for i, base, windows, *_ in sorted(live):
        if out and out[-1][0] == i and out[-1][2] == base:
            out[-1] = (i, out[-1][1], base + windows)
        else:
            out.append((i, base, base + windows))
    return out


def shard_repeats(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    """(name, body, low, high): runs of windows, by their places in the fragment, that also start elsewhere.

    ``rows`` are (name, body, copies, place of the gram, piece).
    """
    hits = [np.full(len(r[4]) - WIDTH + 1, r[2] > 1) for r in rows]
    runs = shared_windows(rows)
    if runs:
        text = np.zeros(sum(b - a + WIDTH for _, a, b in runs) + 1, np.int64)
        at, starts = 0, []
        for i, a, b in runs:
            n = b - a + WIDTH - 1
            text[at : at + n] = np.frombuffer(rows[i][4], np.uint8, n, a)
            text[at : at + n] += 2
            text[at + n] = 1
            starts.append(at)
            at += n + 1
        repeated = repeated_starts(text, suffix_array(text, 258), WIDTH)
        for (i, a, b), s in zip(runs, starts, strict=True):
            hits[i][a:b] |= repeated[s : s + b - a]
    out: list[tuple[int, int, int, int]] = []
    for (name, body, *_), hit in zip(rows, hits, strict=True):
        edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
        out += [(name, body, int(a), int(b)) for a, b in edge.reshape(-1, 2)]
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["name", "body", "low", "high"])


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their byte spans to go -> what is left."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                runs = _merge([(s["low"], s["high"]) for s in spans or []])
                cuts = [0, *(x for r in runs for x in r), len(data)]
                left = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                out.append((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left, [{"low": a, "high": b} for a, b in runs]))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k1, k2, spans): for each distinct text (by its keys) with a repeated window, the byte ranges of the repeated windows.

    Whatever is joined on a name is a written table on both sides, so that adaptive execution can split a hot name.
    """
    with scratch(docs.sparkSession):
        rows = _keyed(docs).where(F.octet_length("text") >= WIDTH).select("k1", "k2", "text", F.monotonically_increasing_id().alias("rid"))
        found = "found array<struct<name:long,body:long,start:int,windows:int,gram:int>>"
        per_row = materialize(rows.mapInArrow(_fragment_batches, f"k1 long, k2 long, rid long, text string, {found}"))
        first = materialize(per_row.groupBy("k1", "k2").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies")))
        doubles = materialize(per_row.select("rid").join(first.select("rid"), "rid", "left_anti"))
        copied = materialize(first.where("copies > 1").select("rid", "copies"))
        texts = by_ids(by_ids(per_row.select("rid", "found"), doubles, "rid", "left_anti"), copied, "rid", "left")
        all_fragments = texts.select("rid", F.coalesce("copies", F.lit(1)).alias("copies"), F.explode("found").alias("f")).select("rid", "copies", "f.*")
        names = materialize(all_fragments.groupBy("name").agg(F.sum("copies").alias("n")).where("n > 1").select("name"))
        several = materialize(all_fragments.join(names, "name", "left_semi"))
        bodies = materialize(several.groupBy("name", "body").agg(F.sum("copies").alias("copies"), F.min(F.struct("rid", "start", "windows", "gram")).alias("one")))
        kinds = materialize(_sizes(bodies))
        judged = materialize(bodies.join(kinds, "name"))
        same = judged.where("bodies = 1").select("name", "body", F.lit(0).alias("low"), F.col("one.windows").alias("high"))
        cuts = judged.where("bodies > 1").groupBy("one.rid").agg(F.collect_list(F.struct("name", "body", "copies", "one.start", "one.windows", "one.gram", "bytes")).alias("cuts"))
        cut = per_row.select("rid", "text").join(cuts, "rid").select("text", "cuts")
        pieces = cut.mapInArrow(_cut_batches, "name long, body long, copies long, gram int, bytes long, piece binary")
        runs = [same]
        if _hot(kinds).isEmpty():
            runs.append(_in_shards(pieces))
        else:
            pieces = materialize(pieces)
            runs += [_in_shards(pieces.where(f"bytes <= {SHARD_BYTES}")), *_split(pieces.where(f"bytes > {SHARD_BYTES}"))]
        spans = several.join(materialize(reduce(DataFrame.unionAll, runs)), ["name", "body"])
        spans = spans.select("rid", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") + WIDTH - 1).alias("high"))
        spans = spans.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
        return keep(spans.join(first, "rid").select("k1", "k2", "spans"))


def _sizes(bodies: DataFrame) -> DataFrame:
    """(name, n, bodies, bytes): how often each name occurs, its different fragments and their bytes."""
    size = F.sum(F.col("one.windows") + WIDTH - 1).alias("bytes")
    return bodies.groupBy("name").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("bodies"), size).where("n > 1")


def _hot(sizes: DataFrame) -> DataFrame:
    return sizes.where(f"bodies > 1 AND bytes > {SHARD_BYTES}")


def _in_shards(pieces: DataFrame) -> DataFrame:
    """(name, body, low, high) of pieces (name, body, copies, gram, piece), whose names all fit a shard."""
    dealt = pieces.select("name", "body", "copies", "gram", "piece").repartition(shuffle_partitions(pieces.sparkSession), "name").sortWithinPartitions("name", "body")
    return dealt.mapInArrow(_shard_batches, "name long, body long, low int, high int")


def _split(pieces: DataFrame) -> Iterator[DataFrame]:
    """(name, body, low, high) of the pieces of names that do not fit a shard, a table for each round of splitting."""
    kinds = "name0 long, body0 long, copies long, base int, windows int, left int, right int, name long, body long"
    pieces = pieces.select(F.col("name").alias("name0"), F.col("body").alias("body0"), "copies", "gram", "piece")
    whole = F.octet_length("piece") - (WIDTH - 1)
    now = pieces.select("*", F.lit(0).alias("base"), whole.cast("int").alias("windows"), F.lit(0).alias("left"), F.lit(0).alias("right"))
    while True:
        keys = materialize(now.mapInArrow(_halve_batches, kinds))
        bodies = materialize(keys.groupBy("name", "body").agg(F.sum("copies").alias("copies"), F.min(F.struct("name0", "body0", "base", "windows")).alias("one")))
        sizes = materialize(_sizes(bodies))
        judged = materialize(bodies.join(sizes, "name").select("name", "body", "copies", "one.*", "bodies", "bytes"))
        same = judged.where("bodies = 1").select("name", "body", F.lit(0).alias("low"), F.col("windows").alias("high"))
        shards = judged.where(f"bodies > 1 AND bytes <= {SHARD_BYTES}").join(pieces.select("name0", "body0", "gram", "piece"), ["name0", "body0"])
        shards = shards.withColumn("gram", F.col("gram") - F.col("base")).withColumn("piece", F.expr(f"substring(piece, base + 1, windows + {WIDTH - 1})"))
        runs = materialize(same.unionAll(_in_shards(shards)))
        shift = keys.select("name0", "body0", "base", "name", "body").join(runs, ["name", "body"])
        yield shift.select("name0", "body0", (F.col("base") + F.col("low")).alias("low"), (F.col("base") + F.col("high")).alias("high"))
        hot = _hot(sizes).select("name")
        if hot.isEmpty():
            return
        again = materialize(keys.join(hot, "name", "left_semi").select("name0", "body0", "base", "windows", "left", "right"))
        now = materialize(pieces.join(again, ["name0", "body0"]))


def _fragment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            name, body, start, windows, gram, ends = [], [], [], [], [], [0]
            for text in part.column("text").to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                for n, s, w, g in fragments(data):
                    name.append(n)
                    body.append(digest(data[s : s + w + WIDTH - 1]))
                    start.append(s)
                    windows.append(w)
                    gram.append(g)
                ends.append(len(name))
            columns = [pa.array(name, pa.int64()), pa.array(np.array(body, np.uint64).view(np.int64)), *(pa.array(c, pa.int32()) for c in (start, windows, gram))]
            flat = pa.StructArray.from_arrays(columns, names=["name", "body", "start", "windows", "gram"])
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("k1", "k2", "rid", "text")), found], names=["k1", "k2", "rid", "text", "found"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) for every row of ``docs``."""
    spans = repeated_spans(docs)
    joined = _keyed(docs).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_span_batches, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<low:int,high:int>>")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
