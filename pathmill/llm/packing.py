"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Every document is tokenised, ended with an id, and cut into pieces of at most one sequence; only its first piece may be
shorter than a sequence, and that remainder is what is packed. Packing needs the lengths only, and there are at most
1024 of them, so the packer works on the histogram of lengths: kinds of bins (the lengths a bin holds) with how many
bins are of that kind. Best fit places the longest lengths first; the local search then exchanges one or two pieces for
one or two, or moves them between kinds of underfull bins, as long as the sum of squared fills grows, until nothing helps,
and drops bins that run empty. What the driver holds depends on the lengths' number, not on the documents'. Spark then numbers the pieces of
each length and gives each its place.

Defined results: a null or empty text is one piece that holds only the end id; repeated rows are packed each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathmill.llm.common import materialize, number_within, table

CAPACITY = 1024
END_ID = 2

#: How the byte-level vocabulary cuts a text before it merges, in the pattern language of tiktoken.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids by the vocabulary file at ``path``, without added special tokens.

    A byte-level vocabulary whose ids follow the order of its merges is run by tiktoken, which gives the same ids in a
    third of the time, but for texts that it cannot cut; those and any other file are run by tokenizers itself.
    """
    spec = json.loads(Path(path).read_text())
    vocabulary, merges = spec["model"].get("vocab", {}), spec["model"].get("merges", [])
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    byte_level = (spec.get("pre_tokenizer") or {}) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if byte_level and not spec.get("normalizer") and all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)):
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            try:
                return encoding.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its regex gives up on runs of about a million white-space characters
                return by_tokenizers(path)(text)

        return encode
    return by_tokenizers(path)


@lru_cache(maxsize=2)
def by_tokenizers(path: str) -> Callable[[str], np.ndarray]:
    """``encoder`` by tokenizers itself, for any vocabulary file and any text."""
    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _piece_batches(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = (encode(text).astype("<u4").tobytes() if text else b"") + end
                    n = len(ids) // 4
                    head = n - (n - 1) // capacity * capacity
                    for k, s in enumerate([0, *range(head, n, capacity)]):
                        size = head if k == 0 else capacity
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * s : 4 * (s + size)]))
                ids = part.column(0).take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every document."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_piece_batches(tokenizer_path, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Bin = tuple[int, ...]


def best_fit(lengths: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Bins by kind for a histogram of lengths: longest first, each into the bins with the least room that is enough."""
    rooms: dict[int, Counter] = defaultdict(Counter)  # room left -> kinds of bins
    order: list[int] = []  # rooms in use, ascending
    done: Counter = Counter()

    def put(kind: Bin, room: int, n: int) -> None:
        if room == 0:
            done[kind] += n
            return
        if not rooms[room]:
            insort(order, room)
        rooms[room][kind] += n

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            i = bisect_left(order, length)
            if i == len(order):
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    put((length,) * per, capacity - per * length, full)
                if rest:
                    put((length,) * rest, capacity - rest * length, 1)
                break
            room = order[i]
            kind, n = rooms[room].popitem()
            if not rooms[room]:
                order.pop(i)
            fits = room // length
            whole = min(n, left // fits)
            if whole:
                put(kind + (length,) * fits, room - fits * length, whole)
                n, left = n - whole, left - whole * fits
            if n and left and left < fits:
                put(kind + (length,) * left, room - left * length, 1)
                n, left = n - 1, 0
            if n:
                put(kind, room, n)
    for kinds in rooms.values():
        done.update(kinds)
    return done


class Kind:
    """A kind of underfull bins: its fill, and what it can give up or take over in one exchange."""

    def __init__(self, lengths: Bin):
        self.lengths, self.fill = lengths, sum(lengths)
        distinct = sorted(set(lengths))
        self.moves = {v: (v,) for v in distinct}
        for i, v in enumerate(distinct):
            for w in distinct[i if lengths.count(v) > 1 else i + 1 :]:
                self.moves.setdefault(v + w, (v, w))
        self.sums = sorted(self.moves)
        self.outs = [0, *self.sums]

    def best_from(self, other: Kind, room: int) -> tuple[int, int, int]:
        """(most length up to ``room`` that this kind can gain, length given, length taken from ``other``); zeros if none."""
        best, sums = (0, 0, 0), other.sums
        for u in self.outs:
            i = bisect_right(sums, room + u)
            if i and sums[i - 1] - u > best[0]:
                best = (sums[i - 1] - u, u, sums[i - 1])
                if best[0] == room:
                    break
        return best


def swapped(kind: Bin, out: Bin, into: Bin) -> Bin:
    left = list(kind)
    for v in out:
        left.remove(v)
    return tuple(sorted(left + list(into), reverse=True))


def local_search(bins: Counter, capacity: int = CAPACITY) -> Counter:
    """Exchanges between underfull bins that raise the sum of squared fills, until none helps; bins that run empty go.

    Kinds are taken from the emptiest and tried against the kinds with more fill; the exchange with the largest gain is
    made for as many bins as both kinds have. A kind that found nothing is tried again only against kinds that came into
    being since. Moving d from fill y to fill x gains 2 d (x - y + d), at most 2 (capacity - x) (capacity - y) as d is at
    most x's room, so partners are tried by fill until that bound is under the best gain. It ends earlier only when the
    bins are as few as their fill allows.
    """
    bins = Counter(bins)
    number = sum(bins.values())
    fewest = -(-sum(sum(k) * n for k, n in bins.items()) // capacity)
    kinds: dict[Bin, Kind] = {}
    ranked: list[tuple[int, Bin]] = []  # underfull kinds by fill
    born: dict[Bin, int] = {}  # when a kind came into being, counted in exchanges
    tried: dict[Bin, int] = {}  # when a kind was last tried against all that were there
    made = 0

    def enter(kind: Bin) -> None:
        if (fill := sum(kind)) < capacity:
            kinds[kind] = Kind(kind)
            insort(ranked, (fill, kind))
            born[kind] = made

    for kind in bins:
        enter(kind)
    queue = list(ranked)
    heapq.heapify(queue)
    while number > fewest:
        if not queue:
            queue = [(fill, k) for fill, k in ranked if tried.get(k, -1) < made]
            if not queue:
                break
        fill, b = heapq.heappop(queue)
        if b not in kinds:
            continue
        since, own, best = tried.get(b, -1), kinds[b], None
        for at in range(bisect_left(ranked, (fill, ())), len(ranked)):
            more, a = ranked[at]
            if best and 2 * (capacity - more) * (capacity - fill) <= best[0]:
                break
            if born[a] <= since or (a == b and bins[b] < 2):
                continue
            delta, out, into = kinds[a].best_from(own, capacity - more)
            gain = 2 * delta * (more - fill + delta)
            if delta and (best is None or gain > best[0]):
                best = (gain, a, kinds[a].moves[out] if out else (), own.moves[into])
        if not best:
            tried[b] = made
            continue
        _, a, out, into = best
        made += 1
        n = bins[b] // 2 if a == b else min(bins[a], bins[b])
        new_a, new_b = swapped(a, out, into), swapped(b, into, out)
        for kind, change in ((a, -n), (b, -n), (new_a, n), (new_b, n)):
            if not kind:
                number -= n
                continue
            bins[kind] += change
            if bins[kind] > 0 and kind not in kinds:
                enter(kind)
            if bins[kind] > 0 and sum(kind) < capacity:
                heapq.heappush(queue, (sum(kind), kind))
        for kind in {a, b}:
            if bins[kind] <= 0:
                del bins[kind], kinds[kind], born[kind]
                tried.pop(kind, None)
                ranked.pop(bisect_left(ranked, (sum(kind), kind)))
    return +bins


def places(bins: Counter) -> list[tuple[int, int, int, int, int]]:
    """(length, from, to, sequence, offset): the pieces of a length numbered from..to go to sequences that follow ``sequence``."""
    used: Counter = Counter()
    out, sequence = [], 0
    for kind, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in kind:
            out.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    spark = docs.sparkSession
    rows = materialize(pieces(docs, tokenizer_path, capacity, end_id).withColumn("_salt", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` lengths
    bins = local_search(best_fit(histogram, capacity), capacity)
    slots = spark.createDataFrame(places(bins), "_length long, _from long, _to long, _sequence long, offset long")
    numbered = number_within(rows, ["length"], F.col("_salt"), "_number")
    here = (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("_from")) & (F.col("_number") < F.col("_to"))
    placed = numbered.join(F.broadcast(slots), here)  # bounded by the number of lengths, not by the documents
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("_number") - F.col("_from")).alias("sequence_id"), "offset")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
