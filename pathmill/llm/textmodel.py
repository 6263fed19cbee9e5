"""Hashed text features and the fits that the two classifiers share.

A text is the set of its lower-cased words, its word pairs, and the 3- to 5-character n-grams of its distinct words (a
n-gram counts for each distinct word that holds it), hashed to 2^18 columns. Fits run on a bounded sample of the
labelled rows, drawn by a hash of doc_id, inside a task; the driver gets the weights only. Scoring reads every row in
Arrow batches.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmill.llm.common import materialize, release_memory, shuffle_partitions
from pathmill.llm.simhash import LOWER

COLUMNS = 1 << 18
#: The fit takes at most this many labelled rows.
TRAIN_ROWS = 6000
#: Of those, it takes rows until they have this many features (six bytes each), which bounds the task's memory.
TRAIN_FEATURES = 1 << 25
#: Columns that fewer rows of the sample have get no weight.
MIN_ROWS = 4
#: Distinct words that a Python worker remembers; it starts afresh beyond them.
KNOWN_WORDS = 100_000
PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Values of a word's own column, of each of its n-grams and of a word pair.
WORD, GRAM, TWO = 3.0, 0.5, 0.5
#: All values are multiples of it.
UNIT = 0.5
#: Rows of the sample that are multiplied at a time.
BLOCK_ROWS = 256


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * PAIR
    h ^= h >> np.uint64(31)
    return h * PAIR


def column(h: np.ndarray) -> np.ndarray:
    return (mixed(h) >> np.uint64(40)).astype(np.int64) % COLUMNS


def word_columns(low: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased words: their hashes and columns, and the owners and columns of their 3- to 5-character n-grams between marks."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, low), np.uint64, len(low))
    text = b"<" + b">\0<".join(w.replace(b"\0", b"\1") for w in low) + b">"
    code = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.cumsum(code == 0)
    owners, columns = [], []
    gram = code
    for k in range(2, 6):
        gram = mixed(gram[:-1]) ^ code[k - 1 :]
        if k > 2:
            inside = (owner[: len(gram)] == owner[k - 1 :]) & (code[: len(gram)] > 0)
            owners.append(owner[: len(gram)][inside])
            columns.append(column(gram[inside]))
    return hashes, column(hashes), np.concatenate(owners), np.concatenate(columns)


class Words(dict):
    """word -> number. For each number: the number of the lower-cased word, its hash, and its score for each head."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights
        self.low, self.hashes = np.zeros(1024, np.int64), np.zeros(1024, np.uint64)
        self.scores = np.zeros((len(weights), 1024))

    def learn(self, words: set[bytes]) -> None:
        """Numbers the words that are new."""
        new = words - self.keys()
        low = list({w.translate(LOWER) for w in new} - self.keys())
        first = len(self)
        self.update(zip(low, range(first, first + len(low)), strict=True))
        rest = list(new - self.keys())
        self.update(zip(rest, range(first + len(low), first + len(low) + len(rest)), strict=True))
        while len(self) > len(self.low):
            self.low, self.hashes = np.r_[self.low, self.low], np.r_[self.hashes, self.hashes]
            self.scores = np.concatenate([self.scores, self.scores], axis=1)
        mid = first + len(low)
        self.low[first:mid] = np.arange(first, mid)
        self.low[mid : len(self)] = [self[w.translate(LOWER)] for w in rest]
        if low:
            self.hashes[first:mid], own, owner, gram = word_columns(low)
            for k, w in enumerate(self.weights):
                self.scores[k, first:mid] = WORD * w[own] + GRAM * np.bincount(owner, weights=w[gram], minlength=len(low))


def pair_columns(hashes: np.ndarray) -> np.ndarray:
    """The column of each pair of neighbouring words, from the words' hashes."""
    return column(mixed(hashes[:-1]) ^ hashes[1:])


def text_columns(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a text."""
    words = [w.translate(LOWER) for w in text.encode("utf-8", "surrogatepass").split()] if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    low = list(set(words))
    hashes, own, _, gram = word_columns(low)
    number = dict(zip(low, range(len(low)), strict=True))
    two = np.unique(pair_columns(hashes[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]))
    cols = np.concatenate([own, gram, two])
    values = np.repeat([WORD, GRAM, TWO], [len(own), len(gram), len(two)])
    cols, at = np.unique(cols, return_inverse=True)
    return cols, np.bincount(at, weights=values) * scale(len(words))


def scale(n_words: int | np.ndarray) -> np.ndarray:
    """Longer texts hold more of everything; their sums are damped."""
    return 1.0 / np.sqrt(8.0 + np.asarray(n_words, float))


class Scorer:
    """Sums of weights over whole texts, many texts at a time, with one remembered score a distinct word."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = [w.astype(np.float32) for w in weights]
        self.words = Words(self.weights)

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n_words, words in windows that repeat, damped sums for each head) of texts given as words."""
        if len(self.words) > KNOWN_WORDS:
            self.words = Words(self.weights)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        sums = np.zeros((len(texts), len(self.weights)))
        if not n.sum():
            return n, np.zeros(len(texts), np.int64), sums
        known = self.words
        known.learn(set(chain.from_iterable(texts)))
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, int(n.sum()))
        doc = np.repeat(np.arange(len(texts)), n)
        low = known.low[at]
        if self.weights:
            key = np.unique(doc << 32 | low)
            d, w = key >> 32, key & 0xFFFFFFFF
            two = pair_columns(known.hashes[low])
            pair = np.unique((doc[1:] << 32 | two)[doc[1:] == doc[:-1]])
            pd, pc = pair >> 32, pair & 0xFFFFFFFF
            for k, head in enumerate(self.weights):
                sums[:, k] = np.bincount(d, weights=known.scores[k, w], minlength=len(texts)) + TWO * np.bincount(pd, weights=head[pc], minlength=len(texts))
            sums *= scale(n)[:, None]
        return n, repeated_words(at, doc, len(texts)), sums


def repeated_words(at: np.ndarray, doc: np.ndarray, texts: int, window: int = 5) -> np.ndarray:
    """Per text, the words inside windows of five words that occur at least twice in it; ``at`` numbers the words."""
    n = len(at) - window + 1
    if n < 2:
        return np.zeros(texts, np.int64)
    name = (doc[:n].astype(np.uint64) + np.uint64(1)) * PAIR
    name ^= name >> np.uint64(31)
    for k in range(window):
        name = (name ^ at[k : k + n].astype(np.uint64)) * PAIR
        name ^= name >> np.uint64(32)
    inside = doc[:n] == doc[window - 1 :]
    ordered = np.sort(name[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(texts, np.int64)
    place = np.minimum(np.searchsorted(twice, name), len(twice) - 1)
    hit = np.flatnonzero((twice[place] == name) & inside)
    marks = np.bincount(hit, minlength=len(at) + 1) - np.bincount(hit + window, minlength=len(at) + 1)
    return np.bincount(doc[np.cumsum(marks[: len(at)]) > 0], minlength=texts)


def _column_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as bytes: columns as 32-bit integers, values as 16-bit multiples of UNIT, and their scale."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = part.column("text").to_pylist()
            found = [text_columns(text) for text in texts]
            n_words = [len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in texts]
            # Sums beyond 16 bits, of texts with very many words of one n-gram, are held in coarser steps.
            scales = [UNIT * float(scale(n)) for n in n_words]
            scales = [s * max(1.0, v.max(initial=0.0) / s / 65535) for (_, v), s in zip(found, scales, strict=True)]
            cols = [c.astype("<u4").tobytes() for c, _ in found]
            counts = [np.rint(v / s).astype("<u2").tobytes() for (_, v), s in zip(found, scales, strict=True)]
            names = [c for c in part.schema.names if c != "text"]
            arrays = [*(part.column(c) for c in names), pa.array(cols, pa.binary()), pa.array(counts, pa.binary()), pa.array(scales, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "cols", "counts", "scale"])


def labelled_features(docs: DataFrame, labels: DataFrame, targets: list[str], rows: int = TRAIN_ROWS) -> DataFrame:
    """(at, targets, cols, counts, scale) of at most ``rows`` labelled documents, the first by a hash of their id.

    An id with several texts counts once, with the text of the smallest hash, so that repeated rows do not lift the bound.
    """
    drawn = labels.where(" AND ".join(f"{t} IS NOT NULL" for t in ["doc_id", *targets])).groupBy("doc_id").agg(*[F.min(t).cast("double").alias(t) for t in targets])
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # a bounded sample, so that it may be broadcast
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(drawn), F.col("_id") == F.col("doc_id")).groupBy("doc_id", *targets).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    spread = joined.repartition(shuffle_partitions(docs.sparkSession), "doc_id").select(F.xxhash64("doc_id").alias("at"), *targets, "text")
    kinds = ", ".join(["at long", *(f"{t} double" for t in targets), "cols binary, counts binary, scale double"])
    return materialize(spread.mapInArrow(_column_batches, kinds))


def fitted(features: DataFrame, targets: list[str], fit: Callable[[Sample], object]) -> object:
    """What ``fit`` makes of the sample, in one task: the driver gets the model only, and a lost executor costs one retry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sample(batches, targets)
        release_memory()
        model = pickle.dumps(fit(sample))
        del sample
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    conf, size = features.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = conf.get(size)
    conf.set(size, str(BLOCK_ROWS))  # rows of features are long; the JVM shall not hold all of them in one batch
    try:
        found = features.coalesce(1).mapInArrow(run, "model binary").collect()
    finally:
        conf.set(size, held)
    return pickle.loads(bytes(found[0]["model"])) if found else fit(Sample(iter(()), targets))


class Sample:
    """Rows of the bounded sample, with their targets.

    Features are held as 32-bit columns and 16-bit counts, six bytes each, in the order of the hash of the id; products go
    through them BLOCK_ROWS rows at a time, so that no array of the sample's size is made beside them. Rows after the one
    that brings TRAIN_FEATURES features are left out.
    """

    def __init__(self, batches: Iterable[pa.RecordBatch], targets: list[str]):
        rows: list[tuple] = []  # a heap, the last row of the order first
        features, arrival = 0, count()
        for batch in batches:
            cols, counts = batch.column("cols"), batch.column("counts")
            rest = zip(*(batch.column(c).to_pylist() for c in ("at", "scale", *targets)), strict=True)
            for i, (at, scale, *y) in enumerate(rest):
                own = np.frombuffer(cols[i].as_buffer(), "<u4").copy()  # so that the batch can go
                heapq.heappush(rows, (-at, next(arrival), own, np.frombuffer(counts[i].as_buffer(), "<u2").copy(), scale, y))
                features += len(own)
                while features - len(rows[0][2]) >= TRAIN_FEATURES:
                    features -= len(heapq.heappop(rows)[2])
        rows.sort(key=lambda r: -r[0])
        order, scales, y = [-r[0] for r in rows], [r[4] for r in rows], {t: [r[5][k] for r in rows] for k, t in enumerate(targets)}
        held = [(r[2], r[3]) for r in rows]
        rows_of = np.zeros(COLUMNS, np.int32)
        for cols, _ in held:
            rows_of[cols] += 1
        self.n = len(held)
        self.order = np.array(order, np.int64)
        self.y = {t: np.array(v, float) for t, v in y.items()}
        self.scale = np.array(scales, float)
        often = rows_of >= MIN_ROWS
        self.active = np.flatnonzero(often)
        number = (np.cumsum(often) - 1).astype(np.int32)
        total = int(rows_of[often].sum(dtype=np.int64))
        self.cols, self.counts = np.zeros(total, np.int32), np.zeros(total, np.uint16)
        self.start = np.zeros(self.n + 1, np.int64)
        for i, (cols, counts) in enumerate(held):
            kept = often[cols]
            at = self.start[i]
            end = self.start[i + 1] = at + np.count_nonzero(kept)
            self.cols[at:end], self.counts[at:end] = number[cols[kept]], counts[kept]

    def _blocks(self) -> Iterator[tuple[int, int, slice, np.ndarray]]:
        """(first row, last row, their features, the row of each within the block)."""
        for a in range(0, self.n, BLOCK_ROWS):
            b = min(a + BLOCK_ROWS, self.n)
            yield a, b, slice(self.start[a], self.start[b]), np.repeat(np.arange(b - a), np.diff(self.start[a : b + 1]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for a, b, part, row in self._blocks():
            out[a:b] = np.bincount(row, weights=w[self.cols[part]] * self.counts[part], minlength=b - a)
        return out * self.scale

    def back(self, g: np.ndarray) -> np.ndarray:
        out, g = np.zeros(len(self.active)), g * self.scale
        for a, b, part, row in self._blocks():
            out += np.bincount(self.cols[part], weights=g[a:b][row] * self.counts[part], minlength=len(self.active))
        return out

    def spread(self, w: np.ndarray) -> np.ndarray:
        """Weights of the active columns as weights of all columns."""
        out = np.zeros(COLUMNS, np.float32)
        out[self.active] = w
        return out


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 40, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(a := rho * (s @ q))
            q -= a * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y, rho), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - rho * (y @ q))
        step, slope = 1.0, g @ q
        if slope <= 1e-12:
            break
        while True:
            new = x - step * q
            value2, g2 = f(new)
            if value2 <= value - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = new - x, g2 - g
        if (sy := s @ y) > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / sy)]
        done = abs(value - value2) < 1e-7 * max(1.0, abs(value))
        x, value, g = new, value2, g2
        if done:
            break
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
