"""Quality rules: base rules on counts, then hashed n-gram logistic regressions with calibrated probabilities.

Two heads are fitted on labelled rows, one for good quality and one for toxic text; each is calibrated on rows that its
fit has not seen (a logistic curve over the sum). A row is kept if it passes the base rules, its quality is at least
KEEP_QUALITY and its toxicity is under DROP_TOXIC. Rows are scored in Arrow batches, whole texts at a time.

Defined results: a null or empty text has no words, so the base rules reject it; labels with a null are left out, of
repeated labels the smallest counts; without labelled rows of both kinds a head says nothing and the base rules decide;
repeated rows are judged alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmill.llm.common import release_memory, table
from pathmill.llm.textmodel import TRAIN_ROWS, Sample, Scorer, fitted, labelled_features, minimize, sigmoid

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
KEEP_QUALITY, DROP_TOXIC = 0.5, 0.2
PENALTY = 3e-6
#: Every so many-th row of the sample is held out for calibration.
HELD_OUT = 5


class Head:
    """One calibrated logistic regression; ``weights`` is None where there was nothing to learn."""

    def __init__(self, weights: np.ndarray | None, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.slope, self.shift = weights, slope, shift

    def probability(self, z: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * np.asarray(z) + self.shift)


def fit_head(sample: Sample, y: np.ndarray, penalty: float = PENALTY) -> Head:
    if sample.n < 2 or y.min(initial=1) == y.max(initial=0):
        return Head(None)
    held = np.arange(sample.n) % HELD_OUT == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(sample.n, bool)
    use = (~held).astype(float)
    n = use.sum()

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = sample.dot(p[:-1]) + p[-1]
        g = use * (sigmoid(z) - y) / n
        value = (use * (np.logaddexp(0, z) - y * z)).sum() / n + penalty / 2 * (p[:-1] @ p[:-1])
        return value, np.r_[sample.back(g) + penalty * p[:-1], g.sum()]

    p = minimize(loss, np.zeros(len(sample.active) + 1))
    z = sample.dot(p[:-1]) + p[-1]
    seen = held if held.any() else ~held
    slope, shift = calibrate(z[seen], y[seen])
    return Head(sample.spread(p[:-1]), slope, slope * p[-1] + shift)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over ``z``, with targets drawn in from 0 and 1, by Newton steps."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        a, b = max(0.05, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def base_counts(text: str | None) -> tuple[int, int, int]:
    """(word_chars, n_symbols, n_dup_lines) of a text."""
    if not text:
        return 0, 0, 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


def _score_batches(heads: list[Head]):
    live = [h for h in heads if h.weights is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer([h.weights for h in live])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                n, repeats, sums = scorer([t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts])
                counts = np.column_stack([n, np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 3), repeats])
                chance = iter(h.probability(z) for h, z in zip(live, sums.T, strict=True))
                by_head = [next(chance) if h.weights is not None else None for h in heads]
                rest = [part.column(c) for c in part.schema.names if c != "text"]
                arrays = [*rest, *(pa.array(counts[:, i]) for i in range(5)), *(pa.array(np.full(part.num_rows, np.nan) if p is None else p) for p in by_head)]
                yield pa.RecordBatch.from_arrays(arrays, names=[c for c in part.schema.names if c != "text"] + ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "p_quality", "p_toxic"])
        del scorer
        release_memory()

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[Head]:
    """The quality head and the toxic head, from at most ``rows`` labelled rows."""
    targets = ["quality", "toxic"]
    return fitted(labelled_features(docs, labels, targets, rows), targets, lambda sample: [fit_head(sample, (sample.y[t] > 0).astype(float)) for t in targets])


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", fitted_on: DataFrame | None = None) -> DataFrame:
    """(id, counts, p_quality, p_toxic, base_failed, kept) for every row of ``docs``; the heads may be fitted on other documents."""
    heads = train(docs if fitted_on is None else fitted_on, labels)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("_id"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(heads)  # 2 x 2^18 weights, whatever the input
    scored = rows.mapInArrow(lambda batches: _score_batches(shared.value)(batches), f"_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, p_quality double, p_toxic double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = (F.isnan("p_quality") | (F.col("p_quality") >= KEEP_QUALITY)) & (F.isnan("p_toxic") | (F.col("p_toxic") < DROP_TOXIC))
    out = scored.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
    return out.withColumnRenamed("_id", id_column)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = shared.value
        live = [(h, good) for h, good in zip(heads, (lambda p: p >= KEEP_QUALITY, lambda p: p < DROP_TOXIC), strict=True) if h.weights is not None]
        scorer = Scorer([h.weights for h, _ in live])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, repeats, sums = scorer([t.encode("utf-8", "surrogatepass").split() if t else [] for t in part.column("text").to_pylist()])
                kept = (n >= MIN_WORDS) & (100 * repeats <= MAX_REPEAT_PERCENT * n)
                for (head, good), z in zip(live, sums.T, strict=True):
                    kept &= good(head.probability(z))
                yield part.filter(pa.array(kept))
        del scorer
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality", "p_toxic")
