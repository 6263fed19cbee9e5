"""Ordinal quality classifier: a cumulative-link regression with shared hashed-text weights and ordered thresholds.

A label's grade is 0 for low quality, 1 for toxic text of good quality and 2 for the rest. One weight vector w and two
thresholds t1 < t2 give P(grade >= k) = sigmoid(w.x - tk); the expected grade is their sum, the tail probability is
P(grade >= 2), and rows whose tail probability is at least SELECT_TAIL are selected.

Defined results: a null or empty text has no features and is never selected; labels with a null are left out, of
repeated labels the smallest counts; with no labelled row, or labels of one grade only, the grade is that one (or null)
and every text with a word is selected unless that grade is below 2; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmill.llm.common import release_memory, table
from pathmill.llm.textmodel import TRAIN_ROWS, Sample, Scorer, fitted, labelled_features, minimize, sigmoid

GRADES = 3
SELECT_TAIL = 0.5
PENALTY = 3e-6
FLOOR = 1e-12


def fit_ordinal(sample: Sample, grade: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds); the thresholds stay ordered because each gap is an exponential."""
    columns = len(sample.active)
    ends = np.zeros((sample.n, GRADES + 1))
    ends[:, 0] = 1.0
    at = np.arange(sample.n)
    g = grade.astype(int)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, first, gaps = p[:columns], p[columns], np.exp(np.clip(p[columns + 1 :], -20, 20))
        cuts = first + np.r_[0.0, np.cumsum(gaps)]
        reach = sigmoid(sample.dot(w)[:, None] - cuts)
        ends[:, 1:GRADES] = reach
        chance = np.maximum(ends[at, g] - ends[at, g + 1], FLOOR)
        slope = np.zeros((sample.n, GRADES + 1))
        slope[:, 1:GRADES] = reach * (1 - reach)
        d_z = -(slope[at, g] - slope[at, g + 1]) / chance / sample.n
        d_cut = np.zeros(GRADES + 1)
        np.add.at(d_cut, g, slope[at, g] / chance / sample.n)
        np.add.at(d_cut, g + 1, -slope[at, g + 1] / chance / sample.n)
        d_cut = d_cut[1:GRADES]
        d_gap = np.array([d_cut[k + 1 :].sum() for k in range(len(gaps))]) * gaps
        value = -np.log(chance).mean() + penalty / 2 * (w @ w)
        return value, np.concatenate([sample.back(d_z) + penalty * w, [d_cut.sum()], d_gap])

    p = minimize(loss, np.r_[np.zeros(columns), -2.0, np.zeros(GRADES - 2)], rounds=50)
    return sample.spread(p[:columns]), p[columns] + np.r_[0.0, np.cumsum(np.exp(np.clip(p[columns + 1 :], -20, 20)))]


def grades(sample: Sample) -> np.ndarray:
    return np.where(sample.y["quality"] <= 0, 0, np.where(sample.y["toxic"] > 0, 1, 2))


def fit_grades(sample: Sample) -> tuple[np.ndarray | None, np.ndarray | None, int | None]:
    """(weights, thresholds, None), or without two grades to tell apart (None, None, the only grade)."""
    grade = grades(sample)
    found = sorted(set(grade.tolist()))
    return (*fit_ordinal(sample, grade), None) if len(found) > 1 else (None, None, found[0] if found else None)


def _score_batches(model):
    weights, cuts, only = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer([weights] if weights is not None else [])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in part.column("text").to_pylist()]
                n, _, sums = scorer(words)
                if weights is not None:
                    z = sums[:, 0]
                    reach = sigmoid(z[:, None] - cuts).reshape(len(words), -1)
                    expected, tail = reach.sum(axis=1), reach[:, -1]
                else:
                    expected = np.full(len(words), np.nan if only is None else float(only))
                    tail = np.full(len(words), 1.0 if only in (None, GRADES - 1) else 0.0)
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n), pa.array(expected), pa.array(tail), pa.array((tail >= SELECT_TAIL) & (n > 0))], names=[*names, "n_words", "expected_grade", "tail_probability", "selected"])
        del scorer
        release_memory()

    return run


def grade_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, n_words, expected_grade, tail_probability, selected) for every row, fitted on at most ``rows`` labelled rows."""
    targets = ["quality", "toxic"]
    model = fitted(labelled_features(docs, labels, targets, rows), targets, fit_grades)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 weights, whatever the input
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(lambda batches: _score_batches(shared.value)(batches), f"doc_id {kind}, n_words long, expected_grade double, tail_probability double, selected boolean")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("kept", F.col("selected"))
