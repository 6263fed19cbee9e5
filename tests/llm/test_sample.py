"""The sample of the classifiers: what it keeps, and its products."""

import numpy as np

from pathmill.llm import textmodel


def sampled(docs, labels, rows=textmodel.TRAIN_ROWS):
    features = textmodel.labelled_features(docs, labels, ["quality", "toxic"], rows).orderBy("at")
    return textmodel.Sample(features.toArrow().to_batches(), ["quality", "toxic"])


def test_sample_keeps_terms_of_four_rows_and_multiplies_them(spark):
    texts = [f"common words stand here {'rareword' if i < 4 else ''} {'scarce' if i < 3 else ''} n{i}" for i in range(6100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6100)], "doc_id long, quality int, toxic int")
    sample = sampled(docs.where("doc_id < 600"), labels.where("doc_id < 600"))
    column = {w: int(textmodel.word_columns([w.encode()])[1][0]) for w in ("rareword", "scarce")}
    assert column["rareword"] in sample.active and column["scarce"] not in sample.active
    order = [r[0] for r in labels.where("doc_id < 600").selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").collect()]
    x = np.zeros((600, textmodel.COLUMNS), np.float32)
    for k, i in enumerate(order):
        cols, values = textmodel.text_columns(texts[i])
        x[k, cols] = values
    x = x[:, sample.active].astype(float)
    rng = np.random.default_rng(0)
    w, g = rng.normal(size=len(sample.active)), rng.normal(size=600)
    assert np.allclose(sample.dot(w), x @ w, atol=1e-4) and np.allclose(sample.back(g), x.T @ g, atol=1e-4)
    assert sample.y["quality"].tolist() == [i % 2 for i in order]
    assert sampled(docs, labels).n == 6000


def test_repeated_rows_of_a_labelled_id_count_once(spark):
    docs = spark.range(50_000).selectExpr("id % 3 AS doc_id", "concat('some text of ', id % 5) AS text")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    assert sampled(docs, labels).n == 3
    assert sampled(docs, labels, 2).n == 2


def test_sample_stops_at_its_features(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 3) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    whole = sampled(docs, labels)
    monkeypatch.setattr(textmodel, "TRAIN_FEATURES", 100)
    cut = sampled(docs, labels)
    assert whole.n == 40 and 1 < cut.n < 40 and cut.order.tolist() == whole.order[: cut.n].tolist()
