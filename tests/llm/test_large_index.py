"""The index of the test items grows with their words, and parts give what one index gives."""

import pickle
import random

from pathmill.llm import decontam


def test_index_is_bounded_by_its_words(monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(f"t{rng.randrange(30_000)}" for _ in range(90)) + ". answer here") for i in range(6000)]
    index = decontam.Index(items)  # 3 MB of items; dense impacts would take 1.4 GB
    words = sum(len(t.split()) + 4 for _, t in items)
    assert len(pickle.dumps(index)) < decontam.WORD_BYTES * words + sum(len(t) for _, t in items)
    known = decontam.Numbers(index.vocabulary)
    filler = " ".join(f"t{rng.randrange(30_000)}" for _ in range(20_000))
    for k in (0, 2999, 5999):
        assert [r[0] for r in index.search(f"{filler} {items[k][1]} {filler}", known)] == [k]


def test_parts_find_all(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"t{rng.randrange(3000)}" for _ in range(60)) for _ in range(40)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"some {t} more" if i % 2 else "clean text") for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(decontam, "INDEX_BYTES", 10 * 160 * 70)
    assert len(list(decontam.indexes(items))) > 3
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()) == [(i, i) for i in range(1, 40, 2)]
    assert sorted(r["doc_id"] for r in decontam.drop_leaks(docs, items).collect()) == list(range(0, 40, 2))
