"""Copies of a page do not make its lines boilerplate."""

import corpus_pipeline


def test_a_group_of_copies_keeps_its_text(spark):
    rows = [("big.org", f"menu\nown {i}") for i in range(100)] + [("big.org", "menu\nfirst\nsecond")] * 100 + [("small.org", f"page {i % 2}\nend") for i in range(12)] + [(None, "same\ntext")] * 9
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert [got[i] for i in range(len(rows))] == [t.removeprefix("menu\n") for _, t in rows]
