"""Scores against a plain BM25, and what the threshold of retrieval finds against a search without it."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pathmill.llm import decontam


def plain_segments(items):
    """[(item, {term: share of the segment's own BM25 score})]"""
    parts = []
    for k, text in items:
        words = ["".join(c for c in w.lower() if c.isalnum()) for w in text.split()]
        words = [w for w in words if w]
        pieces = math.ceil(len(words) / decontam.SEGMENT_WORDS)
        size, more = divmod(len(words), pieces)
        at = 0
        for p in range(pieces):
            end = at + size + (p < more)
            parts.append((k, words[at:end]))
            at = end
    df = Counter(t for _, words in parts for t in set(words))
    mean = sum(len(words) for _, words in parts) / len(parts)
    out = []
    for k, words in parts:
        score = {}
        for t, n in Counter(words).items():
            idf = math.log(1 + (len(parts) - df[t] + 0.5) / (df[t] + 0.5))
            score[t] = idf * n * (decontam.K1 + 1) / (n + decontam.K1 * (1 - decontam.B + decontam.B * len(words) / mean))
        out.append((k, {t: v / sum(score.values()) for t, v in score.items()}))
    return out


@pytest.mark.parametrize("pivot", [0.0, 0.3, 0.49])
def test_every_segment_over_the_threshold_is_retrieved_with_its_score(monkeypatch, pivot):
    monkeypatch.setattr(decontam, "PIVOT_SCORE", pivot)
    monkeypatch.setattr(decontam, "CELLS", 3)
    rng = random.Random(11)
    vocabulary = [f"t{int(rng.paretovariate(0.6)) % 500}" for _ in range(4000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 130)))) for k in range(80)]
    index, segments = decontam.Index(items), plain_segments(items)
    known = decontam.Numbers(index.vocabulary)
    assert len(index.posting_block) <= len(index.impacts.term)
    hits = 0
    for _ in range(150):
        words = rng.choices(vocabulary, k=rng.randint(1, 600))
        own = rng.choice(items)[1].split()
        words[20:20] = own[: rng.randint(1, len(own))]
        expected = defaultdict(float)
        for p in range(0, len(words), decontam.STRIDE):
            passage = set(words[p : p + 2 * decontam.STRIDE])
            for k, share in segments:
                score = sum(v for t, v in share.items() if t in passage)
                if score >= decontam.MIN_SCORE + 1e-3:
                    expected[k] = max(expected[k], score)
        got = index.retrieve(np.array([known[w] for w in words]))
        assert set(expected) <= set(got) and all(abs(got[k] - v) < 1e-3 for k, v in expected.items())
        assert all(v >= decontam.MIN_SCORE - 1e-3 for v in got.values())
        hits += len(expected)
    assert hits > 100


def test_threshold_loses_no_leak_of_the_table(spark):
    folder = "/root/testdata/sf0.1"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()}
    where, parts = defaultdict(set), {}
    for r in items.collect():
        question, answer = decontam.question_and_answer(r.text)
        parts[r.item_id] = (question, answer, question + answer)
        for part, words in enumerate(parts[r.item_id]):
            n = min(5, max(1, len(words)))
            for i in range(len(words) - n + 1):
                where[tuple(words[i : i + n])].add((r.item_id, part))
    widths = {len(s) for s in where}
    total = Counter(key for keys in where.values() for key in keys)
    expected = set()
    for r in docs.select("doc_id", "text").toLocalIterator():
        words = decontam.terms(r.text)
        found = Counter(key for n in widths for s in {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} for key in where.get(s, ()))
        for item in {item for item, _ in found}:
            share = [found[item, part] / total[item, part] if parts[item][part] else 1.0 for part in range(3)]
            if share[2] >= decontam.MIN_OVERLAP or (share[0] >= decontam.MIN_OVERLAP and share[1] >= decontam.MIN_OVERLAP):
                expected.add((r.doc_id, item))
    assert len(expected) > 50 and got == expected
