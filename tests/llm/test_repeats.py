"""Repeated bytes against brute force on whole tables, with names that are split, small shards and many copies."""

import random

import numpy as np
import pytest

from pathmill.llm import exactsubstr
from test_against_brute_force import brute_repeats


def same_as_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:5] for r in exactsubstr.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_whole_table(spark, folder):
    same_as_brute_force(spark, [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()])


@pytest.mark.parametrize("shard_bytes", [1, 2000, 1 << 20])
def test_one_passage_in_many_surroundings(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(exactsubstr, "SHARD_BYTES", shard_bytes)
    random.seed(shard_bytes)

    def noise(n):
        return "".join(random.choices("abcdefghij ", k=n))

    passages = [noise(k) for k in (60, 150, 199, 200, 201, 420)]
    texts = [noise(random.randint(0, 300)) + random.choice(passages) + noise(random.randint(0, 300)) for _ in range(120)]
    texts += [passages[3][k : k + 190] + noise(120) for k in range(0, 10)] + texts[:20] + [texts[0]] * 30 + [passages[5], "z" * 900]
    same_as_brute_force(spark, texts)


def test_chunk_edges(spark, monkeypatch):
    monkeypatch.setattr(exactsubstr, "CHUNK", 300)
    random.seed(5)
    base = "".join(random.choices("abcd", k=1500))
    same_as_brute_force(spark, [base, base[:700] + "x" + base[700:], base[333:], "q" * 5 + base[40:650]])


def test_halves_hold_all_windows_until_one_is_left():
    for gram, windows in ((168, 169), (168, 3), (0, 1), (90, 40), (90, 91)):
        todo, seen, rounds = [(0, windows, 0, 0)], [], 0
        while todo:
            rounds += 1
            done = [p for p in todo if p[1] == 1 and p[2] + p[3] == exactsubstr.WIDTH - exactsubstr.GRAM]
            seen += [p[0] for p in done]
            todo = [h for p in todo if p not in done for h in exactsubstr.halves(gram, *p)]
            for base, n, left, right in todo:
                places = gram - np.arange(base, base + n)
                assert (places >= left).all() and (exactsubstr.WIDTH - exactsubstr.GRAM - places >= right).all()
        assert sorted(seen) == list(range(windows)) and rounds < 12
