"""The near-dedup stage against brute force on five-word shingles."""

import random

import pytest

import corpus_pipeline
from pathmill.llm import nearcopies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def kept_by_brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        near = {j for x in s for j in where.get(x, ())} if s else {j for j in range(i) if not sets[j]}
        for j in near:
            if not s or len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
        for x in s:
            where.setdefault(x, []).append(i)
    return sorted({min(rows[j][0] for j in range(len(rows)) if find(j) == r) for r in {find(i) for i in range(len(rows))}})


def test_copies_at_the_limit_go(spark):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((2 * k, " ".join(words)))
        at = rng.sample(range(0, 200, 10), 4 if k % 2 else 6)  # 20 or 30 of 196 shingles differ: Jaccard 0.81, 0.73
        rows.append((2 * k + 1, " ".join("x" if i in at else w for i, w in enumerate(words))))
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert got == kept_by_brute_force(rows) and len(got) == 60


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert sorted(r["doc_id"] for r in nearcopies.keep_one(docs).collect()) == kept_by_brute_force(rows)


@pytest.mark.parametrize("chunk", [2, 7, 1024])
def test_chunks_of_a_posting_lose_no_link(spark, chunk):
    base = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(30)]
    sets = spark.createDataFrame([(i, [int(k) for k in nearcopies.band_keys(nearcopies.shingle_set(t))], t) for i, t in rows], "node long, keys array<long>, text string")
    named = nearcopies.connected_components(nearcopies.links(sets.select("node", "keys"), sets.select("node", "text"), chunk)).collect()
    assert {(r["node"], r["root"]) for r in named} == {(i, 0) for i in range(30)}


def test_fingerprints_alone_link_what_is_within_three_bits(spark):
    rng = random.Random(9)
    rows = []
    for k in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "x"]))]
    sets = {i: nearcopies.shingle_set(t) for i, t in rows}
    fps = {i: int(nearcopies.fingerprint(s)) for i, s in sets.items()}
    for i, s in sets.items():
        assert fps[i] == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s))
    within = {i for i in range(0, 40, 2) if (fps[i] ^ fps[i + 1]).bit_count() <= 3}
    assert len(within) > 10
    # No two sets share a band's key here.
    df = spark.createDataFrame([(i, [i], fps[i] - (fps[i] >> 63 << 64), t) for i, t in rows], "node long, keys array<long>, fp long, text string")
    found = nearcopies.links(nearcopies.with_simhash(df), df.select("node", "text")).collect()
    assert {(min(r), max(r)) for r in found} == {(i, i + 1) for i in within}
