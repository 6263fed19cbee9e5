"""Each operator against a plain computation of the same result on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathmill.llm import decontam, exactsubstr, fixity, linededup, ordinal, packing, rules, sharding, simhash, suffixes, textmodel, urlfilter
from pathmill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").toPandas()


# op2


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash(spark, folder, documents):
    got = {r["doc_id"]: r for r in QUERIES["op2_simhash"](spark, folder).collect()}
    order = documents.sort_values("doc_id")
    ids, fps = order.doc_id.tolist(), [brute_fingerprint(t) for t in order.text]
    assert [got[i]["fingerprint"] for i in ids] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in ids] == [ids[k] for k in brute_components(fps)]


@pytest.mark.parametrize("posting_rows", [2048, 8, 1])
def test_links_keep_every_component(spark, posting_rows):
    random.seed(posting_rows)
    values = set()
    for _ in range(12):
        v = random.getrandbits(64)
        for _ in range(12):
            values.add(v)
            v ^= sum(1 << random.randrange(64) for _ in range(random.randint(1, 4))) & (2**64 - 1)
    values = sorted(np.array(sorted(values), np.uint64).view(np.int64).tolist())
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = [tuple(r) for r in simhash.links(fps, posting_rows).collect()]
    assert all((a ^ b) & (2**64 - 1) and ((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in edges)
    named = {r["node"]: r["root"] for r in simhash.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [named.get(v, v) for v in values] == [values[k] for k in brute_components([v & (2**64 - 1) for v in values])]


@pytest.mark.parametrize("width", [3, 4, 5])
def test_position_sets_cover_every_five(width):
    from itertools import combinations

    sets = [set(s) for s in simhash.position_sets(width)]
    assert all(len(s) == width for s in sets) and all(any(s <= set(five) for s in sets) for five in combinations(range(8), 5))


# op3


def test_merkle_audit_finds_what_was_damaged(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    records = fixity.to_records(pages, file_pages=20).cache()
    rows = records.orderBy("file", "offset").collect()
    broken, gone = {3, 17, 40}, {29}
    other = [(r["file"], r["offset"], r["length"], r["page_id"], "0" * 64 if i in broken else r["sha256"]) for i, r in enumerate(rows) if i not in gone]
    replica = spark.createDataFrame(other, "file string, offset long, length long, page_id long, sha256 string")
    for size, fanout in ((4096, 2), (1 << 16, 16), (10**9, 16)):
        roots, damage = fixity.audit(records, replica, size, fanout)
        found = {(r["file"], r["offset"], r["status"]) for r in damage.collect()}
        assert found == {(rows[i]["file"], rows[i]["offset"], "corrupt" if i in broken else "missing") for i in broken | gone}
        assert {r["file"] for r in roots.where("root <> replica_root").collect()} == {rows[i]["file"] for i in broken | gone}


def test_warc_round_trip(spark, tmp_path, folder):
    import gzip

    pages = spark.read.parquet(f"{folder}/pages.parquet").limit(5)
    texts = [r[0].encode() for r in pages.select(fixity.record_text(*[pages[c] for c in ("page_id", "url", "html")])).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(texts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, texts)))
    got = fixity.read_warc(spark, str(tmp_path)).orderBy("file", "offset").collect()
    assert [r["sha256"] for r in got] == 2 * [hashlib.sha256(t).hexdigest() for t in texts]
    assert [bytes(r["payload"]).decode() for r in got[:5]] == [r["html"] for r in pages.collect()]


# op4


def brute_repeats(texts, width=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out


def test_repeated_bytes(spark, documents):
    random.seed(3)
    texts = documents.text.tolist()[:60]
    base = "".join(random.choices("abcdefgh é\n", k=900))
    texts += [base, base[100:600] + "x" * 30 + base[100:400], "ab" * 400, "y" * 199, "y" * 200, "q" * 201, base[:199] + "!" + base[200:], None, "", base + base]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:5] for r in exactsubstr.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_arrays(s):
    s = np.array([*s, 0])
    expected = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    small = suffixes.SMALL
    try:
        for suffixes.SMALL in (512, 0):
            assert suffixes.suffix_array(s, 4).tolist() == expected
    finally:
        suffixes.SMALL = small


# op5


def test_line_dedup(spark):
    pages = [("a", f"menu\nown {i}\nmenu\n\nshared") for i in range(10)] + [("b", f"menu\nb {i}") for i in range(3)] + [(None, "menu\nx"), ("a", None)]
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(pages)], "doc_id long, source string, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.drop_boilerplate(docs, 0.5, 4).collect()}
    assert [got[i] for i in range(15)] == [f"own {i}\n" for i in range(10)] + [t for _, t in pages[10:]]
    held = linededup.BROADCAST_BYTES
    try:
        linededup.BROADCAST_BYTES = 0  # the way without a broadcast
        again = {r["doc_id"]: r["text"] for r in linededup.drop_boilerplate(docs, 0.5, 4).collect()}
    finally:
        linededup.BROADCAST_BYTES = held
    assert again == got


# op6


def test_packing(spark, folder, documents):
    got = QUERIES["op6_best_fit_packing"](spark, folder).toPandas()
    ids_of = Tokenizer.from_file(packing.vocabulary_path())
    by_doc = {k: g.sort_values("piece") for k, g in got.groupby("doc_id")}
    total = 0
    for doc_id, text in zip(documents.doc_id, documents.text, strict=True):
        ids = np.array([*ids_of.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        at = 0
        for k, p in enumerate(by_doc[doc_id].itertuples()):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(ids[at : at + p.length].tobytes()))
            assert p.length <= 1024 and (k == 0 or p.length == 1024)
            at += p.length
        assert at == len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-total // 1024) * 1.02 + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_local_search_keeps_pieces_and_never_adds_bins(lengths):
    first = packing.best_fit(lengths, 64)
    after = packing.local_search(first, 64)
    held = Counter()
    for kind, n in after.items():
        assert sum(kind) <= 64
        for v in kind:
            held[v] += n
    assert held == Counter(lengths) and sum(after.values()) <= sum(first.values())
    squares = [sum(sum(k) ** 2 * n for k, n in bins.items()) for bins in (first, after)]
    assert squares[1] >= squares[0]


def test_local_search_empties_bins():
    bins = Counter({(6, 2): 1, (5, 3): 1, (2, 2): 1})
    assert sum(packing.local_search(bins, 10).values()) == 2
    assert sum(packing.local_search(Counter({(7,): 2, (6, 3): 1, (4, 3): 1}), 10).values()) <= 4


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'sL\n\t\u00a0\u0085\x1c\u2003é漢😀0½,<|endoftext|>"), max_size=30))
def test_ids_are_those_of_the_vocabulary_file(text):
    path = packing.vocabulary_path()
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


# op1 and op7


def test_base_counts(spark, folder, documents):
    got = {r["doc_id"]: r for r in QUERIES["op7_quality_rules"](spark, folder).collect()}
    for doc_id, text in zip(documents.doc_id, documents.text, strict=True):
        words = __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
        expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(words) < 10 or 100 * len(inside) > 20 * len(words)) and not (r["base_failed"] and r["kept"])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known, unseen = labels.where("pmod(xxhash64(doc_id, 5), 4) > 0"), labels.where("pmod(xxhash64(doc_id, 5), 4) = 0")
    rest = docs.join(unseen.select("doc_id"), "doc_id", "left_semi")
    judged = rules.judge(rest, known, fitted_on=docs).join(unseen, "doc_id").where("not base_failed").toPandas()
    toxic, clean, poor = judged[judged.toxic == 1], judged[(judged.toxic == 0) & (judged.quality == 1)], judged[judged.quality == 0]
    assert toxic.kept.mean() < 0.15 and clean.kept.mean() > 0.97 and poor.kept.mean() < 0.1
    weights, cuts, _ = textmodel.fitted(textmodel.labelled_features(docs, known, ["quality", "toxic"], 1500), ["quality", "toxic"], ordinal.fit_grades)
    assert cuts[0] < cuts[1] and weights.shape == (textmodel.COLUMNS,)


def test_gradients():
    rng = np.random.default_rng(0)

    class Small:
        n, active = 40, np.arange(6)
        x, y = rng.normal(size=(40, 6)), {}

        def dot(self, w):
            return self.x @ w

        def back(self, g):
            return self.x.T @ g

        def spread(self, w):
            return w

    grade = rng.integers(0, 3, 40)
    losses = []
    held = ordinal.minimize
    try:
        ordinal.minimize = lambda f, x, **k: losses.append(f) or x
        ordinal.fit_ordinal(Small(), grade)
    finally:
        ordinal.minimize = held
    p = rng.normal(size=8) * 0.3
    _, g = losses[0](p)
    numeric = [(losses[0](p + 1e-6 * e)[0] - losses[0](p - 1e-6 * e)[0]) / 2e-6 for e in np.eye(8)]
    assert np.allclose(g, numeric, atol=1e-5)


# op8


def test_leaks(spark, folder, documents):
    items = spark.read.parquet(f"{folder}/benchmark.parquet").toPandas()
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_bm25_decontamination"](spark, folder).collect()}

    def shingles(terms):
        return {tuple(terms[i : i + min(5, len(terms))]) for i in range(len(terms) - min(5, len(terms)) + 1)}

    expected = set()
    for item_id, text in zip(items.item_id, items.text, strict=True):
        q, a = decontam.question_and_answer(text)
        for doc_id, body in zip(documents.doc_id, documents.text, strict=True):
            terms = decontam.terms(body)
            have = {n: {tuple(terms[i : i + n]) for i in range(len(terms) - n + 1)} for n in {min(5, len(x)) for x in (q, a, q + a) if x}}
            share = [len(s & have[min(5, len(x))]) / len(s) if (s := shingles(x)) and x else 1.0 for x in (q, a, q + a)]
            if share[2] >= 0.8 or (share[0] >= 0.8 and share[1] >= 0.8):
                expected.add((doc_id, item_id))
    assert got == expected


def test_block_bounds_lose_no_passage():
    rng = random.Random(1)
    vocabulary = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 70)))) for i in range(60)]
    index = decontam.Index(items)
    numbers = decontam.Numbers(index.vocabulary)
    for _ in range(200):
        words = rng.choices(vocabulary, k=rng.randint(1, 300))
        item = rng.choice(items)[1].split()
        words[10:10] = item[: rng.randint(1, len(item))]
        at = np.array([numbers[w] for w in words])
        exact = defaultdict(float)
        for p in range(len(at) // decontam.STRIDE + 1):
            t = np.unique(at[p * decontam.STRIDE : (p + 2) * decontam.STRIDE])
            scores = index.impacts[:, t[t >= 0]].sum(axis=1).reshape(-1)
            for s in np.flatnonzero(scores[: len(index.of_segment)] >= decontam.MIN_SCORE):
                k = int(index.of_segment[s])
                exact[k] = max(exact[k], float(scores[s]))
        got = index.retrieve(at)
        assert set(exact) <= set(got) and all(abs(got[k] - v) < 1e-4 for k, v in exact.items())


# op9


def test_bad_branch_is_rejected_and_rules_win(spark):
    rows = [(i, f"http://site.net/{'shop' if i % 2 else 'news'}/{i}") for i in range(200)]
    rows += [(1000 + i, f"https://X.Example.ORG/{'en' if i % 2 else 'es'}/{i}?a#b") for i in range(40)] + [(2000, "http://org/a"), (2001, "http://notorg/a"), (2002, "http://a.com"), (2003, "http://a.com/de/x://y")]
    labels = [(i, int(i % 2 == 0), 0) for i in range(0, 200) if i % 3 == 0]
    got = {r["page_id"]: r for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert {got[i]["verdict"] for i in range(1, 200, 2)} == {"block"} and {got[i]["verdict"] for i in range(0, 200, 2)} == {"allow"}
    assert {got[i]["template"] for i in range(0, 200, 2)} == {"/=news/*"}
    assert got[1001]["rule"] == "example.org/en/1" if got[1001]["path"].startswith("/en/1") else True
    assert got[1000]["host"] == "x.example.org" and got[1000]["path"] == "/es/0" and got[1000]["rule"] == "example.org/es/"
    assert got[2000]["rule"] == "org/" and got[2001]["rule"] is None and got[2002]["path"] == "" and got[2003]["rule"] == "com/de/"


def test_merged_branches(spark):
    rows = [(i, f"http://h.net/{'abcd'[i % 4]}/{i}") for i in range(400)]
    labels = [(i, 0 if i % 4 == 0 and i % 8 == 0 else 1, 0) for i in range(400)]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r["template"] for r in got.select("template").distinct().collect()} == {"/=a/*", "/=b|=c|=d/*"}


# op10


def test_shards(spark, documents):
    docs = spark.createDataFrame(documents)
    hot = docs.limit(60).selectExpr("doc_id + 100000 AS doc_id", "'hot hot hot' AS text", "lang", "source", "n_chars")
    got = sharding.kd_shards(docs.unionByName(hot), shards=8).toPandas()
    assert len(got) == len(documents) + 60
    texts = dict(zip(documents.doc_id, documents.text, strict=True))
    for r in got.itertuples():
        data = (texts.get(r.doc_id) if r.doc_id < 100000 else "hot hot hot") or ""
        assert (r.size, r.text_crc32) == (len(data.encode()) + 1, zlib.crc32(data.encode()))
    sizes = got.groupby("shard")["size"].sum()
    assert set(sizes.index) == set(range(8)) and sizes.max() <= sizes.mean() * 1.2
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sharding.kd_shards(docs, target_bytes=200_000).toPandas().groupby("shard")["size"].sum().max() < 250_000
