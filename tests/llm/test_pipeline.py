"""The pipeline from end to end, and both classifiers' verdicts, against plain computations row by row."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_near_copies import kept_by_brute_force
from tokenizers import Tokenizer

import corpus_pipeline
from pathmill.llm import decontam, linededup, ordinal, packing, rules, textmodel


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def tables(spark, folder):
    return [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def heads(tables):
    return rules.train(*tables)


def plain_sum(text, weights):
    cols, values = textmodel.text_columns(text)
    return float(values @ weights.astype(float)[cols])


def plain_verdict(text, heads):
    """(base_failed, p_quality, p_toxic, kept)"""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    quality, toxic = (float(h.probability(np.array(plain_sum(text, h.weights)))) for h in heads)
    return failed, quality, toxic, not failed and quality >= rules.KEEP_QUALITY and toxic < rules.DROP_TOXIC


def test_verdicts_are_plain_sums(tables, rows, heads):
    got = {r.doc_id: r for r in rules.judge(*tables).collect()}
    assert set(got) == {i for i, _, _ in rows} and all(h.weights is not None for h in heads)
    for doc_id, text, _ in rows:
        failed, quality, toxic, kept = plain_verdict(text, heads)
        r = got[doc_id]
        assert abs(r.p_quality - quality) < 1e-4 and abs(r.p_toxic - toxic) < 1e-4
        assert (r.base_failed, r.kept) == (failed, kept)
    assert sorted(r.doc_id for r in rules.keep_good(*tables).collect()) == sorted(i for i, r in got.items() if r.kept)


def test_grades_are_plain_sums(tables, rows):
    weights, cuts, _ = textmodel.fitted(textmodel.labelled_features(*tables, ["quality", "toxic"]), ["quality", "toxic"], ordinal.fit_grades)
    got = {r.doc_id: r for r in ordinal.grade_documents(*tables).collect()}
    for doc_id, text, _ in rows:
        reach = [1 / (1 + np.exp(cut - plain_sum(text, weights))) for cut in cuts]
        r = got[doc_id]
        assert abs(r.expected_grade - sum(reach)) < 1e-4 and abs(r.tail_probability - reach[-1]) < 1e-4
        assert r.selected == (reach[-1] >= ordinal.SELECT_TAIL and bool((text or "").split()))


def without_boilerplate(rows):
    def bare(line):
        return line.strip(" \t\r")

    pages, seen = defaultdict(set), defaultdict(set)
    for _, text, site in rows:
        pages[site].add(text)
        for line in {bare(x) for x in (text or "").split("\n")} - {""}:
            seen[site, line].add(text)
    gone = {k for k, texts in seen.items() if len(texts) >= linededup.MIN_PAGES and len(texts) > linededup.MAX_RATIO * len(pages[k[0]])}
    return [(i, text if text is None else "\n".join(x for x in text.split("\n") if (site, bare(x)) not in gone), site) for i, text, site in rows]


def leaks(text, items):
    terms = decontam.terms(text)
    for item in items:
        shares = []
        question, answer = decontam.question_and_answer(item)
        for part in (question, answer, question + answer):
            n = min(5, max(1, len(part)))
            have = {tuple(terms[i : i + n]) for i in range(len(terms) - n + 1)}
            own = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
            shares.append(len(own & have) / len(own) if part else 1.0)
        if question and (shares[2] >= 0.8 or (shares[0] >= 0.8 and shares[1] >= 0.8)):
            return True
    return False


def test_run_is_its_stages_one_after_the_other(spark, folder, rows, heads):
    kept = [r for r in rows if plain_verdict(r[1], heads)[3]]
    kept = without_boilerplate(kept)
    ids = set(kept_by_brute_force([(i, text) for i, text, _ in sorted(kept)]))
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {i: text for i, text, _ in kept if i in ids and not leaks(text, items)}
    assert 20 < len(kept) < len(ids) < len(rows)
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert set(got.doc_id) == set(kept)
    ids_of = Tokenizer.from_file(packing.vocabulary_path())
    for doc_id, pieces in got.sort_values("piece").groupby("doc_id"):
        ids = np.array([*ids_of.encode(kept[doc_id], add_special_tokens=False).ids, packing.END_ID], "<u4")
        assert pieces.start.tolist() == np.cumsum([0, *pieces.length[:-1]]).tolist() and pieces.length.sum() == len(ids)
        assert pieces.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(pieces.start, pieces.length, strict=True)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.length.cumsum() - s.length == s.offset).all() and s.length.sum() <= packing.CAPACITY
