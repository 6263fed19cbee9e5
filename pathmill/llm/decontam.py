"""Benchmark decontamination: every training passage queries a BM25 index of test items under block-max bounds.

Test items are cut into segments of at most SEGMENT_WORDS words, which an inverted index holds with BM25 impacts, each
divided by its segment's own score, so that a passage that holds a whole segment scores 1. Segments form blocks; a block
keeps the largest impact of each term. Documents are cut into overlapping passages such that some passage holds any
segment of a leak whole. A segment's terms are ordered by frequency; its pivot is the term at which their sum passes
PIVOT_SCORE. What comes before is a rest, too little for the threshold, and has no postings, so the long lists are never
read. A passage's postings are merged in the order of blocks: blocks without one are skipped unseen, those whose maxima
and rest stay under the threshold unscored, and the segments of the others are scored, so that every segment above the
threshold is retrieved. The pivot is found for each segment when the index is built, not anew at each step of a cursor.
Of retrieved items, five-word shingles of the question (all sentences but the last) and of the answer (the last) must be
found in the document: at least 0.8 of both, or 0.8 of all. Terms are the words between white space, lower-cased,
without marks.

The index goes to the executors in parts of at most INDEX_BYTES of built index, each with its own pass over the documents; its
size does not follow the corpus. Defined results: null or empty texts and items without a term match nothing; of items
with the same id each is held for itself and the pair is returned once for each; repeated documents are searched each;
empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmill.llm.common import materialize, release_memory, table

K1, B = 1.2, 0.75
SEGMENT_WORDS = 48
STRIDE = 48  # passages are of 2 * STRIDE terms
MIN_SCORE = 0.5
SHINGLE = 5
MIN_OVERLAP = 0.8
BLOCK = 4
#: What the terms before its pivot may add to a segment's score at most.
PIVOT_SCORE = 0.3
#: A part of the index takes at most this much, unless one item is larger; a word of an item takes at most WORD_BYTES and its text.
INDEX_BYTES = 64 << 20
WORD_BYTES = 160
#: Passages that are searched at a time.
CELLS = 4096
KNOWN_WORDS = 100_000
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def term(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalnum())


def terms(text: str | None) -> list[str]:
    return [t for t in map(term, text.split()) if t] if text else []


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Terms of all sentences but the last, and of the last; an item of one sentence is all question."""
    parts = [p for p in map(terms, SENTENCE.split(text or "")) if p]
    return [t for p in parts[:-1] for t in p] or [t for p in parts for t in p], parts[-1] if len(parts) > 1 else []


class Numbers(dict):
    """word -> its term's number in the index, -1 for terms that the index lacks, -2 for words without a term."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        t = term(word)
        n = self[word] = self.vocabulary.get(t, -1) if t else -2
        return n


def shingle_hashes(numbers: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` terms; runs with a term that the index lacks cannot match and stay zero."""
    n = len(numbers) - width + 1
    if n < 1 or width < 1:
        return np.zeros(0, np.uint64)
    out, whole = np.full(n, width, np.uint64), np.ones(n, bool)
    for k in range(width):
        part = numbers[k : k + n]
        out = (out ^ (part.astype(np.uint64) + np.uint64(1))) * MIX
        out ^= out >> np.uint64(29)
        whole &= part >= 0
    return np.where(whole, out, np.uint64(0))


class Impacts:
    """Sparse impacts: a row for each term of a block, with the impacts of the block's segments, in the order of blocks."""

    def __init__(self, term: np.ndarray, segment: np.ndarray, impact: np.ndarray, blocks: int):
        key, at = np.unique(segment.astype(np.int64) // BLOCK << 32 | term, return_inverse=True)
        self.block, self.term = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
        self.rows = np.zeros((len(key), BLOCK), np.float32)
        self.rows[at, segment % BLOCK] = impact
        self.start = np.searchsorted(self.block, np.arange(blocks + 1))

    def __len__(self) -> int:
        return len(self.start) - 1

    def scores(self, block: int, terms: np.ndarray) -> np.ndarray:
        """Scores of the block's segments for sorted distinct ``terms``."""
        part = slice(self.start[block], self.start[block + 1])
        own = self.term[part]
        place = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
        return self.rows[part][terms[place] == own].sum(axis=0)

    def __getitem__(self, at: tuple[slice, np.ndarray]) -> np.ndarray:
        """The dense impacts of some blocks (a slice) for distinct terms: blocks x terms x segments."""
        terms = np.atleast_1d(at[1])
        out = np.zeros((len(self), len(terms), BLOCK), np.float32)
        for k, t in enumerate(terms):
            rows = self.term == t
            out[self.block[rows], k] = self.rows[rows]
        return out[at[0]]


class Index:
    """Impacts by term and block, and what verification needs of each item."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.items, segments = [], []
        for item_id, text in items:
            question, answer = question_and_answer(text)
            if not question:
                continue
            parts = [np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in p], np.int64) for p in (question, answer, question + answer)]
            self.items.append((item_id, [(min(SHINGLE, max(1, len(p))), len(p), p) for p in parts]))
            whole = parts[2]
            for part in np.array_split(whole, -(-len(whole) // SEGMENT_WORDS)):
                segments.append((len(self.items) - 1, Counter(part.tolist())))
        self.of_segment = np.array([s[0] for s in segments], np.int64)
        n, df = len(segments), Counter(t for _, c in segments for t in c)
        mean = sum(sum(c.values()) for _, c in segments) / max(1, n)
        blocks = -(-n // BLOCK)
        at_term, at_segment, impact = [], [], []
        for s, (_, counts) in enumerate(segments):
            length = sum(counts.values())
            own = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * length / mean)) for t, c in counts.items()}
            total = sum(own.values())
            at_term.append(np.fromiter(own, np.int32, len(own)))
            at_segment.append(np.full(len(own), s, np.int32))
            impact.append(np.fromiter((v / total for v in own.values()), np.float32, len(own)))
        joined = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((at_term, np.int32), (at_segment, np.int32), (impact, np.float32))]
        self.impacts = Impacts(*joined, blocks)
        self._order(df)
        self.checks = [(i, [(w, n, np.unique(shingle_hashes(p, w))) for w, n, p in parts]) for i, parts in self.items]
        del self.items

    def _order(self, df: Counter) -> None:
        """Finds each segment's pivot: its most frequent terms, as long as they bring it no more than PIVOT_SCORE together,
        are its rest; the terms from the pivot on have postings, with a block's number and their largest impact in it."""
        size, held = len(self.vocabulary), self.impacts
        rows, seat = np.nonzero(held.rows)
        segment, terms, impact = held.block[rows] * BLOCK + seat, held.term[rows], held.rows[rows, seat].astype(float)
        count = np.zeros(size, np.int64)
        count[list(df)] = list(df.values())
        order = np.lexsort((terms, -count[terms], segment))
        segment, terms, impact, rows = segment[order], terms[order], impact[order], rows[order]
        so_far = np.cumsum(impact)
        so_far -= (so_far - impact)[np.searchsorted(segment, segment)]
        late = so_far > PIVOT_SCORE
        self.rest = np.zeros(len(held) * BLOCK)
        np.maximum.at(self.rest, segment[~late], so_far[~late])
        self.rest = self.rest.reshape(-1, BLOCK).max(axis=1)
        bound = np.zeros(len(held.term))
        np.maximum.at(bound, rows[late], impact[late])
        by_term = np.argsort(held.term, kind="stable")
        by_term = by_term[bound[by_term] > 0]
        self.posting_block = held.block[by_term]
        self.posting_bound = bound[by_term].astype(np.float32)
        self.posting_count = np.bincount(held.term[by_term], minlength=size)
        self.posting_start = np.cumsum(self.posting_count) - self.posting_count

    def retrieve(self, numbers: np.ndarray) -> dict[int, float]:
        """Items of which a segment scores at least MIN_SCORE in some passage, with the best score."""
        known = np.flatnonzero(numbers >= 0)
        out: dict[int, float] = {}
        if not len(known) or not len(self.impacts):
            return out
        ids, cell = numbers[known], known // STRIDE  # a passage is two neighbouring cells
        for first in range(0, int(cell[-1]) + 1, CELLS):
            a, b = np.searchsorted(cell, [first, first + CELLS + 1])
            if a < b:
                self._retrieve(ids[a:b], cell[a:b] - first, out)
        return out

    def _retrieve(self, ids: np.ndarray, cell: np.ndarray, out: dict[int, float]) -> None:
        """Adds to ``out`` what the passages that start in ``cell`` - 1 and ``cell`` retrieve.

        The cursors of all passages move through the postings in the order of blocks together. Blocks in which a passage
        has no term from a pivot on are never looked at; of the others the largest impacts and the rest are summed, and
        only blocks that can reach MIN_SCORE so are scored.
        """
        blocks = len(self.impacts)
        late = self.posting_count[ids] > 0
        key = np.unique(cell[late] * len(self.posting_count) + ids[late])
        at, term = key // len(self.posting_count), key % len(self.posting_count)
        n = self.posting_count[term]
        posting = np.repeat(self.posting_start[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        here = np.repeat(at, n) * blocks + self.posting_block[posting]
        both, place = np.unique(np.concatenate([here, here - blocks]), return_inverse=True)
        bound = np.bincount(place, weights=np.tile(self.posting_bound[posting], 2), minlength=len(both))
        passage, block = both // blocks, both % blocks
        reach = bound + self.rest[block] >= MIN_SCORE - 1e-4
        last, mine = -2, ids
        for p, b in zip(passage[reach].tolist(), block[reach].tolist(), strict=True):
            if p != last:
                last, mine = p, np.unique(ids[np.searchsorted(cell, p) : np.searchsorted(cell, p + 2)])
            scores = self.impacts.scores(b, mine)
            for s in np.flatnonzero(scores >= MIN_SCORE - 1e-4):
                item = int(self.of_segment[b * BLOCK + s])
                out[item] = max(out.get(item, 0.0), float(scores[s]))

    def verify(self, numbers: np.ndarray, found: dict[int, float]) -> list[tuple[object, float, float, float]]:
        """(item id, score, question overlap, answer overlap) of the retrieved items that the document holds."""
        hashes: dict[int, np.ndarray] = {}
        out = []
        for item, score in sorted(found.items()):
            item_id, parts = self.checks[item]
            shares = []
            for width, n, own in parts:
                if width not in hashes:
                    hashes[width] = np.unique(shingle_hashes(numbers, width))
                shares.append(float(np.isin(own, hashes[width]).mean()) if n else 1.0)
            question, answer, whole = shares
            if whole >= MIN_OVERLAP or (question >= MIN_OVERLAP and answer >= MIN_OVERLAP):
                out.append((item_id, score, question, answer))
        return out

    def search(self, text: str | None, known: Numbers) -> list[tuple[object, float, float, float]]:
        words = text.split() if text else []
        numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        numbers = numbers[numbers > -2]
        found = self.retrieve(numbers)
        return self.verify(numbers, found) if found else []


def indexes(items: DataFrame) -> Iterator[Index]:
    """The test items as indexes of at most INDEX_BYTES each, read and built one after the other."""
    rows, size, any_yet = [], 0, False
    for r in items.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        text = r["text"] or ""
        more = len(text.encode("utf-8", "surrogatepass")) + WORD_BYTES * (len(text.split()) + 4)
        if rows and size + more > INDEX_BYTES:
            yield Index(rows)
            rows, size, any_yet = [], 0, True
        rows.append((r["item_id"], r["text"]))
        size += more
    if rows or not any_yet:
        yield Index(rows)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for every leaked item of every document."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kinds = [texts.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    out = None
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most INDEX_BYTES; the driver holds one part
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            known = Numbers(index.vocabulary)
            for batch in batches:
                row, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for leak in index.search(text, known):
                        row.append(i)
                        found.append(leak)
                if row:
                    ids = batch.column(0).take(pa.array(row, pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[k] for f in found], pa.float64() if k else None) for k in range(4))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
            del known
            release_memory()

        part = texts.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionAll(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns as they are."""
    for k, index in enumerate(indexes(items)):
        if k:
            docs = materialize(docs)  # so that a task holds one part
        shared = docs.sparkSession.sparkContext.broadcast(index)
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            known = Numbers(index.vocabulary)
            for batch in batches:
                clean = [not index.search(text, known) for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))
            del known
            release_memory()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
