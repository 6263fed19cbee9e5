"""The packing's local search runs until nothing helps, and every text has ids."""

import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

from pathmill.llm import packing


@pytest.mark.parametrize(("low", "high", "most"), [(300, 500, 22000), (200, 420, 15300)])
def test_search_settles_on_lengths_of_the_middle(low, high, most):
    rng = random.Random(1)
    lengths = Counter(rng.randint(low, high) for _ in range(50_000))
    bins = packing.local_search(packing.best_fit(dict(lengths)))
    held = Counter()
    for kind, n in bins.items():
        assert sum(kind) <= packing.CAPACITY
        for v in kind:
            held[v] += n
    assert held == lengths and sum(bins.values()) <= most


def test_no_exchange_of_one_piece_is_left():
    rng = random.Random(2)
    bins = packing.local_search(packing.best_fit(dict(Counter(rng.randint(30, 50) for _ in range(300))), 100), 100)
    kinds = [k for k, n in bins.items() if sum(k) < 100]
    if sum(bins.values()) > -(-sum(sum(k) * n for k, n in bins.items()) // 100):
        for a in kinds:
            for b in kinds:
                if a != b and sum(a) >= sum(b):
                    assert not any(0 < v - u <= 100 - sum(a) for v in b for u in (0, *a))


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + " \n" * 1_000_000 + "b"])
def test_long_white_space_has_ids(text):
    path = packing.vocabulary_path()
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
