"""Decontamination of texts of repeated words."""

import time

import numpy as np

from tallframe.llm.decontam import Fingerprints
from tallframe.llm.text import alnum_words, hashes


def brute(words, items, length=10):
    hit, found = [False] * len(words), set()
    for k, item in enumerate(items):
        n = min(length, len(item))
        windows = {tuple(item[j : j + n]) for j in range(len(item) - n + 1)}
        for j in range(len(words) - n + 1):
            if tuple(words[j : j + n]) in windows:
                found.add(k)
                hit[j : j + n] = [True] * n
    return hit, found


def test_equal_words():
    items = ["spam " * 200 + str(k) for k in range(200)] + ["ham"]
    index = Fingerprints([(str(k), t) for k, t in enumerate(items)], 10, 5)
    start = time.perf_counter()
    hit, found = index.find(hashes(alnum_words("spam " * 20_000 + "ham")))
    assert time.perf_counter() - start < 2
    assert hit.all() and found == set(range(201))


def test_few_words_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        items = [rng.choice(["a", "b"], rng.integers(1, 40), p=[0.8, 0.2]).tolist() for _ in range(6)]
        words = rng.choice(["a", "b"], 120, p=[0.8, 0.2]).tolist()
        hit, found = Fingerprints([(str(k), " ".join(t)) for k, t in enumerate(items)], 10, 5).find(hashes(alnum_words(" ".join(words))))
        assert (hit.tolist(), found) == brute(words, items)
