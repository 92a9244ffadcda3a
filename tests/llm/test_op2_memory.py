"""The toxicity model's grams are counted some words at a time."""

import tracemalloc
from collections import Counter

import numpy as np

from sparkveil.llm import op2_toxicity as T


def test_grams_equal_a_plain_loop(monkeypatch):
    monkeypatch.setattr(T, "GRAM_WORDS", 7)
    words = [b"a", b"ab", *(b"word%d" % (i * 7) for i in range(40)), "süß".encode()]
    counts = np.arange(len(words)) % 3, np.arange(len(words)) % 5 * 1.0
    want = [Counter(), Counter()]
    for k, w in enumerate(words):
        padded = b"\x01" * (T.ORDER - 1) + w + b"\x02"
        for i in range(len(w) + 1):
            for total, c in zip(want, counts, strict=True):
                total[int.from_bytes(padded[i : i + T.ORDER], "big")] += int(c[k])
    keys, got = T.gram_counts(words, *counts)
    assert keys.tolist() == sorted(want[0])
    for total, c in zip(want, got, strict=True):
        assert dict(zip(keys.tolist(), c.tolist(), strict=True)) == total


def test_training_holds_grams_of_few_words_at_once():
    words = [bytes(97 + i // 5**k % 5 for k in range(8)) for i in range(200_000)]
    n = np.ones(len(words))
    tracemalloc.start()
    try:
        T.train(words, n, n)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6
