"""What near_copies() finds doesn't depend on how many or how long the texts are."""

import random

import numpy as np
import pytest

from tidemark.llm import simhash


@pytest.mark.parametrize(("words", "own", "other"), [(64, 20, 6), (86, 11, 9)])
def test_large_anchors_lose_no_pair(spark, words, own, other):
    """900 pairs just above 0.8 among texts that are 0.5 or 0.76 alike, in anchors that are searched whole or cut."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    altered = lambda w, n: w[: len(w) - n] + [f"n{rng.randrange(10**9)}" for _ in range(n)]
    rows = [(i, altered(base, own)) for i in range(900)]
    rows += [(10_000 + i, altered(rows[i][1], other)) for i in range(900)]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(8)
    whole, cut = ({r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs, most_direct=n).collect()} for n in (10**9, 1))
    assert cut == whole and sum(whole[10_000 + i] == i for i in range(900)) >= 890


def test_shingles_of_long_texts(monkeypatch):
    """The shingles of a text don't depend on where it is cut: long words, and space at its end."""
    rng = random.Random(22)
    texts = [b" ".join(b"w%d" % rng.randrange(99) for _ in range(400)) + b" " * n for n in (0, 700)]
    texts += [b" ".join(b"x" * rng.choice((1, 3, 90, 300)) + b"%d" % i for i in range(60)), b"y" * 900 + b" z", b" " * 500]
    want = list(simhash.shingle_sets(texts, 5))
    for size in (50, 64, 200, 1000):
        monkeypatch.setattr(simhash, "_LONG", size)
        assert all(np.array_equal(a, b) for a, b in zip(simhash.shingle_sets(texts, 5), want, strict=True))
