"""What the piece encoder holds depends on its bounds, not on the batch."""

import random
import re
import tracemalloc
from pathlib import Path

import pytest

from tidemark.llm import pieces, queries
from tidemark.llm.common import trim


@pytest.fixture(scope="module")
def model():
    return pieces.load(queries.PIECE_MODEL)


def test_batches_of_new_words_take_little_memory(model):
    """4 MB of words that are hardly ever repeated: the indexes and the kept ids of both batches."""
    rng = random.Random(31)
    texts = [" ".join("".join(rng.choices("abcdefghinorstu", k=rng.randrange(3, 12))) for _ in range(1000)) for _ in range(500)]
    tracemalloc.start()
    try:
        for half in (texts[:250], texts[250:]):
            before = tracemalloc.get_traced_memory()[0]
            ids = model.encode_batch(half)
            assert all(model.decode(i.tolist()) == t for i, t in zip(ids[:20], half[:20], strict=True))
            assert before < 60e6
        assert tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()


def test_ids_do_not_depend_on_the_bounds(model, monkeypatch):
    """Long texts, runs of spaces and breaks, segments longer than what is split together."""
    rng = random.Random(32)
    texts = ["".join(rng.choices(["ab", "cde", " ", "  ", "\n", "é", "漢", "▁", "x" * 90, " " * 70], k=120)) for _ in range(4)] + [None, "", " " * 300, "y" * 300]
    want = [x.tolist() for x in model.encode_batch(texts)]
    for bounds in ((1, 1, 1), (64, 40, 7), (200, 1000, 50)):
        for name, n in zip(("_SPLIT", "_HELD", "_KNOWN_MOST"), bounds, strict=True):
            monkeypatch.setattr(pieces, name, n)
        model.known, model.known_before = {}, {}
        assert [x.tolist() for x in model.encode_batch(texts)] == want
    assert [x.tolist() for x in model.encode_batch(texts)] == want


def test_freed_memory_goes_back():
    """Freed memory below some that is still used is the process's until it is trimmed."""
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    some = [bytes(4000) for _ in range(30_000)]
    last, before = some.pop(), held()
    del some
    trim()
    assert len(last) == 4000 and held() < before - 80
