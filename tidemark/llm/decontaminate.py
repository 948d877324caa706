"""Benchmark decontamination: documents that hold a passage within a few word edits of an item.

Windows of each item's size are embedded by the CGK random walk (Chakraborty, Goldenberg and
Koucky 2016), which turns edit distance into Hamming distance; samples of the embedding's
positions are the keys of a repeated LSH, and each window that shares a key with an item is
verified by its exact edit distance. Beside it, each item that shares as many word pairs with a
window as it must is verified too, so that no item depends on the samples' luck.

Only windows that can hold an item are embedded: an edit destroys at most two of an item's word
pairs, so a passage within k edits of n words keeps at least n - 1 - 2k of them. This test loses
nothing. Documents are read once for each _PASS blocks of items and never move between tasks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import small_batches, type_of

_PUNCTUATION = bytes(i for i in range(128) if not chr(i).isalnum())
#: Words of the items of a block, whose index takes some hundred bytes for each, and blocks that a task holds.
_BLOCK_WORDS, _PASS = 400_000, 4
_PLAIN = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def words(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and bytes over 127, in lower case."""
    return text.decode("utf-8", "replace").lower().encode("utf-8", "replace").translate(_PLAIN).split() if text else []


def edits_allowed(n: int, rate: float) -> int:
    return int(n * rate)


def nearest(item: list[int], text: list[int]) -> int:
    """The least edit distance of an item to any part of a text (Myers' bit vectors, free start)."""
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    n = len(item)
    full, high = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best = score
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (~(xh | plus) & full), plus & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | (~(xv | ph) & full), ph & xv
        best = min(best, score)
    return best


class Index:
    """The LSH tables of a block of items."""

    def __init__(self, items: list[tuple[Any, list[bytes]]], rate: float = 0.2, recall: float = 0.98, sampled: int = 4, agree: float = 0.5, walks: int = 4, seed: int = 7):
        """agree: the share of the embeddings' positions expected to agree at the most edits allowed."""
        self.rate, self.sampled, self.walks = rate, sampled, walks
        self.repeats = math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled))
        self.place: dict[bytes, int] = {}
        self.items: list[tuple[Any, list[int]]] = []
        for key, own in items:
            if own:
                self.items.append((key, [self.place.setdefault(w, len(self.place) + 1) for w in own]))
        self.size = len(self.place) + 1
        self.pairs = np.unique(np.array([a * self.size + b for _, w in self.items for a, b in zip(w, w[1:], strict=False)], dtype=np.int64))
        by_pair: dict[int, set[int]] = defaultdict(set)
        for _, w in self.items:
            for a, b in zip(w, w[1:], strict=False):
                by_pair[a * self.size + b].add(len(w))
        #: The lengths of the items that have a pair: those of pair q are spread[first[q] : first[q + 1]].
        own = [sorted(by_pair[q]) for q in self.pairs.tolist()]
        self.spread = np.array([n for x in own for n in x], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        #: The most times that an item has the same pair.
        self.twice = max((int(np.unique(np.array(list(zip(w, w[1:], strict=False))), axis=0, return_counts=True)[1].max()) for _, w in self.items if len(w) > 1), default=1)
        self.lengths = sorted({len(w) for _, w in self.items})
        #: For each length: the numbers of its items' pairs in order, with the items that have them.
        self.holders: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in self.lengths:
            both = [(a * self.size + b, i) for i, (_, w) in enumerate(self.items) if len(w) == n for a, b in set(zip(w, w[1:], strict=False))]
            code, who = np.array(sorted(both), dtype=np.int64).reshape(-1, 2).T
            self.holders[n] = (np.searchsorted(self.pairs, code), who)
        rng = np.random.default_rng(seed)
        self.salts = rng.integers(1, 1 << 62, walks, dtype=np.uint64) | np.uint64(1)
        self.mix = rng.integers(1, 1 << 62, sampled, dtype=np.int64) | 1
        self.turn = rng.integers(1, 1 << 62, self.repeats, dtype=np.int64)
        #: For each length: the sampled positions of each repetition, and the items' keys in order with their items.
        self.classes: dict[int, tuple[list[np.ndarray], np.ndarray, np.ndarray]] = {}
        for n in self.lengths:
            chosen = [np.sort(rng.choice(2 * n, size=min(sampled, 2 * n), replace=False)) for _ in range(self.repeats)]
            own = np.array([i for i, (_, w) in enumerate(self.items) if len(w) == n])
            flat = np.array([w for i in own for w in self.items[i][1]], dtype=np.int64)
            keys = self._keys(np.concatenate([flat, [0]]), np.arange(len(own)) * n, n, chosen)
            order = np.argsort(keys.ravel(), kind="stable")
            self.classes[n] = (chosen, keys.ravel()[order], np.tile(own, self.repeats)[order])

    def _keys(self, text: np.ndarray, starts: np.ndarray, n: int, chosen: list[np.ndarray]) -> np.ndarray:
        """repeats x windows: the repetition and the sampled positions of the CGK embedding, mixed to a number.

        Windows are the n words of text from each start. A walk's bit for a step and a symbol is
        that of a hash, and only sampled positions are kept: nothing grows with the items' length.
        """
        m = len(starts)
        out = np.zeros((len(chosen), m), dtype=np.int64)
        for walk in range(self.walks):
            wanted: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for r in range(walk, len(chosen), self.walks):
                for s, j in enumerate(chosen[r].tolist()):
                    wanted[j].append((r, s))
            at = np.zeros(m, dtype=np.int64)
            with np.errstate(over="ignore"):
                for j in range(2 * n):
                    symbol = np.where(at < n, text[np.minimum(starts + at, len(text) - 1)], self.size)  # the end has its own symbol
                    for r, s in wanted.get(j, ()):
                        out[r] += symbol * self.mix[s]
                    h = (symbol.astype(np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * self.salts[walk]
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    at = np.minimum(at + (h >> np.uint64(63)).astype(np.int64), n)
        with np.errstate(over="ignore"):
            return out + self.turn[: len(chosen), None]

    def matches(self, text: bytes | None) -> list[tuple[Any, int, int]]:
        """(item's key, first word of the region, edits) of each item that the text holds."""
        get = self.place.get
        ids = np.array([get(w, 0) for w in words(text)], dtype=np.int64)
        if not len(ids):
            return []
        codes, by_length = np.full(len(ids), -1, dtype=np.int64), {}
        if len(self.pairs) and len(ids) > 1:
            both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            code = ids[both] * self.size + ids[both + 1]
            near = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            fits = self.pairs[near] == code
            at, q = both[fits], near[fits]
            codes[at] = q
            counts = self.first[q + 1] - self.first[q]
            length = self.spread[np.repeat(self.first[q] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            order = np.argsort(length, kind="stable")
            length, at = length[order], np.repeat(at, counts)[order]
            bounds = np.searchsorted(length, [*self.lengths, 1 << 60])
            by_length = {n: at[a:b] for n, a, b in zip(self.lengths, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)}
        found = []
        for n in self.lengths:
            k = edits_allowed(n, self.rate)
            need = n - 1 - 2 * k
            shared: dict[int, set[int]] = defaultdict(set)
            if need < 1:  # items of a few words: every known word can start one
                some = np.flatnonzero(ids > 0)
            else:
                at = by_length.get(n, ())
                if len(at) < need:
                    continue
                some = at[np.searchsorted(at, at + n + k) - np.arange(len(at)) >= need]
                some = self._varied(codes, at, some, n + k, need)
                if len(some):
                    shared = self._shared(n, k, codes, at, some)
            if not len(some):
                continue
            starts = np.unique((some[:, None] - np.arange(2 * k + 1)[None, :]).ravel())
            starts = starts[starts >= 0]
            if need >= 1 and k >= 16:  # windows of long items that begin near each other are much the same; shared pairs leave none out
                starts = starts[starts % (k // 8) == 0]
            found += self._verified(n, k, ids, starts, shared)
        return sorted(found, key=lambda x: (x[1], str(x[0])))

    def _varied(self, codes: np.ndarray, at: np.ndarray, some: np.ndarray, size: int, need: int) -> np.ndarray:
        """Of the starts, those whose window has enough pairs when none counts more often than items have it."""
        if not len(some):
            return some
        room = np.full(len(codes) + size, -1, dtype=np.int64)
        room[at] = codes[at]
        good, block = [], max(1, (1 << 22) // size)
        for b in range(0, len(some), block):
            part = some[b : b + block]
            rows = np.sort(room[part[:, None] + np.arange(size)[None, :]], axis=1)
            counted = rows >= 0
            counted[:, self.twice :] &= rows[:, self.twice :] != rows[:, : -self.twice]
            good.append(part[counted.sum(axis=1) >= need])
        return np.concatenate(good)

    def _shared(self, n: int, k: int, codes: np.ndarray, at: np.ndarray, some: np.ndarray) -> dict[int, set[int]]:
        """Starts by item, of windows from `some` in which the item has as many pairs as k edits must leave."""
        number, who = self.holders[n]
        seen: dict[int, set[int]] = defaultdict(set)
        last = some[np.maximum(np.searchsorted(some, at, side="right") - 1, 0)]
        at = at[(last <= at) & (at < last + n + k)]  # all others are in no window
        low, high = np.searchsorted(number, codes[at]), np.searchsorted(number, codes[at], side="right")
        counts = high - low
        item = who[np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        place = np.repeat(at, counts)
        order = np.lexsort((place, item))
        item, place, need = item[order], place[order], n - 1 - 2 * k
        i = np.arange(max(0, len(item) - need + 1))
        enough = (item[i] == item[i + need - 1]) & (place[i + need - 1] < place[i] + n + k)
        for j, s in zip(item[i[enough]].tolist(), place[i[enough]].tolist(), strict=True):
            seen[j] |= {max(0, s - 2 * k), s}  # a passage begins at most 2 k words before its first whole pair
        return seen

    def _verified(self, n: int, k: int, ids: np.ndarray, starts: np.ndarray, seen: dict[int, set[int]]) -> list[tuple[Any, int, int]]:
        """The items that are held, of those seen and those that the LSH finds at the starts."""
        chosen, table, owners = self.classes[n]
        long = np.concatenate([ids, np.full(n, self.size)])
        for b in range(0, len(starts), 4096):
            part = starts[b : b + 4096]
            keys = self._keys(long, part, n, chosen)
            low, high = np.searchsorted(table, keys), np.searchsorted(table, keys, side="right")
            for r, j in np.argwhere(high > low).tolist():
                for i in owners[low[r, j] : high[r, j]].tolist():
                    seen[i].add(int(part[j]))
        out = []
        for i, at in seen.items():
            best, first, last, begin = k + 1, 0, -1, 0
            for s in sorted(at) + [len(ids) + 10 * n]:
                if last >= 0 and s > last + n:  # windows that lie together are one region
                    lo = max(0, begin - k)
                    d = nearest(self.items[i][1], ids[lo : last + n + 2 * k].tolist())
                    if d < best:
                        best, first = d, lo
                    last = -1
                if last < 0:
                    begin = s
                last = s
            if best <= k:
                out.append((self.items[i][0], first, best))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int, rate: float, recall: float) -> Iterator[Index]:
    """Indexes of at most `block` items and _BLOCK_WORDS words each, or of one longer item."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_col), F.col(text_col).cast("binary")).where(F.col(text_col).isNotNull()).toLocalIterator():
        own = words(bytes(r[1]))
        if held and (len(held) >= block or size + len(own) > _BLOCK_WORDS):
            yield Index(held, rate, recall)
            held, size = [], 0
        held.append((r[0], own))
        size += len(own)
    if held:
        yield Index(held, rate, recall)


def _passes(spark: SparkSession, blocks: Iterator[Index]) -> Iterator[list[Any]]:
    """Broadcasts of the blocks (each of a bounded size), _PASS at a time."""
    while part := [spark.sparkContext.broadcast(index) for index in islice(blocks, _PASS)]:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", rate: float = 0.2, recall: float = 0.98, block: int = 5000) -> DataFrame:
    """One row (id_col, item_col, edits, start_word) for each row of docs and item that it holds.

    An item is held if some part of the whole text is within rate * n word edits of its n
    words. Null and wordless texts and items match nothing; items that repeat match each;
    repeated rows give repeated rows; empty tables give none. Of other columns none is read.
    """
    spark, out = docs.sparkSession, None
    schema = f"`{id_col}` {type_of(docs, id_col)}, `{item_col}` {type_of(benchmark, item_col)}, edits int, start_word int"
    source = small_batches(docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text")))
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    for held in _passes(spark, _blocks(benchmark, item_col, text_col, block, rate, recall)):

        def run(batches: Iterator[pa.RecordBatch], held: Any = held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, at, found = batch.column(1), [], []
                for i in range(len(texts)):
                    text = texts[i].as_py()
                    own = [x for index in held for x in index.value.matches(text)]
                    at += [i] * len(own)
                    found += own
                kept = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.record_batch([kept, pa.array([x[0] for x in found], item_type), pa.array([x[2] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32())], names=[id_col, item_col, "edits", "start_word"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", rate: float = 0.2, recall: float = 0.98, block: int = 5000) -> DataFrame:
    """docs without rows that hold an item, as contaminated() says; all columns as they are."""
    at = docs.columns.index(text_col)
    for held in _passes(docs.sparkSession, _blocks(benchmark, item_col, "text", block, rate, recall)):

        def run(batches: Iterator[pa.RecordBatch], held: Any = held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).cast(pa.binary())
                clean = [not any(index.value.matches(text) for index in held) for text in (texts[i].as_py() for i in range(len(texts)))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = small_batches(docs).mapInArrow(run, docs.schema)
    return docs
