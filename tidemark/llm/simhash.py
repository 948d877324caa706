"""SimHash near-duplicates by anchor-point covering.

Fingerprints are points of {0,1}^64. Anchors are the words of the Hamming code [63, 57] over
the lower 63 bits; the code is perfect, so every point lies within covering radius 1 of exactly
one anchor. Two fingerprints at distance t have a midpoint within ceil(t / 2) of either, and the
anchor of that midpoint is within 1 + ceil(t / 2) of both. So each fingerprint is replicated to
all anchors within that radius (32 for t = 2) and fingerprints are only compared where they meet.
Covering radius plus the whole t would replicate 652 times and find the same pairs.

An anchor holds distinct fingerprints only, and these lie in a ball of that radius: at most
4,034 for t = 2, however many copies the corpus has. No list of pairs of documents is built.

Texts of a given shingle similarity lie too many bits apart for one covering: at 0.8, some 10 of
64 bits, and radii like that replicate a fingerprint to most of the code. near_copies() therefore
takes SimHashes of small samples of the shingles: each block orders the shingles in its own way
and fingerprints the least of them, so that near copies often have the very same fingerprint,
which a threshold of 0 and the covering radius bring to one anchor. Shingle sets decide there.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, free, small_batches, type_of

CODE_BITS = 63
COVERING_RADIUS = 1
#: Shingles in a sample, and blocks: of pairs at 0.8, 1 - (1 - 0.8 ** 3) ** 12 = 0.9998 meet.
SAMPLES = (3, 12)
#: Bits of a hash by which shingles are counted to put them in order, rare ones first.
_SLOT = 18
#: Texts that are compared with each other in one task: their number and bytes.
_PART, _PART_BYTES = 256, 4 << 20
#: Bytes that are hashed together, columns of a product of sets, and what rounding may take.
_LONG, _COLUMNS, _EPS = 1 << 20, 4096, 1e-9
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64 bits; a bit is 1 if over half of the shingles' hashes have it."""
    words = text.lower().split() if text else []  # of bytes: A-Z only; splits at \x20 and \x09-\x0D
    if not words:
        return 0
    n, block = max(1, len(words) - shingle + 1), 1 << 16
    counts = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for start in range(0, n, block):
        hashes = b"".join([digest(join(words[i : i + shingle]), 42) for i in range(start, min(n, start + block))])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp): the SimHash of each whole text as a signed long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [fingerprint(texts[i].as_py(), shingle) for i in range(len(texts))]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=[id_col, "fp"])

    source = small_batches(docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text")))
    return source.mapInArrow(run, f"`{id_col}` {type_of(docs, id_col)}, fp long")


@cache
def _errors(radius: int, size: int) -> list[np.ndarray]:
    """For each syndrome of the code of size bits, the error patterns of at most radius bits that have it."""
    found: list[list[int]] = [[] for _ in range(size + 1)]
    for weight in range(radius + 1):
        for at in combinations(range(1, size + 1), weight):
            syndrome = mask = 0
            for i in at:
                syndrome ^= i
                mask |= 1 << (i - 1)
            found[syndrome].append(mask)
    return [np.array(x, dtype=np.uint64) for x in found]


def _syndromes(points: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.uint64)
    for i in range(1, size + 1):
        out ^= ((points >> np.uint64(i - 1)) & np.uint64(1)) * np.uint64(i)
    return out


def anchors(points: np.ndarray, radius: int, size: int = CODE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the point) for each anchor within radius of the lower size bits of each uint64 point."""
    low = points & np.uint64((1 << size) - 1)
    near, which = [], []
    syndromes = _syndromes(low, size)
    for s in np.unique(syndromes):
        own = np.flatnonzero(syndromes == s)
        errors = _errors(radius, size)[int(s)]
        near.append((low[own][:, None] ^ errors[None, :]).ravel())
        which.append(np.repeat(own, len(errors)))
    return (np.concatenate(near), np.concatenate(which)) if near else (low, np.zeros(0, dtype=np.int64))


def _ties(members: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint of an anchor with the least one of its component inside the anchor."""
    label = np.arange(len(members))
    todo = np.ones(len(members), dtype=bool)
    for i in range(len(members)):
        if todo[i]:
            front = np.array([i])
            todo[i] = False
            while len(front):
                far = np.zeros(len(members), dtype=bool)
                for j in front:
                    far |= np.bitwise_count(members ^ members[j]) <= most
                front = np.flatnonzero(far & todo)
                label[front] = i
                todo[front] = False
    tied = label != np.arange(len(members))
    return members[tied], members[label[tied]]


def links(points: DataFrame, most: int = 2) -> DataFrame:
    """(u, v) of fingerprints at most bits apart, as stars: their components are those of all such pairs.

    points: a column fp of distinct longs.
    """
    radius = COVERING_RADIUS + (most + 1) // 2

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(fp), 4096):
                part = fp[i : i + 4096]
                anchor, which = anchors(part.view(np.uint64), radius)
                yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(part[which])], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def ready(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            sizes = np.diff(np.r_[starts, len(anchor)])
            two = starts[sizes == 2]
            near = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= most]
            us, vs = [fp[near + 1]], [fp[near]]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                u, v = _ties(fp[s : s + n].view(np.uint64), most)
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
            return pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        for batch in batches:
            anchor = np.concatenate([rest[0], batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([rest[1], batch.column(1).to_numpy(zero_copy_only=False)])
            if len(anchor) == 0:
                continue
            last = np.searchsorted(anchor, anchor[-1])  # the last anchor may go on in the next batch
            rest = (anchor[last:], fp[last:])
            if last:
                yield ready(anchor[:last], fp[:last])
        if len(rest[0]):
            yield ready(*rest)

    met = points.select("fp").mapInArrow(replicate, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor", "fp")
    return met.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2) -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 hex digits), component_id.

    component_id is the least id that can be reached over links of at most `most` differing bits.
    A null or wordless text has fingerprint zero and is linked like any other; a null id takes
    part but is never a component_id unless its component has no other; repeated rows give
    repeated rows; an empty table gives none; other columns, whatever their names, are not read.
    """
    marked = cut(fingerprints(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, shingle))
    points = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    same = components(links(points, most)).withColumnRenamed("node", "fp")
    placed = points.join(same, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    roots = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_point = placed.join(roots, "component").select("fp", "component_id")
    return marked.join(by_point, "fp").select(F.col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- Texts of a given shingle similarity -------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes mixed once more (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, both modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    one = np.ones(1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate([one, np.full(size, x, dtype=np.uint64)])) for x in (base, pow(base, -1, 1 << 64)))
    return up, down


def _shingle_hashes(raw: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word shingle of documents that lie end to end, each ended by a space."""
    up, down = _powers(1 << max(16, int(len(raw)).bit_length()))
    inner = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    change = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]]).view(np.int8)))
    starts, ends = change[::2], change[1::2]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        word = _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        doc = np.searchsorted(bounds, starts, side="right") - 1
        n = len(word)
        size = np.minimum(np.bincount(doc, minlength=len(bounds) - 1), shingle)[doc]  # a shorter text is one shingle
        at = np.arange(n)
        whole = at + size <= n
        whole[whole] = doc[(at + size - 1)[whole]] == doc[whole]
        room = np.concatenate([word, np.zeros(shingle, np.uint64)])
        out = np.zeros(n, dtype=np.uint64)
        for k in range(shingle):
            out = np.where(k < size, out + room[k : k + n] * np.uint64(2 * (k + 7) ** 9 + 1), out)
    return doc[whole], _mixed(out[whole])


def _segments(text: bytes, shingle: int) -> Iterator[bytes]:
    """A long text in parts that share shingle - 1 words: each has a whole shingle, if the text has one."""
    words, new, begin = deque(maxlen=shingle), 0, None
    for m in _WORD.finditer(text):
        words.append(m.start())
        new += 1
        begin = m.start() if begin is None else begin
        if len(words) == shingle and m.end() - begin > _LONG:
            yield text[begin : m.end()]
            new, begin = 0, words[1] if shingle > 1 else None
    if new:
        yield text[begin:]


def _sets(texts: list[bytes | None], shingle: int) -> Iterator[np.ndarray]:
    """shingle_sets() of texts that are hashed together."""
    data = b" ".join([*(t or b"" for t in texts), b""]).lower()
    bounds = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
    doc, h = _shingle_hashes(np.frombuffer(data, dtype=np.uint8), bounds, shingle)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])[: len(h)]
    doc, h = doc[new], h[new]
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    yield from (h[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def shingle_sets(texts: list[bytes | None], shingle: int) -> Iterator[np.ndarray]:
    """For each text the distinct 64-bit hashes of its word shingles, in order (A-Z in lower case)."""
    at = 0
    while at < len(texts):
        if len(texts[at] or b"") > 2 * _LONG:
            parts = [next(_sets([x], shingle)) for x in _segments(texts[at], shingle)]
            yield np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *parts]))
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= _LONG) and len(texts[end] or b"") <= 2 * _LONG:
            size += len(texts[end] or b"")
            end += 1
        yield from _sets(texts[at:end], shingle)
        at = end


def sampled_anchors(sets: list[np.ndarray], samples: int, blocks: int, seed: int = 1) -> np.ndarray:
    """texts x blocks: the anchor of each block's fingerprint, and the block, as one number.

    A block's fingerprint is the SimHash of the shingles that are least under `samples` orders of
    its own, so texts of similarity s share it with a chance of s ** samples, whatever their length.
    Anchors: the words of the code [63, 57] within covering radius and a threshold of 0. Wordless
    texts have the fingerprint 0.
    """
    out = np.zeros((len(sets), blocks), dtype=np.uint64)
    some = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    if len(some):
        h = np.concatenate([sets[i] for i in some])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])[:-1]])
        with np.errstate(over="ignore"):
            for b in range(blocks):
                turns = _mixed(np.arange(samples, dtype=np.uint64) + np.uint64((b + seed * 4096) * 64 + 1)) | np.uint64(1)
                least = np.stack([np.minimum.reduceat(h * t, starts) for t in turns])
                bits = np.unpackbits(_mixed(least).view(np.uint8).reshape(samples, -1, 8), axis=2).sum(axis=0, dtype=np.int64)
                out[some, b] = np.packbits(2 * bits > samples, axis=1).reshape(-1).view(np.uint64)
    near, which = anchors(out.ravel(), COVERING_RADIUS)
    place = np.zeros(out.size, dtype=np.uint64)
    place[which] = near
    with np.errstate(over="ignore"):
        return _mixed(place.reshape(out.shape) + _mixed(np.arange(blocks, dtype=np.uint64) + np.uint64(seed * 4096))[None, :])


def _anchored(sets: list[np.ndarray], samples: int, blocks: int, seed: int) -> pa.Array:
    return pa.array(sampled_anchors(sets, samples, blocks, seed).view(np.int64).tolist(), pa.list_(pa.int64()))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two ordered sets of hashes have at least that Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return not len(b)
    if len(a) < similarity * len(b) - _EPS:
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both >= similarity * (len(a) + len(b) - both) - _EPS


def _spanning(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of texts of different labels that are as similar; their links join all such pairs and labels."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    both = np.zeros((n, n), dtype=np.float32)
    h, own = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    column = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    often = np.bincount(column) > 1 if len(h) else np.zeros(0, bool)  # what one text has alone is in no intersection
    column, own = (np.cumsum(often) - 1)[column[often[column]]], own[often[column]]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [c, c + _COLUMNS])
        part = np.zeros((n, _COLUMNS), dtype=np.float32)
        part[own[a:b], column[a:b] - c] = 1
        both += part @ part.T  # counts of at most _COLUMNS each: exact in float32 below 2^24
    close = (both >= similarity * (sizes[:, None] + sizes[None, :] - both) - _EPS) & (label[:, None] != label[None, :])
    np.fill_diagonal(close, False)
    names, group = np.unique(label, return_inverse=True)
    root, out = list(range(len(names))), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in np.argwhere(np.triu(close)).tolist():
        a, b = top(int(group[i])), top(int(group[j]))
        if a != b:
            root[a] = b
            out.append((i, j))
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Runs of equal keys of sorted batches as (key, whether it goes on from the batch before, rows)."""
    before = None
    for batch in batches:
        told = list(zip(*(batch.column(i).to_pylist() for i in keys), strict=True))
        start = 0
        for i in range(1, len(told) + 1):
            if i == len(told) or told[i] != told[start]:
                yield told[start], told[start] == before, batch.slice(start, i - start)
                before, start = told[start], i


def _check_stars(stars: DataFrame, pool: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The (point, leader) of stars whose texts are as similar. A leader of very many meets them in parts."""
    sized = stars.join(pool.select("point", "text", "bytes"), "point")
    parts = sized.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / _PART), F.ceil(F.sum("bytes") / _PART_BYTES)).cast("int").alias("parts"))
    members = sized.join(parts, "leader").select("leader", F.pmod(F.xxhash64("point"), "parts").cast("int").alias("part"), F.lit(1).alias("turn"), "point", "text")
    heads = pool.join(parts, F.col("point") == F.col("leader")).select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"), "point", "text")
    dealt = members.union(heads).repartition("leader", "part").sortWithinPartitions("leader", "part", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for (leader, _), goes_on, rows in _grouped(batches, [0, 1]):
            points = rows.column(3).to_pylist()
            sets = list(shingle_sets(rows.column(4).to_pylist(), shingle))
            if not goes_on:
                head, points, sets = sets[0], points[1:], sets[1:]
            kept = [p for p, s in zip(points, sets, strict=True) if alike(head, s, similarity)]
            if kept:
                yield pa.record_batch([pa.array(kept, pa.int64()), pa.array([leader] * len(kept), pa.int64())], names=["u", "v"])

    return small_batches(dealt).mapInArrow(run, "u long, v long")


def _check_all(rest: DataFrame, pool: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links among the members (bucket, point, label) of each bucket, of all pairs of different labels.

    A bucket is cut in parts of bounded size, and each two parts meet in a task of their own.
    """
    # Anchors with the same members are one.
    own = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("point").cast("decimal(38,0)")).alias("sum"))
    own = own.groupBy("n", "sum").agg(F.min("bucket").alias("bucket")).select("bucket")
    rows = rest.join(own, "bucket").join(pool, "point")
    parts = rows.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / _PART), F.ceil(F.sum("bytes") / _PART_BYTES)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("point", "bucket"), "parts").cast("int")
    rows = rows.join(parts, "bucket").select("bucket", "point", "label", "text", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = rows.select("bucket", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "point", "label", "text")
    dealt = dealt.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])

        def told() -> Iterator[pa.RecordBatch]:
            points, labels, sets = held
            if len(points) > 1:
                links_ = _spanning(sets, np.array(labels), similarity)
                if links_:
                    yield pa.record_batch([pa.array([points[i] for i, _ in links_], pa.int64()), pa.array([points[j] for _, j in links_], pa.int64())], names=["u", "v"])

        for _, goes_on, rows in _grouped(batches, [0, 1, 2]):
            if not goes_on:
                yield from told()
                held = ([], [], [])
            held[0].extend(rows.column(3).to_pylist())
            held[1].extend(rows.column(4).to_pylist())
            held[2].extend(shingle_sets(rows.column(5).to_pylist(), shingle))
        yield from told()

    return small_batches(dealt).mapInArrow(run, "u long, v long")


def _open(met: DataFrame, labels: DataFrame) -> DataFrame:
    """met with labels, without the buckets whose members all have one."""
    told = met.join(labels, "point", "left").withColumn("label", F.coalesce("label", "point"))
    split = told.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", "n")
    return told.join(split, "bucket")


def _dealt(large: DataFrame, pool: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Buckets (bucket, point, label) cut to smaller ones, in which all pairs that are as similar still meet.

    With all shingles in one order, two sets of at least that similarity have one in common among
    the first |x| - ceil(similarity * |x|) + 1 of each (prefix filtering, Chaudhuri et al. 2006).
    Here rare shingles come first, as counted by some bits of their hashes, so few texts share one
    of those. Any order loses no pair. A bucket whose parts would cost more than it stays whole.
    """
    texts = cut(large.select("point").distinct().join(pool, "point").select("point", "text"))
    shift = np.uint64(64 - _SLOT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _SLOT, dtype=np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(1).to_pylist(), shingle):
                np.add.at(total, (s >> shift).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "n"])

    counted = small_batches(texts).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # of 2 ** _SLOT rows at most
    often = np.zeros(1 << _SLOT, dtype=np.int64)
    often[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = []
            for s in shingle_sets(batch.column(1).to_pylist(), shingle):
                most = len(s) - int(np.ceil(similarity * len(s) - _EPS)) + 1 if len(s) else 0
                firsts.append(s[np.lexsort((s, often[(s >> shift).astype(np.int64)]))[:most]].view(np.int64).tolist())
            yield pa.record_batch([batch.column(0), pa.array(firsts, pa.list_(pa.int64()))], names=["point", "tokens"])

    tokens = small_batches(texts).mapInArrow(first, "point long, tokens array<long>")
    dealt = cut(large.join(tokens, "point").select("bucket", "point", "label", F.explode("tokens").alias("token")))
    members = F.sum(F.xxhash64("point").cast("decimal(38,0)")).alias("sum")
    parts = dealt.groupBy("bucket", "token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), members).where("lo <> hi")
    parts = cut(parts.groupBy("bucket", "n", "sum").agg(F.min("token").alias("token")))  # parts with the same members are one
    work = F.col("n") * (F.col("n") + _PART).cast("double")  # comparisons, and texts that are sent
    whole = large.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", work.alias("own"))
    plan = cut(parts.groupBy("bucket").agg(F.sum(work).alias("cost")).join(whole, "bucket").select("bucket", (F.col("cost") < F.col("own")).alias("apart")))
    split = dealt.join(parts.join(plan.where("apart"), "bucket").select("bucket", "token"), ["bucket", "token"]).select(F.xxhash64("bucket", "token").alias("bucket"), "point", "label")
    return split.union(large.join(plan.where("not apart").select("bucket"), "bucket").select("bucket", "point", "label"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, rounds: int = 2, most_direct: int = 4096) -> DataFrame:
    """One row for each row of docs: id_col, tag, component_id (as in near_duplicates()).

    tag is the XXH64 of the text. Texts are linked whose distinct word shingles have at least the
    Jaccard similarity asked for. Candidates meet at anchors of sampled fingerprints, and each is
    checked by its shingles' hashes. First, `rounds` times, the members of an anchor are checked
    against one of them, that which stands at the most populous anchors; then anchors whose members
    are not yet linked to each other are searched whole. Of these, anchors of over most_direct
    members are first cut to smaller groups that lose no pair; most_direct changes the cost alone.

    Texts of the same shingles are linked always; null and wordless texts are equal. Null ids,
    repeated rows, empty tables and other columns are treated as in near_duplicates().
    """
    text = F.col(text_col).cast("binary")
    kind = type_of(docs, id_col)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(2).to_pylist(), shingle))
            marks = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            yield pa.record_batch([*batch.columns[:2], marks, _anchored(sets, *SAMPLES, 1)], names=["id", "tag", "mark", "buckets"])

    marked = cut(small_batches(source).mapInArrow(mark, f"id {kind}, tag long, mark binary, buckets array<long>"))
    head = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "tag")).alias("head")
    points = cut(marked.groupBy("mark").agg(head, F.first("buckets").alias("buckets")).withColumn("point", F.monotonically_increasing_id()))
    buckets = points.select("point", F.explode("buckets").alias("bucket"))
    met = buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")
    met = cut(met.join(met.groupBy("point").agg(F.sum("n").alias("score")), "point").select("bucket", "point", "score"))
    # Ids are told by their hash beside the text's, so that null ones meet and rows of an id and text stay together.
    named = met.select("point").distinct().join(points, "point").select("point", F.col("head.tag").alias("tag"), F.xxhash64("head.id").alias("key"))
    texts = source.select("tag", F.xxhash64("id").alias("key"), "text").join(named, ["tag", "key"]).dropDuplicates(["tag", "key"])
    pool = cut(texts.select("point", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")))
    free(docs.sparkSession)

    edges = docs.sparkSession.createDataFrame([], "u long, v long")
    labels = docs.sparkSession.createDataFrame([], "point long, label long")
    now, leaders = met.withColumn("label", F.col("point")), None
    for _ in range(rounds):
        if leaders is not None:
            led = leaders.select("bucket", F.col("l.point").alias("point")).join(labels, "point", "left").select("bucket", F.coalesce("label", "point").alias("done"))
            now = cut(_open(met, labels).join(led, "bucket").where("label <> done").select("bucket", "point", "score", "label"))
        leaders = now.groupBy("bucket").agg(F.max_by(F.struct("point", "label"), F.struct("score", -F.col("point"))).alias("l"))
        against = now.join(leaders, "bucket").where("label <> l.label").select("point", F.col("l.point").alias("leader"), "bucket")
        stars = cut(against.select("point", "leader").distinct())
        edges = cut(edges.union(_check_stars(stars, pool, shingle, similarity)))
        labels = components(edges).select(F.col("node").alias("point"), F.col("component").alias("label"))
    rest = cut(_open(met, labels).select("bucket", "point", "label", "n"))
    direct = rest.where(F.col("n") <= most_direct).select("bucket", "point", "label")
    large = cut(rest.where(F.col("n") > most_direct).select("bucket", "point", "label"))
    if not large.isEmpty():
        direct = direct.union(_dealt(large, pool, shingle, similarity))
    free(docs.sparkSession)
    edges = cut(edges.union(_check_all(direct, pool, shingle, similarity)))
    labels = components(edges).select(F.col("node").alias("point"), F.col("component").alias("label"))
    placed = points.join(labels, "point", "left").select("mark", "head", F.coalesce("label", "point").alias("label"))
    roots = placed.groupBy("label").agg(F.min("head").alias("least")).select("label", F.col("least.id").alias("component_id"), F.col("least.tag").alias("component_tag"))
    found = marked.join(placed.join(roots, "label").select("mark", "component_id", "component_tag"), "mark")
    return found.select(F.col("id").alias(id_col), "tag", "component_id", "component_tag")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one row of each component of near_copies(): that with the least id stays.

    Null ids come last; of rows of an id those with the least hash of the text; rows of the same
    id and text are one.
    """
    found = near_copies(docs, id_col, text_col, shingle, similarity)
    # The joined names must not clash with any column of docs.
    taken = "_" * (1 + max(map(len, docs.columns)))
    own = [f"{taken}id", f"{taken}tag"]
    heads = found.where(F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("tag") == F.col("component_tag"))).select(F.xxhash64(F.col(id_col)).alias(own[0]), F.col("tag").alias(own[1])).distinct()
    marked = docs.withColumn(own[0], F.xxhash64(F.col(id_col))).withColumn(own[1], F.xxhash64(F.col(text_col).cast("binary")))
    return marked.join(heads, own, "left_semi").dropDuplicates(own).select(*docs.columns)
