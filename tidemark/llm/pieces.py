"""SentencePiece encoding and decoding of BPE models by suffix-array matching.

The distinct segments of a batch are laid end to end and indexed by a suffix array (sorted by
doubling, as far as the longest piece); every piece of the vocabulary is found in it by binary
search, its range of suffixes gives its occurrences, and these edges are sorted by position and
relaxed from left to right. An edge from i to j is taken if its piece is stable beside the last
piece of i, i.e. no merge of the model crosses the two; each position then has exactly one last
piece, and following these back from the end gives the very ids of the model's own merges.

Pieces have the space mark at their start only, so text falls into segments (marks and what
follows them) that are encoded alone; line breaks are outside the alphabet and cut as well.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, trim, type_of

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_FAR = 1 << 40
_BLOCK = 150_000  # characters that are indexed together
_SPLIT = 1 << 18  # characters that are split together
_HELD = 1 << 21  # characters of distinct segments that are encoded together
_KNOWN_MOST = 60_000
_CACHE_BITS = 20


def _segments(text: str) -> Iterator[list[str]]:
    """The segments of text, those of about _SPLIT characters at a time."""
    at, size = 0, _SPLIT
    while at < len(text):
        own = _SEGMENT.findall(text, at, at + size)
        if at + size < len(text):
            if len(own) == 1:
                size *= 2
                continue
            own.pop()  # it may go on
        yield own
        at, size = at + sum(map(len, own)), _SPLIT


@dataclass
class PieceModel:
    """A vocabulary with the splits by which its merges build each piece."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]  # of <0x00> to <0xFF>
    unk_id: int
    cut_marks: bool = True
    known: dict[str, bytes] = field(default_factory=dict)  # ids of the segments met last
    known_before: dict[str, bytes] = field(default_factory=dict)  # and of those before

    def __post_init__(self) -> None:
        own = [i for i, ok in enumerate(self.normal) if ok]
        self.place = {self.pieces[i]: i for i in own}
        order = {s: r for r, s in enumerate(sorted({-self.scores[i] for i in own if len(self.pieces[i]) > 1}))}
        #: When a piece is merged: equal scores are merged from left to right. Characters are there from the start.
        self.rank = np.array([order[-self.scores[i]] if self.normal[i] and len(p) > 1 else -1 for i, p in enumerate(self.pieces)] + [-1], dtype=np.int64)
        alphabet = sorted({c for i in own for c in self.pieces[i]})
        self.code = {c: i + 2 for i, c in enumerate(alphabet)}  # 0: between segments; 1: unknown
        self.width = max(1, (len(alphabet) + 2).bit_length())
        self.longest = max((len(self.pieces[i]) for i in own), default=1)
        self.left = np.full(len(self.pieces) + 1, -1, dtype=np.int64)
        self.right = self.left.copy()
        reached, plain = [], np.ones(len(self.pieces) + 1, dtype=bool)
        for i in own:
            p = self.pieces[i]
            if len(p) == 1:
                reached.append(i)
                continue
            parts, last = self._merge(list(p))
            if len(parts) == 1:
                self.left[i], self.right[i] = self.place.get(last[0], -1), self.place.get(last[1], -1)
                plain[i] = self.left[i] >= 0 and self.right[i] >= 0 and self.rank[self.left[i]] < self.rank[i] and self.rank[self.right[i]] < self.rank[i]
                reached.append(i)
        # A piece is plain if its merges happen in the order of their ranks, all the way down.
        for i in sorted(reached, key=lambda i: len(self.pieces[i])):
            if self.left[i] >= 0:
                plain[i] &= plain[self.left[i]] and plain[self.right[i]]
        self.plain, self.own = plain, np.array(sorted(reached), dtype=np.int64)
        n = len(self.pieces) + 1
        pairs = {}
        for i in own:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self.place.get(p[:k]), self.place.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = self.rank[i]
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        per = 63 // self.width
        self.per_key = per
        levels = -(-self.longest // per)
        self.piece_keys = np.zeros((levels, len(self.own)), dtype=np.int64)
        self.piece_masks = self.piece_keys.copy()
        for j, i in enumerate(self.own.tolist()):
            p = self.pieces[i]
            for at in range(levels):
                for k in range(per):
                    x = at * per + k
                    shift = self.width * (per - 1 - k)
                    if x < len(p):
                        self.piece_keys[at, j] |= self.code[p[x]] << shift
                        self.piece_masks[at, j] |= ((1 << self.width) - 1) << shift
        #: Characters that stand together in some piece; between others no merge can reach.
        self.bonds = np.unique(np.array([(self.code[a] << 32) | self.code[b] for i in own for a, b in zip(self.pieces[i], self.pieces[i][1:], strict=False)], dtype=np.int64))
        self.piece_sizes = np.array([len(self.pieces[i]) for i in self.own.tolist()], dtype=np.int64)
        self._forget()
        self.spelled = [bytes([self.byte_ids.index(i)]) if i in set(self.byte_ids) else p.encode() for i, p in enumerate(self.pieces)] if self.byte_ids else [p.encode() for p in self.pieces]

    def _forget(self) -> None:
        self.cache_keys = np.full(1 << _CACHE_BITS, -1, dtype=np.int64)
        self.cache_values = np.zeros(1 << _CACHE_BITS, dtype=bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("cache_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _merge(self, parts: list[str]) -> tuple[list[str], tuple[str, str]]:
        """Merges as the model does, best score first and from the left; with the last pair merged."""
        last = ("", "")
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.place.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.scores[j] > best):
                    best, at = self.scores[j], i
            if at < 0:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses pieces a and b that stand together. -1: an unknown character or none."""
        n = len(self.pieces) + 1
        out = np.ones(len(a), dtype=bool)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[todo] * n + b[todo]
        slot = (key * 0x9E3779B1 >> 7) & ((1 << _CACHE_BITS) - 1)
        hit = self.cache_keys[slot] == key
        out[todo[hit]] = self.cache_values[slot[hit]]
        new, back = np.unique(key[~hit], return_inverse=True)
        if len(new):
            told = self._stable(new // n, new % n)
            out[todo[~hit]] = told[back]
            slot = (new * 0x9E3779B1 >> 7) & ((1 << _CACHE_BITS) - 1)
            self.cache_keys[slot] = new
            self.cache_values[slot] = told
            wrong = self.cache_keys[slot] != new  # of two pairs with a slot the last stays, value and all
            self.cache_values[slot[~wrong]] = told[~wrong]
        return out

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Goes back through the merges that built the pieces beside the border, latest first."""
        out = np.ones(len(a), dtype=bool)
        odd = ~(self.plain[a] & self.plain[b])
        for i in np.flatnonzero(odd).tolist():
            x, y = self.pieces[a[i]], self.pieces[b[i]]
            out[i] = self._merge(list(x + y))[0] == [x, y]
        live = np.flatnonzero(~odd)
        x, y = a[live].copy(), b[live].copy()
        limit = np.full(len(live), _FAR)  # a crossing merge of a rank under this comes first
        n = len(self.pieces) + 1
        while len(live):
            key = x * n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
            crossed = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit) if len(self.pair_keys) else np.zeros(len(live), bool)
            out[live[crossed]] = False
            # The later of the two was merged last; of equal ranks the left one came first.
            right_last = self.rank[y] >= self.rank[x]
            ends = np.where(right_last, self.rank[y] < 0, False)  # both are characters
            go = ~crossed & ~ends
            limit = np.where(right_last, self.rank[y] + 1, self.rank[x])[go]
            x, y, right_last, live = x[go], y[go], right_last[go], live[go]
            x, y = np.where(right_last, x, self.right[x]), np.where(right_last, self.left[y], y)
        return out

    def _loose(self, segment: str) -> list[str]:
        """A very long segment in parts of about _BLOCK characters, cut where no merge can reach across."""
        codes = self._codes(np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        free = np.flatnonzero(~np.isin((codes[:-1] << 32) | codes[1:], self.bonds)) + 1
        cuts, at = [0], 0
        while len(segment) - at > _BLOCK:
            k = int(np.searchsorted(free, at + _BLOCK // 2))
            if k == len(free):
                break
            at = int(free[k])
            cuts.append(at)
        return [segment[a:b] for a, b in zip(cuts, [*cuts[1:], len(segment)], strict=True)]

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment, of 32 bits. Blocks are bounded but for a segment that has no place to cut."""
        if any(len(s) > _BLOCK for s in segments):
            parts = [self._loose(s) if len(s) > _BLOCK else [s] for s in segments]
            told = iter(self._encode_blocks([x for p in parts for x in p]))
            return [b"".join([next(told) for _ in p]) for p in parts]
        return self._encode_blocks(segments)

    def _encode_blocks(self, segments: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(segments):
            end, size = at, 0
            while end < len(segments) and (end == at or size + len(segments[end]) < _BLOCK):
                size += len(segments[end]) + 1
                end += 1
            out += self._encode_block(segments[at:end])
            at = end
        return out

    def _encode_block(self, segments: list[str]) -> list[bytes]:
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = "\n".join(segments) + "\n"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self._codes(points)
        codes[begin + sizes] = 0
        n = len(codes)
        # 1. The suffix array, by doubling.
        per, room = self.per_key, np.concatenate([codes, np.zeros(self.longest + 2 * self.per_key, dtype=np.int64)])
        keys = np.zeros(n + self.longest + self.per_key, dtype=np.int64)
        for k in range(per):
            keys[:n] |= room[k : k + n] << (self.width * (per - 1 - k))
        order = np.argsort(keys[:n])
        span, sorted_keys = per, keys[:n][order]
        while span < self.longest:
            rank = np.zeros(n + span, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])]) + 1
            both = rank[:n] * (n + 1) + rank[span : span + n]
            order = np.argsort(both)
            sorted_keys, span = both[order], 2 * span
        # 2. Each piece's range of suffixes, by binary search.
        low, high = self._ranges(keys, order)
        counts = high - low
        which = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        where = order[low[which] + inside]
        # 3. Edges sorted by position in their segments; unknown characters are edges of their own.
        owner = np.repeat(np.arange(len(segments)), sizes + 1)
        odd = np.flatnonzero(codes == 1)
        where, piece = np.concatenate([where, odd]), np.concatenate([self.own[which], np.full(len(odd), -1)])
        size = np.concatenate([self.piece_sizes[which], np.ones(len(odd), dtype=np.int64)])
        offset = where - begin[owner[where]]
        packed = np.sort((offset << 42) | np.arange(len(offset)))
        turn = packed & ((1 << 42) - 1)
        where, piece, size, offset = where[turn], piece[turn], size[turn], packed >> 42
        # 4. Relaxed: all edges of an offset at a time.
        last, back = np.full(n + 1, -1, dtype=np.int64), np.full(n + 1, -1, dtype=np.int64)
        steps = np.flatnonzero(np.concatenate([[True], offset[1:] != offset[:-1]])) if len(offset) else np.zeros(0, int)
        for s, e in zip(steps, [*steps[1:], len(offset)], strict=True):
            p, t = where[s:e], piece[s:e]
            good = self.stable(last[p], t)
            to = p[good] + size[s:e][good]
            last[to], back[to] = t[good], p[good]
        # 5. Back from the ends of all segments at once.
        stack_piece, stack_owner = [], []
        here, own = begin + sizes, np.arange(len(segments))
        alive = here > begin
        here, own = here[alive], own[alive]
        while len(here):
            stack_piece.append(np.where(last[here] >= 0, last[here], -2 - points[np.maximum(back[here], 0)].astype(np.int64)))
            stack_owner.append(own)
            here = back[here]
            alive = here > begin[own]
            here, own = here[alive], own[alive]
        if not stack_piece:
            return [b"" for _ in segments]
        pieces, owners = np.concatenate(stack_piece[::-1]), np.concatenate(stack_owner[::-1])
        sort = np.argsort(owners, kind="stable")
        pieces, owners = pieces[sort], owners[sort]
        if (pieces < 0).any():
            pieces, owners = self._spell(pieces, owners)
        cuts = 4 * np.searchsorted(owners, np.arange(len(segments) + 1))
        ids = pieces.astype(np.int32).tobytes()
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _codes(self, points: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.ones(1 << 16, dtype=np.int64)
            for c, i in self.code.items():
                if ord(c) < 1 << 16:
                    self._table[ord(c)] = i
            self._high = {ord(c): i for c, i in self.code.items() if ord(c) >= 1 << 16}
        out = self._table[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points >= 0xFFFF).tolist():
            out[i] = self._high.get(int(points[i]), 1)
        return out

    def _ranges(self, keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffixes that begin with each piece start and end: by first keys, of long pieces by the others within."""
        first, ones = keys[order], (1 << (self.width * self.per_key)) - 1
        low = np.searchsorted(first, self.piece_keys[0])
        high = np.searchsorted(first, self.piece_keys[0] | (ones ^ self.piece_masks[0]), side="right")
        which = np.flatnonzero((self.piece_sizes > self.per_key) & (low < high))
        low[which], high[which] = (self._bound(keys, order, which, low[which], high[which], after) for after in (False, True))
        return low, high

    def _bound(self, keys: np.ndarray, order: np.ndarray, which: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while len(todo := np.flatnonzero(lo < hi)):
            mid, piece = (lo[todo] + hi[todo]) >> 1, which[todo]
            less = np.zeros(len(todo), dtype=bool)
            tied = ~less
            for level in range(1, len(self.piece_keys)):
                own = keys[order[mid] + level * self.per_key] & self.piece_masks[level, piece]
                less |= tied & (own < self.piece_keys[level, piece])
                tied &= own == self.piece_keys[level, piece]
            up = (less | tied) if after else less
            lo[todo[up]] = mid[up] + 1
            hi[todo[~up]] = mid[~up]
        return lo

    def _spell(self, pieces: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as their bytes' pieces, or as the unknown piece."""
        ids, own = [], []
        for p, o in zip(pieces.tolist(), owners.tolist(), strict=True):
            some = [p] if p >= 0 else [self.byte_ids[x] for x in chr(-2 - p).encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unk_id]
            ids += some
            own += [o] * len(some)
        return np.array(ids, dtype=np.int64), np.array(own, dtype=np.int64)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Null and empty texts have none. Of segments the distinct ones are held, up to _HELD characters."""
        out: list[list[bytes]] = [[] for _ in texts]
        place: dict[str, int] = {}
        shares, held = [], 0
        for k, t in enumerate(texts):
            for own in _segments(MARK + t.replace(" ", MARK)) if t else ():
                for s in own:
                    if s not in place:
                        place[s] = len(place)
                        held += len(s)
                shares.append((k, array("q", map(place.__getitem__, own))))
                if held >= _HELD:
                    self._encode_shares(place, shares, out)
                    place, shares, held = {}, [], 0
        self._encode_shares(place, shares, out)
        return [np.frombuffer(b"".join(x), dtype=np.int32) for x in out]

    def _encode_shares(self, place: dict[str, int], shares: list[tuple[int, array]], out: list[list[bytes]]) -> None:
        """Adds the ids of each share, the places of its segments, to those of its text."""
        ids = [self.known.get(s) or self.known_before.get(s) for s in place]
        new = [s for s, x in zip(place, ids, strict=True) if x is None]
        for s, x in zip(new, self.encode_segments(new), strict=True):
            ids[place[s]] = x
        for k, own in shares:
            out[k].append(b"".join(map(ids.__getitem__, own)))
        for s, x in zip(place, ids, strict=True):
            if len(s) <= 24:
                self.known[s] = x
                if len(self.known) >= _KNOWN_MOST:
                    self.known, self.known_before = {}, self.known

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, and the added first space goes."""
        text = b"".join([self.spelled[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def load(path: str) -> PieceModel:
    """A BPE model's vocabulary, read on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    normal = [not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i)) for i in range(n)]
    byte_ids = [i for i in range(n) if m.is_byte(i)]
    return PieceModel([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], normal, byte_ids if len(byte_ids) == 256 else [], m.unk_id())


def encode(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_tokens, token_ids, round_trip.

    round_trip tells whether decoding the ids gives the text again (a text with the space mark
    itself reads back with spaces). Null and empty texts have no ids and round_trip true.
    Repeated rows are encoded alike; an empty table gives none; no other column is read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # the size of a vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()  # of other operators, too
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = held.value.encode_batch(texts)
            same = [held.value.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts, strict=True)]
            sizes = np.array([len(i) for i in ids], dtype=np.int32)
            bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
            yield pa.record_batch([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(bounds, flat), pa.array(same, pa.bool_())], names=[id_col, "n_tokens", "token_ids", "round_trip"])
        trim()

    source = small_batches(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), 4 << 20)
    return source.mapInArrow(run, f"`{id_col}` {type_of(docs, id_col)}, n_tokens int, token_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: PieceModel, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """encoded with the text of its ids added as text_col. Null ids give a null text."""
    held = encoded.sparkSession.sparkContext.broadcast(model)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x is None else held.value.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, text_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return small_batches(encoded, 4 << 20).mapInArrow(run, f"{schema}, `{text_col}` string")
