"""Language ID as a mixture: each document's language proportions by expectation-maximisation.

A document is a bag of words, each drawn from one language with the likelihood of its byte
n-grams. EM estimates the proportions; sets of one, two, ... of the likeliest languages are
compared by penalised likelihood, and the main language of the best set is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, type_of

UNDETERMINED = "und"
BUCKETS = 1 << 15
#: Each language takes 128 KB of the table that all tasks hold.
_MOST_LANGUAGES = 1000
_PIECE = 1 << 18  # bytes that are worked on together


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # languages x BUCKETS, float32


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngrams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigram around each byte of a word, and where each word starts among them.

    Words are runs of bytes over 0x20 that hold a letter byte (a-z or part of a longer character).
    """
    inner = raw > 32
    inner &= ~((raw >= 48) & (raw <= 57))
    padded = np.concatenate([[False], inner, [False]])
    change = np.flatnonzero(padded[1:] != padded[:-1])
    starts, ends = change[::2], change[1::2]
    letter = np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122) | (raw >= 128))])
    good = letter[ends] > letter[starts]
    starts, ends = starts[good], ends[good]
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, sizes)
    code = np.concatenate([[32], np.where(inner, raw, 32), [32]]).astype(np.uint32)
    three = (code[at] << 16) | (code[at + 1] << 8) | code[at + 2]
    return ((three * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), np.stack([starts, offsets[:-1]])


def _buffer(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lower-case UTF-8, a newline after each, and where each starts."""
    parts = [(t or "").lower().encode("utf-8", "replace") + b"\n" for t in texts]
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _parts(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about _PIECE bytes that end after white space, or where there is none for as long."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        space = np.flatnonzero(raw[end : end + _PIECE] <= 32)
        end = end + int(space[0]) + 1 if len(space) else min(len(raw), end + _PIECE)
        yield at, end
        at = end


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", most_per_lang: int = 2000) -> LanguageModel:
    """N-gram counts of about most_per_lang documents of each language: the documented bound of the sample.

    The sample takes documents by a hash of key_col, at the rate that the counts of all
    documents give. Rows with a null text or language teach nothing. No rows: no languages.
    """
    taught = docs.select(F.col(key_col).cast("string").alias("_k"), F.col(text_col).cast("string").alias("_t"), F.col(lang_col).cast("string").alias("_l")).where("_l is not null and _t is not null")
    counts = {r["_l"]: r["n"] for r in taught.groupBy("_l").agg(F.count("*").alias("n")).limit(_MOST_LANGUAGES + 1).collect()}
    if len(counts) > _MOST_LANGUAGES:
        raise ValueError("more languages than a table of likelihoods can hold")
    if not counts:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32))
    languages = sorted(counts)
    rate = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, most_per_lang / counts[k]))]), F.col("_l"))
    sample = taught.where(F.pmod(F.xxhash64(F.col("_k"), F.lit("sample")), F.lit(1_000_000)) < rate * 1_000_000).select("_l", "_t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, _ = ngrams(_buffer([text])[0])
                sums[lang] = sums.get(lang, np.zeros(BUCKETS, np.int64)) + np.bincount(found, minlength=BUCKETS)
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(total[some])], names=["lang", "bucket", "n"])

    summed = small_batches(sample).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages), BUCKETS))
    place = {k: i for i, k in enumerate(languages)}
    for r in summed.toLocalIterator():  # at most BUCKETS rows for each language
        table[place[r["lang"]], r["bucket"]] = r["n"]
    smoothed = table + 0.5
    log_p = np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32)
    return LanguageModel(languages, log_p)


def _em(lik: np.ndarray, doc: np.ndarray, starts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document (documents x languages), over allowed languages."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    for step in range(rounds + 1):
        joint = lik * pi[doc]
        total = joint.sum(axis=1)
        if step == rounds:
            return pi, np.add.reduceat(np.log(np.maximum(total, 1e-30)), starts)
        joint /= np.maximum(total, 1e-30)[:, None]
        pi = np.add.reduceat(joint, starts, axis=0) / sizes[:, None]
        pi = np.where(allowed > 0, pi, 0)
    raise AssertionError


def mixtures(texts: list[str | None], model: LanguageModel, penalty: float = 4.0, rounds: int = 8) -> list[tuple[str, float, list[str], list[float]]]:
    """(main language, its proportion, languages of the best set, their proportions) for each text."""
    out: list[tuple[str, float, list[str], list[float]]] = [(UNDETERMINED, 0.0, [], [])] * len(texts)
    count = len(model.languages)
    if not count:
        return out
    raw, bounds = _buffer(texts)
    likely, begins = [np.zeros((0, count), np.float32)], [np.zeros(0, np.int64)]
    for a, b in _parts(raw):  # so that n-grams of a long text don't stand side by side
        found, (begin, offsets) = ngrams(raw[a:b])
        if len(begin):
            likely.append(np.add.reduceat(model.log_p[:, found], offsets, axis=1).T)
            begins.append(begin + a)
    words_ll = np.concatenate(likely)
    doc_of = np.searchsorted(bounds, np.concatenate(begins), side="right") - 1
    present, starts, sizes = np.unique(doc_of, return_index=True, return_counts=True)
    if len(present):
        top = words_ll.max(axis=1, keepdims=True)
        lik = np.exp(words_ll - top)
        doc = np.repeat(np.arange(len(present)), sizes)
        n = sizes.astype(np.float32)
        pi, _ = _em(lik, doc, starts, n, np.ones((len(present), count), np.float32), rounds)
        order = np.argsort(-pi, axis=1, kind="stable")
        rank = np.argsort(order, axis=1)
        best_ll, best_pi = None, None
        for size in range(1, count + 1):  # until one more language helps no text
            allowed = (rank < size).astype(np.float32)
            p, ll = _em(lik, doc, starts, n, allowed, 0 if size == 1 else rounds)
            ll = ll - penalty * (size - 1) * np.log(n + 1)
            if best_ll is None:
                best_ll, best_pi = ll, p
            else:
                better = ll > best_ll
                if not better.any():
                    break
                best_ll, best_pi = np.where(better, ll, best_ll), np.where(better[:, None], p, best_pi)
        for i, d in enumerate(present):
            kept = [int(k) for k in np.argsort(-best_pi[i], kind="stable") if best_pi[i, k] > 0]
            shares = [float(best_pi[i, k]) for k in kept]
            out[d] = (model.languages[kept[0]], min(1.0, shares[0]), [model.languages[k] for k in kept], shares)
    for i, t in enumerate(texts):
        if out[i][0] == UNDETERMINED and has_letter(t):
            out[i] = (model.languages[0], 0.0, [], [])  # letters without a word of bytes: no evidence
        elif out[i][0] != UNDETERMINED and not has_letter(t):
            out[i] = (UNDETERMINED, 0.0, [], [])
    return out


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, lang_pred, score, langs, shares.

    lang_pred is the main language of the selected set and score its proportion; langs and
    shares tell the whole set. A null text, or one without a letter, is `und` with score 0.
    Repeated rows are predicted alike; an empty table gives none; no other column is read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):  # pieces of bounded size; a long text is a piece of its own
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= _PIECE):
                    size += len(texts[end] or "")
                    end += 1
                found = mixtures(texts[at:end], held.value)
                made = [pa.array([x[0] for x in found], pa.string()), pa.array([round(x[1], 6) for x in found], pa.float64()), pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array([[round(y, 6) for y in x[3]] for x in found], pa.list_(pa.float64()))]
                yield pa.record_batch([batch.column(0).slice(at, end - at), *made], names=[id_col, "lang_pred", "score", "langs", "shares"])
                at = end

    source = small_batches(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")))
    return source.mapInArrow(run, f"`{id_col}` {type_of(docs, id_col)}, lang_pred string, score double, langs array<string>, shares array<double>")
