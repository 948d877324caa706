"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade > k | x) = sigmoid(w.x - theta_k) with thresholds theta_0 <= theta_1 <= ...: one weight
for each word, shared by all thresholds. The model is fitted on a bounded sample of labelled
rows; every document is scored over its whole text.
"""

from __future__ import annotations

import re
from sys import intern
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, type_of

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The distinct runs of letters of a text, in lower case."""
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[str]:
    """A word, and its beginnings of 3 to 7 letters marked by an asterisk: inflected forms share these."""
    return [word, *(f"{word[:k]}*" for k in range(3, min(8, len(word))))]


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: list[float]
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def severities(self, text: str | None) -> list[float]:
        """P(grade > k) for each threshold k."""
        present: set[str] = set()
        known = self._known
        for w in words(text):
            own = known.get(w)
            if own is None:
                own = tuple(f for f in features(w) if f in self.weights)
                if len(known) < 200_000:
                    known[w] = own
            if own:
                present.update(own)
        z = sum([self.weights[f] for f in sorted(present)])
        return [1.0 / (1.0 + np.exp(-np.clip(z - t, -60, 60))) for t in self.thresholds]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, grade_col: str, most: int) -> list[tuple[int, set[str]]]:
    """At most `most` labelled rows, those with the least hashes of their ids; copies are told once.

    Near copies would pass off their own words as signs of a grade, so of rows of a grade whose
    least hash over 3-word shingles (under either of two seeds) agrees, one stays.
    """
    graded = labels.select(F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("grade")).where("grade is not null and _id is not null")
    chosen = graded.groupBy("_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(chosen), "_id")  # at most `most` ids
    # Rows that repeat an id are one: that with the least hash of its text.
    rows = rows.groupBy("_id", "grade").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, grade in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = text.lower().split()
                shingles = [" ".join(w[i : i + 3]).encode("utf-8", "replace") for i in range(max(1, len(w) - 2))]
                least = [min(xxhash.xxh64_intdigest(s, seed) for s in shingles) >> 1 for seed in (1, 2)]
                out.append({"_id": key, "grade": grade, "a": least[0], "b": least[1], "words": " ".join(sorted(words(text)))})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("_id", batch.schema.field(0).type), ("grade", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("words", pa.string())]))

    kind = type_of(docs, id_col)
    found = small_batches(rows.select("_id", "_text", "grade")).mapInArrow(told, f"_id {kind}, grade int, a long, b long, words string")
    seen: set[tuple[int, int, int]] = set()
    kept = []
    for r in sorted(found.collect(), key=lambda r: str(r["_id"])):  # at most `most` rows
        keys = {(r["grade"], 0, r["a"]), (r["grade"], 1, r["b"])}
        if not keys & seen:
            kept.append((r["grade"], set(map(intern, r["words"].split()))))
        seen |= keys
    return kept


def telling(rows: list[tuple[int, set[str]]], least_grade: int, least_df: int = 4) -> list[str]:
    """Features whose rate among rows of at least a grade differs from chance.

    The bound is what the largest of so many score tests reaches by chance, sqrt(2 log features)
    deviations, as else the many rare features learn single labels by heart.
    """
    if not rows:
        return []
    # Features are counted by their hashes, as there are many and few will tell.
    own = [np.unique(np.array([_hash(f) for w in ws for f in features(w)], dtype=np.uint64)) for _, ws in rows]
    high = np.repeat(np.array([g >= least_grade for g, _ in rows]), [len(h) for h in own])
    known, place, df = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    high_df = np.bincount(place, weights=high, minlength=len(known))
    mean = sum(g >= least_grade for g, _ in rows) / len(rows)
    common = df >= least_df
    bound = np.sqrt(2 * np.log(max(int(common.sum()), 2)))
    far = np.abs(high_df - df * mean) / np.sqrt(df * (1 - df / len(rows)) * mean * (1 - mean) + 1e-9)
    told = dict(zip(known[common & (far > bound)].tolist(), df[common & (far > bound)].tolist(), strict=True))
    named = {f: told[h] for _, ws in rows for w in ws for f in features(w) if (h := _hash(f)) in told}
    return sorted(named, key=lambda f: (-named[f], f))


def _hash(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode())


def severity_grades(rows: list[tuple[int, set[str]]], levels: int = 3) -> list[tuple[int, set[str]]]:
    """Rows with a plain flag (0 or 1) as grades 0 .. levels - 1.

    Flagged rows are divided by how many telling words they have, at equal shares of those that
    have any; flagged rows without one have grade 1.
    """
    signs = set(telling(rows, 1))
    counts = [sum(any(f in signs for f in features(w)) for w in ws) if g else 0 for g, ws in rows]
    some = sorted(c for (g, _), c in zip(rows, counts, strict=True) if g and c)
    bounds = [some[len(some) * k // (levels - 1)] for k in range(1, levels - 1)] if some else []
    return [(1 + sum(c > b for b in bounds) if g else 0, ws) for (g, ws), c in zip(rows, counts, strict=True)]


def fit_ordinal(rows: list[tuple[int, set[str]]], l2: float = 0.03, steps: int = 300, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty on the weights, by full-batch Adam.

    rows: (grade, words). Features are the presence of telling words and beginnings of words.
    No rows, or one grade only, give a model without weights.
    """
    grades = sorted({g for g, _ in rows})
    if len(grades) < 2:
        return OrdinalModel({}, [30.0 if not grades or grades[0] <= 0 else -30.0])
    cuts = grades[:-1]
    y = np.array([g for g, _ in rows])
    vocabulary = telling(rows, grades[1])
    index = {w: i for i, w in enumerate(vocabulary)}
    found = [sorted({index[f] for w in ws for f in features(w) if f in index}) for _, ws in rows]
    at = np.array([i for f in found for i in f], dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    over = np.array([y > c for c in cuts], dtype=float)  # cuts x rows
    share = np.clip(over.mean(axis=1), 1e-4, 1 - 1e-4)
    theta = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(len(vocabulary)), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    nv, n = len(vocabulary), len(rows)
    for step in range(1, steps + 1):
        w, theta = p[:nv], np.concatenate([[p[nv]], p[nv] + np.cumsum(np.exp(p[nv + 1 :]))])
        z = np.bincount(row, weights=w[at], minlength=n)
        s = 1 / (1 + np.exp(-np.clip(z[None, :] - theta[:, None], -60, 60)))  # P(y > cut)
        upper = np.vstack([np.ones(n), s])
        lower = np.vstack([s, np.zeros(n)])
        k = over.sum(axis=0).astype(int)  # the grade's place
        i = np.arange(n)
        prob = np.maximum(upper[k, i] - lower[k, i], 1e-12)
        slope_up = upper[k, i] * (1 - upper[k, i])
        slope_low = lower[k, i] * (1 - lower[k, i])
        g_z = -(slope_up - slope_low) / prob
        g_theta = np.zeros(len(cuts))
        np.add.at(g_theta, k[k > 0] - 1, (slope_up / prob)[k > 0])
        np.add.at(g_theta, k[k < len(cuts)], -(slope_low / prob)[k < len(cuts)])
        g_w = np.bincount(at, weights=g_z[row], minlength=nv) / n + l2 * w / n
        gaps = np.exp(p[nv + 1 :])
        g_rest = np.concatenate([[g_theta.sum()], [g_theta[j + 1 :].sum() * gaps[j] for j in range(len(gaps))]]) / n
        g = np.concatenate([g_w, g_rest])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta = np.concatenate([[p[nv]], p[nv] + np.cumsum(np.exp(p[nv + 1 :]))])
    return OrdinalModel({w: float(x) for w, x in zip(vocabulary, p[:nv], strict=True) if abs(x) > 1e-3}, [float(t) for t in theta])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", most: int = 4000) -> OrdinalModel:
    """A model fitted on at most `most` labelled rows: the documented bound of the sample.

    Labels that only flag rows (grades 0 and 1) are divided further by severity_grades().
    """
    rows = _sample(docs, labels, id_col, text_col, grade_col, most)
    if {g for g, _ in rows} <= {0, 1}:
        rows = severity_grades(rows)
    return fit_ordinal(rows)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """One row for each row of docs: id_col, expected_severity, p_toxic, grade, toxic.

    expected_severity is the sum of P(grade > k); grade counts the thresholds passed with at
    least reject_at; toxic is grade > 0. A null or empty text has no words and gets what the
    thresholds alone say. Repeated rows are scored alike; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # telling words of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            p = np.array([held.value.severities(texts[i].as_py()) for i in range(len(texts))]).reshape(len(texts), -1)
            grade = np.minimum.accumulate(p >= reject_at, axis=1).sum(axis=1)
            yield pa.record_batch([batch.column(0), pa.array(p.sum(axis=1).round(6)), pa.array(p[:, 0].round(6)), pa.array(grade, pa.int32()), pa.array(grade > 0)], names=[id_col, "expected_severity", "p_toxic", "grade", "toxic"])

    source = small_batches(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")))
    return source.mapInArrow(run, f"`{id_col}` {type_of(docs, id_col)}, expected_severity double, p_toxic double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """docs without those that score() calls toxic; all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            clean = [held.value.severities(texts[i].as_py())[0] < reject_at for i in range(len(texts))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
