"""Secret scans: spans of likely credentials, and who owns each value across the corpus.

A value that many owners or repositories hold is a copied example; one that few hold looks live,
as a document copied to a few other sources takes its secret along. Ownership is counted over hashes of the values, in two steps: distinct
(value, repository, owner) first, then counts for each value, so that a value in a third of all
documents is summed before it moves. Values themselves never leave the scan.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small_batches, type_of

#: Kinds in the order in which spans that start together are told. The first three are the base.
KINDS = ("assign", "access", "hex", "private_key", "jwt", "prefixed", "url_login")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_OTHERS = {
    "access": re.compile(r"AKIA[A-Z0-9]{14,}"),
    "hex": re.compile(r"[0-9a-f]{16,}"),
    "private_key": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,40}PRIVATE KEY-----"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "prefixed": re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})"),
    "url_login": re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/:@]{6,128})@"),
}
#: A text without such a part has no span of the kind; looking for it first is much quicker.
_CUES = {"access": "AKIA", "private_key": "PRIVATE KEY-----", "jwt": "eyJ", "url_login": "://"}
_KEYWORDS = ("pass", "secret", "token", "api")
#: Shared values are broadcast up to this number; each is a digest of 64 characters.
_MOST_SHARED = 50_000


def spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) by start, then kind: leftmost and non-overlapping for each kind."""
    if not text:
        return []
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    for kind, pattern in _OTHERS.items():
        if kind not in _CUES or _CUES[kind] in text:
            found += [(m.start(), m.end(), kind, m[m.lastindex or 0]) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _joined(found: list[tuple[int, int, str, str]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, _ in found if k in kinds)


_SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, values array<string>"


def scan(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id_col, the columns keep, counts, digest, spans and the SHA-256 of each span's value, in order."""
    names = [id_col, *keep]
    schema = ", ".join([*(f"`{c}` {type_of(docs, c)}" for c in names), _SCAN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(len(names)):
                found = spans(text.as_py())
                base = _joined(found, KINDS[:3])
                counts = [sum(k == x[2] for x in found) for k in KINDS[:3]]
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), _joined(found, KINDS), [hashlib.sha256(x[3].encode("utf-8", "replace")).hexdigest() for x in found]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.string())]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch([*batch.columns[: len(names)], *made], names=[*names, *(x.split()[0] for x in _SCAN.split(", "))])

    return small_batches(docs.select(*[F.col(c) for c in names], F.col(text_col).cast("string").alias("_text"))).mapInArrow(run, schema)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = 4, most_repos: int = 4) -> DataFrame:
    """One row for each row of docs: id_col, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared.

    n_live counts spans whose value at most most_owners owners and most_repos repositories hold in
    the whole corpus, n_shared the others. A null or empty text has no spans (the digest of the
    empty string, spans ''). Null owners count together as one. Repeated rows are counted alike.
    An empty table gives none; other columns, whatever their names, are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"),
        F.to_json(F.struct(*[F.col(c) for c in repo_cols])).alias("_repo"),
        F.col(text_col).alias("_text"),
    )
    found = scan(rows, "_id", "_text", ["_owner", "_repo"])
    # Rows are numbered, as ids may repeat or be null; cut() makes the number hold for both readings.
    found = cut(found.withColumn("_row", F.monotonically_increasing_id()))
    values = found.where("size(values) > 0").select("_row", "_owner", "_repo", F.explode("values").alias("value"))
    shared, few = shared_values(values, most_owners, most_repos)
    # Most rows of a value in a third of all documents are of shared values, which are few.
    told = values.select("_row", "value").join(F.broadcast(shared) if few else shared, "value", "left_semi")
    per_row = told.groupBy("_row").agg(F.count("*").alias("n_shared"))
    out = found.withColumn("n", F.size("values").cast("long")).join(per_row, "_row", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0).cast("long")))
    return out.select(F.col("_id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", (F.col("n") - F.col("n_shared")).alias("n_live"), "n_shared")


def shared_values(values: DataFrame, most_owners: int, most_repos: int) -> tuple[DataFrame, bool]:
    """The values of (value, _owner, _repo) that count as copied examples, and whether they are at most _MOST_SHARED."""
    owned = values.select("value", "_owner", "_repo").distinct()
    counts = owned.groupBy("value").agg(F.count_distinct("_owner").alias("owners"), F.count_distinct("_repo").alias("repos"))
    shared = cut(counts.where((F.col("owners") > most_owners) | (F.col("repos") > most_repos)).select("value"))
    return shared, shared.count() <= _MOST_SHARED


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = 4, most_repos: int = 4, mask: str = "[SECRET]") -> DataFrame:
    """docs with the values of live-looking spans replaced by mask; all rows and columns stay.

    Which values are live is decided over the whole corpus as in secret_scan(). Only hashes move
    for that. Shared values being few, their hashes go to the documents, which stay where they are;
    beyond _MOST_SHARED, documents meet the hashes of their own live values by id and text.
    """
    mark = F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), mark.alias("_mark"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"), F.to_json(F.struct(*[F.col(c) for c in repo_cols])).alias("_repo"), F.col(text_col).alias("_text"))
    found = cut(scan(rows, "_id", "_text", ["_mark", "_owner", "_repo"]).where("size(values) > 0").select("_id", "_mark", "_owner", "_repo", F.explode("values").alias("value")).distinct())
    shared, few = shared_values(found, most_owners, most_repos)
    names, at = docs.columns, docs.columns.index(text_col)
    if few:
        held = docs.sparkSession.sparkContext.broadcast(frozenset(r["value"] for r in shared.collect()))  # at most _MOST_SHARED

        def mask_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = pa.array([t if t is None else _masked(t, lambda v: v not in held.value, mask) for t in batch.column(at).to_pylist()], pa.string())
                yield pa.record_batch([*batch.columns[:at], texts, *batch.columns[at + 1 :]], names=names)

        return small_batches(docs).mapInArrow(mask_all, docs.schema)
    # The live values of one document: as many as its text has.
    per_doc = found.select("_id", "_mark", "value").distinct().join(shared, "value", "left_anti").groupBy("_id", "_mark").agg(F.collect_set("value").alias("_live"))
    # The joined names must not clash with any column of docs.
    taken = "_" * (1 + max(map(len, docs.columns)))
    key, text_key, live_key = f"{taken}id", f"{taken}mark", f"{taken}live"
    per_doc = per_doc.select(F.col("_id").alias(key), F.col("_mark").alias(text_key), F.col("_live").alias(live_key))
    marked = docs.join(per_doc, F.col(id_col).eqNullSafe(F.col(key)) & mark.eqNullSafe(F.col(text_key)), "left").select(*docs.columns, live_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, live = batch.columns
            texts = [t if values is None else _masked(t, set(values).__contains__, mask) for t, values in zip(columns[at].to_pylist(), live.to_pylist(), strict=True)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=names)

    return small_batches(marked).mapInArrow(run, docs.schema)


def _masked(text: str, live: Callable[[str], bool], mask: str) -> str:
    parts = [m for m in spans(text) if live(hashlib.sha256(m[3].encode("utf-8", "replace")).hexdigest())]
    out, at = [], 0
    for start, end, _, value in parts:
        start += text[start:end].rfind(value)  # of an assignment only the value goes
        end = start + len(value)
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
