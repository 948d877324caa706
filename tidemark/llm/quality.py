"""Quality rules whose thresholds follow the corpus: quantile sketches per language and source.

Signals of each document are sketched (KLL, mergeable) for each language and source; sketches of
sources are merged to languages and to the whole corpus. Each group has two fences for a signal,
both read from its sketches: an inner one, `reach` times the distance from the median to the 0.9
quantile beyond that quantile, and an outer one from the 0.99 quantile in the same way. Fences of a
group are averaged with those of its language, and these with the corpus's, weighted as `weight`
documents; so small groups follow the many, and large ones their own spread. No signal has a
cutoff of its own.

A document is dropped if it fails the base rules, if a signal is beyond its outer fence, or if
signals of two kinds (symbols, repetition, word length) are beyond their inner ones. Counts of one
are never beyond a fence, and a signal whose spread is zero everywhere has no outer fence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

_SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Signals, their kinds, and the count that a share counts (None: both of its sides are watched).
SIGNALS = {"symbol_share": ("symbols", "n_symbols"), "dup_line_share": ("repetition", "n_dup_lines"), "repeat_share": ("repetition", "n_repeat_words"), "word_length": ("words", None)}
_INNER, _OUTER = 0.9, 0.99


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(grams: Column) -> Column:
    """How many words lie in windows of three that a list of windows has twice or more.

    Sorts (window, position) and looks at neighbours: n log n, also for very long texts.
    """
    def doubled(pairs: Column) -> Column:
        before = lambda i: F.get(pairs, i)["g"]
        kept = F.filter(pairs, lambda p, i: F.coalesce(before(i - 1) == p["g"], F.lit(False)) | F.coalesce(before(i + 1) == p["g"], F.lit(False)))
        return F.sort_array(F.transform(kept, lambda p: p["i"]))

    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    fold = F.aggregate(_let(placed, doubled), start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(fold["n"])


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts over each whole text (null: none). Windows are told apart by 64-bit hashes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), *[F.col(k) for k in keys], text.alias("_text"))
    spaced = F.translate("_text", _SPACE[1:], " " * 5)
    rows = rows.withColumn("_words", F.array_remove(F.split(spaced, " ", -1), ""))
    # Java's regular expressions take no lone line break away here, so split() sees all lines.
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.translate(x, _SPACE, "")) > 0))
    n = F.size("_words")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get("_words", i - 1), F.get("_words", i), F.get("_words", i + 1)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_grams", grams)
    return rows.select(
        id_col,
        *keys,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_text", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_grams")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def _shares() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbol_share": per("n_symbols", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words")}


def _fences(sketched: DataFrame, reach: float) -> DataFrame:
    """The group's columns with, for each signal, a struct of fences; null where nothing spreads."""
    def fence(s: str) -> Column:
        q = lambda p: F.kll_sketch_get_quantile_double(F.col(s), F.lit(p))
        beyond = lambda p: q(p) + reach * (q(p) - q(0.5))
        spread = lambda p: F.when(q(p) != q(0.5), beyond(p))
        return F.struct(
            beyond(_INNER).alias("inner"), spread(_OUTER).alias("outer"), beyond(1 - _INNER).alias("low_inner"), spread(1 - _OUTER).alias("low_outer")
        ).alias(s)

    rest = [c for c in sketched.columns if c not in SIGNALS]
    return sketched.where(F.col("n") > 0).select(*rest, *[fence(s) for s in SIGNALS])


_FENCES = ("inner", "outer", "low_inner", "low_outer")


def _shrunk(own: Column, n: Column, wide: Column, weight: float) -> Column:
    """own fences averaged with wider ones, which count as `weight` documents; what is null counts nothing."""
    def one(name: str) -> Column:
        a, b = own[name], wide[name]
        return F.coalesce((n * a + weight * b) / (n + weight), a, b).alias(name)

    return F.struct(*[one(name) for name in _FENCES])


def fences(sketches: DataFrame, reach: float, weight: float) -> DataFrame:
    """(_lang, _source, a struct of fences for each signal) from the sketches (_lang, _source, n, signals) of groups."""
    merged = [F.kll_merge_agg_double(s).alias(s) for s in SIGNALS]
    wide = lambda df, key, name: _fences(df, reach).select(key, *[F.col(s).alias(f"{s}_{name}") for s in SIGNALS])
    by_lang = sketches.groupBy("_lang").agg(F.sum("n").alias("n"), *merged)
    whole = wide(sketches.agg(F.sum("n").alias("n"), *merged), F.lit(True).alias("_all"), "all")  # one row
    langs = _fences(by_lang, reach).join(F.broadcast(whole), F.col("_all"))
    langs = langs.select(F.col("_lang").alias("_l"), *[_shrunk(F.col(s), F.col("n"), F.col(f"{s}_all"), weight).alias(f"{s}_lang") for s in SIGNALS])
    own = _fences(sketches, reach).join(langs, F.col("_lang").eqNullSafe(F.col("_l")))
    return own.select("_lang", "_source", *[_shrunk(F.col(s), F.col("n"), F.col(f"{s}_lang"), weight).alias(s) for s in SIGNALS])


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keys: tuple[str, str] = ("lang", "source"),
    reach: float = 2.0,
    weight: float = 30.0,
    sketch_k: int = 2048,
    least_words: int = 50,
    most_repeats: int = 50,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """One row for each row of docs: id_col, the counts, base_failed, kept, failed.

    base_failed: under least_words words, or over most_repeats percent of them in repeated
    windows. kept: not base_failed, no signal beyond its outer fence and signals of at most one
    kind beyond their inner ones. failed names the signals beyond inner fences, or base. Sketches
    are of documents that pass the base rules; a group without any passes on the others' word:
    its documents all fail the base. Null keys are a group of their own. A null text has no words.
    Repeated rows count each; an empty table gives none; of other columns, whatever their names,
    none is read.

    The fences are joined by broadcast up to broadcast_rows groups, counted first; beyond that by
    a shuffled join, whose hot groups adaptive execution splits.
    """
    lang, source = keys
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    base = signals(docs, id_col, text_col, keys).withColumnRenamed(lang, "_lang").withColumnRenamed(source, "_source").withColumn("base_failed", failed)
    found = cut(base.withColumns(_shares()))
    sketches = found.where(~F.col("base_failed")).groupBy("_lang", "_source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(s, sketch_k).alias(s) for s in SIGNALS])
    told = cut(fences(cut(sketches), reach, weight).select(F.col("_lang").alias("_fl"), F.col("_source").alias("_fs"), *[F.col(s).alias(f"{s}_fence") for s in SIGNALS]))
    small = F.broadcast(told) if told.count() <= broadcast_rows else told
    out = found.join(small, F.col("_lang").eqNullSafe(F.col("_fl")) & F.col("_source").eqNullSafe(F.col("_fs")), "left")

    def beyond(s: str, which: str) -> Column:
        fence, (_, count) = F.col(f"{s}_fence"), SIGNALS[s]
        over = F.col(s) > fence[which]
        over = over | (F.col(s) < fence[f"low_{which}"]) if count is None else over & (F.col(count) > 1)
        return F.coalesce(over, F.lit(False))

    kinds = {}
    for s, (kind, _) in SIGNALS.items():
        kinds[kind] = kinds.get(kind, F.lit(False)) | beyond(s, "inner")
    many = sum([k.cast("int") for k in kinds.values()], F.lit(0)) >= 2
    extreme = F.lit(False)
    for s in SIGNALS:
        extreme = extreme | beyond(s, "outer")
    named = F.filter(F.array(*[F.when(beyond(s, "inner"), F.lit(s)) for s in SIGNALS]), lambda x: x.isNotNull())
    out = out.withColumn("failed", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(named))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~many & ~extreme).alias("kept"), "failed")
