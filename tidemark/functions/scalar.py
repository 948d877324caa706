"""Casts and string, size and duration functions as column expressions; NULL and '' give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def named(values: dict[str, int] | dict[str, float], name: Column) -> Column:
    """The value of a name, NULL if there is none; name is worked out once."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), name)


def to_long(c: Column) -> Column:
    """Through a decimal, toward zero: '12.7' is 12."""
    return F.trim(_text(c)).cast("decimal(38,18)").cast("long")


def to_boolean(c: Column) -> Column:
    """true, yes, 1 and false, no, 0 in either case; other text is an error."""
    low = F.lower(_text(c))
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False).when(low.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), low)).cast("boolean"))


def half_up(c: Column, digits: int) -> Column:
    """Rounds halves toward plus infinity: -2.5 is -2."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def head(c: Column, mark: str) -> Column:
    """The text before the first mark; NULL where there is none."""
    at = F.locate(mark, c)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1))


def tail(c: Column, mark: str) -> Column:
    """The text after the first mark; NULL where there is none."""
    at = F.locate(mark, c)
    return F.when(at > 0, F.substring(c, at + len(mark), F.length(c)))


def between(c: Column, begin: str, end: str) -> Column:
    return head(tail(c, begin), end)


def last_tail(c: Column, mark: str) -> Column:
    return F.when(F.locate(mark, c) > 0, F.substring_index(c, mark, -1))


def last_head(c: Column, mark: str) -> Column:
    """The text before the last mark; NULL where there is none."""
    n = F.length(F.substring_index(c, mark, -1))
    return F.when(F.locate(mark, c) > 0, F.substring(c, F.lit(1), F.length(c) - n - len(mark)))


def split_trimmed(c: Column) -> Column:
    """Parts between commas without the space about them; none for NULL and blanks."""
    blank = c.isNull() | (F.trim(c) == "")
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(F.trim(c), r"\s*,\s*"))


def short_hex(c: Column, most: int = 10) -> Column:
    """Lower-case hex; after `most` bytes the size stands for the rest."""
    n = F.octet_length(c)
    return F.when(n <= most, F.lower(F.hex(c))).otherwise(F.concat(F.lower(F.hex(F.substring(c, 1, most))), F.lit("...(size="), n, F.lit(")")))


_SIZES = [("", 0), ("k", 10), ("m", 20), ("g", 30), ("t", 40), ("p", 50), ("e", 60)]


def size_bytes(c: Column) -> Column:
    """'1kb', '2m', '10b', '-1_230k' in bytes; other text is NULL, an overflow an error."""
    plain = F.lower(F.replace(_text(c), F.lit("_"), F.lit("")))
    number = F.nullif(F.regexp_extract(plain, r"^\s*(-?\d+)\s*([kmgtpe]?)b?\s*$", 1), F.lit("")).cast("decimal(19,0)")
    unit = F.regexp_extract(plain, r"^\s*(-?\d+)\s*([kmgtpe]?)b?\s*$", 2)
    factor = named({name: 1 << bits for name, bits in _SIZES}, unit)
    return (number * factor.cast("decimal(19,0)")).cast("long")


_DURATIONS = [("ns", 1), ("us", 10**3), ("ms", 10**6), ("s", 10**9), ("min", 60 * 10**9), ("h", 3600 * 10**9), ("d", 86400 * 10**9)]


def duration_nanos(c: Column, default_unit: str = "ms") -> Column:
    """'1_500 ms', '2min' in nanoseconds; a bare number has default_unit; other text is NULL."""
    pattern = r"^\s*(-?\d+)\s*(ns|us|ms|s|min|h|d)?\s*$"
    plain = F.lower(F.replace(_text(c), F.lit("_"), F.lit("")))
    number = F.nullif(F.regexp_extract(plain, pattern, 1), F.lit("")).cast("long")
    unit = F.coalesce(F.nullif(F.regexp_extract(plain, pattern, 2), F.lit("")), F.lit(default_unit))
    return number * named(dict(_DURATIONS), unit).cast("long")


def round_up(nanos: Column, to: int) -> Column:
    """The least multiple of `to` that is no less; `to` must be positive."""
    if to <= 0:
        raise ValueError("round up to a positive duration")
    return nanos + F.pmod(-nanos, F.lit(to))
