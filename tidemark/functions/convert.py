"""Strict casts between types, and sizes, speeds and spans as text; '' gives NULL unless said otherwise.

Text that is no value of the type is an error (raise_error), as a wrong cast should not pass as a
missing value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import half_up, named


def _filled(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def once(c: Column, told: Callable[[Column], Column]) -> Column:
    """told(c), where c is worked out once for a row, however often told names it."""
    return F.get(F.transform(F.array(c), told), F.lit(0))


def _checked(ok: Column, value: Column, kind: str, text: Column) -> Column:
    """value where ok holds; an error where it doesn't; NULL where the text is."""
    return F.when(text.isNull(), F.lit(None)).when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"not a {kind}: "), text)).cast("string"))


def _whole(c: Column, bits: int, kind: str) -> Column:
    text = _filled(c)
    number = F.try_to_number(text, F.lit("S9999999999999999999")).cast("decimal(20,0)")
    ok = text.rlike(r"^[+-]?\d+$") & number.between(-(1 << bits - 1), (1 << bits - 1) - 1)
    return _checked(F.coalesce(ok, F.lit(False)), text, kind, text)


def text_to_byte(c: Column) -> Column:
    return _whole(c, 8, "byte").cast("tinyint")


def text_to_short(c: Column) -> Column:
    return _whole(c, 16, "short").cast("smallint")


def wrapped(c: Column, bits: int) -> Column:
    """The low bits of a number cut toward zero, as a signed number: 200 in 8 bits is -56."""
    half = 1 << bits - 1
    return F.pmod(c.cast("long") + half, F.lit(2 * half)) - half


def text_to_char(c: Column) -> Column:
    text = _filled(c)
    return _checked(F.length(text) == 1, text, "character", text)


def text_to_int(c: Column) -> Column:
    """Through a decimal, toward zero: '12.7' is 12."""
    return F.trim(_filled(c)).cast("decimal(38,18)").cast("int")


def text_to_double(c: Column) -> Column:
    return _filled(c).cast("double")


def text_to_decimal(c: Column, scale: int = 18) -> Column:
    return _filled(c).cast(f"decimal(38,{scale})")


def number_to_integer(c: Column) -> Column:
    """A double cut toward zero, as a decimal without a fraction."""
    return c.cast("long").cast("decimal(38,0)")


def _millis(c: Column, least: int, kind: str) -> Column:
    text = _filled(c)
    ok = text.rlike(r"^-?\d+$") & (text.try_cast("long") >= least)
    return F.timestamp_millis(_checked(F.coalesce(ok, F.lit(False)), text, kind, text).cast("long"))


def text_to_date_time(c: Column) -> Column:
    """Text with a hyphen by its length (10: a date; 19: with a time; else with milliseconds); other text is epoch milliseconds from 0."""
    text = _filled(c)
    dashed = F.locate("-", text) > 1
    pattern = lambda p: F.to_timestamp(text, p)
    read = F.when(F.length(text) == 10, pattern("yyyy-MM-dd")).when(F.length(text) == 19, pattern("yyyy-MM-dd HH:mm:ss")).otherwise(pattern("yyyy-MM-dd HH:mm:ss.SSS"))
    return F.when(dashed, read).otherwise(_millis(F.when(~dashed, text), 0, "date"))


def millis_to_timestamp(c: Column) -> Column:
    """Epoch milliseconds above 0; others are an error."""
    return _millis(c, 1, "timestamp")


def text_to_bytes(c: Column) -> Column:
    """Base64; NULL is an error."""
    return F.unbase64(F.when(c.isNull(), F.raise_error(F.lit("no bytes: NULL")).cast("string")).otherwise(c))


def to_enum(c: Column, names: list[str]) -> Column:
    """A name as it is, or the name that a number from 0 stands for."""
    text, listed = _filled(c), F.array(*[F.lit(x) for x in names])
    at = text.try_cast("int")
    name = F.when(text.isin(*names), text).when(at.between(0, len(names) - 1), F.get(listed, at))
    return _checked(name.isNotNull(), name, "name of the enumeration", text)


_UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def text_to_uuid(c: Column) -> Column:
    text = _filled(c)
    return _checked(text.rlike(_UUID), F.lower(text), "UUID", text)


def bytes_to_uuid(c: Column) -> Column:
    """The name-based UUID (version 3) of bytes: their MD5 with the version's and variant's bits."""
    h = F.md5(c)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("3"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def each(c: Column, cast: Callable[[Column], Column]) -> Column:
    """A list with every element cast."""
    return F.transform(c, cast)


def each_value(c: Column, cast: Callable[[Column], Column]) -> Column:
    """A map with every value cast."""
    return F.transform_values(c, lambda _, v: cast(v))


def to_flag(c: Column, default: bool | None) -> Column:
    """true, t, false or f in either case; the default for other text, '' and NULL."""
    low = F.lower(c)
    return F.when(low.isin("true", "t"), True).when(low.isin("false", "f"), False).otherwise(F.lit(default))


def map_text(c: Column) -> Column:
    """An entry per line between braces, by key."""
    lines = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(F.lit("\n  "), e["key"].cast("string"), F.lit(" -> "), F.coalesce(e["value"].cast("string"), F.lit("null"))))
    return F.when(F.size(c) == 0, "<EMPTY_MAP>").otherwise(F.concat(F.lit("{"), F.array_join(lines, ""), F.lit("\n}")))


#: Units of sizes, each 1,024 times the one before.
UNITS = ["bytes", "KB", "MB", "GB", "TB", "PB", "EB", "ZB"]
_SIZE = r"^((\d*\.)?\d+([eE]\d+)?)\s*(BYTES|B|K|KB|M|MB|G|GB|T|TB|P|PB|E|EB|Z|ZB)?"


def _amount(text: Column, pattern: str) -> Column:
    number = F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("double"), F.lit(0.0))
    rate = named({name[0]: 1024.0**i for i, name in enumerate(UNITS[1:], 1)}, F.substring(F.regexp_extract(text, pattern, 4), 1, 1))
    return F.floor(F.least(number * F.coalesce(rate, F.lit(1.0)), F.lit(9.2e18)))


def parse_size(c: Column) -> Column:
    """'1.5GB', '1e5KB' in bytes; units are upper case; other text, NULL too, is 0."""
    return _amount(F.trim(F.coalesce(c, F.lit(""))), _SIZE + "$")


def parse_speed(c: Column) -> Column:
    """'1.5MB/s' in bytes each second, in either case; other text, NULL too, is 0."""
    return _amount(F.upper(F.trim(F.coalesce(c, F.lit("")))), _SIZE + "/S$")


def _unit(amount: Column) -> Column:
    """The place of the unit that an amount is told in: KB below a megabyte, bytes at 0 and below."""
    out = F.lit(len(UNITS) - 1)
    for i in range(len(UNITS) - 2, 0, -1):
        out = F.when(amount < 1024.0 ** (i + 1), F.lit(i)).otherwise(out)
    return F.when(amount <= 0, F.lit(0)).otherwise(out)


def _told(amount: Column) -> Column:
    unit = _unit(amount)
    shown = half_up(amount / F.pow(F.lit(1024.0), unit), 3)
    return F.concat(F.call_function("format_number", shown, F.lit("#0.###")), F.get(F.array(*[F.lit(x) for x in UNITS]), unit))


def size_text(amount: Column) -> Column:
    """Bytes in their unit, with three decimals at most."""
    return once(amount, _told)


def speed_text(amount: Column) -> Column:
    return F.concat(size_text(amount), F.lit("/S"))


def _rounded(amount: Column) -> Column:
    rate = F.pow(F.lit(1024.0), _unit(amount))
    return (half_up(amount / rate, 3) * rate).cast("long")


def rounded_size(amount: Column) -> Column:
    """What arithmetic on sizes gives: bytes to three decimals of their unit."""
    return once(amount, _rounded)


#: Binary prefixes from 2^10 on.
_PREFIXES = "kmgtpe"


def prefix_text(n: Column, unit: str = "", decimals: int = 3, most: str = "e") -> Column:
    """A whole number with its binary prefix, `most` at most: exactly if it divides, else with decimals."""
    last = _PREFIXES.index(most) + 1

    def prefixed(n: Column) -> Column:
        size, at = F.abs(n), F.lit(0)
        for i in range(last):
            at = F.when(size >= 1 << 10 * (i + 1), i + 1).otherwise(at)
        return once(F.struct(n.alias("n"), size.alias("size"), at.alias("at")), placed)

    def placed(x: Column) -> Column:
        n, size, at = x["n"], x["size"], x["at"]
        shown = lambda i: F.format_string(f"%.{decimals}f", size / F.pow(F.lit(1024.0), i))
        up = F.when((at > 0) & (at < last) & shown(at).startswith("1024"), at + 1).otherwise(at)  # what rounds up to the next prefix
        exact = F.pmod(size, F.pow(F.lit(2), 10 * at).cast("long")) == 0
        told = F.when(exact, F.floor(size / F.pow(F.lit(1024.0), at)).cast("string")).otherwise(shown(up))
        place = F.when(exact, at).otherwise(up)
        name = F.substring(F.lit(" " + _PREFIXES), place + 1, F.lit(1))
        plain = F.concat(size.cast("string"), F.lit(f" {unit}" if unit else ""))
        sign = F.when(n < 0, "-").otherwise("")
        return F.concat(sign, F.when(at == 0, plain).otherwise(F.concat(told, F.lit(" "), name, F.lit(unit))))

    return once(n, prefixed)


#: Minutes of a unit.
SPANS = [("year", 365 * 1440), ("month", 30 * 1440), ("day", 1440), ("hour", 60), ("minute", 1)]


def span_unit(minutes: Column) -> Column:
    """The largest unit that minutes are a whole number of; negative ones are an error."""
    out = F.lit("minute")
    for name, size in reversed(SPANS[:-1]):
        out = F.when((minutes >= size) & (minutes % size == 0), name).otherwise(out)
    return F.when(minutes < 0, F.raise_error(F.lit("negative minutes")).cast("string")).otherwise(out)


def path_value(c: Column, *keys: str) -> Column:
    """JSON text at a path of keys; a missing step gives NULL."""
    return F.get_json_object(c, "$" + "".join(f"['{k}']" for k in keys))


def path_values(c: Column, *keys: str) -> Column:
    """The values at a path as a list; one that is no list is a list of one, a missing one of none."""
    found = path_value(c, *keys)
    many = F.from_json(found, "array<string>")
    return F.when(found.isNull(), F.array().cast("array<string>")).when(found.startswith("["), many).otherwise(F.array(found))


def aes_encrypt(c: Column, key: Column, iv: Column) -> Column:
    """AES in CBC mode with padding, as Base64 without the initial vector."""
    return F.replace(F.base64(F.substring(F.aes_encrypt(c, key, F.lit("CBC"), F.lit("DEFAULT"), iv), 17, 1 << 30)), F.lit("\r\n"), F.lit(""))  # no line breaks


def aes_decrypt(c: Column, key: Column, iv: Column) -> Column:
    return F.aes_decrypt(F.concat(iv, F.unbase64(c)), key, F.lit("CBC"), F.lit("DEFAULT"))
