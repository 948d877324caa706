"""Codecs that Spark lacks, as Arrow-batched functions over binary columns."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Base58 alphabet and the reflected Castagnoli polynomial.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
CASTAGNOLI = 0x82F63B78


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(CASTAGNOLI), out >> 1).astype(np.uint32)
    return out


_TABLE = _table()


def crc32c_batch(values: list[bytes | None]) -> list[int | None]:
    """The checksums of many values, a byte position of all of them at a time."""
    some = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: -len(values[i]))
    sizes = np.array([len(values[i]) for i in some], dtype=np.int64)
    flat = np.frombuffer(b"".join([values[i] for i in some]), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    crc = np.full(len(some), 0xFFFFFFFF, dtype=np.uint32)
    longer = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0))  # how many values go on at a position
    for at, n in enumerate(longer.tolist()):
        now = crc[:n]
        crc[:n] = _TABLE[(now ^ flat[starts[:n] + at]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out: list[int | None] = [None] * len(values)
    for i, x in zip(some, (crc ^ np.uint32(0xFFFFFFFF)).tolist(), strict=True):
        out[i] = x
    return out


def crc32c_of(data: bytes) -> int:
    return crc32c_batch([data])[0]


def base58_of(data: bytes) -> str:
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return BASE58[0] * (len(data) - len(data.lstrip(b"\0"))) + out


def base58_back(text: str) -> bytes:
    """The bytes of a Base58 text; a character outside the alphabet is an error."""
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    zeros = len(text) - len(text.lstrip(BASE58[0]))
    return b"\0" * zeros + n.to_bytes((n.bit_length() + 7) // 8, "big")


def crc32c(c: Column) -> Column:
    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(crc32c_batch(x.where(x.notna(), None).tolist()), dtype="Int64")

    return run(c)


def _mapped(kind: str, one):  # noqa: ANN001, ANN202
    def call(c: Column) -> Column:
        @F.pandas_udf(kind)
        def run(x: pd.Series) -> pd.Series:
            return x.map(one, na_action="ignore")

        return run(c)

    return call


base58, unbase58 = _mapped("string", base58_of), _mapped("binary", base58_back)
deflate, inflate = _mapped("binary", zlib.compress), _mapped("binary", zlib.decompress)
