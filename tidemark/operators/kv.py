"""Point reads and ordered range scans with keyset paging over a key column.

Ranges are half open; a null bound is none. Scans are filters and a bounded sort, so bounds
reach the Parquet reader and a page costs one top-N, not a global sort.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 256


def in_range(key: str, start: Any = None, end: Any = None) -> Column:
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(key) >= F.lit(start))
    if end is not None:
        cond = cond & (F.col(key) < F.lit(end))
    return cond


def get(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """A row for each wanted key, with found and the row's columns (null where absent)."""
    hits = df.withColumn("_hit", F.lit(True))
    return keys.join(hits, key, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def exists(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The wanted keys that df has."""
    return keys.join(df.select(key), key, "left_semi")


def scan(df: DataFrame, key: str, start: Any = None, end: Any = None, limit: int = PAGE, resume: Any = None, reverse: bool = False) -> DataFrame:
    """A page of rows by key. resume is the last key of the page before; limit 0 takes a page of 256.

    has_more tells on each row whether rows follow the page: one row beyond it is looked at. resume_key
    is the page's last key if they do, for the next page's resume.
    """
    size = limit or PAGE
    rows = df.where(in_range(key, start, end))
    if resume is not None:
        rows = rows.where(F.col(key) < F.lit(resume) if reverse else F.col(key) > F.lit(resume))
    order = F.col(key).desc() if reverse else F.col(key).asc()
    ahead = rows.orderBy(order).limit(size + 1)  # at most a page and one row
    keys = F.sort_array(F.collect_list(key), asc=not reverse)  # of one page
    edge = ahead.agg(keys.alias("_keys")).select(F.size("_keys").alias("_n"), F.get("_keys", F.lit(size)).alias("_next"), F.get("_keys", F.lit(size - 1)).alias("_last"))
    page = ahead.join(F.broadcast(edge)).where(F.col("_next").isNull() | (F.col(key) != F.col("_next")))
    return page.withColumn("has_more", F.col("_n") > size).withColumn("resume_key", F.when(F.col("_n") > size, F.col("_last"))).drop("_n", "_next", "_last")


def prefix(df: DataFrame, key: str, start: str, limit: int = PAGE) -> DataFrame:
    return df.where(F.col(key).startswith(start)).orderBy(key).limit(limit or PAGE)


def first_last(df: DataFrame, key: str, start: Any = None, end: Any = None) -> DataFrame:
    """The rows of the least and the greatest key in a range, as two structs."""
    rows = df.where(in_range(key, start, end))
    return rows.agg(F.min_by(F.struct(*df.columns), key).alias("first"), F.max_by(F.struct(*df.columns), key).alias("last"))


def count(df: DataFrame, key: str, start: Any = None, end: Any = None, limit: int = 0) -> DataFrame:
    """(count, truncated): with a limit, counting stops there."""
    rows = df.where(in_range(key, start, end)).select(key)
    total = (rows.limit(limit + 1) if limit else rows).agg(F.count("*").alias("n"))
    over = F.col("n") > limit if limit else F.lit(False)
    return total.select(F.when(over, F.lit(limit)).otherwise(F.col("n")).cast("long").alias("count"), over.alias("truncated"))
