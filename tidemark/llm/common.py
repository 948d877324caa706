"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and runs on one machine (tests) a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: later stages reread it when executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of what has been cut() and is no longer in use."""
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package wrote and that no DataFrame still reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(df: DataFrame, size: int = 16 << 20) -> DataFrame:
    """df; bounds the bytes of an Arrow batch, so that long texts don't pile up in a Python worker."""
    df.sparkSession.conf.set(_BATCH_BYTES, str(size))
    return df


def trim() -> None:
    """Gives the system what this Python worker has freed; else it stays with the worker through later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_of(df: DataFrame, name: str) -> str:
    """The DDL type of a column."""
    return df.schema[name].dataType.simpleString()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): one row (node, component) for each node of an edge.

    component is the smallest node that can be reached. Alternates large-star and small-star
    steps (Kiveris et al. 2014), which need a logarithmic number of rounds in practice; each
    round is written to the checkpoint folder. No step gathers the neighbours of a node: only
    minima are aggregated, and edges find them by joins that adaptive execution can split.
    """
    def distinct(df: DataFrame) -> DataFrame:
        return df.where("u <> v").distinct()

    edges = cut(distinct(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    seen = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every greater neighbour is tied to the least node of the neighbourhood.
        large = distinct(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # Small star: the lesser neighbours of a node are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(distinct(tied.union(low.select("u", F.col("m").alias("v")))))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
