"""Sequence-ordered, de-duplicated processing: batch forms and their streaming counterparts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_free(requests: DataFrame, client: str = "client_id", seq: str = "seq") -> DataFrame:
    """Requests that can be handled in order: each client's longest run without a gap from its first seq, once each."""
    once = requests.dropDuplicates([client, seq])
    order = Window.partitionBy(client).orderBy(seq)
    placed = once.withColumn("_n", F.row_number().over(order)).withColumn("_first", F.min(seq).over(order))
    return placed.where(F.col(seq) - F.col("_first") + 1 == F.col("_n")).drop("_n", "_first")


def deduplicate(requests: DataFrame, keys: list[str], time: str, ttl_seconds: int) -> DataFrame:
    """Requests without repeats of a key within ttl_seconds of the one that was kept last before.

    A repeat after that is a request again. Rows go by key and time through one pass that carries
    the key and the time last kept, so a key's rows are never held together.
    """
    names, many = requests.columns, len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        kept = 0
        for batch in batches:
            told = zip(*(c.to_pylist() for c in batch.columns[: many + 1]), strict=True)
            keep = []
            for *key, at in told:
                new = key != last or at is None or at - kept >= ttl_seconds * 1_000_000
                if new and at is not None:
                    last, kept = key, at
                keep.append(new)
            yield batch.filter(pa.array(keep, pa.bool_())).select(range(many + 1, batch.num_columns))

    marked = requests.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.unix_micros(F.col(time).cast("timestamp")).alias("_at"), *names)
    own = [f"_key{i}" for i in range(many)]
    return marked.repartition(*own).sortWithinPartitions(*own, "_at", *names).mapInArrow(run, requests.schema)


def reassemble(messages: DataFrame, stream: str, part: str, body: str, sep: str = "") -> DataFrame:
    """Each stream's parts as one text; complete tells whether their numbers have no gap from 0."""
    out = messages.groupBy(stream).agg(F.sort_array(F.collect_list(F.struct(part, body))).alias("p"), F.count("*").alias("parts"), F.max(part).alias("_hi"), F.count_distinct(part).alias("_d"), F.min(part).alias("_lo"))
    return out.select(stream, "parts", ((F.col("_lo") == 0) & (F.col("_hi") + 1 == F.col("_d"))).alias("complete"), F.array_join(F.transform("p", lambda x: x[body]), sep).alias("text"))


def watch(wanted: DataFrame, progress: DataFrame, group: str, index: str = "idx", seq: str = "seq") -> DataFrame:
    """Each wanted index of a group with the first progress row that reaches it; TIMEOUT where none does.

    Progress is reduced to the first row of each index before wanted rows are swept among these.
    """
    steps = progress.groupBy(group, F.col(index).alias("wanted")).agg(F.min(seq).cast("long").alias("reached_at")).withColumn("_side", F.lit(1))
    both = wanted.select(group, "wanted", F.lit(None).cast("long").alias("reached_at"), F.lit(0).alias("_side")).unionByName(steps)
    ahead = Window.partitionBy(group).orderBy("wanted", "_side").rowsBetween(0, Window.unboundedFollowing)
    out = both.withColumn("reached_at", F.min("reached_at").over(ahead)).where("_side = 0")
    return out.select(group, "wanted", "reached_at", F.when(F.col("reached_at").isNull(), "TIMEOUT").otherwise("DONE").alias("status"))


def unapplied(entries: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """Entries (key, term, idx) beyond the position (at: term, idx) that a key has applied; all where it has none."""
    met = entries.join(applied.select(F.col(key).alias("_k"), "at"), F.col(key) == F.col("_k"), "left")
    return met.where(F.col("at").isNull() | (F.struct("term", "idx") > F.col("at"))).drop("_k", "at")


def judged(requests: DataFrame, ahead: DataFrame, client: str = "client_id", seq: str = "seq") -> DataFrame:
    """Requests with a status: LATE below the number that is next for their client (next_seq), else ACCEPTED."""
    met = requests.join(ahead, client)
    return met.withColumn("status", F.when(F.col(seq) < F.col("next_seq"), "LATE").otherwise("ACCEPTED")).drop("next_seq")


def apply_log(stream: DataFrame, target: str, checkpoint: str, seq: str = "seq"):  # noqa: ANN201
    """Writes a stream of log entries, each batch in order of seq to a folder of its own below target.

    A batch that is run again after a failure overwrites its own folder, so entries are applied once.
    """
    def apply(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions(seq).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def guarded_read(wanted: DataFrame, progress: DataFrame, group: str) -> DataFrame:
    """Reads with a least index, and why one is refused: its group's commit index is behind it."""
    met = wanted.join(progress, group)
    return met.withColumn("refused", F.when(F.col("commit_index") < F.col("write_index"), "commit index is behind")).drop(group)


def deduplicate_stream(stream: DataFrame, keys: list[str], time: str, ttl: str) -> DataFrame:
    """One request of a key within ttl of event time: a repeat is dropped while the first one's state lasts.

    Unlike deduplicate(), what is dropped doesn't depend on the request kept last, but on the watermark.
    """
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts in event-time windows; events later than `late` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
