"""Reads of multi-version rows as of a timestamp, and the folds that commit, undo and collect versions.

A version is a row of (key columns, commit_ts, deleted, payload). A tombstone or an empty
payload that is the newest visible version hides older ones: the choice of the version comes
first, the test whether it can be read second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(read_ts: int, committed: str | None = "committed", commit_ts: str = "commit_ts") -> Column:
    """Committed, and not after read_ts."""
    seen = F.col(commit_ts) <= read_ts
    return F.col(committed) & seen if committed else seen


def readable(payload: str = "payload", deleted: str = "deleted") -> Column:
    """Not deleted, and neither null nor empty."""
    return ~F.coalesce(F.col(deleted), F.lit(False)) & F.col(payload).isNotNull() & (F.length(payload) > 0)


def newest(versions: DataFrame, keys: list[str], commit_ts: str = "commit_ts") -> DataFrame:
    """The newest version of each key; one partial aggregate before the shuffle."""
    rest = [c for c in versions.columns if c not in keys]
    best = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), commit_ts).alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def snapshot(versions: DataFrame, keys: list[str], read_ts: int, committed: str | None = "committed") -> DataFrame:
    """Rows that a transaction starting at read_ts sees."""
    return newest(versions.where(visible(read_ts, committed)), keys).where(readable())


def as_of(probes: DataFrame, versions: DataFrame, key: str, ts: str, commit_ts: str = "commit_ts", width: int = 1 << 40) -> DataFrame:
    """Each probe with the newest version at or before its time (null where there is none).

    Probes and versions are laid in one column and swept by key and time, so nothing is paired:
    the cost is one sort, whatever the number of versions of a key. A key's time is cut into ranges
    of `width`, each swept in a task of its own; what comes before a range is carried in from the
    newest versions of the ranges, one row each.
    """
    from pyspark.sql import Window

    rest = [c for c in versions.columns if c != key]
    left = probes.select(F.col(key), F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*[c for c in probes.columns if c != key]).alias("_p"), F.lit(None).cast(versions.select(F.struct(*rest).alias("s")).schema["s"].dataType).alias("_v"))
    right = versions.select(F.col(key), F.col(commit_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_p"].dataType).alias("_p"), F.struct(*rest).alias("_v"))
    both = left.union(right).withColumn("_b", F.floor(F.col("_t") / width))
    sweep = Window.partitionBy(key, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_v", F.last("_v", ignorenulls=True).over(sweep)).where("_side = 1")
    ranges = both.groupBy(key, "_b").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(F.col(key).alias("_ck"), F.col("_b").alias("_cb"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    swept = swept.join(carried, F.col(key).eqNullSafe(F.col("_ck")) & F.col("_b").eqNullSafe(F.col("_cb"))).withColumn("_v", F.coalesce("_v", "_carried"))
    return swept.select(key, *[F.col(f"_p.{c}").alias(c) for c in probes.columns if c != key], *[F.col(f"_v.{c}").alias(f"v_{c}") for c in rest])


def fold_batch(ops: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The state after ordered puts and deletes: the last operation of each key, if it is a put."""
    last = ops.groupBy(key).agg(F.max_by(F.struct("op", "value"), seq).alias("o"))
    return last.where("o.op = 'PUT'").select(key, F.col("o.value").alias("value"))


def commit(intents: DataFrame, commits: DataFrame) -> DataFrame:
    """Intents of committed transactions, with their commit_ts; others stay uncommitted."""
    done = commits.select("txn_id", F.col("commit_ts").alias("_c"))
    out = intents.drop("commit_ts", "committed").join(done, "txn_id", "left")
    return out.withColumn("committed", F.col("_c").isNotNull()).withColumnRenamed("_c", "commit_ts")


def prewrite(mutations: DataFrame, locks: DataFrame, versions: DataFrame) -> DataFrame:
    """Mutations with the lock that each takes, or the error that it meets; failures are values.

    mutations: txn_id, key, value, start_ts, primary_key and region_id, where a null primary is the
    key itself and a null region unknown. Errors in order: an empty value, another transaction's
    lock (of the least id), a version committed after the start. Locks and versions are reduced to
    one row a key before they meet the mutations.
    """
    held = locks.groupBy("key").agg(F.min("txn_id").alias("_low"), F.max("txn_id").alias("_high"))
    newest_ts = versions.groupBy("key").agg(F.max("commit_ts").alias("_newest"))
    met = mutations.join(held, "key", "left").join(newest_ts, "key", "left")
    other = F.when(F.col("_low") != F.col("txn_id"), F.col("_low")).when(F.col("_high") != F.col("txn_id"), F.col("_high"))
    error = (
        F.when(F.coalesce(F.length("value"), F.lit(0)) == 0, "empty value")
        .when(other.isNotNull(), F.concat(F.lit("locked by "), other))
        .when(F.col("_newest") > F.col("start_ts"), F.concat(F.lit("write conflict at "), F.col("_newest")))
    )
    out = met.withColumn("error", error).withColumn("lock_primary", F.coalesce("primary_key", "key")).withColumn("lock_region", F.coalesce("region_id", F.lit("unknown")))
    return out.drop("_low", "_high", "_newest")


def two_phase(replies: DataFrame) -> DataFrame:
    """(txn_id, outcome, sent, error) from prewrite replies (txn_id, primary, error).

    The primary goes first: if it fails, nothing else is sent. Any failure rolls the transaction
    back; the error told is the primary's, else the first in order of text.
    """
    first, bad = F.col("primary"), F.col("error").isNotNull()
    out = replies.groupBy("txn_id").agg(
        F.count("*").alias("n"), F.count_if(first).alias("primaries"), F.count_if(bad).alias("bad"), F.count_if(bad & first).alias("primary_bad"),
        F.min(F.when(first, F.col("error"))).alias("primary_error"), F.min("error").alias("other_error"),
    )
    failed = F.col("primary_bad") > 0
    return out.select("txn_id", F.when(F.col("bad") == 0, "COMMIT").otherwise("ROLLBACK").alias("outcome"), F.when(failed, F.col("primaries")).otherwise(F.col("n")).alias("sent"), F.when(failed, F.col("primary_error")).otherwise(F.col("other_error")).alias("error"))


def merge(target: DataFrame, source: DataFrame, key: str, delete: Column | None = None) -> DataFrame:
    """target after MERGE: met rows take the source's values (or go where delete, over `new` and `old`, holds), unmet source rows come in."""
    rest = [c for c in target.columns if c != key]
    old = target.select(F.col(key).alias("_ok"), F.struct(*rest).alias("old"))
    new = source.select(F.col(key).alias("_nk"), F.struct(*rest).alias("new"))
    met = old.join(new, F.col("_ok") == F.col("_nk"), "full")
    if delete is not None:
        met = met.where(F.col("_ok").isNull() | F.col("_nk").isNull() | ~F.coalesce(delete, F.lit(False)))
    return met.select(F.coalesce("_nk", "_ok").alias(key), *[F.when(F.col("_nk").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in rest])


def rollback(intents: DataFrame, undone: DataFrame) -> DataFrame:
    """Intents without those of the transactions that are undone."""
    return intents.join(undone.select("txn_id"), "txn_id", "left_anti")


def resolve_locks(locks: DataFrame, commits: DataFrame, now: int) -> DataFrame:
    """WAIT while a lock lives; then ROLL_FORWARD if its primary is committed, else ROLLBACK."""
    out = locks.join(commits.select("txn_id", "commit_ts"), "txn_id", "left")
    action = F.when(F.col("start_ts") + F.col("ttl") > now, "WAIT").when(F.col("commit_ts").isNotNull(), "ROLL_FORWARD").otherwise("ROLLBACK")
    return out.withColumn("action", action)


def collect_garbage(versions: DataFrame, keys: list[str], safe_point: int, commit_ts: str = "commit_ts") -> DataFrame:
    """Versions that a read at or after safe_point can need: those beyond it, and each key's newest before."""
    before = versions.where(F.col(commit_ts) <= safe_point)
    kept = before.groupBy(*keys).agg(F.max(commit_ts).alias(commit_ts))
    return versions.where(F.col(commit_ts) > safe_point).unionByName(before.join(kept, [*keys, commit_ts], "left_semi"))


def next_safe_point(current: int, candidate: int, active: list[int], backup: int | None = None) -> int:
    """candidate if it goes forward and no transaction or backup needs older versions; else current."""
    held = [*active, *([] if backup is None else [backup])]
    return candidate if candidate > current and all(candidate < x for x in held) else current


def allocate(requests: DataFrame, key: str = "key", seq: str = "seq", step: str = "step") -> DataFrame:
    """[first, last) of the ids that each request gets from its key's counter, in order of seq."""
    from pyspark.sql import Window

    end = F.sum(step).over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("last_id", end).withColumn("first_id", F.col("last_id") - F.col(step))
