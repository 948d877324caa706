"""Queries over the version log that the events table stands for: key user_id, commit_ts event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import mvcc
from tidemark.sources.tables import table

READ_TS = 7000
NOW = 9500


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.col("event_id").alias("commit_ts"),
        F.lit(True).alias("committed"),
        (F.col("event_type") == "error").alias("deleted"),
        F.col("event_type").alias("payload"),
    )


def mvcc_snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.snapshot(versions(spark, sf_dir), ["user_id"], READ_TS).select("user_id", "commit_ts", "payload")


def mvcc_snapshot_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc_snapshot_read(spark, sf_dir).agg(F.count("*").alias("n"))


def mvcc_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a probe of its customer's version at a time that its key gives."""
    probes = table(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(200)).alias("user_id"), "o_orderkey", F.pmod(F.col("o_orderkey") * 7, F.lit(11000)).alias("ts"))
    out = mvcc.as_of(probes, versions(spark, sf_dir).select("user_id", "commit_ts", "payload"), "user_id", "ts", width=1000)
    return out.select("user_id", "o_orderkey", "ts", "v_commit_ts", "v_payload")


def _txns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as transactions: finished ones are committed, their line items are the intents."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn_id"), "o_orderstatus", "o_custkey")
    return o, o.where("o_orderstatus = 'F'").select("txn_id", (F.col("txn_id") + 20).alias("commit_ts"))


def primary_lock_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, commits = _txns(spark, sf_dir)
    return o.select("txn_id").join(commits, "txn_id", "left").select("txn_id", F.col("commit_ts").isNotNull().alias("committed"), "commit_ts")


def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, commits = _txns(spark, sf_dir)
    intents = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("txn_id"), F.col("l_partkey").alias("key")).agg(F.count("*").alias("n"))
    done = mvcc.commit(intents, commits)
    return done.groupBy("committed").agg(F.count("*").alias("intents"), F.sum("n").alias("writes"), F.max("commit_ts").alias("last_ts"))


def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, _ = _txns(spark, sf_dir)
    intents = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn_id"), "l_partkey")
    left = mvcc.rollback(intents, o.where("o_orderstatus = 'O'"))
    return left.groupBy("txn_id").agg(F.count("*").alias("intents"))


def lock_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, commits = _txns(spark, sf_dir)
    locks = o.select("txn_id", F.col("txn_id").alias("start_ts"), F.pmod("o_custkey", F.lit(1000)).alias("ttl"))
    return mvcc.resolve_locks(locks, commits, NOW).select("txn_id", "action")


def version_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.collect_garbage(versions(spark, sf_dir).select("user_id", "commit_ts", "payload"), ["user_id"], READ_TS)


def batch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"), F.col("event_type").alias("value"))
    return mvcc.fold_batch(ops)


def delete_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("not (o_orderkey >= 100 and o_orderkey < 1300)").select("o_orderkey", "o_custkey")


def allocate_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), (F.pmod("o_orderkey", F.lit(5)) + 1).alias("step"))
    return mvcc.allocate(requests).select("key", "seq", "first_id", "last_id")


def two_phase_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction commits if no region's prewrite failed: line items are the regions' replies."""
    replies = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") != "R").alias("ok"), F.count("*").alias("replies"))
    return replies.select(F.col("l_orderkey").alias("txn_id"), F.when(F.col("ok"), "COMMIT").otherwise("ROLLBACK").alias("outcome"), "replies")


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts merged with newer prices: the newest row of each key stays."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("v"), F.lit(0).alias("ver"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 30).alias("k"), (F.col("s_nationkey") + 100).cast("long").alias("v"), F.lit(1).alias("ver"))
    return part.union(new).groupBy("k").agg(F.max_by("v", "ver").alias("v"))


QUERIES = {f.__name__: f for f in (mvcc_snapshot_read, mvcc_snapshot_count, mvcc_as_of, primary_lock_status, txn_commit, txn_rollback, lock_resolve, version_gc, batch_fold, delete_range, allocate_segments, two_phase_outcome, upsert)}

_NEWEST = f"""
  SELECT user_id, event_id, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
  FROM events WHERE event_id <= {READ_TS}"""

ORACLES = {
    "mvcc_snapshot_read": f"SELECT user_id, event_id AS commit_ts, event_type AS payload FROM ({_NEWEST}) WHERE rn = 1 AND event_type <> 'error'",
    "mvcc_snapshot_count": f"SELECT count(*) AS n FROM ({_NEWEST}) WHERE rn = 1 AND event_type <> 'error'",
    "mvcc_as_of": """
SELECT p.user_id, p.o_orderkey, p.ts, e.event_id AS v_commit_ts, e.event_type AS v_payload
FROM (SELECT o_custkey % 200 AS user_id, o_orderkey, (o_orderkey * 7) % 11000 AS ts FROM orders) p
ASOF LEFT JOIN events e ON p.user_id = e.user_id AND p.ts >= e.event_id""",
    "primary_lock_status": "SELECT o_orderkey AS txn_id, o_orderstatus = 'F' AS committed, CASE WHEN o_orderstatus = 'F' THEN o_orderkey + 20 END AS commit_ts FROM orders",
    "txn_commit": """
SELECT coalesce(o_orderstatus = 'F', false) AS committed, count(*) AS intents, sum(n)::BIGINT AS writes,
       max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey + 20 END) AS last_ts
FROM (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "txn_rollback": "SELECT l_orderkey AS txn_id, count(*) AS intents FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1",
    "lock_resolve": f"SELECT o_orderkey AS txn_id, CASE WHEN o_orderkey + o_custkey % 1000 > {NOW} THEN 'WAIT' WHEN o_orderstatus = 'F' THEN 'ROLL_FORWARD' ELSE 'ROLLBACK' END AS action FROM orders",
    "version_gc": f"""
SELECT user_id, event_id AS commit_ts, event_type AS payload FROM (
  SELECT *, max(CASE WHEN event_id <= {READ_TS} THEN event_id END) OVER (PARTITION BY user_id) AS keep FROM events)
WHERE event_id > {READ_TS} OR event_id = keep""",
    "batch_fold": "SELECT user_id AS key, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'",
    "delete_range": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 100 OR o_orderkey >= 1300",
    "allocate_segments": """
SELECT o_custkey AS key, o_orderkey AS seq, (total - step)::BIGINT AS first_id, total::BIGINT AS last_id FROM (
  SELECT *, sum(step) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS total FROM (SELECT *, o_orderkey % 5 + 1 AS step FROM orders))""",
    "two_phase_outcome": "SELECT l_orderkey AS txn_id, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'COMMIT' ELSE 'ROLLBACK' END AS outcome, count(*) AS replies FROM lineitem GROUP BY 1",
    "upsert": """
SELECT coalesce(k2, k1) AS k, coalesce(v2, v1)::BIGINT AS v FROM (SELECT p_partkey AS k1, p_size AS v1 FROM part)
FULL JOIN (SELECT s_suppkey * 30 AS k2, s_nationkey + 100 AS v2 FROM supplier) ON k1 = k2""",
}
