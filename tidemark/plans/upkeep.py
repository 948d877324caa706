"""Upkeep decisions over logs, replicas and payloads, derived from orders, suppliers, events and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import stats
from tidemark.sources.tables import table


def effective_voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voters of each nation's group: real peers, and one more if it has any virtual peer."""
    peers = table(spark, sf_dir, "supplier").select("s_nationkey", (F.pmod("s_suppkey", F.lit(5)) == 0).alias("virtual"))
    count = F.count_if(~F.col("virtual")) + F.bool_or("virtual").cast("long")
    return peers.groupBy("s_nationkey").agg(count.alias("voters")).withColumn("majority", F.floor(F.col("voters") / 2) + 1)


def best_virtual_follower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All real followers, and of the virtual ones of each group that with the greatest match index."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.pmod("s_suppkey", F.lit(5)) == 0).alias("virtual"), F.pmod(F.col("s_suppkey") * 37, F.lit(101)).alias("match_index"))
    best = s.where("virtual").groupBy("s_nationkey").agg(F.max_by(F.struct("s_suppkey", "match_index"), F.struct("match_index", "s_suppkey")).alias("b"))
    chosen = best.select("s_nationkey", F.col("b.s_suppkey").alias("s_suppkey"), F.lit(True).alias("virtual"), F.col("b.match_index").alias("match_index"))
    return s.where("not virtual").unionByName(chosen)


def log_purge(spark: SparkSession, sf_dir: str, upto: int = 4321) -> DataFrame:
    """Segments that a purge up to an index leaves: whole closed segments that end there or before go."""
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("segment"), "o_orderkey")
    segments = o.groupBy("segment").agg(F.min("o_orderkey").alias("start_index"), F.max("o_orderkey").alias("end_index"), F.count("*").alias("entries"))
    return segments.where(F.col("end_index") > upto)


def snapshot_trigger(spark: SparkSession, sf_dir: str, threshold: int = 40) -> DataFrame:
    """Events that take a snapshot of a user's log: each that is threshold entries after the last one that did."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("applied"))
    return e.where(F.col("applied") % threshold == 0)


def payload_chunks(spark: SparkSession, sf_dir: str, size: int = 1000) -> DataFrame:
    """Pages cut to ordered chunks of at most size characters; an empty page has none."""
    p = table(spark, sf_dir, "pages").where("length(html) > 0")
    at = F.explode(F.sequence(F.lit(0), F.length("html") - 1, F.lit(size))).alias("offset")
    cut = p.select("page_id", "html", at).withColumn("chunk", F.substring("html", F.col("offset") + 1, F.lit(size)))
    return cut.select("page_id", F.col("offset").cast("long").alias("offset"), F.length("chunk").cast("long").alias("chars"), F.md5(F.col("chunk").cast("binary")).alias("md5"))


def event_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 95th and 99th percentile and maximum of the values of each event type, exact."""
    q = lambda p: F.greatest(F.ceil(F.col("n") * p) - 1, F.lit(0))
    return stats.kth(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": q(0.5), "p95": q(0.95), "p99": q(0.99), "most": F.col("n") - 1})


def latest_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control-plane records: the newest version of each (user, kind)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("version"), F.max_by("value", "event_id").alias("value"))


def region_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's replicas by role, in order; a group without a data voter is not valid."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.pmod("s_suppkey", F.lit(4)).alias("m"))
    ids = lambda cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("s_suppkey")))), ",")
    out = s.groupBy("s_nationkey").agg(ids(F.col("m") < 2).alias("data"), ids(F.col("m") == 2).alias("witnesses"), ids(F.col("m") == 3).alias("learners"))
    return out.select(F.concat(F.lit("region-"), "s_nationkey").alias("group_id"), "data", "witnesses", "learners", (F.col("data") != "").alias("valid"))


QUERIES = {f.__name__: f for f in (effective_voters, best_virtual_follower, log_purge, snapshot_trigger, payload_chunks, event_quantiles, latest_settings, region_groups)}

_IDS = "coalesce(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) FILTER (s_suppkey % 4 {}), '')"
ORACLES = {
    "effective_voters": """
SELECT s_nationkey, voters, voters // 2 + 1 AS majority FROM (
  SELECT s_nationkey, count(*) FILTER (s_suppkey % 5 <> 0) + bool_or(s_suppkey % 5 = 0)::BIGINT AS voters FROM supplier GROUP BY 1)""",
    "best_virtual_follower": """
SELECT s_nationkey, s_suppkey, virtual, match_index FROM (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey, virtual ORDER BY match_index DESC, s_suppkey DESC) AS rn FROM (
    SELECT s_nationkey, s_suppkey, s_suppkey % 5 = 0 AS virtual, s_suppkey * 37 % 101 AS match_index FROM supplier))
WHERE NOT virtual OR rn = 1""",
    "log_purge": "SELECT o_orderkey // 100 AS segment, min(o_orderkey) AS start_index, max(o_orderkey) AS end_index, count(*) AS entries FROM orders GROUP BY 1 HAVING max(o_orderkey) > 4321",
    "snapshot_trigger": "SELECT user_id, event_id, applied FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS applied FROM events) WHERE applied % 40 = 0",
    "payload_chunks": """
SELECT page_id, begin_at AS "offset", length(substr(html, begin_at + 1, 1000)) AS chars, md5(substr(html, begin_at + 1, 1000)) AS md5
FROM (SELECT page_id, html, unnest(range(0, length(html), 1000)) AS begin_at FROM pages WHERE length(html) > 0)""",
    "event_quantiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS most FROM events GROUP BY 1",
    "latest_settings": "SELECT user_id, event_type, max(event_id) AS version, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "region_groups": f"""
SELECT 'region-' || s_nationkey AS group_id, data, witnesses, learners, data <> '' AS valid FROM (
  SELECT s_nationkey, {_IDS.format("< 2")} AS data, {_IDS.format("= 2")} AS witnesses, {_IDS.format("= 3")} AS learners FROM supplier GROUP BY 1)""",
}
