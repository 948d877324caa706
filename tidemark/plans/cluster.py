"""Regions, replicas and progress, derived from the order and supplier tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import regions as rg
from tidemark.operators import stats
from tidemark.sources.tables import table
from tidemark.streaming import ordered


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of 600 rows for each nation but the last two; the nation leads it. The first has no start, the last no end."""
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").where("n_nationkey < 23").select(F.concat(F.lit("r"), n).alias("region_id"), F.when(n > 0, n * 600).alias("start_row"), F.when(n < 22, (n + 1) * 600).alias("end_row"), F.when(n % 5 != 4, F.col("n_name")).alias("leader"))


def region_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    return rg.route(keys, _regions(spark, sf_dir), "o_orderkey").select("o_orderkey", "region_id", "leader")


def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")  # every seventh scan has no start, every eleventh no end
    scans = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 7 != 0, k * 97).alias("scan_start"), F.when(k % 11 != 0, k * 97 + 900).alias("scan_end"))
    return rg.overlap(scans, _regions(spark, sf_dir)).select("s_suppkey", "region_id", "task_start", "task_end")


def client_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("client_id")).distinct()
    managed = table(spark, sf_dir, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("client_id"))
    return rg.refresh(active, managed)


def _replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    role = F.when(s % 4 == 3, "LEARNER").when(s % 4 == 2, "WITNESS_VOTER").otherwise("DATA_VOTER")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("vnode_id"), s.alias("ordinal"), F.col("s_name").alias("replica_id"), role.alias("role"), (F.col("s_acctbal") > 2000).alias("reachable"))


def _led(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _replicas(spark, sf_dir)
    lead = r.where("role = 'DATA_VOTER'").groupBy("vnode_id").agg(F.min_by("replica_id", "ordinal").alias("leader_id"))
    return r.join(lead, "vnode_id").withColumn("epoch", F.col("vnode_id") + 1)


def quorum_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    acks = _led(spark, sf_dir).select(F.col("vnode_id").alias("region_id"), "role", F.col("reachable").alias("acked"), (F.col("replica_id") == F.col("leader_id")).alias("is_leader"), (F.pmod("vnode_id", F.lit(7)) != 3).alias("leader_matches"))
    return rg.write_gate(acks)


def failover_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.failover(_led(spark, sf_dir))


def membership_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _replicas(spark, sf_dir)
    now, then = r.where("reachable").select("vnode_id", "replica_id", F.lit(True).alias("a")), r.where("role <> 'LEARNER'").select("vnode_id", "replica_id", F.lit(True).alias("b"))
    action = F.when(F.col("a").isNull(), "ADD").when(F.col("b").isNull(), "REMOVE").otherwise("KEEP")
    return now.join(then, ["vnode_id", "replica_id"], "full").select("vnode_id", "replica_id", action.alias("action"))


def commit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("match_index"))
    return stats.majority(p, ["o_custkey"], gap=4000)


def lease_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th least reply of each user, k = n div 2 from 0."""
    return stats.kth(table(spark, sf_dir, "events"), ["user_id"], "event_id", {"lease": F.floor(F.col("n") / 2)})


def vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(40)).alias("election"), F.col("user_id").alias("peer"), F.col("event_id").alias("seq"), F.col("event_type").isin("click", "view").alias("granted"), F.lit(5).alias("voters"))
    return stats.tally(r)


def event_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", F.pmod("user_id", F.lit(17))).alias("name"), F.floor("value").alias("bytes"))
    return stats.hotspots(e, "name", "bytes", 25)


def count_with_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a key range by whole segments of 1,000 and scanned edges."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    whole = o.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("seg")).agg(F.count("*").alias("n")).where("seg >= 1 and seg < 9").select("n")
    edges = o.where("(o_orderkey >= 350 and o_orderkey < 1000) or (o_orderkey >= 9000 and o_orderkey < 9500)").select(F.lit(1).cast("long").alias("n"))
    return whole.union(edges).agg(F.sum("n").alias("n"))


def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("slow"), F.max("value").alias("worst"), F.count_distinct("user_id").alias("users"), F.min("event_id").alias("first_id"))
    return sums.join(stats.kth(e, ["event_type"], "event_id", {"mid": F.floor((F.col("n") - 1) / 2)}), "event_type")


def snapshot_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), (F.col("n_regionkey") != 2).alias("valid"))
    return stats.retained(s, 3)


def map_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    et = F.col("event_type")
    method = F.when(F.pmod("event_id", F.lit(997)) == 0, "clear").when(et == "error", "remove").otherwise("put")
    ops = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), method.alias("method"), F.concat(F.lit("m"), F.pmod("user_id", F.lit(7))).alias("map_name"), F.col("user_id").alias("key"), et.alias("value"))
    return stats.fold_map(ops)


def map_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_fold(spark, sf_dir).groupBy("map_name").agg(F.count("*").alias("size"))


def log_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of each customer's log whose term differs from the one stored."""
    mine = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("idx"), F.pmod("o_orderkey", F.lit(3)).alias("term"))
    theirs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.pmod("o_custkey", F.lit(3)).alias("their_term"))
    return mine.join(theirs, "idx").groupBy("o_custkey").agg(F.min(F.when(F.col("term") != F.col("their_term"), F.col("idx"))).alias("conflict"))


def ordered_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("client_id"), F.col("l_linenumber").alias("seq"))
    return ordered.gap_free(r).groupBy("client_id").agg(F.count("*").alias("handled"), F.max("seq").alias("last_seq"))


def request_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return ordered.deduplicate(e, ["user_id", "event_type"], "ts", 3600).select("user_id", "event_type", "event_id")


def message_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.reassemble(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", "|")


def watch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = table(spark, sf_dir, "events").select("event_type", F.floor("value").cast("long").alias("idx"), F.col("event_id").alias("seq"))
    wanted = table(spark, sf_dir, "events").select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(2000), F.lit(7)).cast("array<long>")).alias("wanted"))
    return ordered.watch(wanted, progress, "event_type")


def read_after_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's least index for a read: that of the user's last write."""
    e = table(spark, sf_dir, "events")
    return e.where("event_type <> 'view'").groupBy("user_id").agg(F.max("event_id").alias("write_index"))


QUERIES = {
    f.__name__: f
    for f in (
        region_route, region_overlap, client_refresh, quorum_gate, failover_plan, membership_change, commit_index, lease_timestamp, vote_tally, event_hotspots, count_with_deltas,
        request_metrics, snapshot_retention, map_fold, map_list, log_conflict, ordered_prefix, request_dedup, message_reassembly, watch_index, read_after_write,
    )
}

_REG = "(SELECT 'r' || n_nationkey AS region_id, CASE WHEN n_nationkey > 0 THEN n_nationkey * 600 END AS start_row, CASE WHEN n_nationkey < 22 THEN (n_nationkey + 1) * 600 END AS end_row, CASE WHEN n_nationkey % 5 <> 4 THEN n_name END AS leader FROM nation WHERE n_nationkey < 23)"
_REP = "(SELECT s_nationkey::BIGINT AS vnode_id, s_suppkey AS ordinal, s_name AS replica_id, CASE WHEN s_suppkey % 4 = 3 THEN 'LEARNER' WHEN s_suppkey % 4 = 2 THEN 'WITNESS_VOTER' ELSE 'DATA_VOTER' END AS role, s_acctbal > 2000 AS reachable FROM supplier)"
_LED = f"(SELECT r.*, leader_id, r.vnode_id + 1 AS epoch FROM {_REP} r JOIN (SELECT vnode_id, arg_min(replica_id, ordinal) AS leader_id FROM {_REP} WHERE role = 'DATA_VOTER' GROUP BY 1) l USING (vnode_id))"
_MAP = """(SELECT map_name, key, value FROM (
  SELECT *, row_number() OVER (PARTITION BY map_name, key ORDER BY seq DESC) AS rn FROM ops WHERE method <> 'clear')
  LEFT JOIN (SELECT map_name AS cm, max(seq) AS cleared FROM ops WHERE method = 'clear' GROUP BY 1) ON cm = map_name
  WHERE rn = 1 AND method = 'put' AND (cleared IS NULL OR seq > cleared))"""
_OPS = "WITH ops AS (SELECT event_id AS seq, CASE WHEN event_id % 997 = 0 THEN 'clear' WHEN event_type = 'error' THEN 'remove' ELSE 'put' END AS method, 'm' || (user_id % 7) AS map_name, user_id AS key, event_type AS value FROM events)"

ORACLES = {
    "region_route": f"SELECT o_orderkey, region_id, leader FROM orders LEFT JOIN {_REG} ON (start_row IS NULL OR o_orderkey >= start_row) AND (end_row IS NULL OR o_orderkey < end_row)",
    "region_overlap": f"""
SELECT s_suppkey, region_id, greatest(a, start_row) AS task_start, least(b, end_row) AS task_end
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey * 97 END AS a, CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey * 97 + 900 END AS b FROM supplier)
JOIN {_REG} ON (a IS NULL OR end_row IS NULL OR a < end_row) AND (start_row IS NULL OR b IS NULL OR start_row < b)""",
    "client_refresh": """
SELECT coalesce(a, m) AS client_id, CASE WHEN a IS NULL THEN 'UNREGISTER' WHEN m IS NULL THEN 'REGISTER' ELSE 'RETAIN' END AS action
FROM (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderstatus = 'O') FULL JOIN (SELECT c_custkey AS m FROM customer WHERE c_acctbal > 3000) ON a = m""",
    "quorum_gate": f"""
SELECT region_id, required, acked, reason IS NULL AS allowed, reason FROM (
  SELECT *, CASE WHEN NOT ok THEN 'leader does not match metadata' WHEN acked < required THEN 'quorum is not satisfied' END AS reason FROM (
    SELECT vnode_id AS region_id, count(*) FILTER (role <> 'LEARNER') // 2 + 1 AS required, count(*) FILTER (role <> 'LEARNER' AND reachable) AS acked, vnode_id % 7 <> 3 AS ok FROM {_LED} GROUP BY vnode_id))""",
    "failover_plan": f"""
SELECT vnode_id, action, CASE action WHEN 'KEEP_LEADER' THEN leader_id WHEN 'PROMOTE_DATA_LEADER' THEN heir END AS leader, epoch + (action = 'PROMOTE_DATA_LEADER')::BIGINT AS epoch FROM (
  SELECT *, CASE WHEN up >= n // 2 + 1 AND leader_up THEN 'KEEP_LEADER' WHEN up >= n // 2 + 1 AND heir IS NOT NULL THEN 'PROMOTE_DATA_LEADER' WHEN heir IS NOT NULL THEN 'DEGRADED_READONLY' ELSE 'UNAVAILABLE' END AS action FROM (
    SELECT vnode_id, count(*) FILTER (role <> 'LEARNER') AS n, count(*) FILTER (role <> 'LEARNER' AND reachable) AS up, bool_or(reachable AND replica_id = leader_id) AS leader_up,
           arg_min(replica_id, ordinal) FILTER (reachable AND role = 'DATA_VOTER') AS heir, any_value(leader_id) AS leader_id, any_value(epoch) AS epoch FROM {_LED} GROUP BY 1))""",
    "membership_change": f"""
SELECT vnode_id, replica_id, CASE WHEN NOT reachable THEN 'ADD' WHEN role = 'LEARNER' THEN 'REMOVE' ELSE 'KEEP' END AS action FROM {_REP} WHERE reachable OR role <> 'LEARNER'""",
    "commit_index": """
SELECT o_custkey, least, CASE WHEN mid - least > 4000 THEN least ELSE mid END AS majority, greatest FROM (
  SELECT o_custkey, min(o_orderkey) AS least, list_sort(list(o_orderkey))[(count(*) - 1) // 2 + 1] AS mid, max(o_orderkey) AS greatest FROM orders GROUP BY 1)""",
    "lease_timestamp": "SELECT user_id, list_sort(list(event_id))[count(*) // 2 + 1] AS lease FROM events GROUP BY 1",
    "vote_tally": """
SELECT election, yes, no, CASE WHEN yes >= 3 THEN 'PASSED' WHEN 5 - no < 3 THEN 'REJECTED' ELSE 'TIMEOUT' END AS result FROM (
  SELECT user_id % 40 AS election, count(*) FILTER (granted) AS yes, count(*) FILTER (NOT granted) AS no FROM (
    SELECT user_id, arg_min(event_type IN ('click', 'view'), event_id) AS granted FROM events GROUP BY 1) GROUP BY 1)""",
    "event_hotspots": """
SELECT name, amount::BIGINT AS amount, events FROM (
  SELECT event_type || '/' || (user_id % 17) AS name, sum(greatest(floor(value)::BIGINT, 0)) AS amount, count(*) AS events FROM events GROUP BY 1)
ORDER BY CASE WHEN amount > 0 THEN amount ELSE events END DESC, name LIMIT 25""",
    "count_with_deltas": "SELECT count(*) AS n FROM orders WHERE o_orderkey >= 350 AND o_orderkey < 9500",
    "request_metrics": """
SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS slow, max(value) AS worst, list_sort(list(event_id))[(count(*) - 1) // 2 + 1] AS mid,
       count(DISTINCT user_id) AS users, min(event_id) AS first_id FROM events GROUP BY 1""",
    "snapshot_retention": """
SELECT n_nationkey AS idx, n_regionkey <> 2 AS valid, (SELECT count(*) FROM nation b WHERE b.n_nationkey > a.n_nationkey AND b.n_regionkey <> 2) >= 3 AS deleted FROM nation a""",
    "map_fold": f"{_OPS} SELECT * FROM {_MAP}",
    "map_list": f"{_OPS} SELECT map_name, count(*) AS size FROM {_MAP} GROUP BY 1",
    "log_conflict": "SELECT o_custkey, min(CASE WHEN o_orderkey % 3 <> o_custkey % 3 THEN o_orderkey END) AS conflict FROM orders GROUP BY 1",
    "ordered_prefix": """
SELECT client_id, count(*) AS handled, max(seq) AS last_seq FROM (
  SELECT l_orderkey AS client_id, l_linenumber AS seq, row_number() OVER w AS n, min(l_linenumber) OVER w AS f
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
WHERE seq - f + 1 = n GROUP BY 1""",
    # Each kept request is the first at least an hour after the one kept before.
    "request_dedup": """
WITH RECURSIVE k AS (
  SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY 1, 2
  UNION ALL SELECT k.user_id, k.event_type, min(e.ts) FROM k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts >= k.t + INTERVAL 1 HOUR GROUP BY k.user_id, k.event_type, k.t)
SELECT k.user_id, k.event_type, min(event_id) AS event_id FROM k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts = k.t GROUP BY k.user_id, k.event_type, k.t""",
    "message_reassembly": "SELECT conv_id, count(*) AS parts, min(turn) = 0 AND max(turn) + 1 = count(DISTINCT turn) AS complete, string_agg(text, '|' ORDER BY turn) AS text FROM conversations GROUP BY 1",
    "watch_index": """
SELECT event_type, wanted, reached_at, CASE WHEN reached_at IS NULL THEN 'TIMEOUT' ELSE 'DONE' END AS status FROM (
  SELECT t.event_type, w.wanted, (SELECT min(e.event_id) FROM events e WHERE e.event_type = t.event_type AND floor(e.value)::BIGINT >= w.wanted) AS reached_at
  FROM (SELECT DISTINCT event_type FROM events) t, (SELECT unnest(range(0, 2001, 7)) AS wanted) w)""",
    "read_after_write": "SELECT user_id, max(event_id) AS write_index FROM events WHERE event_type <> 'view' GROUP BY 1",
}
