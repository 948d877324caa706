"""Reads and writes across regions, folds of map operations, and checks of order and reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import table_functions
from tidemark.operators import kv, mvcc, stats
from tidemark.operators import regions as rg
from tidemark.plans.cluster import _regions, client_refresh
from tidemark.sources import region_source as region_scan
from tidemark.sources.tables import table
from tidemark.streaming import ordered


def region_scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a scan over all regions, which a budget of rows bounds: 700 from key 1,500."""
    rows = rg.route(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), _regions(spark, sf_dir), "o_orderkey").where("region_id is not null")
    return kv.scan(rows, "o_orderkey", 100, None, limit=700, resume=1500).select("region_id", "o_orderkey", "o_totalprice", "has_more", "resume_key")


def region_count_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a key range in each region, and in all of them."""
    rows = rg.route(table(spark, sf_dir, "orders").select("o_orderkey").where("o_orderkey >= 250 and o_orderkey < 9000"), _regions(spark, sf_dir), "o_orderkey").where("region_id is not null")
    return rows.rollup("region_id").agg(F.count("*").alias("n"))


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region result rows: those of an index have its id and key beside the row's, others nulls."""
    o = table(spark, sf_dir, "orders")
    is_index = F.pmod("o_orderkey", F.lit(3)) == 0
    hexed = lambda c: F.lower(F.hex(c))
    return o.select(F.col("o_orderkey").alias("row_id"), "o_orderstatus", hexed("o_orderkey").alias("key_hex"), F.when(is_index, F.lit(1)).cast("long").alias("index_id"), F.when(is_index, hexed("o_custkey")).alias("index_hex"))


def routed_lock_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary lock of each order by way of its key's region; without a leader or region the reason instead."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    met = rg.route(o, _regions(spark, sf_dir), "o_orderkey")
    return met.select("o_orderkey", "leader", F.when(F.col("region_id").isNull(), "no route").when(F.col("leader").isNull(), "no leader").when(F.col("o_orderstatus") == "F", "COMMITTED").otherwise("PENDING").alias("status"))


def _mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_returnflag"))
    region = F.when(F.pmod("l_suppkey", F.lit(7)) > 0, F.concat(F.lit("r"), F.pmod("l_suppkey", F.lit(7))))
    return l.select(F.col("l_orderkey").alias("txn_id"), F.col("l_linenumber").cast("long").alias("part"), F.pmod("l_partkey", F.lit(500)).alias("key"), region.alias("region_id"), F.lit(None).cast("long").alias("primary_key"), F.col("l_orderkey").alias("start_ts"), value.alias("value"))


def _prewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderkey % 3 = 0").select(F.pmod("o_custkey", F.lit(500)).alias("key"), F.col("o_orderkey").alias("txn_id"))
    versions = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.pmod("user_id", F.lit(500)).alias("key"), (F.col("event_id") - 400).alias("commit_ts"))
    return mvcc.prewrite(_mutations(spark, sf_dir), locks, versions)


def prewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prewritten(spark, sf_dir).select("txn_id", "part", "key", "lock_primary", "lock_region", "error")


def two_phase_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mvcc.two_phase(_prewritten(spark, sf_dir).withColumn("primary", F.col("part") == 1).withColumn("region_id", F.col("lock_region")))


def system_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as views (nodes, regions, transactions, locks), and how many rows each has."""
    o = table(spark, sf_dir, "orders")
    views = {
        "sys_nodes": table(spark, sf_dir, "supplier").select(F.col("s_name").alias("node_id"), F.col("s_nationkey").alias("zone")),
        "sys_regions": _regions(spark, sf_dir),
        "sys_transactions": o.select(F.col("o_orderkey").alias("txn_id"), F.when(F.col("o_orderstatus") == "F", "COMMITTED").otherwise("OPEN").alias("state")),
        "sys_locks": o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("key")),
    }
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    return spark.sql(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM {name}" for name in views))


_LABELS = [("joining", "THE"), ("joining", "und"), ("ending", "ing"), ("ending", "tion"), ("rare", "Zzz")]


def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for each label any of whose patterns they contain, in either case."""
    patterns = spark.createDataFrame(_LABELS, "label string, pattern string")
    return stats.label(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", patterns)


def joint_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit index of customers whose peers change: the lesser of the majorities of old and new peers."""
    p = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("match_index"), (F.col("o_orderstatus") != "O").alias("old"), (F.col("o_orderstatus") != "F").alias("new"))
    return stats.joint(p, ["o_custkey"])


def log_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first and last log entry by term, then index."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.struct(F.pmod("o_orderkey", F.lit(4)).alias("term"), F.col("o_orderkey").alias("idx")).alias("at"))
    return o.groupBy("o_custkey").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).select("o_custkey", F.col("lo.term").alias("first_term"), F.col("lo.idx").alias("first_index"), F.col("hi.term").alias("last_term"), F.col("hi.idx").alias("last_index"))


def pending_watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's watches in the order in which they complete: by index, then time of creation."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("idx"))
    return e.withColumn("turn", F.row_number().over(Window.partitionBy("user_id").orderBy("idx", "event_id")).cast("long"))


def snapshot_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all pages as one snapshot's files; no file at all is an error."""
    total = table(spark, sf_dir, "pages").agg(F.count("*").alias("files"), F.sum(F.octet_length(F.coalesce("html", F.lit("")))).alias("bytes"))
    return total.select("files", F.when(F.col("files") > 0, F.col("bytes")).otherwise(F.raise_error(F.lit("a snapshot without files")).cast("long")).alias("bytes"))


def refresh_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = client_refresh(spark, sf_dir)
    count = lambda x: F.count_if(F.col("action") == x)
    return done.agg(count("REGISTER").alias("registered"), count("RETAIN").alias("retained"), count("UNREGISTER").alias("unregistered"), F.count_if((F.col("action") != "UNREGISTER") & (F.pmod("client_id", F.lit(5)) == 4)).alias("without_leader"))


def cache_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses and hit rate for each event type; a repeat of a user's kind of event is a hit."""
    e = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    out = e.groupBy("event_type").agg(F.sum(F.col("n") - 1).alias("hits"), F.count("*").alias("misses"))
    return out.withColumn("rate", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6))


def approximate_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketch of distinct customers of each order status is within a tenth of the count."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.count_distinct("o_custkey").alias("n"))
    return o.select("o_orderstatus", "n", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("close"))


def _map_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as map operations, of which some put or replace several entries or drop the map."""
    key, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    method = F.when(key % 1009 == 0, "drop").when(key % 499 == 0, "replaceAll").when(key % 7 == 0, "putAll").when(kind == "error", "remove").otherwise("put")
    both = F.map_from_arrays(F.array(user, user + 1000), F.array(kind, F.upper(kind)))
    return table(spark, sf_dir, "events").select(key.alias("seq"), method.alias("method"), F.concat(F.lit("m"), F.pmod(user, F.lit(7))).alias("map_name"), user.alias("key"), kind.alias("value"), F.when(method.isin("putAll", "replaceAll"), both).alias("entries"))


def map_fold_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fold_map(stats.spread_entries(_map_ops(spark, sf_dir)))


def map_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of some keys in each map."""
    return map_fold_all(spark, sf_dir).where("key % 10 = 3").select("map_name", "key", "value")


def map_read_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read function over whole maps: entries, the greatest key, and the longest value."""
    return stats.map_read(map_fold_all(spark, sf_dir), size=F.count("*"), last_key=F.max("key"), longest=F.max(F.length("value")).cast("long"))


def map_update_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update function over the entries of one map."""
    return stats.map_update(map_fold_all(spark, sf_dir), "m3", lambda key, value: F.concat(F.upper(value), F.lit("#"), key.cast("string")))


def map_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many maps there are, and entries in all."""
    return map_fold_all(spark, sf_dir).agg(F.count_distinct("map_name").alias("maps"), F.count("*").alias("entries"))


def apply_new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a log that advance each user's applied position (term, index); others are skipped."""
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 1000).alias("term"), F.col("event_id").alias("idx"))
    applied = e.where("idx % 3 = 0 and idx < 5000").groupBy("user_id").agg(F.max(F.struct("term", "idx")).alias("at"))
    return ordered.unapplied(e, applied, "user_id")


def stale_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read that waits for a user's own writes: refused where the region's commit is behind them."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    mine = e.where("event_type <> 'view'").groupBy("user_id").agg(F.max("event_id").alias("write_index"))
    done = e.groupBy(F.pmod("user_id", F.lit(7)).alias("region")).agg((F.max("event_id") - 3).alias("commit_index"))
    return ordered.guarded_read(mine.withColumn("region", F.pmod("user_id", F.lit(7))), done, "region")


def routing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether suppliers under those of half their key are a tree: one root, one way to each, all reached."""
    edges = table(spark, sf_dir, "supplier").where("s_suppkey > 1").select(F.floor(F.col("s_suppkey") / 2).alias("parent"), F.col("s_suppkey").alias("child"))
    return rg.tree_check(edges)


def merge_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers merged with suppliers of their key: met rows are updated, or deleted where in debt; others are inserted."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_acctbal").alias("v"))
    return mvcc.merge(c, s, "k", delete=F.col("new.v") < 0)


def region_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read region by region through the package's own data source."""
    bounds = list(range(0, 15001, 3000))
    return region_scan.scan(spark, f"{sf_dir}/orders.parquet", "o_orderkey", bounds).groupBy(F.floor(F.col("o_orderkey") / 3000).alias("region")).agg(F.count("*").alias("n"), F.max("o_custkey").alias("last_customer"))


def list_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists without repeats in their order, and whether two lists are equal whatever their order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(*[F.pmod(F.col("o_orderkey") * i, F.lit(5)) for i in (3, 1, 4, 1)]).alias("a"), F.array(*[F.pmod(F.col("o_orderkey") * i, F.lit(5)) for i in (1, 4, 1, 8)]).alias("b"))
    return o.select("o_orderkey", F.array_join(F.array_distinct("a"), ",").alias("once"), (F.array_sort("a") == F.array_sort("b")).alias("same"))


def region_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of regions put together as a bag, with the region's place and the row's place in it."""
    rows = rg.route(table(spark, sf_dir, "orders").select("o_orderkey"), _regions(spark, sf_dir), "o_orderkey").where("region_id is not null")
    placed = rg.places(rows.select("region_id", "o_orderkey"), "region_id", "o_orderkey")
    return placed.select(F.substring("region_id", 2, 10).cast("long").alias("region"), "o_orderkey", "place")


def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of dates, arrays and maps."""
    day = F.col("o_orderdate")
    held = F.map_from_arrays(F.array(F.lit("y"), F.lit("m")), F.array(F.year(day), F.month(day)))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.quarter(day).cast("long").alias("quarter"), F.datediff(F.last_day(day), day).cast("long").alias("left"), F.date_format(F.add_months(F.to_date(day), 1), "yyyy-MM-dd").alias("next"),
        (held["y"] * 100 + held["m"]).cast("long").alias("ym"), F.array_max(F.array(F.dayofmonth(day), F.month(day))).cast("long").alias("greater"), F.array_join(F.map_keys(held), "").alias("names"),
    )


def late_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests below the number that their client is to send next are late, others are accepted."""
    sent = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("client_id"), F.col("l_linenumber").cast("long").alias("seq"))
    ahead = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("client_id"), F.pmod("o_custkey", F.lit(8)).alias("next_seq"))
    return ordered.judged(sent, ahead).groupBy("client_id", "status").agg(F.count("*").alias("n"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function in SQL: the parts of page addresses with their places."""
    spark.udtf.register("path_parts", table_functions.PathParts)
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return spark.sql("SELECT page_id, t.place, t.part FROM pages, LATERAL path_parts(url) t")


QUERIES = {
    f.__name__: f
    for f in (
        region_scan_page, region_count_merge, index_rows, routed_lock_status, prewrite, two_phase_commit, system_tables, label_match, joint_majority, log_positions, pending_watches, snapshot_bytes, refresh_counters,
        cache_rates, approximate_users, map_fold_all, map_get, map_read_function, map_update_function, map_count, apply_new_entries, stale_read, routing_tree, merge_into, region_source, late_requests, url_parts, list_equality, region_union, date_parts,
    )
}

_REGION = "CASE WHEN o_orderkey < 13800 THEN 'r' || greatest(o_orderkey // 600, 0) ELSE 'r22' END"
_MUT = """(SELECT l_orderkey AS txn_id, l_linenumber::BIGINT AS part, l_partkey % 500 AS key, CASE WHEN l_suppkey % 7 > 0 THEN 'r' || (l_suppkey % 7) ELSE 'unknown' END AS region,
  CASE WHEN l_linenumber = 7 THEN '' ELSE l_returnflag END AS value FROM lineitem)"""
_PRE = f"""(SELECT m.*, CASE WHEN value = '' THEN 'empty value' WHEN lock_txn <> txn_id OR locks > 1 THEN 'locked by ' || CASE WHEN lock_txn <> txn_id THEN lock_txn ELSE lock_last END WHEN newest > txn_id THEN 'write conflict at ' || newest END AS error
  FROM {_MUT} m LEFT JOIN (SELECT o_custkey % 500 AS lk, min(o_orderkey) AS lock_txn, max(o_orderkey) AS lock_last, count(DISTINCT o_orderkey) AS locks FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 3 = 0 GROUP BY 1) ON lk = key
  LEFT JOIN (SELECT user_id % 500 AS vk, max(event_id) - 400 AS newest FROM events WHERE event_type = 'purchase' GROUP BY 1) ON vk = key)"""
_MOPS = """ops AS (SELECT event_id AS seq, CASE WHEN event_id % 1009 = 0 THEN 'drop' WHEN event_id % 499 = 0 THEN 'replaceAll' WHEN event_id % 7 = 0 THEN 'putAll' WHEN event_type = 'error' THEN 'remove' ELSE 'put' END AS method,
    'm' || (user_id % 7) AS map_name, user_id, event_type FROM events),
  clears AS (SELECT map_name AS cm, max(seq) AS cleared FROM ops WHERE method IN ('drop', 'replaceAll') GROUP BY 1),
  flat AS (SELECT seq, map_name, user_id AS key, CASE WHEN method <> 'remove' THEN event_type END AS value FROM ops WHERE method <> 'drop'
           UNION ALL SELECT seq, map_name, user_id + 1000, upper(event_type) FROM ops WHERE method IN ('putAll', 'replaceAll')),
  folded AS (SELECT map_name, key, value FROM (SELECT *, row_number() OVER (PARTITION BY map_name, key ORDER BY seq DESC) AS rn FROM flat) LEFT JOIN clears ON cm = map_name
             WHERE rn = 1 AND value IS NOT NULL AND (cleared IS NULL OR seq >= cleared))"""

ORACLES = {
    "region_scan_page": f"""
SELECT region_id, o_orderkey, o_totalprice, has_more, CASE WHEN has_more THEN max(o_orderkey) OVER () END AS resume_key FROM (
  SELECT {_REGION} AS region_id, o_orderkey, o_totalprice, (SELECT count(*) > 700 FROM orders WHERE o_orderkey > 1500) AS has_more FROM orders WHERE o_orderkey > 1500 ORDER BY o_orderkey LIMIT 700)""",
    "region_count_merge": f"SELECT region_id, count(*) AS n FROM (SELECT {_REGION} AS region_id FROM orders WHERE o_orderkey >= 250 AND o_orderkey < 9000) GROUP BY ROLLUP (region_id)",
    "index_rows": "SELECT o_orderkey AS row_id, o_orderstatus, lower(hex(o_orderkey)) AS key_hex, CASE WHEN o_orderkey % 3 = 0 THEN 1::BIGINT END AS index_id, CASE WHEN o_orderkey % 3 = 0 THEN lower(hex(o_custkey)) END AS index_hex FROM orders",
    "routed_lock_status": """
SELECT o_orderkey, leader, CASE WHEN leader IS NULL THEN 'no leader' WHEN o_orderstatus = 'F' THEN 'COMMITTED' ELSE 'PENDING' END AS status
FROM orders LEFT JOIN (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 5 <> 4 THEN n_name END AS leader FROM nation) ON n = least(o_orderkey // 600, 22)""",
    "prewrite": f"SELECT txn_id, part, key, key AS lock_primary, region AS lock_region, error FROM {_PRE}",
    "two_phase_commit": f"""
SELECT txn_id, CASE WHEN bad = 0 THEN 'COMMIT' ELSE 'ROLLBACK' END AS outcome, CASE WHEN primary_bad > 0 THEN primaries ELSE n END AS sent, CASE WHEN primary_bad > 0 THEN primary_error ELSE other_error END AS error FROM (
  SELECT txn_id, count(*) AS n, count(error) AS bad, count(*) FILTER (part = 1) AS primaries, count(error) FILTER (part = 1) AS primary_bad,
         min(error) FILTER (part = 1) AS primary_error, min(error) AS other_error FROM {_PRE} GROUP BY 1)""",
    "system_tables": """
SELECT 'sys_nodes' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'sys_regions', count(*) FROM nation WHERE n_nationkey < 23
UNION ALL SELECT 'sys_transactions', count(*) FROM orders UNION ALL SELECT 'sys_locks', count(*) FROM orders WHERE o_orderstatus = 'P'""",
    "label_match": """
SELECT DISTINCT doc_id, label FROM documents, (VALUES ('joining', 'the'), ('joining', 'und'), ('ending', 'ing'), ('ending', 'tion'), ('rare', 'zzz')) p(label, pattern) WHERE contains(lower(text), pattern)""",
    "joint_majority": """
SELECT o_custkey, o AS old, n AS new, least(o, n) AS joint FROM (
  SELECT o_custkey, (list_sort(list(o_orderkey) FILTER (o_orderstatus <> 'O')))[(count(*) FILTER (o_orderstatus <> 'O') - 1) // 2 + 1] AS o,
         (list_sort(list(o_orderkey) FILTER (o_orderstatus <> 'F')))[(count(*) FILTER (o_orderstatus <> 'F') - 1) // 2 + 1] AS n FROM orders GROUP BY 1)""",
    "log_positions": """
SELECT o_custkey, lo.term AS first_term, lo.idx AS first_index, hi.term AS last_term, hi.idx AS last_index FROM (
  SELECT o_custkey, min({'term': o_orderkey % 4, 'idx': o_orderkey}) AS lo, max({'term': o_orderkey % 4, 'idx': o_orderkey}) AS hi FROM orders GROUP BY 1)""",
    "pending_watches": "SELECT user_id, event_id, floor(value)::BIGINT AS idx, row_number() OVER (PARTITION BY user_id ORDER BY floor(value), event_id) AS turn FROM events",
    "snapshot_bytes": "SELECT count(*) AS files, sum(strlen(coalesce(html, '')))::BIGINT AS bytes FROM pages",
    "refresh_counters": """
SELECT count(*) FILTER (m IS NULL) AS registered, count(*) FILTER (a IS NOT NULL AND m IS NOT NULL) AS retained, count(*) FILTER (a IS NULL) AS unregistered, count(*) FILTER (a IS NOT NULL AND a % 5 = 4) AS without_leader
FROM (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderstatus = 'O') FULL JOIN (SELECT c_custkey AS m FROM customer WHERE c_acctbal > 3000) ON a = m""",
    "cache_rates": "SELECT event_type, (count(*) - count(DISTINCT user_id))::BIGINT AS hits, count(DISTINCT user_id) AS misses, round((count(*) - count(DISTINCT user_id)) / count(*), 6) AS rate FROM events GROUP BY 1",
    "approximate_users": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, true AS close FROM orders GROUP BY 1",
    "map_fold_all": f"WITH {_MOPS} SELECT * FROM folded",
    "map_get": f"WITH {_MOPS} SELECT * FROM folded WHERE key % 10 = 3",
    "map_read_function": f"WITH {_MOPS} SELECT map_name, count(*) AS size, max(key) AS last_key, max(length(value))::BIGINT AS longest FROM folded GROUP BY 1",
    "map_update_function": f"WITH {_MOPS} SELECT map_name, key, CASE WHEN map_name = 'm3' THEN upper(value) || '#' || key ELSE value END AS value FROM folded",
    "map_count": f"WITH {_MOPS} SELECT count(DISTINCT map_name) AS maps, count(*) AS entries FROM folded",
    "apply_new_entries": """
SELECT user_id, event_id // 1000 AS term, event_id AS idx FROM events LEFT JOIN (SELECT user_id AS u, max(event_id) AS done FROM events WHERE event_id % 3 = 0 AND event_id < 5000 GROUP BY 1) ON u = user_id WHERE done IS NULL OR event_id > done""",
    "stale_read": """
SELECT user_id, write_index, commit_index, CASE WHEN commit_index < write_index THEN 'commit index is behind' END AS refused FROM (
  SELECT user_id, max(event_id) AS write_index FROM events WHERE event_type <> 'view' GROUP BY 1) JOIN (SELECT user_id % 7 AS region, max(event_id) - 3 AS commit_index FROM events GROUP BY 1) ON region = user_id % 7""",
    "routing_tree": """
WITH RECURSIVE e AS (SELECT s_suppkey // 2 AS parent, s_suppkey AS child FROM supplier WHERE s_suppkey > 1),
v AS (SELECT parent AS x FROM e UNION SELECT child FROM e), roots AS (SELECT x FROM v WHERE x NOT IN (SELECT child FROM e)),
r AS (SELECT x FROM roots UNION SELECT child FROM r JOIN e ON parent = x)
SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM roots) AS roots, (SELECT count(*) FROM (SELECT child FROM e GROUP BY 1 HAVING count(*) > 1)) AS doubled, (SELECT count(*) FROM r) AS reached,
  (SELECT count(*) FROM roots) = 1 AND (SELECT count(*) FROM r) = (SELECT count(*) FROM v) AND (SELECT count(*) FROM e) = (SELECT count(*) FROM v) - 1 AS valid""",
    "list_equality": """
SELECT o_orderkey, array_to_string(list_transform(list_filter(range(1, 5), lambda i: list_position(a, a[i]) = i), lambda i: a[i]), ',') AS once, list_sort(a) = list_sort(b) AS same
FROM (SELECT o_orderkey, [o_orderkey * 3 % 5, o_orderkey % 5, o_orderkey * 4 % 5, o_orderkey % 5] AS a, [o_orderkey % 5, o_orderkey * 4 % 5, o_orderkey % 5, o_orderkey * 8 % 5] AS b FROM orders)""",
    "region_union": f"SELECT region, o_orderkey, row_number() OVER (PARTITION BY region ORDER BY o_orderkey) AS place FROM (SELECT substr({_REGION}, 2)::BIGINT AS region, o_orderkey FROM orders)",
    "date_parts": """
SELECT o_orderkey, quarter(o_orderdate) AS quarter, datediff('day', o_orderdate, last_day(o_orderdate)) AS "left", strftime(o_orderdate::DATE + INTERVAL 1 MONTH, '%Y-%m-%d') AS next,
       year(o_orderdate) * 100 + month(o_orderdate) AS ym, greatest(day(o_orderdate), month(o_orderdate)) AS greater, 'ym' AS names FROM orders""",
    "region_source": "SELECT o_orderkey // 3000 AS region, count(*) AS n, max(o_custkey) AS last_customer FROM orders GROUP BY 1",
    "late_requests": "SELECT l_orderkey AS client_id, CASE WHEN l_linenumber < o_custkey % 8 THEN 'LATE' ELSE 'ACCEPTED' END AS status, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "url_parts": "SELECT page_id, unnest(range(0, len(p))) AS place, unnest(p) AS part FROM (SELECT page_id, string_split(url, '/') AS p FROM pages WHERE url IS NOT NULL)",
    "merge_into": """
SELECT coalesce(k1, k2) AS k, coalesce(v2, v1) AS v FROM (SELECT c_custkey AS k1, c_acctbal AS v1 FROM customer) FULL JOIN (SELECT s_suppkey * 3 AS k2, s_acctbal AS v2 FROM supplier) ON k1 = k2
WHERE k1 IS NULL OR k2 IS NULL OR v2 >= 0""",
}
