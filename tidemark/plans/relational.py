"""The relational surface, declared in SQL: joins, grouping, windows and set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codecs, scalar
from tidemark.sources.tables import table

#: Text that Spark and the check read alike.
SQL = {
    "join_inner": "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_full": "SELECT a.k AS a, b.k AS b FROM (SELECT s_suppkey AS k FROM supplier) a FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 = 0) b ON a.k = b.k",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')",
    "join_right": "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_cross": "SELECT r_name, b.o_orderstatus AS status, count(*) AS n FROM region CROSS JOIN (SELECT o_orderstatus FROM orders WHERE o_orderkey % 100 = 0) b GROUP BY r_name, b.o_orderstatus",
    "join_lateral": "SELECT c_custkey, t.n, t.last_key FROM customer, LATERAL (SELECT count(*) AS n, max(o_orderkey) AS last_key FROM orders WHERE o_custkey = c_custkey) t",
    "join_theta": "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "subquery_scalar": "SELECT p_partkey FROM part WHERE p_size > (SELECT avg(p_size) FROM part)",
    "group_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10",
    "group_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "group_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "group_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "window_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders",
    "window_lag": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(event_type, 1, 'none') OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events",
    "window_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS near, max(event_id) OVER (PARTITION BY user_id) AS last_id FROM events",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) u GROUP BY k",
    "set_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey < 1000",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O'",
    "recursive_reach": "WITH RECURSIVE t(n) AS (SELECT min(n_nationkey) FROM nation UNION ALL SELECT n + 1 FROM t WHERE n < 24) SELECT n, n_name FROM t JOIN nation ON n = n_nationkey",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS qty, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "skip_take": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 12",
    "top_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
}


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return query


def scalar_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return o.select("o_orderkey", scalar.to_long(price).alias("as_long"), scalar.to_boolean(F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("0")).alias("as_bool"), scalar.half_up(F.col("o_orderkey") / 4 - 100, 0).cast("long").alias("rounded"))


def scalar_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", scalar.head(u, "://").alias("scheme"), scalar.between(u, "://", "/").alias("host"), scalar.last_tail(u, "/").alias("leaf"), scalar.tail(u, "#").alias("anchor"),
        scalar.short_hex(u.cast("binary")).alias("hex"), F.md5(u.cast("binary")).alias("md5"), F.sha2(u, 256).alias("sha"), F.size(scalar.split_trimmed(F.replace(u, F.lit("/"), F.lit(" , ")))).cast("long").alias("parts"),
    )


def scalar_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.concat(F.col("p_size"), F.element_at(F.array(*[F.lit(x) for x in ("b", "kb", "m", "g")]), F.pmod("p_partkey", F.lit(4)).cast("int") + 1))
    wait = F.concat(F.col("p_size"), F.element_at(F.array(*[F.lit(x) for x in ("ms", " s", "min", "")]), F.pmod("p_partkey", F.lit(4)).cast("int") + 1))
    return p.select("p_partkey", scalar.size_bytes(size).alias("bytes"), scalar.duration_nanos(wait).alias("nanos"), scalar.round_up(F.col("p_partkey"), 64).alias("up"))


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.length(F.to_json(F.struct("event_id", "event_type"))).cast("long").alias("n"), F.get_json_object("props", "$").isNotNull().alias("is_json"))


def codec_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", codecs.crc32c(u).alias("crc32c"), codecs.base58(u).alias("base58"))


QUERIES = {k: _run(v) for k, v in SQL.items()} | {f.__name__: f for f in (scalar_casts, scalar_strings, scalar_sizes, json_paths, codec_digests)}

ORACLES = {**SQL} | {
    "pricing_summary": SQL["pricing_summary"].replace("AS BIGINT)) AS qty", "AS BIGINT))::BIGINT AS qty").replace("AS BIGINT)) AS cents", "AS BIGINT))::BIGINT AS cents"),
    "scalar_casts": "SELECT o_orderkey, trunc(o_totalprice::DECIMAL(18,2))::BIGINT AS as_long, o_orderstatus = 'F' AS as_bool, floor(o_orderkey / 4 - 100 + 0.5)::BIGINT AS rounded FROM orders",
    "scalar_strings": """
SELECT page_id, split_part(url, '://', 1) AS scheme, CASE WHEN contains(substr(url, strpos(url, '://') + 3), '/') THEN split_part(substr(url, strpos(url, '://') + 3), '/', 1) END AS host,
       list_extract(string_split(url, '/'), -1) AS leaf, CASE WHEN contains(url, '#') THEN substr(url, strpos(url, '#') + 1) END AS anchor,
       CASE WHEN strlen(url) <= 10 THEN lower(hex(url)) ELSE lower(substr(hex(url), 1, 20)) || '...(size=' || strlen(url) || ')' END AS hex,
       md5(url) AS md5, sha256(url) AS sha, len(string_split(url, '/'))::BIGINT AS parts FROM pages""",
    "scalar_sizes": """
SELECT p_partkey, (p_size::BIGINT * [1, 1024, 1048576, 1073741824][(p_partkey % 4 + 1)::INT])::BIGINT AS bytes, (p_size::BIGINT * [1000000, 1000000000, 60000000000, 1000000][(p_partkey % 4 + 1)::INT])::BIGINT AS nanos,
       ((p_partkey + 63) // 64 * 64)::BIGINT AS up FROM part""",
    "json_paths": """SELECT event_id, strlen('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}')::BIGINT AS n, json_valid(props) AS is_json FROM events""",
}
