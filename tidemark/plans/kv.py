"""Point reads and range scans: orders as rows keyed by o_orderkey, customers by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import kv
from tidemark.sources.tables import table

_COLS = ["o_orderkey", "o_custkey", "o_totalprice"]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*_COLS)


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") * 13).alias("o_orderkey"))


def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.get(_orders(spark, sf_dir), _wanted(spark, sf_dir), "o_orderkey")


def kv_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.exists(_orders(spark, sf_dir), _wanted(spark, sf_dir), "o_orderkey")


def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(_orders(spark, sf_dir), "o_orderkey", 100, 5000, limit=0, resume=355)


def kv_scan_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(_orders(spark, sf_dir), "o_orderkey", 100, 5000, limit=50, resume=1200, reverse=True)


def kv_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.prefix(table(spark, sf_dir, "customer").select("c_name", "c_custkey"), "c_name", "Customer#00000001")


def kv_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kv.first_last(_orders(spark, sf_dir), "o_orderkey", 10, 1000)
    return out.select(F.col("first.o_orderkey").alias("first_key"), F.col("first.o_custkey").alias("first_cust"), F.col("last.o_orderkey").alias("last_key"), F.col("last.o_custkey").alias("last_cust"))


def kv_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.count(_orders(spark, sf_dir), "o_orderkey", 10, 4106)


def kv_count_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.count(_orders(spark, sf_dir), "o_orderkey", 10, None, limit=500)


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey = 777")


def pk_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).where(F.col("o_orderkey").between(200, 4295))


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the index on o_custkey in a range, then their rows."""
    index = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("row_id")).where(kv.in_range("o_custkey", 50, 60))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return index.join(rows, index["row_id"] == rows["o_orderkey"]).select("o_custkey", "row_id", F.lower(F.hex("o_custkey")).alias("index_hex"), "o_orderstatus", "o_totalprice")


def table_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (kv_get, kv_exists, kv_scan, kv_scan_reverse, kv_prefix_scan, kv_first_last, kv_count, kv_count_capped, point_lookup, pk_range_scan, index_lookup, table_count)}

_W = "(SELECT c_custkey * 13 AS o_orderkey FROM customer)"
ORACLES = {
    "kv_get": f"SELECT w.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderkey IS NOT NULL AS found FROM {_W} w LEFT JOIN orders o USING (o_orderkey)",
    "kv_exists": f"SELECT o_orderkey FROM {_W} w WHERE o_orderkey IN (SELECT o_orderkey FROM orders)",
    "kv_scan": "SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) > 256 FROM orders WHERE o_orderkey > 355 AND o_orderkey < 5000) AS has_more, (SELECT max(k) FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey > 355 AND o_orderkey < 5000 ORDER BY k LIMIT 256)) AS resume_key FROM orders WHERE o_orderkey > 355 AND o_orderkey < 5000 ORDER BY o_orderkey LIMIT 256",
    "kv_scan_reverse": "SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) > 50 FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1200) AS has_more, (SELECT min(k) FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1200 ORDER BY k DESC LIMIT 50)) AS resume_key FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1200 ORDER BY o_orderkey DESC LIMIT 50",
    "kv_prefix_scan": "SELECT c_name, c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY c_name LIMIT 256",
    "kv_first_last": "SELECT min(o_orderkey) AS first_key, arg_min(o_custkey, o_orderkey) AS first_cust, max(o_orderkey) AS last_key, arg_max(o_custkey, o_orderkey) AS last_cust FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 1000",
    "kv_count": "SELECT count(*) AS count, false AS truncated FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 4106",
    "kv_count_capped": "SELECT least(count(*), 500) AS count, count(*) > 500 AS truncated FROM orders WHERE o_orderkey >= 10",
    "point_lookup": "SELECT * FROM orders WHERE o_orderkey = 777",
    "pk_range_scan": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 200 AND 4295",
    "index_lookup": "SELECT o_custkey, o_orderkey AS row_id, lower(hex(o_custkey)) AS index_hex, o_orderstatus, o_totalprice FROM orders WHERE o_custkey >= 50 AND o_custkey < 60",
    "table_count": "SELECT count(*) AS n FROM orders",
}
