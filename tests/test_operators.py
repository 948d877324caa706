"""Literal cases of the operators' rules, paging and collection properties, and streaming."""

import pytest

from tidemark.functions import scalar
from tidemark.operators import kv, mvcc, regions
from tidemark.streaming import ordered

V = "row_id long, commit_ts long, committed boolean, deleted boolean, payload string"


def snapshot(spark, rows, ts=20):
    return [(r["row_id"], r["payload"]) for r in mvcc.snapshot(spark.createDataFrame(rows, V), ["row_id"], ts).orderBy("row_id").collect()]


def test_snapshot_cases(spark):
    assert snapshot(spark, [(1, 30, True, False, "new"), (1, 10, True, False, "v1"), (2, 11, True, False, "v2")]) == [(1, "v1"), (2, "v2")]
    assert snapshot(spark, [(1, 15, True, True, "gone"), (1, 10, True, False, "old")]) == []
    assert snapshot(spark, [(1, 15, True, False, ""), (1, 10, True, False, "old"), (2, 5, False, False, "mine")]) == []


def test_pages_make_the_scan(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    for reverse in (False, True):
        got, resume = [], None
        while True:
            page = kv.scan(df, "k", 10, 600, limit=64, resume=resume, reverse=reverse).collect()
            got += [r["k"] for r in page]
            if not page or not page[0]["has_more"]:
                break
            resume = (min if reverse else max)(r["k"] for r in page)
        assert sorted(got) == list(range(10, 600))


def test_gc_changes_no_later_read(spark):
    rows = [(k, t, True, t % 5 == 0, f"p{t}") for k in range(6) for t in range(k, 60, 4 + k)]
    versions = spark.createDataFrame(rows, V)
    kept = mvcc.collect_garbage(versions, ["row_id"], 30)
    assert kept.count() < len(rows)
    for ts in (30, 31, 45, 99):
        a, b = (sorted(map(tuple, mvcc.snapshot(x, ["row_id"], ts).collect())) for x in (versions, kept))
        assert a == b
    assert mvcc.next_safe_point(5, 9, [12]) == 9 and mvcc.next_safe_point(5, 9, [8]) == 5 and mvcc.next_safe_point(5, 4, []) == 5


def test_gate_and_failover(spark):
    def gate(leader, acks):
        rows = [("r", role, n in acks, n == "a", leader == "a") for n, role in (("a", "DATA_VOTER"), ("b", "DATA_VOTER"), ("w", "WITNESS_VOTER"), ("l", "LEARNER"))]
        r = regions.write_gate(spark.createDataFrame(rows, "region_id string, role string, acked boolean, is_leader boolean, leader_matches boolean")).first()
        return r["allowed"], r["acked"], r["reason"]

    assert gate("a", "aw") == (True, 2, None) and gate("a", "a") == (False, 1, "quorum is not satisfied")
    assert gate("a", "al") == (False, 1, "quorum is not satisfied") and gate("b", "bw")[2] == "leader does not match metadata"

    def plan(up):
        rows = [("v", i, n, role, n in up, "a", 1) for i, (n, role) in enumerate((("a", "DATA_VOTER"), ("b", "DATA_VOTER"), ("w", "WITNESS_VOTER")))]
        r = regions.failover(spark.createDataFrame(rows, "vnode_id string, ordinal int, replica_id string, role string, reachable boolean, leader_id string, epoch long")).first()
        return r["action"], r["leader"], r["epoch"]

    assert plan("ab") == ("KEEP_LEADER", "a", 1) and plan("bw") == ("PROMOTE_DATA_LEADER", "b", 2)
    assert plan("b")[0] == "DEGRADED_READONLY" and plan("w")[0] == "UNAVAILABLE"


def test_scalars(spark):
    from pyspark.sql import functions as F

    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    lit = F.lit
    assert [one(scalar.size_bytes(lit(x))) for x in ("1kb", "2m", "10b", "-1_230k", "891g", "?", "")] == [1024, 2097152, 10, -1259520, 956703965184, None, None]
    assert one(scalar.duration_nanos(lit("1_500 ms"))) == 1_500_000_000 and one(scalar.round_up(lit(1000001), 10**6)) == 2_000_000
    assert one(scalar.to_long(lit(" 12.7"))) == 12 and one(scalar.half_up(lit(-2.5), 0)) == -2
    assert one(scalar.head(lit("a-b-c"), "-")) == "a" and one(scalar.tail(lit("abc"), "-")) is None and one(scalar.split_trimmed(lit(" a , b "))) == ["a", "b"]
    with pytest.raises(ValueError):
        scalar.round_up(lit(1), 0)


def test_streaming_windows_and_dedup(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, id % 3 as k, id % 5 as call from range(60)").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k long, call long").parquet(src)
    out = str(tmp_path / "out")
    q = ordered.windowed_counts(stream, "ts", ["k"], "30 minutes", "5 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["n"] for r in spark.read.parquet(out).collect()} == {10}
    out2 = str(tmp_path / "out2")
    q = ordered.deduplicate_stream(stream, ["k", "call"], "ts", "2 hours").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).option("path", out2).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(out2).count() == 15
    out3 = str(tmp_path / "out3")
    for _ in range(2):  # the second run finds nothing new
        ordered.apply_log(stream, out3, str(tmp_path / "c3"), "ts").awaitTermination()
    assert spark.read.parquet(out3).count() == 60


@pytest.mark.parametrize("most", [10**6, 0])
def test_many_regions_by_cells(spark, monkeypatch, most):
    """Cells find what comparing with each region finds; most: broadcast or shuffled."""
    from tidemark.operators import regions as rg

    rows = [(f"r{i}", i * 10 + i % 3, i * 10 + 9 + i % 2 * 400 * (i % 50 == 1)) for i in range(1500)]
    rows = [r for i, r in enumerate(rows) if not any(p[1] < r[2] and r[1] < p[2] for p in rows[max(0, i - 60) : i])] + [("last", 20000, None)]
    regions = spark.createDataFrame(rows, "region_id string, start_row long, end_row long")
    keys = spark.range(-50, 20300, 7).withColumnRenamed("id", "k").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    scans = spark.range(0, 15000, 37).selectExpr("id AS s", "id AS scan_start", "id + id % 500 AS scan_end")
    monkeypatch.setattr(rg, "FEW", 10**6)
    want = [sorted(map(str, f.collect())) for f in (rg.route(keys, regions, "k"), rg.overlap(scans, regions))]
    monkeypatch.setattr(rg, "FEW", 10)
    monkeypatch.setattr(rg, "MOST_BROADCAST", most)
    assert [sorted(map(str, f.collect())) for f in (rg.route(keys, regions, "k"), rg.overlap(scans, regions))] == want
    assert sum("region_id=None" not in x for x in want[0]) > 500


def test_null_region_bounds_are_unbounded(spark, monkeypatch):
    from tidemark.operators import regions as rg

    regions = spark.createDataFrame([("a", None, 10), ("b", 10, 20), ("c", 20, None)], "region_id string, start_row long, end_row long")
    scans = spark.createDataFrame([(1, 5, 20), (2, None, None), (3, 20, None), (4, None, 10)], "s long, scan_start long, scan_end long")
    for few in (10**6, 0):
        monkeypatch.setattr(rg, "FEW", few)
        got = {(r["s"], r["region_id"], r["task_start"], r["task_end"]) for r in rg.overlap(scans, regions).collect()}
        assert got == {(1, "a", 5, 10), (1, "b", 10, 20), (2, "a", None, 10), (2, "b", 10, 20), (2, "c", 20, None), (3, "c", 20, None), (4, "a", None, 10)}
        keys = spark.createDataFrame([(-5,), (10,), (99,), (None,)], "k long")
        assert {(r["k"], r["region_id"]) for r in rg.route(keys, regions, "k").collect()} == {(-5, "a"), (10, "b"), (99, "c"), (None, None)}


def test_casts_refuse_what_is_no_value(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from tidemark.functions import convert as cv

    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    lit = F.lit
    assert [one(cv.text_to_byte(lit(x))) for x in ("-128", "127", "")] == [-128, 127, None] and one(cv.wrapped(lit(200), 8)) == -56
    assert one(cv.text_to_date_time(lit("1704067200000"))) == one(cv.text_to_date_time(lit("2024-01-01"))) == one(cv.text_to_date_time(lit("2024-01-01 00:00:00.000")))
    assert one(cv.bytes_to_uuid(lit(b"hello"))) == "5d41402a-bc4b-3a76-b971-9d911017c592" and one(cv.map_text(F.create_map())) == "<EMPTY_MAP>"
    assert [one(cv.parse_size(lit(x))) for x in ("1.5GB", "1e5KB", "-1KB", "0bytes", "2 M", None)] == [1610612736, 102400000, 0, 0, 2097152, 0]
    assert [one(cv.size_text(lit(x))) for x in (0, 512, 1 << 20, 1610612736)] == ["0bytes", "0.5KB", "1MB", "1.5GB"] and one(cv.parse_speed(lit("1.5mb/s"))) == 1572864
    assert [one(cv.prefix_text(lit(x), "B", 2)) for x in (1023, 1024, 1536, (1 << 20) - 1, -(1 << 30))] == ["1023 B", "1 kB", "1.50 kB", "1.00 mB", "-1 gB"]
    assert [one(cv.span_unit(lit(x))) for x in (59, 60, 1440, 43200, 525600)] == ["minute", "hour", "day", "month", "year"]
    wrong = [cv.text_to_byte(lit("128")), cv.text_to_short(lit("1.5")), cv.text_to_char(lit("ab")), cv.to_enum(lit("9"), ["A"]), cv.text_to_uuid(lit("x")), cv.millis_to_timestamp(lit("0")), cv.text_to_date_time(lit("-5")), cv.text_to_bytes(lit(None).cast("string")), cv.span_unit(lit(-1))]
    for c in wrong:
        with pytest.raises(PySparkException):
            one(c)


def test_kth_of_large_and_flat_groups(spark):
    import random

    from pyspark.sql import functions as F

    from tidemark.operators import stats

    rng = random.Random(1)
    rows = [("wide", rng.randrange(10**6)) for _ in range(3000)] + [("flat", 7)] * 500 + [("two", 1), ("two", 2), ("none", None)]
    got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in stats.kth(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", {"lo": F.lit(0), "mid": F.floor(F.col("n") / 2), "hi": F.col("n") - 1}).collect()}
    for g in ("wide", "flat", "two"):
        v = sorted(x for k, x in rows if k == g)
        assert got[g] == (v[0], v[len(v) // 2], v[-1])
    assert "none" not in got


def test_prewrite_failures_are_values(spark):
    m = [(1, 10, "r1", None, 5, "x"), (1, 11, None, 10, 5, ""), (2, 10, "r1", None, 9, "y"), (3, 12, "r2", None, 1, "z"), (4, 13, "r2", None, 8, "ok")]
    mutations = spark.createDataFrame(m, "txn_id long, key long, region_id string, primary_key long, start_ts long, value string").withColumnRenamed("txn_id", "txn_id")
    locks = spark.createDataFrame([(10, 1)], "key long, txn_id long")
    versions = spark.createDataFrame([(12, 7), (13, 7)], "key long, commit_ts long")
    got = {(r["txn_id"], r["key"]): (r["error"], r["lock_primary"], r["lock_region"]) for r in mvcc.prewrite(mutations, locks, versions).collect()}
    assert got == {(1, 10): (None, 10, "r1"), (1, 11): ("empty value", 10, "unknown"), (2, 10): ("locked by 1", 10, "r1"), (3, 12): ("write conflict at 7", 12, "r2"), (4, 13): (None, 13, "r2")}
    replies = spark.createDataFrame([(1, True, None), (1, False, "bad"), (2, True, "no"), (2, False, None), (3, True, None)], "txn_id long, primary boolean, error string")
    assert {r["txn_id"]: (r["outcome"], r["sent"], r["error"]) for r in mvcc.two_phase(replies).collect()} == {1: ("ROLLBACK", 2, "bad"), 2: ("ROLLBACK", 1, "no"), 3: ("COMMIT", 1, None)}
