"""Queries over tables whose keys and groups are those of larger copies."""

import duckdb
from oracle import rows

from tidemark import catalog


def differs(spark, folder, name, **tables):
    """None, or the first rows in which a query over tables and its SQL differ."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df, cur = catalog.QUERIES[name](spark, str(folder)), con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cur.fetchall())
    assert sorted(names) == sorted(df.columns) and len(a) == len(b)
    return next(((x, y) for x, y in zip(a, b, strict=True) if x != y), None)


def test_prefixes_of_large_keys(spark, tmp_path):
    """Amounts of a gibibyte and more: whole mebibytes, halves, and those that begin with 1024."""
    keys = [1 << 24, (1 << 24) + 1, (1 << 24) + 8192, 10 * (1 << 24) + 5, 1_199_999, 7_199_999, 16383, 16384, 16776]
    part = spark.createDataFrame([(k, size) for k in keys for size in (1, 2, 37, 50)], "p_partkey long, p_size int")
    assert differs(spark, tmp_path, "prefix_units", part=part) is None


def test_size_expressions_do_not_multiply(spark):
    """A size's text is searched a fixed number of times for a row, however its functions are nested."""
    from pyspark.sql import functions as F

    from tidemark.functions import convert, scalar

    def searches(c):
        return spark.range(3).select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract")

    size = convert.parse_size(F.concat(F.col("id"), F.lit("KB")))
    assert searches(size) == 2 and searches(convert.size_text(convert.rounded_size(convert.rounded_size(size) + 512))) == 2
    span = scalar.duration_nanos(F.concat(F.col("id"), F.lit("min")))
    assert searches(convert.prefix_text(span, "B", 2)) <= 4 and searches(scalar.size_bytes(F.concat(F.col("id"), F.lit("kb")))) <= 4


def test_places_in_a_region_by_ranges(spark, tmp_path, monkeypatch):
    """The last region has nearly all rows; they are numbered in ranges of it."""
    from tidemark.operators import regions as rg

    monkeypatch.setattr(rg, "TOGETHER", 500, raising=False)
    orders, nation = spark.range(0, 40_000, 3).selectExpr("id AS o_orderkey"), spark.range(25).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name")
    assert differs(spark, tmp_path, "region_union", orders=orders, nation=nation) is None
    plan = catalog.QUERIES["region_union"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in line.split("[region_id")[-1] for line in plan.splitlines() if "Window [row_number" in line)
    rows = [("a", k) for k in [5, 5, 5, None, -3, 900, 901, 902]] + [("b", 7)] * 3 + [("c", None), (None, 1)]
    monkeypatch.setattr(rg, "TOGETHER", 2)
    got = sorted((r["g"], r["place"], r["k"]) for r in rg.places(spark.createDataFrame(rows, "g string, k long"), "g", "k").collect())
    keys = {g: [k for h, _, k in got if h == g] for g in "abc"}
    assert keys == {"a": [None, -3, 5, 5, 5, 900, 901, 902], "b": [7, 7, 7], "c": [None]} and [p for _, p, _ in got] == [*range(1, 9), 1, 2, 3, 1]
