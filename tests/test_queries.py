"""Every query of the catalog against its SQL."""

import pytest
from oracle import DATA, same

from tidemark import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    assert same(spark, catalog.QUERIES[name], catalog.ORACLES[name]) is None


def test_queries_without_sql(spark):
    from tidemark.functions import codecs

    rows = catalog.QUERIES["codec_digests"](spark, DATA).collect()
    assert rows and all(r["crc32c"] >= 0 and r["base58"] for r in rows)
    assert codecs.crc32c_of(b"123456789") == 0xE3069283 and codecs.base58_of(b"\0\0hello") == "11Cn8eVZg"
    # Published vectors of the checksum, and batches of values of several lengths.
    assert codecs.crc32c_batch([b"\0" * 32, None, b"", b"\xff" * 32, bytes(range(32))]) == [0x8A9136AA, None, 0, 0x62A8AB43, 0x46DD794E]
    for raw in (b"", b"\0", b"\0\0\x01", b"any bytes \xff"):
        assert codecs.base58_back(codecs.base58_of(raw)) == raw


def test_dedup_is_a_fold_over_times(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_type", "ts", "event_id").orderBy("ts").collect()
    last, want = {}, set()
    for r in rows:
        k = (r["user_id"], r["event_type"])
        if k not in last or (r["ts"] - last[k]).total_seconds() >= 3600:
            last[k] = r["ts"]
            want.add(r["event_id"])
    assert {r["event_id"] for r in catalog.QUERIES["request_dedup"](spark, DATA).collect()} == want
