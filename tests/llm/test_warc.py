import hashlib

import pytest
from pyspark.sql import functions as F

from evigrain.llm import warc


def test_stream_in_any_pieces():
    payload = ("ab\r\n\r\nWARC/1.1 " * 30_000).encode()
    digest = hashlib.sha256(payload).hexdigest()
    raw = b"".join(c[2] for c in warc.record_chunks(5, "http://x/ é\r\n", memoryview(payload), digest, chunk=1000))
    raw += b"".join(c[2] for c in warc.record_chunks(6, None, memoryview(payload), digest, 5))
    raw += b"".join(c[2] for c in warc.record_chunks(7, "u", memoryview(b""), hashlib.sha256(b"").hexdigest()))
    for step in (1 << 20, 777, 3):
        r, found = warc.RecordReader(), []
        for k in range(0, len(raw), step):
            found += r.feed(raw[k : k + step])
        r.close()
        assert [(x["page_id"], x["payload_bytes"], x["record_type"], x["refers_to"]) for x in found] == [(5, len(payload), "response", None), (6, len(payload), "revisit", 5), (7, 0, "response", None)]
    r = warc.RecordReader()
    list(r.feed(raw[:-2]))
    with pytest.raises(ValueError):
        r.close()
    with pytest.raises(ValueError):
        list(warc.RecordReader().feed(raw.replace(b"ab\r", b"xb\r", 1)))


def test_chunks_carry_running_digests():
    got = list(warc.record_chunks(1, "u", memoryview(b"x" * 2500), hashlib.sha256(b"x" * 2500).hexdigest(), chunk=1000))
    assert [c[1] for c in got] == [0, 1, 2, 3, 4]
    assert got[2][3] == hashlib.sha256(b"x" * 2000).hexdigest()


def test_table(spark):
    long = "z" * 300_000
    rows = [(9, "u9", long, 1), (2, "u2", long, 2), (3, None, None, 3), (4, "u", "", 4), (5, "u", "a" * 100, 5), (6, "u", "a" * 100, 6), (7, "u", "b", 7), (8, "u", "b", 8), (8, "u", "b", 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(warc.write_archives(df)).collect()}
    assert got == {(9, "revisit", 2, 300000), (2, "response", None, 300000), (3, "response", None, 0), (4, "response", None, 0), (5, "response", None, 100), (6, "revisit", 5, 100), (7, "response", None, 1), (8, "response", None, 1)}
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_archives_are_rolled_and_broken_records_are_rows(spark):
    rows = [(i, f"u{i}", f"{i} " * 3000) for i in range(1, 21)]
    chunks = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), limit=30_000).persist()
    per = [r.n for r in chunks.groupBy("archive").agg(F.countDistinct("record").alias("n")).collect()]
    assert len(per) > 3 and sum(per) == 20
    first = chunks.where("archive = 0").orderBy("seq").collect()
    reader = warc.RecordReader()
    assert [x["page_id"] for c in first for x in reader.feed(c.data)] and not reader.close()
    lost = chunks.where("not (record_id like '%:3' and chunk = 1)").withColumn("data", F.when(F.col("record_id").like("%:7") & (F.col("chunk") == 1), F.lit(b"x" * 10)).otherwise(F.col("data")))
    lost = lost.where("not (record_id like '%:9' and chunk = 2)")
    got = {r.page_id: r for r in warc.read_archives(lost).collect()}
    assert len(got) == 20 and sorted(k for k, r in got.items() if r.error) == [3, 7, 9]
    assert all(r.payload_digest == hashlib.sha256((f"{k} " * 3000).encode()).hexdigest() for k, r in got.items() if not r.error)
