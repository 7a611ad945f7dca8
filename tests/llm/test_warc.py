"""Archives as other readers see them, their size, rows without an id, records that stand apart."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, warc

SCHEMA = "page_id long, url string, html string"


def members(data):
    """Contents of each gzip member, by the format alone."""
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data) + one.flush())
        assert one.eof
        data = one.unused_data
    return out


def test_each_record_is_a_member_and_archives_are_bounded(spark, tmp_path):
    rows = [(i, f"http://a.org/{i}", "".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(60)) + "é") for i in range(60)]
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "w"), size=20_000)
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) > 6 and not list((tmp_path / "w").glob("*.txt"))
    seen = 0
    for f in files:
        data = f.read_bytes()
        records = members(data)
        assert len(data) < 20_000 + 10_000
        assert records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
        kinds = [r.split(b"\r\n")[1] for r in records[1:]]
        assert kinds == [b"WARC-Type: request", b"WARC-Type: response", b"WARC-Type: metadata"] * (len(kinds) // 3)
        seen += len(kinds) // 3
    assert seen == 60


def test_a_record_over_the_member_limit_is_read_whole(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1000)
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5000\r\n\r\n" + bytes(range(250)) * 20
    data = warc.member(record)
    assert data[-1] == 0 and len(members(data)) == 6
    ((fields, block),) = warc.parse(data)
    assert block == bytes(range(250)) * 20
    with pytest.raises(ValueError):
        list(warc.parse(data[:-200]))


def test_pieces_may_end_anywhere():
    bodies = [b"x" * n + b"\r\n\r\nWARC/1.1\r\n" for n in (0, 1, 7, 300)]
    data = b"".join(warc.member(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(b) + b) for b in bodies)
    want = [b for _, b in warc.parse(data)]
    assert want == bodies
    for step in (1, 2, 5, 13):
        warc_unpacked, whole = warc.unpacked, b"".join(warc.unpacked(data))
        try:
            warc.unpacked = lambda _, step=step, whole=whole: iter([whole[i : i + step] for i in range(0, len(whole), step)])
            assert [b for _, b in warc.parse(data)] == bodies
        finally:
            warc.unpacked = warc_unpacked


def test_rows_without_an_id_are_captures_each(spark):
    big = "z" * 300
    pages = [(None, None, None)] * 40 + [(None, "http://a.org/", big)] * 5 + [(None, "http://b.org/", "w" * 200)] * 3 + [(7, "http://c.org/", big), (9, "http://c.org/", big), (9, "http://c.org/", big)]
    df = spark.createDataFrame(pages, SCHEMA).withColumn("records", F.lit(1)).withColumn("value", F.lit("v")).repartition(4)
    got = warc.round_trip(df).select(warc.page_of(F.col("metadata")).alias("p"), "capture.type", F.col("original.capture.payload_digest").alias("d"), warc.page_of(F.col("original.metadata")).alias("o"), F.col("request.uri").alias("u"))
    found = collections.Counter(tuple(r) for r in got.collect())

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    assert found == {
        (None, "response", sha(""), None, "urn:unknown"): 40,
        (None, "revisit", sha(big), 7, "http://a.org/"): 5,
        (None, "response", sha("w" * 200), None, "http://b.org/"): 3,
        (7, "response", sha(big), 7, "http://c.org/"): 1,
        (9, "revisit", sha(big), 7, "http://c.org/"): 2,
    }


def test_records_of_other_archives_are_found(spark):
    names = [f.split()[0] for f in warc.RECORD.split(", ")]
    base = dict.fromkeys(names)
    rows = [
        {**base, "file": "a", "ordinal": 0, "record_id": "c1", "type": "response"}, {**base, "file": "b", "ordinal": 0, "record_id": "r1", "type": "request", "concurrent_to": "c1"},
        {**base, "file": "b", "ordinal": 1, "record_id": "c2", "type": "response"}, {**base, "file": "b", "ordinal": 2, "record_id": "m2", "type": "metadata", "concurrent_to": "c2"},
    ]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], warc.RECORD)
    got = {(r["capture"]["record_id"], r["request"] and r["request"]["record_id"], r["metadata"] and r["metadata"]["record_id"]) for r in warc.assemble(df).collect()}
    assert got == {("c1", "r1", None), ("c2", None, "m2")}


def test_query_equals_brute_force(spark):
    data = "/root/testdata/sf0.001"
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    least = {}
    for i, h in pages:
        least[h] = min(least.get(h, i), i)
    want = {(i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if len(h) >= 100 and least[h] != i else "response", least[h] if len(h) >= 100 and least[h] != i else None) for i, h in pages}
    assert {tuple(r) for r in queries.op10_warc(spark, data).collect()} == want
