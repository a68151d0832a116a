import base64
import gzip
import hashlib

from tessella.llm.queries import QUERIES, SQL
from tessella.llm.warc import read_archives, warc_round_trip, write_archives
from tests.oracle import assert_same, connect


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_equals_its_sql(spark, small):
    assert_same(QUERIES["op8_warc_chunks"](spark, small), connect(small), SQL["op8_warc_chunks"])


def test_records_chunks_and_bytes(spark, tmp_path):
    html = {1: "é" * 1000, 2: "same\r\n\r\nbody", 3: "same\r\n\r\nbody", 4: ""}
    pages = spark.createDataFrame([(i, f"http://x/{i} y", h) for i, h in html.items()], "page_id long, url string, html string")
    manifest = write_archives(pages, f"file:{tmp_path}/a", chunk=64)
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    rows = read_archives(manifest, chunk=100).collect()
    payload = {}
    for r in sorted(rows, key=lambda r: (r.page_id, r.chunk_no)):
        if r.record_type == "response":
            before = payload.get(r.page_id, b"")
            payload[r.page_id] = before + bytes(r.chunk)
            assert len(r.chunk) <= 100 and r.payload_bytes == len(payload[r.page_id])
            assert r.payload_digest == base64.b32encode(hashlib.sha1(payload[r.page_id]).digest()).decode()
    assert payload == {i: html[i].encode() for i in (1, 3, 4)}
    revisit = [r for r in rows if r.record_type == "revisit"]
    assert [(r.page_id, r.refers_to, r.payload_bytes, r.payload_digest) for r in revisit] == [(2, 3, 12, digest(html[2]))]
    raw = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "a").glob("*.warc.gz")))
    assert raw.count(b"WARC/1.1\r\n") == 4 and b"WARC-Target-URI: http://x/1%20y\r\n" in raw
    assert not list((tmp_path / "a").glob(".part*"))


def test_defined_cases(spark):
    rows = [(1, None, None, 7), (2, "u", "", 7), (None, "u", "a", 7), (5, "u", "a", 7), (5, "u", "a", 7), (None, "u", "lone", 7), (6, "u", "b" * 700_000, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, chunk int")
    out = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_round_trip(df).collect()), key=repr)
    wanted = [(1, 0, digest(""), "revisit", 2), (2, 0, digest(""), "response", None), (None, 1, digest("a"), "revisit", 5), (5, 1, digest("a"), "response", None), (5, 1, digest("a"), "response", None), (None, 4, digest("lone"), "response", None), (6, 700_000, digest("b" * 700_000), "response", None)]
    assert out == sorted(wanted, key=repr)
    assert warc_round_trip(df.where("false")).collect() == []
    least = warc_round_trip(df.where("html = 'a'"), least_bytes=2).collect()
    assert {r.record_type for r in least} == {"response"}
