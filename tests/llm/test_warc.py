import base64
import hashlib

from opsight.llm import queries as Q
from opsight.llm import warc as W

SF = "/root/testdata/sf0.001"


def expected(rows):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to)"""
    low = {}
    for page, _, html in rows:
        if page is not None:
            low[html or ""] = min(page, low.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = low.get(html or "")
        own = first is None or page == first
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else first))
    return sorted(out, key=str)


ROWS = [(5, "http://a.example.com/x", "<p>one</p>"), (3, "https://A.example.com:443/y?q=1#f", "<p>one</p>"), (9, None, None), (8, "", ""), (12, "http://b.org", "é" * 50_000),
        (14, "bad url\r\nWARC-Type: x", "two"), (15, "http://a.example.com/x", "two"), (15, "http://a.example.com/x", "two"), (None, "http://n.org/", "two"), (None, "http://n.org/", "none"),
        (20, "http://a.example.com/x", "three\r\n\r\nWARC/1.1\r\n\r\n"), (-4, "ftp://user@h.net:21/p", "four"), (30, "http://d.org/\tq", "four")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "c", 1) for r in ROWS], "page_id long, url string, html string, payload string, hash int").repartition(4)
    got = W.archive_round_trip(df, folder=str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)
    assert W.archive_round_trip(df.limit(0), folder=str(tmp_path)).collect() == []


def test_large_group_and_small_blocks(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.org/{i}", "same" if i % 3 else f"own {i}") for i in range(300)]
    caps = W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"{tmp_path}/a")
    index = W.build_index(caps, f"{tmp_path}/i", shards=4, block=16)
    got = W.read_archives(caps, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    asked = spark.createDataFrame([(f"http://h{i % 7}.org/{i}",) for i in (0, 17, 299)] + [("http://none.org/",), (None,)], "url string")
    found = {r.url: (r.page_id, r.record_type, r.payload and bytes(r.payload)) for r in W.look_up(asked, index).collect()}
    assert found == {"http://h0.org/0": (0, "response", b"own 0"), "http://h3.org/17": (17, "revisit", None), "http://h5.org/299": (299, "revisit", None)}


def test_keys():
    assert W.url_key("http://User@Blog.Example.com:80/a?b#c") == "com,example,blog)/a?b"
    assert W.url_key("https://x.org:8443") == "org,x:8443)/"
    assert W.capture_key("http://x.org/", "2024-01-01T00:00:00Z", 9) < W.capture_key("http://x.org/", "2024-01-01T00:00:00Z", 10)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = Q.QUERIES["op4_warc_capture_index"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
