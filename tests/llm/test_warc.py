import base64
import hashlib

from millrace.llm.common import scratch
from millrace.llm.warc import op7_warc, parse, read, write


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_query_against_brute_force(spark, tmp_path):
    html = {1: "a\r\n\r\nWARC/1.1\r\n\r\n", 2: "same é", 3: "same é", 4: None, 5: "", 6: "same é", 7: "end\n", 8: "x" * 100_000}
    rows = [(i, f"http://a/{i}\r\nX: 1", h, "extra") for i, h in html.items()] + [(9, None, "same é", None), (2, "http://again", "same é", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in op7_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").fillna(-1).collect())
    want = []
    for i, _, h, _ in rows:
        first = min(j for j, _, g, _ in rows if (g or "") == (h or ""))
        want.append((i, len((h or "").encode()), digest(h or ""), "revisit" if i > first else "response", first if i > first else -1))
    assert got == sorted(want)


def test_archives_are_whole_and_deduplicated(spark):
    rows = [(i, f"http://a/{i}", "copy" if i % 3 == 0 else f"own {i}") for i in range(60)]
    path = scratch(spark, "test")
    write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path, archive_bytes=5000)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    assert len(files) > 3
    found = [x for f in files for x in parse(bytes(f.content))]
    assert len(found) == 60 and sum(b == b"copy" for _, b in found) == 1
    assert all(f["warc-type"] == "response" or not b for f, b in found)
    assert read(spark, path).where("record_type = 'revisit' and refers_to = 0").count() == 19


def test_small_payloads_and_nulls(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (None, None, "abcdef"), (3, "u", "abcdef"), (4, "u", "abcdef"), (None, "u", "lone"), (None, "u", "lone")]
    path = scratch(spark, "test")
    write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path, min_bytes=3)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in read(spark, path).collect())
    assert got == [(0, "response", 0)] * 3 + [(1, "response", 0), (2, "response", 0), (3, "response", 0), (4, "revisit", 3)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op7_warc(spark, str(tmp_path)).count() == 0
