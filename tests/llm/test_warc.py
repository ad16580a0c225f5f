import gzip

import pytest
from pyspark.sql import functions as F

from obsweave.llm import warc


@pytest.fixture
def archives(rows, tmp_path):
    big = "<html>" + "x" * 200 + "</html>"
    pages = rows(
        "page_id long, url string, html string, record_type string", (5, "http://a.b/c", big, "q"), (3, None, big, None), (4, "u", None, None), (6, "u", "", None),
        (7, "u\r\nWARC-Type: request", "short", None), (8, "u", "short", None), (9, "é", "é" * 60, None), (3, None, big, None), (10, "u", "y" * 3_000_000, None))
    path = str(tmp_path / "warc")
    warc.archive_pages(pages, path)
    return path


def test_pages_come_back(spark, archives):
    got = {(r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(spark, archives).collect()}
    kinds = {(i, k): n for i, k, _, n, _ in got}
    assert kinds[("<urn:page:3>", "response")] == kinds[("<urn:page:5>", "revisit")] == 213
    assert kinds[("<urn:page:4>", "response")] == kinds[("<urn:page:6>", "response")] == 0
    assert kinds[("<urn:page:9>", "response")] == 120 and kinds[("<urn:page:10>", "response")] == 3_000_000
    assert {r for _, _, r, _, _ in got} == {None, "<urn:page:3>"}
    assert warc.read_archives(spark, archives).count() == 9


def test_digests_are_those_of_payloads(spark, archives):
    responses = warc.read_archives(spark, archives).where("record_type = 'response'")
    assert responses.where(F.sha2("payload", 256) != F.col("payload_digest")).count() == 0


def test_filters_are_pushed_and_payloads_left_out(spark, archives):
    found = warc.read_archives(spark, archives, payload=False).where("record_type = 'revisit' and payload_bytes > 5")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in text and "record_type" not in text.split("Filter")[1].split("BatchScan")[0]
    assert [r["payload"] for r in found.collect()] == [None]
    assert found.where(F.col("target_uri").startswith("http://a")).count() == 1


def test_standard_tools_read_the_members(archives):
    import glob

    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{archives}/*.gz"))
    assert data.count(b"WARC/1.1\r\n") == 9 and b"\r\nWARC-Type: request" not in data


def test_plain_and_foreign_archives(spark, tmp_path):
    row = {"record_id": "<urn:page:1>", "record_type": "response", "target_uri": "u", "date": None, "refers_to": None, "payload_digest": None, "payload_bytes": 3, "payload": b"abc"}
    raw = warc.record_bytes(row)
    (tmp_path / "a.warc").write_bytes(raw * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw) * 3)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [bytes(r["payload"]) for r in got] == [b"abc"] * 5


def test_no_pages(spark, rows, tmp_path):
    path = str(tmp_path / "none")
    warc.archive_pages(rows("page_id long, url string, html string", (1, "u", "h")).limit(0), path)
    assert warc.read_archives(spark, path).count() == 0
