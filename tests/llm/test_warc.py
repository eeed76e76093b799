"""WARC archives: round trips, revisit resolution, faults."""

from __future__ import annotations

import base64
import hashlib

import pytest

from tests.llm import tables as T
from tracefold.llm import warc
from tracefold.sources.sinks import new_path

PAGES = "page_id long, url string, html string"


def brute(rows, least=0):
    """(page_id, html) rows -> sorted expected tuples."""
    groups = {}
    for page_id, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for payload, ids in groups.items():
        name = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        free = list(ids)
        if len(payload) >= least:
            out.append((top, len(payload), name, "response", None))
            free.remove(top)
        for i in free:
            revisit = len(payload) >= least
            out.append((i, len(payload), name, "revisit" if revisit else "response",
                        top if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest",
                                       "record_type", "refers_to").collect()), key=str)


ODD = [(1, "http://a.de/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, " ", ""), (4, "x", None),
       (None, "http://n/", "<p>one</p>"), (5, "http://b/\r\nEvil: 1", "a\r\n\r\nWARC/1.1\r\n\r\n"),
       (6, "http://c/", "a\r\n\r\nWARC/1.1\r\n\r\n"), (7, "http://d/", "é\u0000\n\r \U0001f600"),
       (7, "http://d/", "é\u0000\n\r \U0001f600"), (None, "q", "alone"), (None, "q", "alone"),
       (8, "http://long/", "line\r\n" * 300_000), (9, "http://e/", "\r\n"), (10, "f", "no end\r")]


@pytest.mark.parametrize("least", [0, 5])
def test_pages_equal_brute_force(spark, least):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(ODD, PAGES).withColumn("record_type", F.lit("x")).withColumn(
        "payload", F.lit(1))
    got = warc.archive_pages(pages.repartition(3), least_bytes=least)
    assert result(got) == brute([(i, h) for i, _, h in ODD], least)
    assert warc.archive_pages(pages.where("false")).count() == 0


@pytest.mark.parametrize("few_revisits", [0, 50_000])
def test_archives_are_real_and_binary_safe(spark, few_revisits):
    """Any bytes come back; the second archive holds each payload once, under fresh headers."""
    body = bytes(range(256)) * 3 + b"\r\n\r\nWARC/1.1\r\n"
    rows = [(f"urn:uuid:{i}", "http://x/", "2020-01-01T00:00:00Z", i, "response", None, None,
             None, body if i else b"", None) for i in range(5)]
    first, second = new_path(spark, "t-warc"), new_path(spark, "t-warc2")
    warc.write_archive(spark.createDataFrame(rows, warc.RECORD).repartition(2), first, 2)
    back = warc.read_archive(spark, first, keep_payload=True).orderBy("page_id").collect()
    assert [bytes(r["payload"]) for r in back] == [b"", body, body, body, body]
    warc.deduplicate(spark, first, second, date="2024-05-05T00:00:00Z",
                     few_revisits=few_revisits)
    new = {r["page_id"]: r for r in warc.read_archive(spark, second, True).collect()}
    assert [i for i, r in new.items() if r["record_type"] == "response"
            and r["payload"]] == [4] and bytes(new[4]["payload"]) == body
    assert new[1]["refers_id"] == new[4]["record_id"] and new[1]["refers_uri"] == "http://x/"
    assert new[1]["refers_date"] == new[4]["date"] == "2024-05-05T00:00:00Z"
    assert not {r["record_id"] for r in new.values()} & {r[0] for r in rows}
    raw = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(
        second).select("content").collect() if r["content"])
    import zlib

    text = b""
    while raw:  # one gzip member a file
        member = zlib.decompressobj(31)
        text += member.decompress(raw)
        raw = member.unused_data
    assert text.count(b"WARC-Type: revisit") == 3 and text.count(bytes(range(256))) == 3


def test_given_revisits_follow_their_original(spark):
    """b revisits a, and a's payload is also that of the later page c: both go to c."""
    same = dict(uri="http://x/", date="2020-01-01T00:00:00Z", refers_uri=None, refers_date=None)
    rows = [dict(record_id="a", page_id=1, record_type="response", payload=b"hello"),
            dict(record_id="b", page_id=9, record_type="revisit", refers_id="a"),
            dict(record_id="c", page_id=3, record_type="response", payload=b"hello"),
            dict(record_id="d", page_id=4, record_type="revisit", refers_id="elsewhere"),
            dict(record_id="e", page_id=5, record_type="response", payload=b"single"),
            dict(record_id="f", page_id=6, record_type="revisit", refers_id="e")]
    names = [c.split()[0] for c in warc.RECORD.split(", ")]
    df = spark.createDataFrame([tuple((same | r).get(n) for n in names) for r in rows],
                               warc.RECORD)
    first, second = new_path(spark, "t-warc"), new_path(spark, "t-warc2")
    warc.write_archive(df, first)
    warc.deduplicate(spark, first, second)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in
           warc.resolved(warc.stored(warc.read_archive(spark, second), "t")).collect()}
    assert got == {1: ("revisit", 3, 5), 9: ("revisit", 3, 5), 3: ("response", None, 5),
                   4: ("revisit", None, None), 5: ("response", None, 6), 6: ("revisit", 5, 6)}


def test_faults_stop_the_job(spark):
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <u>\r\nContent-Length: {}\r\n" \
           "WARC-Payload-Digest: sha1:{}\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    name = warc.digest(b"body")
    for text, message in [(good.format(23, "AAAA"), "does not fit"), (good.format(
            22, name), "longer"), (good.format(99, name), "cut short"), ("hello", "no WARC")]:
        path = new_path(spark, "t-bad")
        spark.createDataFrame([(text[:-2],)], "value string").write.option(
            "lineSep", "\r\n").option("compression", "gzip").text(path)
        with pytest.raises(Exception, match=message):
            warc.read_archive(spark, path).collect()


def test_very_long_page(spark):
    text = T.prose(5, 200_000)
    pages = spark.createDataFrame([(1, "http://a/", text), (2, "http://b/", text)], PAGES)
    assert result(warc.archive_pages(pages)) == brute([(1, text), (2, text)])
