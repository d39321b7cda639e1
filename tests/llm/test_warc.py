"""WARC derivatives."""

import gzip
import hashlib
import uuid

import pytest

from larder.llm import warc

PAGE = """<!DOCTYPE html><html LANG='de-AT'><head><title>A &amp; B
 &lt;x&gt;</title><style>p{}</style><script>if (a < b) document.write("<p>no</p>")</script></head>
<body><!-- hidden <p> --><nav><a href="/x?a=1&amp;b=2">X</a> <a class=q href='y'>Y</a><a href=z>Z</a></nav><h1>Head</h1>one <b>t</b>wo&nbsp;&eacute;<br>three
<noscript>none</noscript><p>5 < 6 &amp;amp; 7</p></body></html>"""


def test_visible_text():
    assert warc.visible_text(PAGE) == "A & B\n<x>\nX YZ\nHead\none two é\nthree\n5 < 6 &amp; 7"
    assert warc.visible_text("") == "" and warc.visible_text("<p") == "" and warc.visible_text("a<!-- cut") == "a"
    assert warc.visible_text("a<script>cut") == "a" and warc.visible_text("<nav>" * 50 + "deep" + "</nav>" * 50 + "after") == "deep\nafter"


def test_source_fields():
    assert warc.source_fields(PAGE) == [
        ("title", "A & B <x>"), ("language", "de-at"), ("outlink", "/x?a=1&b=2"), ("outlink", "y"), ("outlink", "z"),
    ]


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://a/", PAGE), (2, None, "plain"), (3, "http://b/", None), (4, "http://c/", ""), (1, "http://a/", PAGE), (None, "u", "<b>x" + "y" * 200_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", F.lit("clash")).withColumn("block", F.lit(1))


def test_records_are_linked(pages):
    sources = {r["record_id"]: r for r in warc.responses(pages).collect()}
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 12 and len(sources) == 5
    by_id = {r["record_id"]: r for r in rows}
    for r in rows:
        source, twin = sources[r["refers_to"]], by_id[r["concurrent_to"]]
        assert twin["concurrent_to"] == r["record_id"] and twin["record_type"] != r["record_type"]
        assert (r["page_id"], r["target_uri"], r["date"]) == (source["page_id"], source["target_uri"], source["date"])
        assert r["content_length"] == len(r["block"].encode()) and r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
        assert r["source_payload_digest"] == source["payload_digest"] == "sha256:" + hashlib.sha256(source["payload"].encode()).hexdigest()
        assert uuid.UUID(r["record_id"][10:-1])
        if r["record_type"] == "metadata":
            fields = dict(x.split(": ", 1) for x in r["block"].split("\r\n")[:-1])
            assert fields["source-content-type"] == warc.HTML_TYPE and fields["source-block-digest"] == source["block_digest"]
            assert fields["source-content-length"] == str(len(source["payload"].encode())) and fields["conversion"] == r["concurrent_to"]
            assert source["block_digest"][7:] == hashlib.sha256((source["http_header"] + source["payload"]).encode()).hexdigest()
        else:
            assert r["block"] == warc.visible_text(source["payload"])


def test_no_pages(pages):
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_files_can_be_read_back(pages, tmp_path):
    rows = warc.derive(warc.responses(pages.filter("page_id = 1").limit(1)))
    warc.write_records(rows.coalesce(1), str(tmp_path / "w"))
    (path,) = (tmp_path / "w").glob("part-*.gz")
    data = gzip.decompress(path.read_bytes())
    want = {r["record_id"]: r for r in rows.collect()}
    seen = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        r = want[fields["WARC-Record-ID"]]
        assert lines[0] == "WARC/1.1" and rest[:n].decode() == r["block"] and fields["WARC-Refers-To"] == r["refers_to"] and fields["WARC-Type"] == r["record_type"]
        assert rest[n : n + 4] == b"\r\n\r\n"
        data, seen = rest[n + 4 :], seen + 1
    assert seen == 2
