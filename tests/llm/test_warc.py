"""WARC derivatives: against DuckDB, and by parsing the written files."""

import gzip
import hashlib
import html
import zlib

from pyspark.sql import functions as F

from tests.oracle import same
from trackframe.llm import warc
from trackframe.llm.queries import ORACLES, op8_warc_derivatives


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert same(op8_warc_derivatives(spark, sf), ORACLES["op8_warc_derivatives"], sf) == 500


def parse(raw):
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        raw = rest[n + 4 :]


def members(raw):
    """The contents of the gzip members of a file."""
    while raw:
        one = zlib.decompressobj(31)
        yield one.decompress(raw)
        raw = one.unused_data


def test_written_records_are_linked_and_whole(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.record_id: r for r in warc.responses(pages, "2025-01-01T00:00:00Z").collect()}
    warc.write_warc(warc.derive(warc.responses(pages.union(pages.limit(9)), "2025-01-01T00:00:00Z")), str(tmp_path / "out"))
    files = list((tmp_path / "out").iterdir())
    assert files and all(p.name.endswith(".warc.gz") for p in files)
    records = []
    for p in files:
        first, *own = [next(parse(m)) for m in members(p.read_bytes())]  # a gzip member holds one record
        assert first[0]["WARC-Type"] == "warcinfo" and first[0]["WARC-Filename"] == p.name
        records += own
    assert len(records) == 2 * pages.count()
    by = {f["WARC-Record-ID"]: f for f, _ in records}
    assert len(by) == len(records)
    for f, body in records:
        assert f["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        own = source[f["WARC-Refers-To"]]
        assert f["WARC-Target-URI"] == own.target_uri
        assert by[f["WARC-Concurrent-To"]]["WARC-Refers-To"] == f["WARC-Refers-To"]
        if f["WARC-Type"] == "metadata":
            assert own.payload_digest in body.decode() and "source-http-header: HTTP/1.1 200 OK" in body.decode()


def test_text_of_html(spark):
    cases = {
        "": "",
        "<p>a</p><p>b<b>c</b></p>": "a\nbc",
        "x<!-- <p>no</p> -->y<script>if (a<b) {}</script>z<STYLE a='b'>q</STYLE>": "xyz",
        "a &amp;lt; &lt;b&gt; &#233;&#x1F600;&nbsp;&#0;&#55296;": "a &lt; <b> é😀 &#0;&#55296;",
        "a <!-- open": "a",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "<ul><li>a<li>b</ul>  \n\n c": "a\nb\nc",
        "<script>" * 3000: "",
        "<" * 20_000: "<" * 20_000,
    }
    rows = spark.createDataFrame(list(cases.items()), "h string, want string").select(warc.plain_text(F.col("h")).alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    text = "&#65;&#x42;&lt;&copy;&amp;&quot;&#8364;"
    assert spark.createDataFrame([(text,)], "h string").select(warc.unescape(F.col("h"))).first()[0] == html.unescape(text)


def test_nulls_repeats_and_empty(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "http://a/", "<title>T\n t</title>", "y")], "page_id long, url string, html string, body string")
    rows = warc.derive(warc.responses(pages, "d")).collect()
    assert len(rows) == 6 and len({r.record_id for r in rows}) == 4
    assert all(("WARC-Target-URI" in r.headers) == (r.target_uri is not None) for r in rows)
    assert [r.body for r in rows if r.record_type == "conversion" and r.id is None] == ["T\nt"]
    assert "title: T t" in next(r.body for r in rows if r.record_type == "metadata" and r.id is None)
    assert warc.derive(warc.responses(pages.limit(0), "d")).count() == 0
