import gzip
import hashlib

from helpers import rows

from spindle.llm import warc

PAGE = (
    '<!DOCTYPE html><html><head><title> A &amp; B </title><style>p{}</style><script>var t="</p>";</script></head>'
    '<body><!-- x <a href="/no"> --><p>Hello&nbsp;<b>wor</b>ld</p><a class="c" href="/x?a=1&amp;b=2">link</a>'
    "<a href='http://o.org/y'>o</a><a href=z>z</a><br>1 < 2 &lt; 3<div title='a>b'>end</div></body></html>"
)


def test_html():
    title, text, links = warc.read_html(PAGE)
    assert title == "A & B"
    assert links == ["/x?a=1&b=2", "http://o.org/y", "z"]
    assert text.split("\n") == ["Hello world", "linkoz", "1 < 2 < 3", "end"]


def test_broken_html():
    assert warc.read_html("a <!-- never closed <p>x")[1] == "a"
    assert warc.read_html("a <script>never closed")[1] == "a"
    assert warc.read_html("a <b never closed")[1] == "a <b never closed"
    assert warc.read_html("") == ("", "", [])
    many = "<a '" * 20_000
    assert warc.read_html(many)[1].startswith("<a '")
    assert warc.read_html('x <a href="y>z</a> w')[1]


def test_records_round_trip():
    headers, block = warc.response_record(7, "http://h.org/\np", PAGE, "2020-01-01T00:00:00Z")
    made = [(headers, block), *warc.derived_records(7, headers, block)]
    data = b"".join(warc.serialize(h, b) for h, b in made)
    assert list(warc.parse(data)) == made
    assert list(warc.parse(b"".join(gzip.compress(warc.serialize(h, b)) for h, b in made))) == made
    get = warc.value_of
    for h, b in made[1:]:
        assert get(h, "WARC-Refers-To") == get(headers, "WARC-Record-ID")
        assert get(h, "WARC-Target-URI") == get(headers, "WARC-Target-URI") == "http://h.org/ p"
        assert get(h, "WARC-Date") == "2020-01-01T00:00:00Z"
        assert get(h, "WARC-Block-Digest") == warc.digest(b) and int(get(h, "Content-Length")) == len(b)
    meta, conversion = made[1], made[2]
    assert get(conversion[0], "WARC-Concurrent-To") == get(meta[0], "WARC-Record-ID")
    assert f"source-warc-payload-digest: {get(headers, 'WARC-Payload-Digest')}".encode() in meta[1]
    assert b"outlink: http://h.org/x?a=1&b=2" in meta[1] and b"title: A & B" in meta[1]
    assert len({get(h, "WARC-Record-ID") for h, _ in made}) == 3


def test_tables(spark):
    data = [(1, "http://a.org", PAGE), (1, "http://a.org", PAGE), (2, None, None), (None, "", ""), (3, "http://[bad", "<a href='http://[x'>q</a>" + "<p>y" * 20_000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 AS block", "'x' AS headers")
    got = rows(warc.read_records(warc.derive(warc.responses(df))))
    assert len(got) == 2 * len(data)
    assert {r["record_type"] for r in got} == {"metadata", "conversion"}
    conversions = [r for r in got if r["record_type"] == "conversion"]
    text = warc.read_html(PAGE)[1].encode()
    assert sum(r["block_sha256"] == hashlib.sha256(text).hexdigest() for r in conversions) == 2
    assert len({r["record_id"] for r in got if r["page_id"] == 1}) == 2  # equal rows, equal ids
    assert [r["content_length"] for r in conversions if r["page_id"] in (2, None)] == [0, 0]
    assert [r["target_uri"] for r in conversions if r["page_id"] == 2] == [None]
    assert warc.derive(warc.derive(warc.responses(df))).collect() == []  # derived records aren't responses
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.derive(warc.responses(empty))).collect() == []
