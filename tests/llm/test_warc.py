from __future__ import annotations

import hashlib

import pytest

from quire.llm import warc as W
from quire.llm.common import Scratch

LONG, BLANKS = "<p>é</p>" * 40, "a\r\n\r\nWARC/1.1\r\n\r\n" * 20
ROWS = [(5, "http://a/", LONG), (3, "http://b/ c", LONG), (9, None, LONG), (4, "http://d/", "short"), (6, "http://e/", "short"), (7, "http://f/\nx", None), (8, "http://g/", BLANKS), (10, "http://h/", "x" * 300000), (None, "http://i/", LONG)]


def test_round_trip(spark, monkeypatch):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'d' as digest", "1 as payload").repartition(3)
    got = {r.page_id: r for r in W.round_trip(pages, Scratch(spark, "t")).collect()}
    assert len(got) == len(ROWS) and all(r.intact for r in got.values())
    for page, url, html in ROWS:
        body = (html or "").encode()
        twin = html == LONG and page != 3
        r = got[page]
        assert (r.url, r.payload_bytes, r.payload_digest) == ((url or None) and url.replace("\n", "%0A"), len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if twin else ("response", None))
    assert W.round_trip(pages.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("pack", [bytes, W.member])
def test_both_versions_of_arc(version, pack):
    blocks = [b"HTTP/1.1 200 OK\r\nX-A: b\r\n\r\nbody\n\n", b"raw\r\n", b""]
    data = b"".join(pack(x) for x in [W.arc_version_block("f.arc", version), *(W.arc_record(version, f"http://x/a b{i}", "19961104142103", "text/html", "f.arc", 7, b) for i, b in enumerate(blocks))])
    got = list(W.read_arc(data))
    assert [b for _, b in got] == blocks and [f["URL"] for f, _ in got] == [f"http://x/a b{i}" for i in range(3)]
    assert all(f["Archive-date"] == "19961104142103" and f["Content-type"] == "text/html" for f, _ in got)
    assert W.http_block(blocks[0]) == ({"x-a": "b"}, b"body\n\n") and W.iso_date("19961104142103") == "1996-11-04T14:21:03Z"


def test_revisits_refer_to_records(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2)
    arcs = W.write_arc(pages)
    for most in (32 << 20, 0):
        heads = [h for r in W.write_warc(arcs, Scratch(spark, "t"), most=most).collect() for h, _ in W.read_warc_records(bytes(r.content)) if h["warc-type"] != "warcinfo"]
        first = next(h["warc-record-id"] for h in heads if h.get("x-page-id") == "3")
        assert len(heads) == len(ROWS) and {h["warc-refers-to"] for h in heads if h["warc-type"] == "revisit"} == {first}


def test_a_long_record(spark):
    body = "<p>" + "words and more words " * 1_000_000 + "</p>"
    r = W.round_trip(spark.createDataFrame([(1, "u", body)], "page_id long, url string, html string"), Scratch(spark, "t")).head()
    assert (r.payload_bytes, r.payload_digest, r.intact) == (len(body), hashlib.sha256(body.encode()).hexdigest(), True)


GOOD = W.arc_record(1, "http://a", "19960101000000", "text/html", "f", 0, b"fine")


@pytest.mark.parametrize(
    ("bad", "n_good", "n_bad"),
    [
        (GOOD + b"http://x 0.0.0.0 19960101000000 text/html 99\nshort", 1, 1),
        (GOOD + b"no end", 1, 1),
        (GOOD + b"http://x 0.0.0.0 19960101000000 text/html -5\nshort\n" + GOOD, 1, 1),
        (GOOD + b"http://x 0.0.0.0 text/html 4\nabcd\n" + GOOD, 2, 1),
        (GOOD + b"http://x 0.0.0.0 yesterday text/html 4\nabcd\n" + GOOD, 2, 1),
    ],
)
def test_bad_records_are_rows_with_an_error(spark, bad, n_good, n_bad):
    block = W.arc_version_block("f.arc", 1)
    rows = W.convert(spark.createDataFrame([(bytearray(block + bad),), (bytearray(block + GOOD),), (None,), (bytearray(),)], "content binary")).collect()
    assert sum(r.error is None for r in rows) == n_good + 1 and sum(r.error is not None for r in rows) == n_bad
    assert all(bytes(r.payload) == b"fine" for r in rows if not r.error)
    warc = W.write_warc(spark.createDataFrame([(bytearray(block + bad),)], "content binary"), Scratch(spark, "t"))
    assert W.read_warc(warc).count() == n_good


def test_bad_members():
    block = W.arc_version_block("f.arc", 1)
    whole = W.member(block) + W.member(GOOD)
    assert [("error" in f) for f, _ in W.read_arc(whole[:-9])] == [True]
    assert [("error" in f) for f, _ in W.read_arc(whole + b"\x1f\x8bnonsense")] == [False, True]
    assert [("error" in f) for f, _ in W.read_arc(block.replace(b"1 0 quire", b"7 0 quire") + GOOD)] == [True, True]
    with pytest.raises(ValueError, match="WARC"):
        list(W.read_warc_records(b"nonsense"))
