"""Literal cases of the folds and parsers over regions that SQL doesn't cover."""

from __future__ import annotations

import base64

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire.operators import regions as R


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("doc_id", F.lit(1)).withColumn("page", F.lit(1)) if "page" not in schema else spark.createDataFrame(rows, schema)


def test_rules_snap_and_join(spark):
    rules = frame(spark, [(10.0, 0.0, 50.0), (11.5, 52.0, 80.0), (11.7, 90.0, 95.0), (30.0, 5.0, 5.0), (float("nan"), 0.0, 9.0)], "p double, lo double, hi double")
    got = {(r.line, r.p, r.lo, r.hi) for r in R.grid_lines(rules).collect()}
    assert got == {(1, 10.0, 0.0, 80.0), (2, 11.7, 90.0, 95.0)}  # 11.7 is too far from the line's first place
    band = frame(spark, [(26.8, 257.4, 126.4), (257.4, 340.6, 126.4), (340.6, 589.2, 126.4)], "x0 double, x1 double, y double")
    assert [(r.x0, r.x1) for r in R.h_bands(band).collect()] == [(26.8, 589.2)]


def test_rule_banded(spark):
    bands = frame(spark, [(0.0, 100.0, 50.0), (0.0, 100.0, 10.0), (0.0, 30.0, 90.0)], "x0 double, x1 double, y double")
    runs = frame(spark, [(1, 0.0, 100.0, 15.0, 45.0, 10.0), (2, 0.0, 50.0, 15.0, 45.0, 10.0), (3, 0.0, 100.0, 15.0, 30.0, 10.0)], "run int, x0 double, x1 double, y0 double, y1 double, pad double")
    assert {r.run: r.banded for r in R.rule_banded(runs, bands).collect()} == {1: True, 2: False, 3: False}


def test_lane_chains(spark):
    t = frame(spark, [(0, 1, 0.0, 100.0), (0, 2, 200.0, 260.0), (1, 1, 10.0, 90.0), (1, 2, 20.0, 80.0), (2, 1, 205.0, 300.0), (2, 2, 0.0, 60.0)], "lane int, k long, y0 double, y1 double")
    got = {(r.lane, r.k): r.chain for r in R.lane_chains(t).collect()}
    assert got == {(0, 1): 1, (1, 1): 1, (2, 2): 1, (0, 2): 2, (2, 1): 2, (1, 2): 3}


def test_spans_are_cut_at_columns(spark):
    spans = frame(spark, [(1, 10.0, 90.0, 55.0, 8.0, "abcdefgh", 0.0), (2, 12.0, 30.0, 5.0, 8.0, "low", 0.0), (3, 12.0, 30.0, 5.0, 8.0, "turned", 1.0), (4, 200.0, 220.0, 5.0, 8.0, "out", 0.0)], "n int, x double, x1 double, y double, size double, text string, angle double")
    grid = spark.createDataFrame([(1, 1, 0, [0.0, 50.0, 100.0], [0.0, 50.0, 100.0])], "doc_id int, page int, grid int, xs array<double>, ys array<double>")
    got = sorted((r.n, r.row, r.col, r.text) for r in R.bind_contained(spans, grid).collect())
    assert got == [(1, 0, 0, "abcd"), (1, 0, 1, "efgh"), (2, 1, 0, "low")]


def test_continuations_and_merged_rows(spark):
    schema = "doc_id int, page int, k int, signature string, leads boolean, ends boolean, styled boolean, first_row string"
    rows = [(1, 1, 0, "a", True, True, True, "h"), (1, 2, 0, "a", True, True, True, "h"), (1, 3, 0, "a", True, True, False, "x"), (1, 4, 0, "a", True, True, True, "other"), (1, 5, 0, "b", True, True, False, "x"), (1, 7, 0, "a", True, True, True, "other"), (2, 1, 0, "a", True, False, True, "h"), (2, 2, 0, "a", True, True, True, "h"), (3, 1, 0, "a", True, True, True, "h"), (3, 2, 0, "a", True, True, True, "h"), (3, 2, 1, "a", True, True, True, "h")]
    parts = R.continuations(spark.createDataFrame(rows, schema))
    got = {(r.doc_id, r.page, r.k): (r.anchor_page, r.anchor_k, r.skip) for r in parts.collect()}
    assert got == {(1, 1, 0): (1, 0, False), (1, 2, 0): (1, 0, True), (1, 3, 0): (1, 0, False), (1, 4, 0): (4, 0, False), (1, 5, 0): (5, 0, False), (1, 7, 0): (7, 0, False), (2, 1, 0): (1, 0, False), (2, 2, 0): (2, 0, False), (3, 1, 0): (1, 0, False), (3, 2, 0): (2, 0, False), (3, 2, 1): (2, 1, False)}
    cells = spark.createDataFrame([(1, p, 0, r, f"{p}.{r}") for p in (1, 2, 3) for r in (0, 1)], "doc_id int, page int, k int, row int, cells string")
    merged = R.merged_rows(cells, parts.where("doc_id = 1")).orderBy("row").collect()
    assert [(r.page, r.row, r.cells) for r in merged] == [(1, 0, "1.0"), (1, 1, "1.1"), (1, 2, "2.1"), (1, 3, "3.0"), (1, 4, "3.1")]


def test_ownership_hash(spark):
    r = spark.createDataFrame([([1, 0, 5],), ([],)], "s array<long>").select(R.ownership_hash(F.col("s")).alias("h")).collect()
    h = 0xCBF29CE484222325
    for b in b"".join(x.to_bytes(8, "little") for x in (1, 0, 5)):
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    assert [x.h for x in r] == [f"{h:016x}", "cbf29ce484222325"]


@pytest.mark.parametrize("seed", range(5))
def test_lane_by_steps(seed):
    rng = np.random.default_rng(seed)
    lo = np.r_[rng.uniform(0, 80, 40), rng.uniform(120, 200, 40), 60.0]
    hi = lo + np.r_[rng.uniform(1, 30, 80), 90.0]
    x, runs, run = lo.min() + 1, [], []
    while x < hi.max():
        if ((lo < x) & (x < hi)).sum() <= 1:
            run.append(x)
        elif run:
            runs.append(run)
            run = []
        x += 1
    runs += [run] if run else []
    want = max(((r[-1] - r[0], (r[0] + r[-1]) / 2) for r in runs), key=lambda r: r[0])
    assert np.allclose(R.lane(lo, hi, 1), want)
    assert R.lane(np.array([0.0]), np.array([1.0]), 0) is None


def test_captions(spark):
    rows = [(1, 0.0, 100.0, 10.0, "Figure 1. A", True, False), (2, 0.0, 88.0, 10.0, "goes on", False, False), (3, 0.0, 87.0, 5.0, "2", False, False), (4, 9.0, 76.0, 10.0, "indented", False, False), (5, 0.0, 60.0, 10.0, "Table 2", True, False), (6, 0.0, 30.0, 10.0, "far below", False, False), (7, 0.0, 20.0, 10.0, "Fig 3", True, False), (8, 0.0, 10.0, 10.0, "- item", False, True)]
    lines = frame(spark, rows, "ord int, x0 double, y double, size double, text string, caption boolean, breaks boolean")
    assert {r.ord: r.caption_ord for r in R.gather_captions(lines).collect()} == {1: 1, 2: 1, 3: 1, 4: None, 5: 5, 6: None, 7: 7, 8: None}


def test_heading_continuations(spark):
    rows = [(1, 0.0, 100.0, 14.0, 2, True, "A title that"), (2, 2.0, 84.0, 14.0, 2, True, "goes on"), (3, 0.0, 60.0, 14.0, 2, True, "another heading"), (4, 0.0, 44.0, 14.0, 2, True, "page 7"), (5, 0.0, 30.0, 10.0, 1, False, "text"), (6, 0.0, 20.0, 14.0, 2, True, "last")]
    lines = frame(spark, rows, "ord int, x0 double, y double, size double, font int, tier boolean, text string")
    assert {r.ord: r.head for r in R.heading_continuations(lines).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_toc_reads_levels_pages_and_ids(spark):
    nav = '<body><nav><ul><li data-level="1" data-page="3"><a href="#sec-a">A <b>bold</b></a><ul><li data-level="3"><a href="#sec-b">B</a></li></ul></li><li data-level="2">no link</li></ul></nav><li data-level="9"><a href="#out">x</a>'
    got = R.toc(spark.createDataFrame([(1, nav), (2, "no nav")], "doc_id int, html string")).collect()
    assert [(r.level, r.title, r.page, r.id) for r in got] == [(1, "A bold", 3, "sec-a"), (3, "B", 0, "sec-b")]


def test_a_page_that_is_not_there_is_an_error(spark):
    pages = spark.createDataFrame([(1, 1, "text", "x"), (1, 2, " ", "fallback")], "doc_id int, page int, text string, other string")
    assert R.page_text_of(pages, 2, "other").head().text == "fallback" and R.page_text_of(pages, 2).head().text == " "
    with pytest.raises(PySparkException, match="no page 3"):
        R.page_text_of(pages, 3).collect()


def test_json_is_sorted_and_indented(spark):
    r = spark.createDataFrame([('{"b": [1, 2], "a": {"z": "é"}}',)], "j string").select(R.emit_json(F.col("j")).alias("x")).head()
    assert r.x == '{\n  "a": {\n    "z": "é"\n  },\n  "b": [\n    1,\n    2\n  ]\n}\n'


def test_images_become_files(spark):
    png = base64.b64encode(b"\x89PNG").decode()
    page = f'<p>a</p><figure><img src="data:image/png;base64,{png}"><figcaption>The <b>Red</b> Boat, seen from afar</figcaption></figure><img src="kept.png"><svg><g/></svg><img src="data:image/jpeg;base64,{png}">'
    text, files = R.externalize(page)
    assert files == [("img/fig_01_the-red-boat-seen-fr.png", b"\x89PNG"), ("img/fig_03.svg", b"<svg><g/></svg>"), ("img/fig_04.jpg", b"\x89PNG")]
    assert "data:" not in text and '<img src="kept.png">' in text and '<img src="img/fig_03.svg">' in text
    rows = R.externalize_images(spark.createDataFrame([(1, page), (2, None)], "doc_id int, html string")).collect()
    assert sorted((r.doc_id, r.path or "") for r in rows) == [(1, ""), (1, files[0][0]), (1, files[1][0]), (1, files[2][0]), (2, "")]


def test_whole_documents(spark):
    b = spark.createDataFrame([(1, 1, 1, "heading", "Top", 1), (1, 1, 2, "para", "text", None), (1, 2, 3, "heading", "Sub", 2)], "doc_id int, page int, ord int, kind string, text string, heading_level int").withColumn("list_ordered", F.lit(False)).withColumn("el_group", F.lit(None).cast("int"))
    pages = b.select("doc_id", "page").distinct()
    html = R.to_html(pages, b).head().html
    assert html.startswith("<html><body>\n<nav>") and 'data-page="2"' in html
    nested = R.to_html(pages, b, "section", with_toc=False).head().html
    assert nested.count("<section id=") == 2 and "data-page" not in nested and nested.count("</section></section></body>") == 1
    with pytest.raises(ValueError, match="mode"):
        R.to_html(pages, b, "other")


def test_digests_and_time(spark):
    r = spark.createDataFrame([(bytearray(b"abc"),)], "c binary").select(R.source_digest(F.col("c")).alias("d"), R.generated_at().alias("t")).head()
    assert r.d.crc32 == 0x352441C2 and r.d.sha256.startswith("ba7816bf") and r.d.bytes == 3 and r.t.endswith("Z") and len(r.t) == 20
