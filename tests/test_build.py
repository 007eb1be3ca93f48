from __future__ import annotations

from pyspark.sql import functions as F

from quire import cli
from quire.operators import build, layout

PAGE = "<html><body><h1>One</h1><p>first <b>para</b><ul><li>a<li></ul><h2>Two</h2><p>second<h1>One</h1><p></p></body></html>"


def test_pages_become_a_model(spark, tmp_path):
    b = build.page_blocks(spark.createDataFrame([(7, PAGE), (8, None)], "page_id long, html string"))
    assert [(r.ord, r.kind, r.text, r.heading_level) for r in b.orderBy("ord").collect()] == [(1, "heading", "One", 1), (2, "para", "first para", None), (3, "list_item", "a", None), (4, "heading", "Two", 2), (5, "para", "second", None), (6, "heading", "One", 1)]
    build.write(build.build_model(b), str(tmp_path / "m"))
    m = build.read(spark, str(tmp_path / "m"))
    assert {(r.ord, r.section) for r in m["blocks"].collect()} == {(1, "sec-one"), (2, "sec-one"), (3, "sec-one"), (4, "sec-two"), (5, "sec-two"), (6, "sec-one-2")}
    assert m["chunks"].count() == 3 and m["documents"].head().n_heading == 3


def test_sections_nest(spark):
    html = build.nest_sections(spark.createDataFrame([(PAGE,), (None,)], "html string")).collect()
    assert html[0].html.replace("<html><body>", "") == '<section id="sec-one"><h1>One</h1><p>first <b>para</b><ul><li>a<li></ul><section id="sec-two"><h2>Two</h2><p>second</section></section><section id="sec-one-2"><h1>One</h1><p></p></section></body></html>'
    assert html[1].html is None


def test_converter(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.html").write_text(PAGE)
    (source / "b.html").write_bytes(b"\xff\xfe\xfa")
    left = cli.convert(spark, str(source), str(tmp_path / "out"), "markdown").collect()
    assert [(r.doc_id.rsplit("/", 1)[1], r.error) for r in left] == [("b.html", "not UTF-8")]
    assert spark.read.parquet(str(tmp_path / "out")).head().value.startswith("# One\n\nfirst **para**")
    cli.convert(spark, str(source), str(tmp_path / "model"), "model")
    assert spark.read.parquet(str(tmp_path / "model" / "sections")).count() == 3


def spans(spark, rows):
    return spark.createDataFrame([(1, 1, i, float(x), float(y), float(s), 0.0, t, False, 1, 0.0) for i, (x, y, s, t) in enumerate(rows)], "doc_id int, page int, n int, x double, y double, size double, width double, text string, bold boolean, font int, angle double")


def test_two_columns_are_read_one_after_the_other(spark):
    left = [(10, 700 - 14 * i, 10, f"left{i}") for i in range(8)]
    right = [(300, 700 - 14 * i, 10, f"right{i}") for i in range(8)]
    title = [(10, 760, 16, "A title over both columns that is rather long")]
    mixed = [x for pair in zip(left, right, strict=True) for x in pair] + title
    text = layout.page_text(layout.reading_order(spans(spark, mixed))).head().text
    assert text.split("\n") == [title[0][3], *(t for *_, t in left), *(t for *_, t in right)]


def test_rows_cells_and_anchors(spark):
    s = spans(spark, [(10, 100, 10, "Item"), (40, 101, 10, "one"), (200, 99, 10, "33.20"), (235, 100, 10, "0.96"), (10, 80, 10, "next"), (10, 50, 10, " ")])
    rows = layout.visual_rows(s)
    assert [r.row for r in rows.orderBy("n").collect()] == [1, 1, 1, 1, 2, None]
    cells = layout.row_cells(rows)
    assert [(r.row, r.text) for r in cells.orderBy("row", "x").collect()] == [(1, "Item one"), (1, "33.20"), (1, "0.96"), (2, "next")]
    assert [r.x for r in layout.column_anchors(cells, 20.0).orderBy("column").collect()] == [10.0, 200.0, 235.0]
    assert s.where(F.trim("text") != "").count() == 5
