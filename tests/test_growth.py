"""Cases where work or memory once grew with the square of a group, or a result hung on the order of rows."""

from __future__ import annotations

import json
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import build, detect, layout, markup, model, regions, render, sequence
from quire.plans import registry
from quire.sources import containers


def test_outline_links_of_one_large_document(spark):
    """150,000 entries and headings that begin alike: comparing all of them would take minutes."""
    n = F.col("id")
    rows = spark.range(150_000).select(F.lit(1).alias("doc_id"), n.alias("n"), F.concat(F.lit("Chapter "), n.cast("string"), F.when(n % 2 == 0, ": the rest").otherwise("")).alias("title"))
    heads = spark.range(150_000).select(F.lit(1).alias("doc_id"), n.alias("ord"), n.alias("id"), F.concat(F.lit("chapter "), n.cast("string")).alias("title"))
    began = time.monotonic()
    got = sequence.outline_links(rows, heads).selectExpr("count(*) AS rows", "count_if(n % 2 = 1 AND heading = n) AS exact").head()
    assert (got["rows"], got["exact"]) == (150_000, 75_000)
    assert time.monotonic() - began < 60
    small = {r["n"]: r["heading"] for r in sequence.outline_links(rows.where("n in (10, 12, 400)"), heads).collect()}
    assert small == {10: 1, 12: 1, 400: 4}


def test_outline_links_of_short_and_null_titles(spark):
    outline = spark.createDataFrame([(1, 1, "Über alle Maße"), (1, 2, "abc def"), (1, 3, None), (2, 1, "abc")], "doc_id int, n int, title string")
    heads = spark.createDataFrame([(1, 5, 50, "über alle"), (1, 3, 30, "Über alle M"), (1, 9, 90, "abc"), (2, 7, 70, "ABC."), (2, 4, 40, "a-b-c")], "doc_id int, ord int, id int, title string")
    got = {(r["doc_id"], r["n"]): r["heading"] for r in sequence.outline_links(outline, heads).collect()}
    assert got == {(1, 1): 30, (1, 2): None, (1, 3): None, (2, 1): 40}


def test_ocr_plan_by_other_measures(spark):
    """Broken text drops its layer, unless the caller says that nothing is garbled; so does a text's length."""
    pages = spark.createDataFrame([(1, 1, "xkcd " * 60, 1.0, "TeX"), (2, 1, " \n" * 100 + "short", 1.0, "TeX"), (3, 1, None, 1.0, "ScanSnap")], "doc_id int, page int, text string, area double, producer string")
    images = pages.select("doc_id", "page", F.lit(0.1).alias("area"))
    plan = lambda **more: [r["decision"] for r in build.ocr_plan(pages, images, **more).orderBy("doc_id").collect()]
    assert plan() == ["drop_and_ocr", "needs_ocr", "needs_ocr"]
    assert plan(n_text=F.length(F.trim("text")), garbled=F.lit(False)) == ["not_needed", "not_needed", "drop_and_ocr"]


def test_page_blocks_against_sql_on_odd_pages(spark, tmp_path):
    """Other references than the SQL's three, headings below the first, pages without blocks or text."""
    html = ["<h1>a &quot;b&amp; &amp;lt; c&amp</h1><h2>z</h2><ul><li>x</li></ul>", "<p>no heading</p>", "", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["doc_id"]: (r["title"], r["items"]) for r in registry.queries()["page_blocks"](spark, str(tmp_path)).collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {d: (t, n) for d, t, n in duckdb.sql(f"SELECT doc_id, title, items FROM ({registry.oracle_sql()['page_blocks']})").fetchall()}
    assert got[0] == ("a &quot;b& &lt; c&amp", 1)
    assert build.page_blocks(spark.read.parquet(str(tmp_path / "pages.parquet"))).where("heading_level = 1").head()["text"] == 'a "b& &lt; c&'


def test_elements_take_their_first_row_whatever_the_order(spark):
    """An aggregate with more than 128 groups in a task goes on by sorting, where a group's first rows come last."""
    n = F.col("id")
    rows = spark.range(4000).select((n / 4).cast("int").alias("doc_id"), F.lit(1).alias("page"), n.alias("ord"), F.lit("list_item").alias("kind"), n.cast("string").alias("text"), (n % 4 == 0).alias("list_ordered"), F.lit(1).alias("el_group"), F.lit(None).cast("int").alias("heading_level"))
    assert render.elements(rows).selectExpr("count_if(ordered AND size(texts) = 4) AS n").head()["n"] == 1000


def test_vector_bytes_against_sql_on_halves_and_nulls(spark, tmp_path):
    """Halves of the last decimal go to the even one, as in C; vectors without numbers have no row."""
    odd = [0.0078125, -0.0234375, 1e-9, -1e-9, 0.5, 12345.678, float("nan"), None] * 8
    schema = "vec_id long, embedding array<float>"
    spark.createDataFrame([(1, odd), (2, None), (3, []), (4, [k / 128 for k in range(64)])], schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: (r["back"], r["n"]) for r in registry.queries()["vector_bytes"](spark, str(tmp_path)).collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == {v: (b, n) for v, b, n in duckdb.sql(f"SELECT vec_id, back, n FROM ({registry.oracle_sql()['vector_bytes']})").fetchall()}
    assert got[1][0].startswith("0.007812,-0.023438,0.000000,-0.000000,")


def test_continuations_of_a_long_document(spark):
    """90,000 pages with a table each, every third one new: looking through all earlier tables would take minutes."""
    n = F.col("id")
    x = spark.range(90_000).select(F.lit(1).alias("doc_id"), n.alias("page"), F.lit(0).alias("k"), (n / 3).cast("int").cast("string").alias("signature"), F.lit(True).alias("leads"), F.lit(True).alias("ends"), F.lit(True).alias("styled"), (n / 3).cast("int").cast("string").alias("first_row"))
    began = time.monotonic()
    got = regions.continuations(x).selectExpr("count_if(anchor_page = page - page % 3 AND skip = (page % 3 > 0)) AS n").head()
    assert got["n"] == 90_000
    assert time.monotonic() - began < 25


def test_continuations_with_several_candidates(spark):
    rows = [(1, 1, "a", True, "h"), (1, 2, "a", True, "g"), (2, 1, "a", True, "h"), (3, 1, "a", False, "x"), (5, 1, "a", True, "x"), (6, 1, "b", True, None), (7, 1, "b", True, None), (7, 2, "b", True, None)]
    x = spark.createDataFrame([(1, p, k, s, True, True, st, f) for p, k, s, st, f in rows], "doc_id int, page int, k int, signature string, leads boolean, ends boolean, styled boolean, first_row string")
    got = {(r["page"], r["k"]): (r["anchor_page"], r["anchor_k"], r["skip"]) for r in regions.continuations(x).collect()}
    assert got == {(1, 1): (1, 1, False), (1, 2): (1, 2, False), (2, 1): (1, 1, True), (3, 1): (1, 1, False), (5, 1): (5, 1, False), (6, 1): (6, 1, False), (7, 1): (7, 1, False), (7, 2): (7, 2, False)}


def chains(rows: list[tuple]) -> dict:
    """lane_chains of one page by its definition."""
    held, used, out, chain = sorted(rows), set(), {}, 0
    for i, (own, k, lo, hi) in enumerate(held):
        if i in used:
            continue
        chain, last = chain + 1, own
        out[own, k] = chain
        for j in range(i + 1, len(held)):
            to, k1, a, b = held[j]
            if j not in used and to > last and min(hi, b) - max(lo, a) >= max(min(hi - lo, b - a), 1.0) * 0.5:
                used.add(j)
                out[to, k1] = chain
                lo, hi, last = min(lo, a), max(hi, b), to
    return out


@pytest.mark.parametrize(("n", "tall"), [(300, 4), (300, 60), (200, 0.2), (1, 5)])
def test_lane_chains_equal_their_definition(spark, n, tall):
    rng = np.random.default_rng(n)
    y = rng.integers(0, 120, n) * 0.5
    rows = [(int(a), k, float(b), float(b + c)) for k, (a, b, c) in enumerate(zip(rng.integers(0, 4, n), y, rng.integers(0, 9, n) * tall / 8, strict=True))]
    x = spark.createDataFrame([(1, 1, *r) for r in rows], "doc_id int, page int, lane int, k long, y0 double, y1 double")
    assert {(r["lane"], r["k"]): r["chain"] for r in regions.lane_chains(x).collect()} == chains(rows)


def test_lane_chains_of_a_crowded_page(spark):
    n = F.col("id")
    x = spark.range(60_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), (n % 3).cast("int").alias("lane"), n.alias("k"), (n - n % 3).cast("double").alias("y0"), (n - n % 3 + 2).cast("double").alias("y1"))
    began = time.monotonic()
    assert regions.lane_chains(x).selectExpr("count(*) AS n", "count_if(chain = floor(k / 3) + 1) AS same").head() == (60_000, 60_000)
    assert time.monotonic() - began < 25


def test_reconcile_preferred_with_many_tables_of_one_place(spark):
    """A hundred thousand tables against as many on one page: as pairs they would take minutes."""
    n = F.col("id")
    at = lambda shift, places: (n % places * 100.0 + shift)
    tables = lambda shift, places: spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), n.alias("k"), at(shift, places).alias("x0"), F.lit(0.0).alias("y0"), (at(shift, places) + 60).alias("x1"), F.lit(50.0).alias("y1"))
    began = time.monotonic()
    got = {r["source"]: (r["n"], r["places"]) for r in regions.reconcile_preferred(tables(0, 4), tables(5, 2)).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("x0").alias("places")).collect()}
    assert got == {"existing": (50_000, 2), "preferred": (100_000, 2)}
    assert time.monotonic() - began < 30


class Batches:
    """Stands for a DataFrame whose Arrow batches a test hands over itself."""

    def __init__(self, **kinds):
        self.dtypes = list(kinds.items())

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_containers_are_read_and_written_in_small_batches(spark):
    """A batch of 2,000 documents of 20 kB: 40 MB in, never more than a few MB out at a time."""
    model_ = json.dumps({"schema_version": 0, "source": {}, "pages": [], "sections": [], "blocks": [{"text": "x" * 20_000}]})
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([model_] * 2000), pa.array([[("a", b"y")]] * 2000, pa.map_(pa.string(), pa.binary()))], ["doc_id", "model", "members"])
    made = list(containers.containers(Batches(doc_id="bigint"))(iter([batch])))
    assert sum(b.num_rows for b in made) == 2000 and max(b.nbytes for b in made) < 8 << 20
    content = pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    for run in (containers.models(Batches(path="bigint")), containers.member(Batches(path="bigint"), "a")):
        back = list(run(iter([content])))
        assert sum(b.num_rows for b in back) == 2000 and max(b.nbytes for b in back) < 8 << 20
    assert back[0].column(1)[0].as_py() == b"y"


def test_nodes_come_in_small_batches(spark):
    html = "<ul>" + "<li a=b>some text</li>" * 500 + "</ul>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([html] * 400)], ["page_id", "html"])
    made = list(markup.nodes(Batches(page_id="bigint"))(iter([batch])))
    assert sum(b.num_rows for b in made) == 400 * 1001 and max(b.nbytes for b in made) < 8 << 20


def test_collapse_loops_over_many_rows_and_nulls(spark):
    texts = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.concat(F.repeat(F.concat("id", F.lit("\n")), 5), F.lit("end"))).alias("t"), "id").coalesce(1)
    assert texts.select(markup.collapse_loops(F.col("t")).eqNullSafe(F.when(F.col("id") % 3 > 0, F.concat("id", F.lit("\nend")))).alias("same")).where("same").count() == 1000


def test_ids_of_a_document_with_many_equal_titles(spark):
    """20,000 times one title, then titles that are taken suffixes: starting from -2 each time would take minutes."""
    n = F.col("id")
    rows = spark.range(20_010).select(F.lit(1).alias("doc_id"), n.alias("ord"), F.when(n < 20_000, "a").otherwise(F.concat(F.lit("a-"), (n - 19_990).cast("string"))).alias("base"))
    began = time.monotonic()
    got = {r["ord"]: r["final_id"] for r in model.mint_ids(rows, "base").collect()}
    assert time.monotonic() - began < 20
    assert (got[0], got[1], got[19_999], got[20_000]) == ("a", "a-2", "a-20000", "a-10-2") and len(set(got.values())) == 20_010


def test_merge_fragmented_lists_row_by_row(spark):
    kinds = ["l1", "p", "p", "p", "l2", "p", "p", "p", "p", "l3", "l4", "o5", "p", "colon", "o6", "p"]
    of = {"l": ("list_item", False), "o": ("list_item", True), "p": ("para", False), "c": ("para", False)}
    rows = [(d, i // 8, i, *of[k[0]], ["these:"] if k == "colon" else [f"{k}{i}", "x"] if k[0] in "lo" else [f"{k}{i}"], None) for d in (1, 2) for i, k in enumerate(kinds)]
    x = spark.createDataFrame(rows, "doc_id int, page int, ord int, kind string, ordered boolean, texts array<string>, level int")
    got = render.merge_fragmented_lists(x)
    assert got.dtypes == x.dtypes
    got = [(r["ord"], r["texts"]) for r in got.where("doc_id = 2").orderBy("ord").collect()]
    assert got == [(0, ["l10", "x p1 p2 p3", "l24", "x"]), *((i, [f"p{i}"]) for i in range(5, 9)), (9, ["l39", "x ", "l410", "x"]), (11, ["o511", "x"]), (12, ["p12"]), (13, ["these:"]), (14, ["o614", "x"]), (15, ["p15"])]


def test_reading_order_of_many_small_pages(spark):
    """120,000 pages: a frame for each would take minutes."""
    n = F.col("id")
    spans = spark.range(240_000).select((n / 2).cast("long").alias("doc_id"), F.lit(1).alias("page"), n.alias("n"), F.lit(0.0).alias("x"), (n % 2 * 30).cast("double").alias("y"), F.lit(10.0).alias("size"), F.lit(0.0).alias("width"), F.lit("ab").alias("text"))
    began = time.monotonic()
    assert layout.reading_order(spans).where("ord = 1 - n % 2").count() == 240_000
    assert time.monotonic() - began < 25


def test_grid_verdict_finds_its_grid_once_or_twice(spark):
    """The grid's own expression is in the plan once, not at every fact."""
    grid = F.array(F.array(F.concat(F.lit("only here "), F.col("id").cast("string"))))
    plan = spark.range(1).select(detect.grid_verdict(grid).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("only here ") == 1


def test_expand_hits_sends_no_table_whole(spark):
    """Labels, spaces and chunks grow with the corpus; a broadcast of them is in the memory of each task, whatever the tables' files say of their size."""
    hits = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 0, 0.25), (1, 2, 1, 0.2), (1, 3, 2, 0.1), (1, 4, -1, 0.1), (1, 5, None, 0.1), (2, 0, 0, 0.1234567), (3, 0, 0, 0.3)], "doc_id long, rank int, row int, score double")
    spaces = spark.createDataFrame([(1, ["a", "gone"]), (2, ["b"])], "doc_id long, chunk_ids array<string>")
    chunks = spark.createDataFrame([(1, "a", 0, "s", 1, 2, [5]), (2, "b", 0, None, 1, None, [])], "doc_id long, id string, chunk int, section string, page_start int, page_end int, ords array<int>")
    texts = spark.createDataFrame([(1, 0, "t")], "doc_id long, chunk int, text string")
    labels = spark.createDataFrame([(1, 1, "i"), (1, 2, "ii"), (2, 2, "ii")], "doc_id long, page int, label string")
    got = regions.expand_hits(hits, spaces, chunks, texts, labels)
    a = ("a", "s", 1, 2, "i", "ii", [5], "t")
    rows = {(r["doc_id"], r["rank"]): (r["score"], *(r[c] for c in "chunk_id section page_start page_end label_start label_end ords snippet".split())) for r in got.collect()}
    assert rows == {(1, 0): (0.5, *a), (1, 1): (0.25, *a), (2, 0): (0.123457, "b", None, 1, None, None, None, [], None)}
    # as planned, and as it ran after the sizes were known
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
