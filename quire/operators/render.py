"""From blocks back to documents: elements, HTML, text, Markdown, sections; and the tables around rendering."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.functions.classify import introduces_list
from quire.operators import markup
from quire.operators.model import folded
from quire.operators.sequence import islands


def elements(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, ord, kind, ordered, texts, level): neighbouring list items and notes of one el_group are one element again.

    An item without a group is a paragraph that only looks like one. Blocks need
    list_ordered and el_group besides the usual columns.
    """
    loose = (F.col("kind") == "list_item") & F.col("el_group").isNull()
    b = blocks.withColumn("kind", F.when(loose, "para").otherwise(F.col("kind")))
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    grouped = F.col("kind").isin("list_item", "footnote") & (F.lag("kind").over(w) == F.col("kind")) & F.lag("el_group").over(w).eqNullSafe(F.col("el_group"))
    runs = islands(b, ["doc_id", "page"], "ord", grouped)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    # an aggregate that runs out of hash buckets takes a group's rows out of order
    first = lambda c: F.min_by(c, "ord")
    return runs.groupBy("doc_id", "page", "island").agg(F.min("ord").alias("ord"), first("kind").alias("kind"), F.coalesce(first("list_ordered"), F.lit(False)).alias("ordered"), texts.alias("texts"), first("heading_level").alias("level")).drop("island")


def element_html() -> Column:
    """HTML of a row of elements(); the text of blocks is inline markup already."""
    first = F.get("texts", 0)
    name = F.when(F.col("ordered"), "ol").otherwise("ul")
    items = F.array_join(F.transform("texts", lambda t: F.concat(F.lit("<li>"), t, F.lit("</li>"))), "")
    level = F.least(F.coalesce("level", F.lit(1)), F.lit(6)).cast("string")
    notes = F.array_join(F.transform("texts", lambda t: F.concat(F.lit("<p>"), t, F.lit("</p>"))), "")
    return (
        F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(">"), first, F.lit("</h"), level, F.lit(">\n")))
        .when(F.col("kind") == "list_item", F.concat(F.lit("<"), name, F.lit(">"), items, F.lit("</"), name, F.lit(">\n")))
        .when(F.col("kind") == "footnote", F.concat(F.lit('<aside class="footnotes">'), notes, F.lit("</aside>\n")))
        .when(F.col("kind").isin("code", "table", "figure", "caption", "header", "dest_anchors"), F.concat(first, F.lit("\n")))
        .otherwise(F.concat(F.lit("<p>"), first, F.lit("</p>\n")))
    )


def page_html(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, html): a section for each of pages(doc_id, page), empty ones too."""
    body = elements(blocks).withColumn("h", element_html()).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "h"))), lambda x: x["h"]), "").alias("body"))
    joined = pages.join(body, ["doc_id", "page"], "left")
    return joined.select("doc_id", "page", F.concat(F.lit('<section data-page="'), F.col("page").cast("string"), F.lit('">\n'), F.coalesce("body", F.lit("")), F.lit("</section>\n")).alias("html"))


def document_html(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, html), with the ids of a document made unique."""
    parts = page_html(pages, blocks).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "html"))), lambda x: x["html"]), "").alias("html"))
    return parts.select("doc_id", markup.dedup_ids(markup.merge_adjacent_links(F.concat(F.lit("<html><body>\n"), F.col("html"), F.lit("</body></html>\n")))).alias("html"))


def document_markdown(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    return document_html(pages, blocks).select("doc_id", markup.to_markdown(F.col("html")).alias("markdown"))


def document_text(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, text): a line for each page."""
    lines = page_html(pages, blocks).withColumn("t", F.concat(T.visible_text(F.col("html")), F.lit("\n")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "").alias("text"))


def merge_fragmented_lists(els: DataFrame) -> DataFrame:
    """elements with lists joined that only up to three short paragraphs (under 400 bytes, not ending in a colon) part.

    Those paragraphs continue the last item. Greedy and order-dependent, so a fold
    over one document's elements.
    """
    rows = els.withColumn("joins", (F.col("kind") == "para") & (F.octet_length(F.get("texts", 0)) < 400) & ~introduces_list(F.get("texts", 0)))

    def start():
        cur, between = None, []

        def close():
            nonlocal cur
            done = ([tuple(cur)] if cur else []) + between
            cur, between[:] = None, []
            return done

        def step(page, at, kind, ordered, texts, level, joins):
            nonlocal cur
            if at is None:
                return close()
            row = (page, at, kind, ordered, texts, level)
            if cur and joins and len(between) < 3:
                between.append(row)
                return []
            if cur and kind == "list_item" and bool(ordered) == bool(cur[3]):
                cur[4][-1] += " " + " ".join(x[4][0] for x in between)
                cur[4] += texts
                between.clear()
                return []
            done = close()
            if kind != "list_item":
                return [*done, row]
            cur = [page, at, kind, ordered, list(texts), level]
            return done

        return step

    kinds = dict(els.dtypes)
    cols = ["page", "ord", "kind", "ordered", "texts", "level"]
    out = ", ".join(f"{c} {kinds[c]}" for c in cols)
    return folded(rows, ["doc_id"], ["page", "ord"], [*cols, "joins"], start, out).select(els.columns)


def section_slices(headings: DataFrame) -> DataFrame:
    """(doc_id, ord, end): where each section ends: the next heading of its level or higher, null at the end of the document."""
    a, b = headings.alias("a"), headings.alias("b")
    later = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.ord") > F.col("a.ord")) & (F.col("b.level") <= F.col("a.level")), "left")
    return later.groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.ord").alias("ord")).agg(F.min("b.ord").alias("end"))


def section_neighbours(sections: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ord")
    return sections.select("doc_id", "ord", "id", F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"), "parent")


def section_by_name(sections: DataFrame, name: str) -> DataFrame:
    """The first section of each document whose id is the name's, begins with it, or whose title holds the name."""
    want = T.section_slug(F.lit(name))
    hit = (F.col("id") == want) | F.startswith(F.col("id"), want) | F.contains(F.lower("title"), F.lit(name.lower()))
    return sections.where(hit).groupBy("doc_id").agg(F.min(F.struct("ord", "id", "title")).alias("x")).select("doc_id", "x.ord", "x.id", "x.title")


# ---- recognised lines


def recognised_order(lines: DataFrame, width: int, height: int, least: float = 30.0) -> DataFrame:
    """(page, doctags): lines(page, x1, y1, x2, y2, text, conf) from the top, places scaled to 0..500; blank and doubtful ones go."""
    at = lambda c, size: F.concat(F.lit("<loc_"), F.greatest(F.lit(0), F.least(F.lit(500), F.round(F.col(c) / size * 500).cast("int"))).cast("string"), F.lit(">"))
    t = T.trim_ws(F.col("text"))
    kept = lines.where((t != "") & (F.col("conf") >= least)).withColumn("line", F.concat(at("x1", width), at("y1", height), at("x2", width), at("y2", height), t, F.lit("\n")))
    return kept.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "line"))), lambda x: x["line"]), "").alias("doctags"))


def line_stats(lines: DataFrame, least: float = 30.0) -> DataFrame:
    """(page, raw_words, conf_chars) of recognised lines."""
    chars = F.length(F.regexp_replace("text", r"\s", ""))
    return lines.groupBy("page").agg(F.sum(T.word_like_count(F.col("text"))).alias("raw_words"), F.sum(F.when(F.col("conf") >= least, chars).otherwise(0)).alias("conf_chars"))


def ocr_status(pages: DataFrame, passes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with a decision or an active pass, and a row for each result of each pass(id, engine, results)."""
    decided = pages.where("ocr_decision is not null or active_ocr_pass is not null").select("doc_id", F.col("n").alias("page"), F.col("ocr_decision").alias("decision"), F.col("active_ocr_pass").alias("active_pass"))
    rows = passes.select("doc_id", F.col("id").alias("pass"), "engine", F.explode("results").alias("r"))
    return decided, rows.select("doc_id", "pass", "engine", "r.page", "r.outcome", "r.legible_chars", "r.confidence")


# ---- assets and output


def assets(figures: DataFrame, keep: bool = True) -> DataFrame:
    """(doc_id, id, storage, sha256, bytes): figures(doc_id, id, data) embedded, or dropped if there is no data or keep is false."""
    has = F.col("data").isNotNull() & F.lit(keep)
    return figures.select("doc_id", "id", F.when(has, "embedded").otherwise("dropped").alias("storage"), F.when(has, F.sha2("data", 256)).alias("sha256"), F.when(has, F.octet_length("data").cast("long")).alias("bytes"))


def join_space(left: Column, right: Column) -> Column:
    """Does a space belong between two runs of a cell?"""
    p, n = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    return (p != "") & (n != "") & ~n.rlike(r"^[)\]},.;:!?%]$") & ~p.rlike(r"^[(\[{]$") & ~(p.rlike("^[.:/,−-]$") & n.rlike("^[0-9]$"))


def output_path(source: str | None, path: str | None, ext: str) -> str:
    """Where a rendering goes: beside its source, into a folder, or to the path itself."""
    if path is not None and not os.path.isdir(path):
        return path
    if source is None:
        raise ValueError("without a source a path is needed")
    name = os.path.splitext(source)[0] + "." + ext
    return name if path is None else os.path.join(path, os.path.basename(name))


def write_documents(docs: DataFrame, target: str, text: str = "html", per_file: int = 10_000) -> None:
    """docs(doc_id, text) as JSON lines (doc_id, text), at most per_file documents in a file, so that a corpus isn't a folder for each document."""
    docs.select("doc_id", F.col(text).alias("text")).write.mode("overwrite").option("maxRecordsPerFile", per_file).json(target)
