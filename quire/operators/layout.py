"""Operators over positioned text: spans(doc_id, page, n, x, y, size, width, text, bold, font, angle), y upwards, n the paint order.

Any reader that yields such rows will do; each page stands for itself. What is a
comparison or a window is native; only the recursive cut of a page and the
anchored clustering of rows are folds over one page.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import classify as K
from quire.functions import numeric as N
from quire.operators.model import folded
from quire.operators.sequence import first_of, islands

PAGE = ["doc_id", "page"]


def span_width() -> Column:
    return F.when(F.col("width") > 0.1, F.col("width")).otherwise(F.length("text") * F.col("size") * 0.5)


def span_box() -> Column:
    return N.box(F.col("x"), F.col("y"), F.col("x") + span_width(), F.col("y") + F.col("size"))


def dedup_coincident(spans: DataFrame) -> DataFrame:
    """The first of the spans with one text at one place, to the nearest point."""
    return first_of(spans, [F.col("doc_id"), F.col("page"), F.round("x"), F.round("y"), F.col("text")], "n")


def clip(spans: DataFrame, box: Column) -> DataFrame:
    """Spans that meet a box, if only at an edge."""
    i = N.box_intersect(span_box(), box)
    return spans.where((i["x1"] >= i["x0"]) & (i["y1"] >= i["y0"]))


def link_at(spans: DataFrame, rects: DataFrame) -> DataFrame:
    """spans with href: the first of rects(doc_id, page, k, x0, y0, x1, y1, href) that holds the span's start, else null."""
    s = spans.alias("s")
    inside = F.col("s.x").between(F.col("r.x0"), F.col("r.x1")) & F.col("s.y").between(F.col("r.y0"), F.col("r.y1"))
    hit = s.join(rects.alias("r"), (F.col("s.doc_id") == F.col("r.doc_id")) & (F.col("s.page") == F.col("r.page")) & inside)
    best = hit.groupBy(F.col("s.doc_id").alias("doc_id"), F.col("s.page").alias("page"), "n").agg(F.min(F.struct("k", "href"))["href"].alias("href"))
    return spans.join(best, [*PAGE, "n"], "left")


def visual_rows(spans: DataFrame) -> DataFrame:
    """spans with row: a new one where y is farther from the row's first span than 0.6 of the mean size (two at least).

    Rotated and blank spans have none. The first span anchors the row, so this is a
    fold, not a comparison with the span before.
    """
    use = spans.where((F.trim("text") != "") & (F.abs("angle") < 0.01))
    band = F.greatest(F.avg("size").over(Window.partitionBy(*PAGE)) * 0.6, F.lit(2.0))
    rows = use.select(*PAGE, (-F.col("y")).cast("double").alias("up"), F.col("n").cast("long").alias("n"), band.cast("double").alias("band"))

    def start():
        ref, row = None, 0

        def step(up, n, band):
            nonlocal ref, row
            if n is None:
                return []
            if ref is None or abs(ref - up) > band:
                ref, row = up, row + 1
            return [(n, row)]

        return step

    made = folded(rows, PAGE, ["up", "n"], ["up", "n", "band"], start, "n long, row int")
    return spans.join(made, [*PAGE, "n"], "left")


def row_cells(spans: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, page, row, cell, x, end, text) of spans with row: spans closer than 1.3 sizes are one cell, but two numbers split at 0.45.

    keep: columns that are the same all over a row, and stay.
    """
    from quire.operators.render import join_space

    w = Window.partitionBy(*PAGE, "row").orderBy("x", "n")
    s = spans.where("row is not null and trim(text) <> ''").withColumn("text", F.trim("text")).withColumn("end", F.col("x") + span_width())
    gap = F.col("x") - F.lag("end").over(w)
    numbers = K.is_num_token(F.col("text")) & K.is_num_token(F.regexp_extract(F.lag("text").over(w), r"(\S+)$", 1)) & (gap > F.col("size") * 0.45)
    s = s.withColumn("gap", gap).withColumn("glue", (gap < F.col("size") * 1.3) & ~F.coalesce(numbers, F.lit(False)))
    s = s.withColumn("space", F.when(F.col("glue") & ~((F.col("gap") <= F.col("size") * 0.2) & (F.col("gap") >= F.col("size") * -0.35)) & join_space(F.lag("text").over(w), F.col("text")), " ").otherwise(""))
    s = s.withColumn("cell", F.sum(F.when(F.coalesce("glue", F.lit(False)), 0).otherwise(1)).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x", "n", "space", "text"))), lambda p: F.concat(p["space"], p["text"]))
    return s.groupBy(*PAGE, "row", "cell").agg(F.min("x").alias("x"), F.max("end").alias("end"), F.ltrim(F.array_join(parts, "")).alias("text"), *(F.first(c).alias(c) for c in keep))


def column_anchors(cells: DataFrame, tolerance: float) -> DataFrame:
    """(doc_id, page, column, x): left edges, a new one where an edge is farther than the tolerance from the last anchor."""
    page = cells.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.col("x").cast("double"))).alias("xs"))
    fold = f"aggregate(xs, cast(array() as array<double>), (a, x) -> case when size(a) = 0 or x - element_at(a, -1) > {tolerance} then concat(a, array(x)) else a end)"
    return page.select(*PAGE, F.posexplode(F.expr(fold)).alias("column", "x"))


def bind_to_bands(items: DataFrame, bands: DataFrame, at: str = "center") -> DataFrame:
    """items(doc_id, page, n, center) with band: the first of bands(doc_id, page, band, lo, hi) that holds the centre, else the nearest."""
    joined = items.join(bands, PAGE)
    away = F.greatest(F.lit(0.0), F.col("lo") - F.col(at), F.col(at) - F.col("hi"))
    best = joined.groupBy(*PAGE, "n").agg(F.min_by("band", F.struct(away, "band")).alias("band"))
    return items.join(best, [*PAGE, "n"], "left")


# ---- reading order


def _gap(lo: np.ndarray, hi: np.ndarray) -> tuple[float, float]:
    """The widest hole in a union of intervals, and its middle."""
    if len(lo) < 2:
        return 0.0, 0.0
    o = np.argsort(lo, kind="stable")
    edge = np.maximum.accumulate(hi[o])[:-1]
    hole = lo[o][1:] - edge
    k = int(hole.argmax())
    return (float(hole[k]), float(edge[k] + hole[k] / 2)) if hole[k] > 0 else (0.0, 0.0)


def cut_order(box: np.ndarray, size: float) -> list[int]:
    """Reading order of boxes (x0, x1, y0, y1) by recursive cuts: columns where the gutter is the widest hole, else blocks from the top."""
    size = max(size, 1.0)
    column, block, band, tall = max(size, 7.0), max(size * 1.2, 6.0), max(size * 0.6, 2.0), max(size * 0.4, 2.0)

    def lines(idx: np.ndarray) -> list[int]:
        return idx[np.lexsort((box[idx, 0], -np.round(box[idx, 2] / band)))].tolist()

    def is_gutter(left: np.ndarray, right: np.ndarray) -> bool:
        if min(len(left), len(right)) < max(3, (len(left) + len(right)) / 10):
            return False
        top, low = [box[s, 3].max() for s in (left, right)], [box[s, 2].min() for s in (left, right)]
        return max(0.0, min(top) - max(low)) >= 0.5 * max(1.0, min(top[0] - low[0], top[1] - low[1]))

    def cut(idx: np.ndarray, depth: int) -> list[int]:
        if len(idx) <= 1 or depth >= 40:
            return lines(idx)
        upright = idx[box[idx, 3] - box[idx, 2] >= tall]
        v, at_x = _gap(box[upright, 0], box[upright, 1])
        h, at_y = _gap(box[idx, 2], box[idx, 3])
        side = (box[idx, 0] + box[idx, 1]) / 2 < at_x
        gutter = v >= column and is_gutter(idx[side], idx[~side])
        if gutter and (v >= h or h < block):
            return cut(idx[side], depth + 1) + cut(idx[~side], depth + 1)
        if h >= block:
            above = (box[idx, 2] + box[idx, 3]) / 2 >= at_y
            return cut(idx[above], depth + 1) + cut(idx[~above], depth + 1)
        return lines(idx)

    return cut(np.arange(len(box)), 0)


def reading_order(spans: DataFrame) -> DataFrame:
    """spans with ord, the place in the page's reading order."""

    def start():
        held: list[tuple] = []

        def step(n, *values):
            if n is not None:
                held.append((n, *values))
                return []
            x, y, size, width = np.array([h[1:] for h in held], float).T
            order = cut_order(np.stack([x, x + width, y, y + size], 1), float(np.sort(size)[len(size) // 2]))
            return [(held[i][0], at) for at, i in enumerate(order)]

        return step

    number = lambda c, name: c.cast("double").alias(name)
    rows = spans.select(*PAGE, "n", *(number(F.col(c), c) for c in ("x", "y", "size")), number(span_width(), "wide"))
    made = folded(rows, PAGE, ["n"], ["n", "x", "y", "size", "wide"], start, f"n {dict(spans.dtypes)['n']}, ord int")
    return spans.join(made, [*PAGE, "n"])


def page_text(ordered: DataFrame) -> DataFrame:
    """(doc_id, page, text) of spans with ord: a new line where the band of y changes, a space where the gap is over 0.2 sizes."""
    sizes = ordered.groupBy(*PAGE).agg(F.greatest(N.upper_median(F.collect_list("size")) * 0.6, F.lit(2.0)).alias("band"))
    w = Window.partitionBy(*PAGE).orderBy("ord")
    s = ordered.where("text <> ''").join(sizes, PAGE).withColumn("line", F.round(F.col("y") / F.col("band"))).withColumn("end", F.col("x") + span_width())
    gap = F.col("x") - F.lag("end").over(w)
    spaced = (gap > F.col("size") * 0.2) & ~F.lag("text").over(w).endswith(" ") & ~F.col("text").startswith(" ")
    s = s.withColumn("lead", F.when(F.lag("line").over(w).isNull(), "").when(F.lag("line").over(w) != F.col("line"), "\n").when(spaced, " ").otherwise(""))
    return s.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "lead", "text"))), lambda x: F.concat(x["lead"], x["text"])), "").alias("text"))


# ---- typography of a document


def style_clusters(spans: DataFrame) -> DataFrame:
    """(doc_id, size, bold, font, chars, spans, captions, pages) of upright spans."""
    start = F.lower(F.ltrim("text"))
    return spans.where(F.abs("angle") < 0.01).groupBy("doc_id", F.round("size").cast("int").alias("size"), "bold", "font").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("spans"), F.count_if(start.rlike(r"^(figure|table|fig\.|tab\.)")).alias("captions"), F.countDistinct("page").alias("pages"))


def heading_tiers(spans: DataFrame) -> DataFrame:
    """(doc_id, level, size, bold, font, body_size, body_font): up to four styles that look like headings.

    Body is the style with most characters (ties: the largest). Tiers are larger
    than body and of a heading's face, no larger than the title, not too frequent,
    not on nearly every page and not captions; larger first, then the title's font,
    bold, denser.
    """
    c = style_clusters(spans)
    key = F.struct("chars", "size", "bold", "font")
    body = c.groupBy("doc_id").agg(F.max(key).alias("b"))
    pages = spans.groupBy("doc_id").agg(F.countDistinct("page").alias("all_pages"))
    x = c.join(body, "doc_id").join(pages, "doc_id")
    title = x.where((F.col("size") > F.col("b.size")) & (F.col("chars") >= 15)).groupBy("doc_id").agg(F.max(F.struct("size", "chars", "bold", "font")).alias("t"))
    x = x.join(title, "doc_id", "left")
    is_body = (F.col("size") == F.col("b.size")) & (F.col("bold") == F.col("b.bold")) & (F.col("font") == F.col("b.font"))
    plain = (F.col("font") == F.col("b.font")) & ~F.col("bold") & (F.col("size") < F.col("b.size") * 1.18)
    over = F.coalesce((F.col("t.size") > F.col("b.size") * 1.15) & (F.col("size") >= F.col("t.size")), F.lit(False))
    running = (F.col("all_pages") >= 4) & (F.col("pages") > F.col("all_pages") * 0.9)
    kept = x.where((F.col("size") > F.col("b.size")) & ~is_body & ~plain & ~over & (F.col("chars") < F.col("b.chars") * 0.4) & ~running & (F.col("captions") * 2 < F.col("spans")))
    faced = F.coalesce(F.col("font") == F.col("t.font"), F.col("font") == F.col("b.font"))
    w = Window.partitionBy("doc_id").orderBy(F.col("size").desc(), faced.desc(), F.col("bold").desc(), F.col("chars").desc(), F.col("font").desc())
    return kept.withColumn("level", F.row_number().over(w)).where("level <= 4").select("doc_id", "level", "size", "bold", "font", F.col("b.size").alias("body_size"), F.col("b.font").alias("body_font"))


def tier_levels(lines: DataFrame, tiers: DataFrame) -> DataFrame:
    """lines(doc_id, n, size, bold, font) with level: the first tier within 0.6 of the size, of the font, bold if the tier is."""
    t = tiers.select("doc_id", "level", F.col("size").alias("ts"), F.col("bold").alias("tb"), F.col("font").alias("tf"), "body_font")
    fits = (F.abs(F.col("size") - F.col("ts")) <= 0.6) & ((F.col("tf") == 0) | (F.col("body_font") == 0) | (F.col("font") == F.col("tf"))) & (~F.col("tb") | F.col("bold"))
    best = lines.join(t, "doc_id").where(fits).groupBy("doc_id", "n").agg(F.min("level").alias("level"))
    return lines.join(best, ["doc_id", "n"], "left")


def distrusted_styles(headings: DataFrame, pages: DataFrame, least: int = 90) -> DataFrame:
    """(doc_id, size, bold, font): styles with more headings by style alone than `least` and than the document has pages(doc_id, n_pages)."""
    counts = headings.groupBy("doc_id", F.round("size").cast("int").alias("size"), "bold", "font").agg(F.count("*").alias("c"))
    return counts.join(pages, "doc_id").where(F.col("c") > F.greatest(F.lit(least), F.col("n_pages"))).select("doc_id", "size", "bold", "font")


def footnote_lines(lines: DataFrame) -> DataFrame:
    """lines(doc_id, page, ord, y, size, text, body) with footnote: runs of 2 to 12 small lines that begin in the lower 45 percent."""
    all_ = Window.partitionBy(*PAGE)
    x = lines.withColumn("cut", F.min("y").over(all_) + (F.max("y").over(all_) - F.min("y").over(all_)) * 0.45)
    x = x.withColumn("small", (F.trim("text") != "") & (F.col("size") < F.col("body") * 0.86))
    x = islands(x, PAGE, "ord", F.col("small") & F.lag("small").over(all_.orderBy("ord")))
    run = Window.partitionBy(*PAGE, "island")
    low = F.first("y").over(run.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) < F.col("cut")
    return x.withColumn("footnote", F.col("small") & F.count("*").over(run).between(2, 12) & low).drop("cut", "small", "island")
