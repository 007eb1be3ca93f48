"""Regions of a page: rules and grid lines, table claims, images, captions and headings over positioned rows.

Boxes are columns x0, y0, x1, y1 with y upwards. A page stands for itself
throughout. What compares rows of a page is a join on the page or a window; what
depends on the choices made before it is a fold over the page's ordered rows.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import numeric as N
from quire.functions import text as T
from quire.operators.model import folded
from quire.operators.sequence import first_of

PAGE = ["doc_id", "page"]


def box_of(alias: str = "") -> Column:
    p = f"{alias}." if alias else ""
    return N.box(*(F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")))


def _width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def _height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def _area(b: Column) -> Column:
    return _width(b) * _height(b)


# ---------------------------------------------------------------- rules


def grid_lines(rules: DataFrame, snap: float = 1.6, seam: float = 2.5) -> DataFrame:
    """(doc_id, page, line, p, lo, hi): rules(doc_id, page, p, lo, hi) as lines, the intervals of each joined over seams.

    A rule belongs to the line whose first place is at most snap before its own;
    empty and non-finite rules are left out.
    """
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = rules.select(*PAGE, *(F.col(c).cast("double").alias(c) for c in ("p", "lo", "hi"))).where("hi > lo").where(finite(F.col("p")) & finite(F.col("lo")) & finite(F.col("hi")))

    def start():
        at, line = None, 0

        def step(p, lo, hi):
            nonlocal at, line
            if p is None:
                return []
            if at is None or abs(p - at) > snap:
                at, line = p, line + 1
            return [(line, at, lo, hi)]

        return step

    snapped = folded(good, PAGE, ["p", "lo"], ["p", "lo", "hi"], start, "line int, p double, lo double, hi double")
    w = Window.partitionBy(*PAGE, "line").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    pieces = snapped.withColumn("new", F.when(F.col("lo") <= before + seam, 0).otherwise(1)).withColumn("piece", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return pieces.groupBy(*PAGE, "line", "piece").agg(F.first("p").alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("piece")


def h_bands(rules: DataFrame) -> DataFrame:
    """(doc_id, page, x0, x1, y): horizontal rules(doc_id, page, x0, x1, y) with their pieces joined."""
    lines = grid_lines(rules.select(*PAGE, F.col("y").alias("p"), F.col("x0").alias("lo"), F.col("x1").alias("hi")))
    return lines.select(*PAGE, F.col("lo").alias("x0"), F.col("hi").alias("x1"), F.col("p").alias("y"))


def rule_banded(runs: DataFrame, bands: DataFrame, narrow: float = 60.0, share: float = 0.7) -> DataFrame:
    """runs(doc_id, page, run, x0, x1, y0, y1, pad) with banded: a band over most of the width close above, and one close below."""
    r, b = runs.alias("r"), bands.alias("b")
    spans = F.least("b.x1", "r.x1") - F.greatest("b.x0", "r.x0") >= (F.col("r.x1") - F.col("r.x0")) * share
    met = r.join(b, [F.col(f"r.{c}") == F.col(f"b.{c}") for c in PAGE] + [spans])
    above = (F.col("b.y") > F.col("r.y1")) & (F.col("b.y") <= F.col("r.y1") + F.col("r.pad"))
    below = (F.col("b.y") < F.col("r.y0")) & (F.col("b.y") >= F.col("r.y0") - F.col("r.pad"))
    sides = met.groupBy(*(F.col(f"r.{c}").alias(c) for c in [*PAGE, "run"])).agg((F.bool_or(above) & F.bool_or(below)).alias("both"))
    wide = F.col("x1") - F.col("x0") >= narrow
    return runs.join(sides, [*PAGE, "run"], "left").withColumn("banded", wide & F.coalesce("both", F.lit(False))).drop("both")


# ---------------------------------------------------------------- tables


def owns(outer: Column, t: Column) -> Column:
    """Does a frame own a table's region: half of the smaller area, or the same columns and rows that meet."""
    i = N.box_intersect(outer, t)
    ow, oh = F.greatest(_width(i), F.lit(0.0)), F.greatest(_height(i), F.lit(0.0))
    area = ow * oh >= F.greatest(F.least(_area(t), _area(outer)), F.lit(1.0)) * 0.5
    columns = (ow >= F.greatest(F.least(_width(outer), _width(t)), F.lit(1.0)) * 0.6) & (oh > 0)
    return area | columns


def covers(outer: Column, t: Column, share: float = 0.5) -> Column:
    """Does a region hold that share of a table's own area?"""
    i = N.box_intersect(outer, t)
    return F.greatest(_width(i), F.lit(0.0)) * F.greatest(_height(i), F.lit(0.0)) >= F.greatest(_area(t), F.lit(1.0)) * share


def reconcile_preferred(existing: DataFrame, preferred: DataFrame, own=owns, cover=covers) -> DataFrame:
    """(doc_id, page, source, k, x0, y0, x1, y1): preferred tables in place of the existing ones that they own.

    A preferred table that owns one it doesn't cover is dropped, and the existing one stays.
    """
    # tables of one place have one fate, so places are compared, and each once a page
    place = ["x0", "y0", "x1", "y1"]
    e, p = existing.select(*PAGE, *place).distinct().alias("e"), preferred.select(*PAGE, *place).distinct().alias("p")
    of = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in place)).alias(side)
    met = e.join(p, [F.col(f"e.{c}") == F.col(f"p.{c}") for c in PAGE] + [own(box_of("p"), box_of("e"))]).select(*(F.col(f"p.{c}").alias(c) for c in PAGE), of("e"), of("p"), cover(box_of("p"), box_of("e")).alias("ok"))
    # the places that one preferred table owns are few; whether it is over and which ones go is known from them
    owned = met.groupBy(*PAGE, "p").agg(F.bool_and("ok").alias("ok"), F.collect_list("e").alias("es"))
    over = owned.where(~F.col("ok")).select(*PAGE, "p.*")
    gone = owned.where("ok").select(*PAGE, F.explode("es").alias("e")).select(*PAGE, "e.*").distinct()
    cols = [*PAGE, "k", "x0", "y0", "x1", "y1"]
    kept = existing.select(cols).join(gone, [*PAGE, *place], "left_anti").withColumn("source", F.lit("existing"))
    won = preferred.select(cols).join(over, [*PAGE, *place], "left_anti").withColumn("source", F.lit("preferred"))
    return kept.unionByName(won).select(*PAGE, "source", "k", "x0", "y0", "x1", "y1")


class Heights:
    """Fragments (place, y0, y1) of one lane, taken one by one: the first that overlaps given heights by half of the smaller.

    Equal heights wait in one line; the lines are in a tree by y0 that knows each
    branch's first place and highest y1, so a search leaves out what doesn't reach
    the heights and what comes later than the best so far.
    """

    def __init__(self, fragments: list[tuple]):
        lines: dict[tuple, list[int]] = {}
        for place, a, b in fragments:
            lines.setdefault((a, b), []).append(place)
        self.keys = sorted(lines)
        self.lines = [lines[key][::-1] for key in self.keys]
        self.taken: set[int] = set()
        n = self.size = 1 << (len(self.keys) - 1).bit_length()
        self.first = [float("inf")] * 2 * n
        self.low, self.high = [float("inf")] * 2 * n, [float("-inf")] * 2 * n
        for i, (a, b) in enumerate(self.keys):
            self.first[n + i], self.low[n + i], self.high[n + i] = self.lines[i][-1], a, b
        for v in range(n - 1, 0, -1):
            for x, of in ((self.first, min), (self.low, min), (self.high, max)):
                x[v] = of(x[2 * v], x[2 * v + 1])

    def take(self, lo: float, hi: float) -> int | None:
        best, at, stack = float("inf"), None, [1]
        while stack:
            v = stack.pop()
            if self.first[v] >= best or self.low[v] > hi or self.high[v] < lo:
                continue
            if v < self.size:
                near, far = sorted((2 * v, 2 * v + 1), key=self.first.__getitem__)
                stack += (far, near)
                continue
            a, b = self.keys[v - self.size]
            if min(hi, b) - max(lo, a) >= max(min(hi - lo, b - a), 1.0) * 0.5:
                best, at = self.first[v], v
        if at is None:
            return None
        line = self.lines[at - self.size]
        self.taken.add(place := line.pop())
        self.first[at] = line[-1] if line else float("inf")
        while at > 1:
            at //= 2
            self.first[at] = min(self.first[2 * at], self.first[2 * at + 1])
        return place


def lane_chains(tables: DataFrame) -> DataFrame:
    """tables(doc_id, page, lane, k, y0, y1) with chain: fragments of one table over lanes, each taking the first free one to its right that overlaps half.

    With two lanes these are the pairs of a page that a gutter split. A chain of
    several is what is detected anew over the heights together.
    """

    def start():
        held: list[tuple] = []

        def step(lane, k, y0, y1):
            if lane is not None:
                held.append((lane, k, y0, y1))
                return []
            lanes = {own: Heights([(i, *t[2:]) for i, t in of_lane]) for own, of_lane in groupby(enumerate(held), key=lambda t: t[1][0])}
            order, out, chain = list(lanes), [], 0
            for i, (own, k0, lo, hi) in enumerate(held):
                if i in lanes[own].taken:
                    continue
                chain += 1
                out.append((own, k0, chain))
                for to in order[order.index(own) + 1 :]:
                    j = lanes[to].take(lo, hi)
                    if j is not None:
                        out.append((to, held[j][1], chain))
                        lo, hi = min(lo, held[j][2]), max(hi, held[j][3])
            return out

        return step

    rows = tables.select(*PAGE, F.col("lane").cast("int").alias("lane"), F.col("k").cast("long").alias("k"), F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1"))
    return tables.join(folded(rows, PAGE, ["lane", "k"], ["lane", "k", "y0", "y1"], start, "lane int, k long, chain int"), [*PAGE, "lane", "k"])


def bind_contained(spans: DataFrame, grids: DataFrame, edge: float = 1.0) -> DataFrame:
    """(doc_id, page, grid, row, col, n, piece, text): upright spans(x, x1, y, size) cut at the columns of grids(doc_id, page, grid, xs, ys), by cell.

    The middle of the glyphs decides the row, counted from the top; each piece's
    middle its column. Characters are taken as equally wide.
    """
    s = spans.where((F.abs("angle") < 0.01) & (F.trim("text") != "")).join(grids, PAGE)
    cy = F.col("y") + F.col("size") * 0.25
    ends = lambda a: (F.get(a, 0) - edge, F.element_at(a, -1) + edge)
    s = s.where(cy.between(*ends(F.col("ys"))) & (F.col("x1") >= ends(F.col("xs"))[0]) & (F.col("x") <= ends(F.col("xs"))[1]))
    band = lambda a, v: F.least(F.greatest(F.size(F.filter(a, lambda t: t <= v)) - 1, F.lit(0)), F.size(a) - 2)
    chars = F.length("text")
    inner = F.filter(F.slice("xs", 2, F.size("xs") - 2), lambda t: (t > F.col("x")) & (t < F.col("x1")))
    cuts = F.transform(inner, lambda t: F.round((t - F.col("x")) / (F.col("x1") - F.col("x")) * chars).cast("int"))
    at = F.array_distinct(F.concat(F.array(F.lit(0)), cuts, F.array(chars)))
    s = s.withColumn("row", F.size("ys") - 2 - band(F.col("ys"), cy)).withColumn("at", at)
    s = s.select("*", F.posexplode(F.slice("at", 1, F.size("at") - 1)).alias("piece", "lo")).withColumn("hi", F.get("at", F.col("piece") + 1))
    middle = F.col("x") + (F.col("x1") - F.col("x")) * (F.col("lo") + F.col("hi")) / 2 / chars
    text = F.substring(F.col("text"), F.col("lo") + 1, F.col("hi") - F.col("lo"))
    return s.select(*PAGE, "grid", "row", band(F.col("xs"), middle).alias("col"), "n", "piece", text.alias("text"))


def prose_without_claims(spans: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, page, n, lo, text): what is left of spans(doc_id, page, n, text) without the character intervals [lo, hi) of claims."""
    held = claims.where("hi > lo").groupBy(*PAGE, "n").agg(F.array_sort(F.collect_list(F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi")))).alias("c"))
    s = spans.join(held, [*PAGE, "n"], "left").withColumn("len", F.length("text"))
    # a gap begins where all claims before it end
    ends = F.expr("transform(c, (x, i) -> aggregate(slice(c, 1, i + 1), 0, (m, y) -> greatest(m, y.hi)))")
    gaps = F.expr("filter(transform(sequence(0, size(c)), i -> struct(case when i = 0 then 0 else e[i - 1] end as lo, case when i = size(c) then len else least(c[i].lo, len) end as hi)), g -> g.hi > g.lo)")
    s = s.withColumn("e", ends).withColumn("g", F.when(F.col("c").isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.col("len").alias("hi")))).otherwise(gaps))
    s = s.select(*PAGE, "n", "text", F.explode("g").alias("g"))
    return s.select(*PAGE, "n", F.col("g.lo").alias("lo"), F.substring(F.col("text"), F.col("g.lo") + 1, F.col("g.hi") - F.col("g.lo")).alias("text"))


def continuations(tables: DataFrame) -> DataFrame:
    """tables(doc_id, page, k, signature, leads, ends, styled, first_row) with anchor_page, anchor_k, skip: the table that each goes on with.

    A table that begins its page (leads) goes on with one that ends the page before
    (ends) and has its signature and a styled first row, if that is the only such
    pair between the two pages. skip: its own first row is the header again; a
    styled first row that differs is no continuation.
    """

    def start():
        anchors: list[dict] = []  # of tables whose last part is on the page before
        fresh: list[tuple] = []
        now = None

        def pairs(page):
            """The only pair of a table that leads and an anchor that it may go on with, or none."""
            by_style, by_row = {}, {}
            for x in anchors:
                if x["last"] + 1 == page and x["ends"] and x["styled"]:
                    by_style.setdefault(x["signature"], []).append(x)
                    by_row.setdefault((x["signature"], x["first"]), []).append(x)
            found = []
            for t in fresh:
                _, _, signature, leads, _, styled, first = t
                if leads:
                    found += [(t, x) for x in (by_row.get((signature, first), []) if styled else by_style.get(signature, []))[:2]]
                if len(found) > 1:
                    return None
            return found[0] if found else None

        def close():
            joined, out, kept = (pairs(now) if fresh else None), [], []
            for t in fresh:
                page, k, signature, leads, ends, styled, first = t
                if joined and joined[0] is t:
                    x = joined[1]
                    x["last"], x["ends"] = page, ends
                    kept.append(x)
                    out.append((page, k, x["page"], x["k"], bool(styled)))
                else:
                    kept.append({"page": page, "k": k, "last": page, "ends": ends, "styled": styled, "signature": signature, "first": first})
                    out.append((page, k, page, k, False))
            if fresh:
                anchors[:] = kept
            fresh.clear()
            return out

        def step(page, *rest):
            nonlocal now
            out = close() if page != now else []
            now = page
            if page is not None:
                fresh.append((page, *rest))
            return out

        return step

    rows = tables.select("doc_id", F.col("page").cast("int").alias("page"), F.col("k").cast("int").alias("k"), F.col("signature").cast("string").alias("signature"), "leads", "ends", "styled", F.col("first_row").cast("string").alias("first_row"))
    made = folded(rows, ["doc_id"], ["page", "k"], ["page", "k", "signature", "leads", "ends", "styled", "first_row"], start, "page int, k int, anchor_page int, anchor_k int, skip boolean")
    return tables.join(made, ["doc_id", "page", "k"])


def merged_rows(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, page, k, row, cells): rows(doc_id, page, k, row, cells) of the tables that parts (of continuations) joins, a repeated header left out."""
    x = rows.join(parts.select("doc_id", "page", "k", "anchor_page", "anchor_k", "skip"), ["doc_id", "page", "k"]).where(~(F.col("skip") & (F.col("row") == 0)))
    w = Window.partitionBy("doc_id", "anchor_page", "anchor_k").orderBy("page", "row")
    return x.select("doc_id", F.col("anchor_page").alias("page"), F.col("anchor_k").alias("k"), (F.row_number().over(w) - 1).alias("row"), "cells")


def cells_array(cells: DataFrame) -> DataFrame:
    """(doc_id, page, cells): the texts of cells(doc_id, page, row, cell, text) as rows of cells."""
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    return cells.groupBy(*PAGE, "row").agg(ordered("cell", "text").alias("texts")).groupBy(*PAGE).agg(ordered("row", "texts").alias("cells"))


def header_depth(rows: DataFrame) -> DataFrame:
    """(doc_id, k, depth): how many rows of a table(doc_id, k, row from 0, cells, styled) are its header.

    More than one only if styled rows from the first on have more and more cells
    filled, and one of them all; the first of these ends the header.
    """
    filled = F.size(F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    w = Window.partitionBy("doc_id", "k").orderBy("row")
    x = rows.select("doc_id", "k", "row", "styled", filled.alias("n"), F.first(F.size("cells")).over(w).alias("columns"))
    first = (F.col("row") == 0) & (F.col("n") > 0) & (F.col("n") < F.col("columns"))
    good = F.col("styled") & F.when(F.col("row") == 0, first).otherwise(F.col("n") > F.lag("n").over(w))
    x = x.withColumn("good", F.min(F.coalesce(good, F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.col("good") & (F.col("row") > 0) & (F.col("n") == F.col("columns")) & (F.col("columns") > 1)
    return x.groupBy("doc_id", "k").agg(F.coalesce(F.min(F.when(whole, F.col("row") + 1)), F.lit(1)).cast("int").alias("depth"))


def ownership_hash(slices: Column) -> Column:
    """FNV-1a (64 bits, hexadecimal) over the numbers of an array, eight bytes each, lowest first."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(xs):
            h = 0xCBF29CE484222325  # fixed values of this hash: its start, and the prime below
            for b in np.asarray(xs, "<u8").tobytes() if xs is not None else b"":
                h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            return f"{h:016x}"

        return s.map(one)

    return run(slices)


# ---------------------------------------------------------------- images and labels


def page_images(images: DataFrame, object_: str = "object") -> DataFrame:
    """images(doc_id, page, n, object, ...) with each object once a page, numbered from 0 in paint order."""
    once = first_of(images, [F.col("doc_id"), F.col("page"), F.col(object_)], "n")
    return once.withColumn("index", F.row_number().over(Window.partitionBy(*PAGE).orderBy("n")) - 1)


def image_coverage(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, coverage): the largest image's share of pages(doc_id, page, width, height); 0 without images."""
    largest = images.groupBy(*PAGE).agg(F.max(F.abs(F.col("x1") - F.col("x0")) * F.abs(F.col("y1") - F.col("y0"))).alias("a"))
    return pages.join(largest, PAGE, "left").select(*PAGE, (F.coalesce("a", F.lit(0.0)) / F.greatest(F.col("width") * F.col("height"), F.lit(1.0))).alias("coverage"))


def tile_clusters(tiles: DataFrame, near: float = 2.0) -> DataFrame:
    """tiles(doc_id, page, n, x0, y0, x1, y1) with cluster: the first n of the tiles that touch, directly or by others, within `near`."""

    def start():
        held: list[tuple] = []  # (n, x0, y0, x1, y1), by x0
        parent: dict[int, int] = {}
        open_: list[tuple] = []

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def step(n, x0, y0, x1, y1):
            if n is None:
                return [(t[0], root(t[0])) for t in held]
            parent[n] = n
            # of the tiles that begin before, those that reach here
            open_[:] = [t for t in open_ if x0 < t[3] + near]
            for t in open_:
                if x1 + near > t[1] and y0 < t[4] + near and t[2] < y1 + near:
                    a, b = root(n), root(t[0])
                    parent[max(a, b)] = min(a, b)
            open_.append((n, x0, y0, x1, y1))
            held.append((n,))
            return []

        return step

    cols = ["n", "x0", "y0", "x1", "y1"]
    rows = tiles.select(*PAGE, F.col("n").cast("long").alias("n"), *(F.col(c).cast("double").alias(c) for c in cols[1:]))
    return tiles.join(folded(rows, PAGE, ["x0", "n"], cols, start, "n long, cluster long"), [*PAGE, "n"])


def attach_labels(labels: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, page, n, figure, in_table): labels(x, y, in_table) by the first of figures(figure, box) that holds their place; others are left out."""
    s, f = labels.alias("l"), figures.alias("f")
    met = s.join(f, [F.col(f"l.{c}") == F.col(f"f.{c}") for c in PAGE] + [N.box_contains(box_of("f"), F.col("l.x"), F.col("l.y"))])
    return met.groupBy(*(F.col(f"l.{c}").alias(c) for c in [*PAGE, "n"])).agg(F.min("f.figure").alias("figure"), F.first("l.in_table").alias("in_table"))


def figure_gate(figures: DataFrame) -> DataFrame:
    """(doc_id, accepted, suppressed, pages) of figures(doc_id, page, strong, demoted); pages have a demotion."""
    dropped = ~F.col("strong") & F.col("demoted")
    return figures.groupBy("doc_id").agg(F.count_if("strong").alias("accepted"), F.count_if(dropped).alias("suppressed"), F.array_sort(F.collect_set(F.when(dropped, F.col("page")))).alias("pages"))


# ---------------------------------------------------------------- columns, captions, headings


def tolerant_gap(boxes: DataFrame, tolerance: int) -> DataFrame:
    """(doc_id, page, width, center): the widest inner lane that at most `tolerance` of boxes(lo, hi) cross, in steps of a point; none without a lane."""

    def start():
        lo, hi = [], []

        def step(a, b):
            if a is not None:
                lo.append(a)
                hi.append(b)
                return []
            found = lane(np.array(lo), np.array(hi), tolerance)
            return [found] if found else []

        return step

    rows = boxes.select(*PAGE, F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    return folded(rows, PAGE, ["lo", "hi"], ["lo", "hi"], start, "width double, center double")


def lane(lo: np.ndarray, hi: np.ndarray, tolerance: int) -> tuple[float, float] | None:
    if not len(lo) or not hi.max() - lo.min() > 2:
        return None
    x = lo.min() + np.arange(1, int(np.ceil(hi.max() - lo.min())) + 1, dtype=float)
    x = x[x < hi.max()]
    crossed = np.searchsorted(np.sort(lo), x, "left") - np.searchsorted(np.sort(hi), x, "right")
    clear = np.r_[False, crossed <= tolerance, False].astype(np.int8)
    first, last = np.flatnonzero(np.diff(clear) == 1), np.flatnonzero(np.diff(clear) == -1) - 1
    if not len(first):
        return None
    width = x[last] - x[first]
    best = int(width.argmax())
    return (float(width[best]), float(x[first[best]] + x[last[best]]) / 2) if width[best] > 0 else None


def tall_columns(boxes: DataFrame, cuts: DataFrame, lines: float = 8.0) -> DataFrame:
    """cuts(doc_id, page, cut, med) with tall: the boxes on either side share a height of `lines` lines of med or more."""
    b = boxes.join(cuts, PAGE)
    left = (F.col("x0") + F.col("x1")) * 0.5 < F.col("cut")
    top, low = (lambda s: F.max(F.when(s, F.col("y1")))), (lambda s: F.min(F.when(s, F.col("y0"))))
    both = F.least(top(left), top(~left)) - F.greatest(low(left), low(~left))
    shared = b.groupBy(*PAGE, "cut", "med").agg(F.when(F.count_if(left) * F.count_if(~left) > 0, both).otherwise(0.0).alias("shared"))
    return cuts.join(shared.select(*PAGE, "cut", "shared"), [*PAGE, "cut"], "left").withColumn("tall", F.greatest(F.coalesce("shared", F.lit(0.0)), F.lit(0.0)) >= F.col("med") * lines).drop("shared")


def gather_captions(lines: DataFrame, most: int = 14) -> DataFrame:
    """lines(doc_id, page, ord, x0, y, size, text, caption, breaks) with caption_ord: the caption that a line belongs to, null for others.

    caption begins one; breaks says that a line is a heading, list item or caption.
    A caption ends at a gap, an indent or a break, and has at most `most` lines;
    tiny superscripts are in it without a say.
    """

    def start():
        head = base = None
        used, last = 0, 0.0

        def step(at, x0, y, size, text, caption, breaks):
            nonlocal head, base, used, last
            if at is None:
                return []
            if head is not None and used < most:
                if size < base[1] * 0.75 and len(text.strip()) <= 3:
                    used += 1
                    return [(at, head)]
                if -size <= last - y <= size * 1.8 and x0 - base[0] <= size * 0.6 and not breaks and not caption:
                    used, last = used + 1, y
                    return [(at, head)]
            head = at if caption else None
            base, used, last = (x0, size), 1, y
            return [(at, head)]

        return step

    cols = ["ord", "x0", "y", "size", "text", "caption", "breaks"]
    rows = lines.select(*PAGE, F.col("ord").cast("int").alias("ord"), *(F.col(c).cast("double").alias(c) for c in cols[1:4]), F.coalesce("text", F.lit("")).alias("text"), "caption", "breaks")
    return lines.join(folded(rows, PAGE, ["ord"], cols, start, "ord int, caption_ord int"), [*PAGE, "ord"])


def heading_continuations(lines: DataFrame, most: int = 16) -> DataFrame:
    """lines(doc_id, page, ord, x0, y, size, font, tier, text) with head: the first line of the heading that goes on in it, its own ord elsewhere.

    tier says that a line is set as a heading. The next line goes on with it if
    size, font and indent agree, it is close, doesn't end in a digit, and both have
    at most `most` words together.
    """

    def start():
        cur = None

        def step(at, x0, y, size, font, tier, text):
            nonlocal cur
            if at is None:
                return []
            words = len(text.split())
            if cur is not None and tier and round(cur["size"]) == round(size) and cur["font"] == font and abs(cur["y"] - y) < cur["size"] * 1.8 and abs(x0 - cur["x0"]) < cur["size"] * 1.5 and cur["words"] + words <= most and not text.strip()[-1:].isdigit():
                cur["words"] += words
                return [(at, cur["ord"])]
            cur = {"ord": at, "x0": x0, "y": y, "size": size, "font": font, "words": words} if tier and words <= most else None
            return [(at, at)]

        return step

    cols = ["ord", "x0", "y", "size", "font", "tier", "text"]
    rows = lines.select(*PAGE, F.col("ord").cast("int").alias("ord"), *(F.col(c).cast("double").alias(c) for c in cols[1:4]), F.col("font").cast("int").alias("font"), "tier", F.coalesce("text", F.lit("")).alias("text"))
    return lines.join(folded(rows, PAGE, ["ord"], cols, start, "ord int, head int"), [*PAGE, "ord"])


def header_at(verdicts: DataFrame, distrusted: DataFrame) -> DataFrame:
    """verdicts(doc_id, ord, level, kind, size, bold, font) without those by style alone whose style is distrusted."""
    bad = distrusted.select("doc_id", F.round("size").alias("_size"), F.col("bold").alias("_bold"), F.col("font").alias("_font")).distinct()
    v = verdicts.alias("v")
    same = [F.col("v.doc_id") == F.col("d.doc_id"), F.round("v.size") == F.col("d._size"), F.col("v.bold") == F.col("d._bold"), F.col("v.font") == F.col("d._font"), F.col("v.kind") == "style"]
    return v.join(bad.alias("d"), same, "left_anti").select("v.*")


# ---------------------------------------------------------------- glyphs

# Fixed pairs: a diacritic that stands alone, and the combining mark for it.
MARKS = {",": "̦", "¸": "̧", "¯": "̄", "ˉ": "̄", "‾": "̄", "~": "̃", "˜": "̃", "´": "́", "ˊ": "́", "`": "̀", "ˋ": "̀", "¨": "̈", "ˆ": "̂", "ˇ": "̌", "˚": "̊", "°": "̊", "˙": "̇"}


def binds(prev: Column, prev2: Column, next_: Column) -> Column:
    """Do two characters bind, so that no space belongs between them? prev2 is the one before prev; null and empty ones bind nothing."""
    has = (F.coalesce(prev, F.lit("")) != "") & (F.coalesce(next_, F.lit("")) != "")
    number = prev.rlike("^[-,.:/–]$") & next_.rlike("^[0-9]$") & F.coalesce(prev2, F.lit("")).rlike("^[0-9]$")
    return has & (next_.rlike(r"^[)\]},.;:!?%]$") | prev.rlike(r"^[(\[{]$") | number)


def mark_to_combining(c: Column) -> Column:
    """The combining mark for a glyph that is nothing but a diacritic, else null."""
    return F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair))[c]


# ---------------------------------------------------------------- whole documents


def toc(docs: DataFrame, html: str = "html") -> DataFrame:
    """(doc_id, n, level, title, page, id): the entries of the first nav with a link, in order; level and page are 0 where they aren't given."""
    nav = F.regexp_extract(F.col(html), r"(?s)<nav>(.*?)</nav>", 1)
    # each entry ends where the next begins
    items = F.filter(F.split(nav, "<li "), lambda x, i: i > 0)
    x = docs.select("doc_id", F.posexplode(items).alias("n", "li"))
    field = lambda key: F.regexp_extract("li", key + r"([^\"]*)\"", 1)
    number = lambda v: F.coalesce(F.when(v.rlike("^[0-9]{1,9}$"), v.cast("int")), F.lit(0))
    label = F.trim(T.strip_inline(F.regexp_extract("li", r"(?s)^[^>]*>[^>]*>(.*?)(?:</a>|$)", 1)))
    return x.select("doc_id", "n", number(field('data-level=\\"')).alias("level"), label.alias("title"), number(field('data-page=\\"')).alias("page"), field('href=\\"#').alias("id")).where("id <> ''")


def outline(bookmarks: DataFrame) -> DataFrame:
    """(doc_id, n, level, title, page, anchor) of a document's own bookmarks(doc_id, n, level from 0, title, page)."""
    return bookmarks.select("doc_id", "n", (F.col("level") + 1).alias("level"), "title", "page", F.concat(F.lit("page-"), F.col("page").cast("string")).alias("anchor"))


def page_text_of(pages: DataFrame, page: int, fallback: str | None = None) -> DataFrame:
    """(doc_id, text) of one page of each document of pages(doc_id, page, text); a document without that page is an error.

    Under two characters the fallback column's text stands in.
    """
    text = F.coalesce("text", F.lit(""))
    if fallback:
        text = F.when(F.length(T.trim_ws(text)) >= 2, text).otherwise(F.coalesce(fallback, F.lit("")))
    own = pages.groupBy("doc_id").agg(F.max(F.when(F.col("page") == page, F.struct(text.alias("text")))).alias("x"))
    return own.select("doc_id", F.when(F.col("x").isNull(), F.raise_error(F.concat(F.lit(f"no page {page} in document "), F.col("doc_id").cast("string")))).otherwise(F.col("x.text")).alias("text"))


def expand_hits(hits: DataFrame, spaces: DataFrame, chunks: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, rank, chunk_id, score, section, page_start, page_end, label_start, label_end, ords, snippet) of hits(doc_id, rank, row, score).

    row counts the chunk ids of spaces(doc_id, chunk_ids); a row beyond them, or an
    id that chunks doesn't have any more, is skipped. texts(doc_id, chunk, text) and
    labels(doc_id, page, label) add what is read.
    """
    # Sorted and merged: each table grows with the corpus, and a small file says little of the rows made from it, so none may be sent whole to every task.
    named = hits.join(spaces.select("doc_id", "chunk_ids").hint("merge"), "doc_id").withColumn("chunk_id", F.get("chunk_ids", F.col("row"))).where("chunk_id is not null")
    known = chunks.select("doc_id", F.col("id").alias("chunk_id"), "chunk", "section", "page_start", "page_end", "ords").hint("merge")
    x = named.join(known, ["doc_id", "chunk_id"]).join(texts.select("doc_id", "chunk", F.col("text").alias("snippet")).hint("merge"), ["doc_id", "chunk"], "left")
    for side in ("start", "end"):
        x = x.join(labels.select("doc_id", F.col("page").alias(f"page_{side}"), F.col("label").alias(f"label_{side}")).hint("merge"), ["doc_id", f"page_{side}"], "left")
    return x.select("doc_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "section", "page_start", "page_end", "label_start", "label_end", "ords", "snippet")


def emit_json(c: Column) -> Column:
    """JSON text with sorted keys and an indent of two."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import json

        return s.map(lambda x: None if x is None else json.dumps(json.loads(x), indent=2, sort_keys=True, ensure_ascii=False) + "\n")

    return run(c)


def merge_adjacent_figures(elements: DataFrame) -> DataFrame:
    """elements(doc_id, page, ord, html) with each pair of neighbouring figures, one graphic and one caption, as one; a merged figure pairs no further."""
    from quire.operators.markup import pair_figures

    w = Window.partitionBy(*PAGE).orderBy("ord")
    figure = lambda c: F.coalesce(F.startswith(c, F.lit("<figure")), F.lit(False))
    x = elements.withColumn("_next", F.lead("html").over(w)).withColumn("_pair", F.when(figure(F.col("html")) & figure(F.col("_next")), pair_figures(F.col("html"), F.col("_next"))))
    # of pairs that overlap in a row, every other one from the first is taken
    x = x.withColumn("_run", F.sum(F.when(F.col("_pair").isNull(), 1).otherwise(0)).over(w))
    place = F.row_number().over(Window.partitionBy(*PAGE, "_run", F.col("_pair").isNull()).orderBy("ord"))
    x = x.withColumn("_taken", F.col("_pair").isNotNull() & (place % 2 == 1))
    x = x.withColumn("_gone", F.coalesce(F.lag("_taken").over(w), F.lit(False)))
    return x.where(~F.col("_gone")).withColumn("html", F.when(F.col("_taken"), F.col("_pair")).otherwise(F.col("html"))).drop("_next", "_pair", "_run", "_taken", "_gone")


def doctags_html(blocks: DataFrame) -> DataFrame:
    """(doc_id, html): a recognised page's blocks(doc_id, ord, tag, level, text); list items in a row are one list, empty texts are left out."""
    t = T.esc(F.trim(F.coalesce("text", F.lit(""))))
    heading = F.least(F.greatest(F.col("level") + 1, F.lit(2)), F.lit(6)).cast("string")
    anchor = F.concat(F.lit(' id="sec-'), T.slug(F.coalesce("text", F.lit(""))), F.lit('">'))
    one = (
        F.when(F.col("tag") == "title", F.concat(F.lit("<h1"), anchor, t, F.lit("</h1>\n")))
        .when(F.col("tag") == "heading", F.concat(F.lit("<h"), heading, anchor, t, F.lit("</h"), heading, F.lit(">\n")))
        .when(F.col("tag") == "list_item", F.concat(F.lit("<li>"), t, F.lit("</li>\n")))
        .when(F.col("tag") == "code", F.concat(F.lit("<pre><code>"), T.esc(F.coalesce("text", F.lit(""))), F.lit("</code></pre>\n")))
        .when(F.col("tag").isin("formula", "caption", "footnote"), F.concat(F.lit('<p class="'), F.col("tag"), F.lit('">'), t, F.lit("</p>\n")))
        .otherwise(F.concat(F.lit("<p>"), t, F.lit("</p>\n")))
    )
    w = Window.partitionBy("doc_id").orderBy("ord")
    item = F.col("tag") == "list_item"
    x = blocks.withColumn("_h", F.when((t == "") & (F.col("tag") != "code"), "").otherwise(one))
    first, last = item & ~F.coalesce(F.lag(item).over(w), F.lit(False)), item & ~F.coalesce(F.lead(item).over(w), F.lit(False))
    x = x.withColumn("_h", F.concat(F.when(first, "<ul>\n").otherwise(""), "_h", F.when(last, "</ul>\n").otherwise("")))
    return x.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_h"))), lambda b: b["_h"]), "").alias("html"))


_FIGURE = re.compile(r"<figure\b.*?</figure>|<img\b[^>]*>|<svg\b.*?</svg>", re.S | re.I)
_GRAPHIC = re.compile(r"<img\b[^>]*>|<svg\b.*?</svg>", re.S | re.I)
_CAPTION = re.compile(r"<figcaption\b[^>]*>(.*?)</figcaption>", re.S | re.I)
_DATA = re.compile(r"""src\s*=\s*["'](data:image/([a-z+.-]+)[^,"']*,[^"']*)["']""", re.I)


def externalize(source: str) -> tuple[str, list[tuple[str, bytes]]]:
    """A page with its inline images as img/fig_NN_slug.ext, and the files (path, bytes). Images that aren't inline keep their place in the count."""
    import base64
    from urllib.parse import unquote_to_bytes

    files: list[tuple[str, bytes]] = []
    n = 0

    def slug(caption: str) -> str:
        words = re.sub(r"<[^>]*>", "", caption).lower()
        return re.sub(r"[^a-z0-9]+", "-", words).strip("-")[:20].strip("-")

    def name(caption: str, ext: str) -> str:
        s = slug(caption)
        return f"img/fig_{n:02d}{'_' + s if s else ''}.{ext}"

    def graphic(m: re.Match, caption: str) -> str:
        tag = m[0]
        if tag[:4].lower() == "<svg":
            path = name(caption, "svg")
            files.append((path, tag.encode()))
            return f'<img src="{path}">'
        d = _DATA.search(tag)
        if d is None:
            return tag
        head, _, body = d[1].partition(",")
        try:
            data = base64.b64decode(body, validate=True) if head.lower().endswith(";base64") else unquote_to_bytes(body)
        except ValueError:
            return tag
        path = name(caption, {"jpeg": "jpg", "svg+xml": "svg"}.get(d[2].lower(), d[2].lower()))
        files.append((path, data))
        return tag.replace(d[1], path)

    def figure(m: re.Match) -> str:
        nonlocal n
        n += 1
        if m[0][:7].lower() != "<figure":
            return graphic(m, "")
        caption = _CAPTION.search(m[0])
        before, inner, after = (m[0][: caption.start()], caption[0], m[0][caption.end() :]) if caption else (m[0], "", "")
        said = caption[1] if caption else ""
        swap = lambda part: _GRAPHIC.sub(lambda g: graphic(g, said), part, count=1)
        return (swap(before) + inner + after) if _GRAPHIC.search(before) else before + inner + swap(after)

    return _FIGURE.sub(figure, source), files


def externalize_images(docs: DataFrame, html: str = "html") -> DataFrame:
    """(doc_id, path, content): the page itself (path null) and each of its images as a file."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key, source in zip(pdf["doc_id"], pdf["html"], strict=True):
                page, files = externalize(source or "")
                rows += [(key, None, page.encode()), *((key, p, b) for p, b in files)]
            yield pd.DataFrame(rows, columns=["doc_id", "path", "content"])

    x = docs.select("doc_id", F.col(html).alias("html"))
    return x.mapInPandas(run, f"doc_id {dict(x.dtypes)['doc_id']}, path string, content binary")


def to_html(pages: DataFrame, blocks: DataFrame, mode: str = "page", with_toc: bool = True) -> DataFrame:
    """(doc_id, html): whole documents, a section for each page or for each heading, with a nav of the headings.

    blocks(doc_id, page, ord, kind, heading_level, text, ...) as render.elements takes them.
    """
    from quire.operators import build, markup, render

    if mode not in ("page", "section"):
        raise ValueError("mode is page or section")
    body = render.document_html(pages, blocks)
    if mode == "section":
        # a heading opens a section, which the next one of its level or a higher one closes
        flat = body.withColumn("html", F.regexp_replace("html", r'<section data-page="[0-9]+">\n|</section>\n', ""))
        body = build.nest_sections(flat)
    if with_toc:
        heads = blocks.where("kind = 'heading'").select("doc_id", "ord", F.col("heading_level").alias("level"), T.strip_inline(F.col("text")).alias("title"))
        nav = markup.build_nav(heads.withColumn("id", F.concat(F.lit("sec-"), T.slug(F.col("title")))))
        body = body.join(nav, "doc_id", "left").select("doc_id", F.concat(F.lit("<html><body>\n"), F.coalesce("nav", F.lit("")), F.substring(F.col("html"), F.lit(14), F.length("html"))).alias("html"))
    return body


def source_digest(content: Column) -> Column:
    """The address of a document's bytes: sha256 in hexadecimal, and the CRC-32."""
    return F.struct(F.sha2(content, 256).alias("sha256"), F.crc32(content).alias("crc32"), F.octet_length(content).alias("bytes"))


def generated_at() -> Column:
    """One UTC time for a whole run, as ISO 8601 with seconds."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
