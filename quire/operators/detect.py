"""Verdicts over grids, heading lines, gutters, ruled frames and painted paths, and the small codes of stored text.

Grids and lines are judged by expressions of one row. What belongs to a page is a
window, a join on the page, or a fold over the page's ordered rows.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from quire.functions import classify as K
from quire.functions.text import trim_ws, words
from quire.operators import layout
from quire.operators.model import folded
from quire.operators.regions import PAGE, grid_lines

# ---- grids

# Signs of formulas, of relations and of diagrams.
OPERATORS = "=+−–×÷·≤≥≠≈∝∫∑∏√∈∉∂∇→←↔⇒⇐↦∼≜≡∥⟨⟩"
GREEK = "αβγδεζηθικλμνξπρςστυϕφχψωΓΔΘΛΞΠΣΦΨΩ"
RELATIONS = "=≤≥≠≈≜≡∝"
ARROWS = "→←↔⇒⇐↦⟨⟩∘↪↩⟶⟵↠↣"


def outside_brackets(c: Column) -> Column:
    """The text outside (...), however deep; an open bracket takes all that follows, a stray closing one is dropped."""
    pieces = F.regexp_extract_all(c, F.lit(r"([()]|[^()]+)"), F.lit(1))
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        depth = F.when(p == "(", acc["depth"] + 1).when(p == ")", F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        plain = (acc["depth"] == 0) & ~p.isin("(", ")")
        return F.struct(depth.alias("depth"), F.concat(acc["out"], F.when(plain, p).otherwise("")).alias("out"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def grid_verdict(grid: Column) -> Column:
    """Why a grid of texts (array of rows) is no table, or null if it may be one.

    prose-2col, gutter-title-3col, prose-wide: cells are running text; equation,
    matrix, diagram: they are signs. Null cells and those a short row lacks are empty.
    """
    some = lambda b, pattern: F.size(F.filter(b["cells"], lambda c: c.rlike(pattern)))
    # what is used again is an array's element, or it would be found anew at every place
    let = lambda of, f: F.transform(of, f)
    bound = let(F.array(grid), lambda g: F.struct(g.alias("grid"), F.transform(F.flatten(g), lambda c: F.coalesce(c, F.lit(""))).alias("cells"), F.coalesce(F.size(F.try_element_at(g, F.lit(1))), F.lit(0)).alias("columns")))
    bound = let(bound, lambda b: F.struct(b["grid"].alias("grid"), b["cells"].alias("cells"), b["columns"].alias("columns"), F.filter(F.transform(b["cells"], lambda c: F.size(words(c))), lambda n: n > 0).alias("filled")))

    def void(b: Column) -> Column:
        places = F.when(b["columns"] > 0, F.sequence(F.lit(0), b["columns"] - 1)).otherwise(F.array().cast("array<int>"))
        blank = lambda k: F.size(F.filter(b["grid"], lambda r: trim_ws(F.coalesce(F.get(r, k), F.lit(""))) == ""))
        return F.exists(places, lambda k: blank(k) * 5 >= F.size(b["grid"]) * 4)

    facts = lambda b: F.struct(
        F.size(b["filled"]).alias("n"),
        F.aggregate(b["filled"], F.lit(0), lambda a, n: a + n).alias("words"),
        F.size(F.filter(b["filled"], lambda n: n > 8)).alias("long"),
        b["columns"].alias("columns"),
        void(b).alias("void"),
        some(b, f"[{OPERATORS}{GREEK}]").alias("signs"),
        ((some(b, f"[{RELATIONS}]") > 0) | (some(b, r"^\s*\([0-9.]+\)\s*$") > 0)).alias("relation"),
        F.aggregate(F.transform(b["cells"], lambda c: F.regexp_count(c, F.lit(r"\p{L}{3,}"))), F.lit(0), lambda a, n: a + n).alias("named"),
        F.size(F.filter(b["cells"], lambda c: outside_brackets(c).rlike(r"[0-9]\.[0-9]|[0-9]{3}"))).alias("values"),
        some(b, r"^\s*\p{L}").alias("lettered"),
        (some(b, f"[{ARROWS}]") > 0).alias("arrows"),
        (some(b, r"[0-9]\.[0-9]") > 0).alias("decimals"),
    )

    def verdict(x: Column) -> Column:
        mean = lambda m: x["words"] > x["n"] * m
        equation = (x["signs"] * 2 >= x["n"]) | ((x["signs"] >= 1) & x["relation"] & (x["values"] * 3 < x["n"]))
        return (
            F.when((x["columns"] <= 2) & mean(4), "prose-2col")
            .when((x["columns"] == 3) & mean(4.5) & x["void"], "gutter-title-3col")
            .when((x["n"] >= 6) & (x["long"] * 3 >= x["n"] * 2) & mean(6), "prose-wide")
            .when((x["n"] > 0) & (x["named"] <= x["n"]) & equation, "equation")
            .when((x["n"] >= 4) & (x["values"] == 0) & (x["named"] == 0) & (x["lettered"] * 2 >= x["n"]), "matrix")
            .when((x["n"] >= 6) & x["arrows"] & (x["named"] * 3 <= x["n"]) & ~x["decimals"], "diagram")
        )

    return let(let(bound, facts), verdict)[0]


def group_spans(top: Column, leaves: Column, styled: Column, header_rows: Column, n_rows: Column) -> Column:
    """Array of (start, span) of the labels of a header's first row, or null where they don't cover the second one.

    Every label is styled (styled: by column), begins with the first column, and
    has at least one empty column after it; every leaf has a text.
    """
    width = F.size(top)
    full = lambda c: F.coalesce(trim_ws(c), F.lit("")) != ""
    starts = F.filter(F.transform(top, lambda c, k: F.when(full(c), k)), lambda k: k.isNotNull())

    def spans(s: Column) -> Column:
        return F.transform(s, lambda a, k: F.struct(a.alias("start"), (F.coalesce(F.get(s, k + 1), width) - a).alias("span")))

    shape = (header_rows >= 2) & (n_rows > header_rows) & (width >= 4) & (F.size(leaves) == width) & (F.size(styled) == width) & F.forall(leaves, full)
    labels = F.transform(F.array(starts), lambda s: F.when((F.size(s) >= 2) & (F.get(s, F.lit(0)) == 0) & F.forall(s, lambda k: F.coalesce(F.get(styled, k), F.lit(False))) & F.forall(spans(s), lambda x: x["span"] >= 2), spans(s)))[0]
    return F.when(shape, labels)


# ---- headings

# Fixed words: labels of statements and floats, canonical headings, endings of a byline, verbs after an appendix's name.
STATEMENTS = "theorem lemma definition denition corollary proposition remark example proof claim question questions notation conjecture observation fact case step assumption assumptions algorithm problem require input output hypothesis property figure fig table tab listing equation eq".split()
CANONICAL = "abstract references acknowledgements acknowledgments introduction conclusion conclusions appendix".split()
BYLINE = "collaboration collaborations consortium".split()
LINKING = "is are was were".split()
# Fixed signs of formulas in lines.
EQUATES = "=≤≥≡≈←→∝≪≫∑∈"
FORMULA = "=≤≥≡≈≠<>+←→↔⇒↦∝≪≫∑∏∫∂∇√∈∉±×÷·∞⎢⎝⎠⎥⎜⎟|∆−" + GREEK


def no_heading(t: Column) -> Column:
    """Is a trimmed line ruled out as a heading whatever its style: names, years, leaders, list items, formulas, statements?"""
    tokens, low = words(t), F.lower(t)
    n = F.size(tokens)
    byline = n.between(2, 6) & F.regexp_replace(F.element_at(F.split(low, r"\s+"), -1), "[.,:]+$", "").isin(BYLINE)
    real = F.size(F.filter(tokens, lambda w: F.regexp_count(w, F.lit("[A-Za-z]")) >= 2))
    equates, signs = t.rlike(f"[{EQUATES}]"), F.regexp_count(t, F.lit(f"[{FORMULA}]"))
    single = F.size(F.filter(tokens, lambda w: F.length(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")) <= 1))
    digits, ink = F.regexp_count(t, F.lit("[0-9]")), F.length(F.regexp_replace(t, r"\s", ""))
    word, rest = F.lower(F.regexp_extract(t, r"^(\p{L}*)", 1)), F.regexp_replace(t, r"^\p{L}*\s*", "")
    return (
        (F.regexp_count(t, F.lit(r"\p{L}")) < 2)
        | F.contains(low, F.lit("et al"))
        | low.startswith("arxiv")
        | K.has_year(t)
        | (K.initials_count(t) >= 2)
        | byline
        | K.dotleader_tail(t)
        | ~F.coalesce(K.list_ordered(t), F.lit(True))
        | ((real == 0) & (equates | (signs >= 1) | (single * 2 >= n) | (digits * 10 > ink * 4)))
        | ((real == 1) & equates)
        | ((signs >= 3) & (signs >= real + 2))
        | (word.isin(STATEMENTS) & ((rest == "") | rest.rlike("^[0-9]") | t.rlike("[.:]$")))
    )


def detect_headings(lines: DataFrame) -> DataFrame:
    """lines(runs: array of (text, bold), size, body, tier) with level, n_runs and kind; null where a line is no heading.

    kind: reliable (numbered, canonical, appendix, filing parts), style (bold, large
    or of a heading tier) or run-in (a bold lead before other text). n_runs is how
    many runs the heading takes. tier: the level of the line's style, or null.
    """
    run_at = lambda cond: F.array_min(F.transform("runs", lambda r, k: F.when(cond(r, k), k)))
    inked = lambda r: trim_ws(r["text"]) != ""
    said = lambda n: F.array_join(F.transform(F.slice("runs", F.lit(1), n), lambda r: r["text"]), "")
    x = lines.withColumn("_raw", said(F.size("runs"))).withColumn("_t", trim_ws(F.col("_raw")))
    t, tokens = F.col("_t"), words(F.col("_t"))
    x = x.withColumns({
        "_n": F.size(tokens),
        "_no": no_heading(t),
        "_ratio": F.col("size") / F.greatest(F.col("body"), F.lit(1.0)),
        "_real": F.size(F.filter(tokens, lambda w: F.regexp_count(w, F.lit("[A-Za-z]")) >= 2)),
        "_ref": K.looks_like_reference(t),
        "_thin": run_at(lambda r, _: inked(r) & ~r["bold"]),  # the first run that isn't bold
        "_bold": run_at(lambda r, _: inked(r) & r["bold"]),
        "_title": F.regexp_extract(t, r"^\S+\s(.*)$", 1),
        "_rest": F.regexp_replace(t, r"(?i)^appendix\s+", ""),
    })
    x = x.withColumn("_end", F.coalesce(run_at(lambda r, k: (k >= F.col("_bold")) & inked(r) & ~r["bold"]), F.size("runs")))
    x = x.withColumns({"_lead": F.rtrim(said(F.col("_end"))), "_first": trim_ws(said(F.coalesce("_thin", F.lit(0)))), "_after": F.regexp_replace("_rest", r"^\S*\s*", ""), "_id": F.regexp_extract("_rest", r"^(\S+)", 1)})
    n, title, ratio, after = F.col("_n"), F.col("_title"), F.col("_ratio"), F.col("_after")
    all_runs, lead, first = F.size("runs"), F.col("_lead"), F.col("_first")
    depth = F.coalesce(K.numbered_level(t), K.roman_section(t))
    unit = F.lower(F.regexp_extract(t, r"^\S+\s+[^\p{L}\s]*(\p{L}*)[^\p{L}\s]*(?:\s|$)", 1)).isin(K.UNITS.split("|"))
    numbered = (n <= 12) & ~F.col("_ref") & depth.isNotNull() & title.rlike(r"^[^\p{L}]*\p{Lu}") & (F.regexp_count(title, F.lit(r"\p{L}")) >= 3) & (ratio >= 0.92) & ~unit
    cut = F.col("_bold").isNotNull() & (F.col("_end") < all_runs) & lead.rlike("[.:]$")
    value = t.startswith("0") & F.get(F.split(title, r"\. "), F.lit(1)).rlike(r"^[^\p{L}]*\p{Lu}")
    canonical = (n <= 2) & F.regexp_replace(F.lower(t), "[.:— -]+$", "").isin(CANONICAL)
    appendix = F.lower(t).startswith("appendix ") & (n <= 16) & F.col("_id").rlike(r"^[\p{L}\p{N}.:-]+$") & ((after == "") | after.rlike(r"^[:.—\p{Lu}]"))
    sentence = (F.size(words(after)) > 6) & (F.contains(after, F.lit(",")) | F.exists(words(after), lambda w: w.isin(LINKING)))
    name_end = F.length(F.regexp_extract("_raw", r"(?i)^(\s*appendix\s+\S+)", 1))
    named_runs = F.coalesce(run_at(lambda r, k: F.length(said(k + 1)) >= name_end) + 1, all_runs)
    plain = ~F.col("_ref") & ~((F.col("_real") >= 2) & K.looks_like_clause(t)) & ~t.rlike(r"^\p{Ll}")
    tier = (n <= 16) & ~t.rlike("[.,;]$") & plain & F.col("tier").isNotNull()
    alone = (n <= 12) & (F.col("_thin").isNull() | (ratio >= 1.18)) & ~t.rlike("[.,;:]$") & plain
    lead_words = F.size(words(first))
    run_in = (F.col("_bold") < F.col("_thin")) & ~first.rlike(r"^\p{Ll}") & ~first.endswith(",") & (lead_words.between(2, 8) | (first.rlike("[:.]$") & (F.regexp_count(first, F.lit(r"\p{L}")) >= 2)))
    made = lambda level, runs, kind: F.struct(level.cast("int").alias("level"), runs.cast("int").alias("n_runs"), F.lit(kind).alias("kind"))
    verdict = (
        F.when((t == "") | F.col("_no"), F.lit(None))
        .when((n <= 16) & K.sec_anchor(t).isNotNull(), made(K.sec_anchor(t), all_runs, "reliable"))
        .when(numbered & cut, made(depth, F.col("_end"), "reliable"))
        .when(numbered & F.coalesce(value, F.lit(False)), F.lit(None))
        .when(numbered, made(depth, all_runs, "reliable"))
        .when(canonical, made(F.lit(1), all_runs, "reliable"))
        .when(appendix, made(F.lit(1), F.when(sentence, named_runs).otherwise(all_runs), "reliable"))
        .when(tier, made(F.col("tier"), all_runs, "style"))
        .when(alone, made(K.size_level(ratio), all_runs, "style"))
        .when(F.coalesce(run_in, F.lit(False)), made(F.lit(3), F.col("_thin"), "run-in"))
    )
    return x.withColumn("_v", verdict).select(*lines.columns, F.col("_v.level").alias("level"), F.col("_v.n_runs").alias("n_runs"), F.col("_v.kind").alias("kind"))


# ---- gutters


def shared_baselines(rows: list[tuple[np.ndarray, np.ndarray]], size: float, epsilon: float = 0.05, least: int = 4, share: float = 0.45) -> bool:
    """Do the two sides of a gutter lie on one baseline in most rows (y of the left and right spans), or in too few to tell?"""
    nearest = [np.abs(left[:, None] - right).min() for left, right in rows if len(left) and len(right)]
    return len(nearest) < least or sum(d <= size * epsilon for d in nearest) >= len(nearest) * share


def clearest(row: np.ndarray, x0: np.ndarray, x1: np.ndarray, lo: float, hi: float) -> tuple[float, int]:
    """(place, rows that leave it clear): the first place in the middle two fifths of lo to hi that fewest rows cross."""
    step = max((hi - lo) / 200, 1.0)
    places = lo + (hi - lo) * 0.3 + step * np.arange(int((hi - lo) * 0.4 / step) + 1)
    crossed = np.zeros((row.max() + 1, len(places)), bool)
    for r, a, b in zip(row, x0, x1, strict=True):
        crossed[r] |= (a <= places) & (places <= b)
    clear = row.max() - crossed.sum(axis=0)
    best = int(clear.argmax())
    return float(places[best]), int(clear[best])


def central_split(spans: DataFrame) -> DataFrame:
    """(doc_id, page, gutter, may_span) of pages in two columns; may_span: some row crosses the gutter.

    The gutter holds if 88 % of six rows or more leave it clear and either side has
    three lines of prose, or if all do and the sides don't share baselines.
    """

    def start():
        held: list[tuple] = []

        def step(n, row, *values):
            if n is not None:
                held.append((n, row or 0, *values))
                return []
            ids, rows = [h[0] for h in held], np.array([h[1] for h in held])
            x, y, size, width = np.array([h[2:] for h in held]).T
            reach, n_rows = x + np.maximum(width, size * 0.3), int(rows.max())
            lo, hi = float(x.min()), float(reach.max())
            if n_rows < 6 or not hi - lo > 1:
                return []
            use = rows > 0
            gutter, clear = clearest(rows[use], x[use], reach[use], lo, hi)
            left = x + np.maximum(width, 0) * 0.5 < gutter
            if clear < n_rows * 0.88:
                return []
            # the page comes by rows
            ends = np.searchsorted(rows, np.arange(1, n_rows + 2)).tolist()
            sides = ((y[a:b][left[a:b]], y[a:b][~left[a:b]]) for a, b in pairwise(ends))
            apart = clear >= n_rows and not shared_baselines(list(sides), float(size.mean()))
            return [(i, r * 2 + int(s), gutter, (gutter - lo if s else hi - gutter) * 0.5, clear < n_rows, apart) for i, r, s in zip(ids, rows.tolist(), left.tolist(), strict=True) if r]

        return step

    number = lambda c: F.col(c).cast("double").alias(c)
    rows = layout.visual_rows(spans)
    page = rows.select(*PAGE, F.col("n").cast("long").alias("n"), "row", *(number(c) for c in ("x", "y", "size", "width")))
    sided = folded(page, PAGE, ["row", "x", "n"], ["n", "row", "x", "y", "size", "width"], start, "n long, row int, gutter double, room double, may_span boolean, apart boolean")
    facts = ["gutter", "room", "may_span", "apart"]
    cells = layout.row_cells(spans.drop("row").join(sided, [*PAGE, "n"]), facts)
    lines = cells.groupBy(*PAGE, "row").agg(F.count("*").alias("cells"), F.first("text").alias("text"), F.first(F.col("end") - F.col("x")).alias("wide"), *(F.first(c).alias(c) for c in facts))
    prose = (F.col("cells") == 1) & (F.size(words(F.col("text"))) >= 4) & (F.col("wide") > F.col("room"))
    of_side = lambda side: F.count_if(prose & (F.col("row") % 2 == side)) >= 3
    found = lines.groupBy(*PAGE).agg(F.first("gutter").alias("gutter"), F.first("may_span").alias("may_span"), (F.first("apart") | (of_side(0) & of_side(1))).alias("split"))
    return found.where("split").drop("split")


# ---- rules and ruled frames


def _edges(segs):
    """The straight edges (x0, y0, x1, y1) of a path's parts, closing ones included."""
    here = first = None
    for s in segs or ():
        if s["op"] == "Z":
            to = first
        else:
            to = (s["x"], s["y"])
        if s["op"] in "LZ" and here is not None and to is not None:
            yield *here, *to
        if s["op"] == "M" or first is None:
            first = to
        here = to


def rules_of(paths: DataFrame, thick: float = 3.0, least: float = 8.0, straight: float = 0.8) -> DataFrame:
    """(doc_id, page, axis, p, lo, hi) of paths(doc_id, page, x0..y1, filled, stroked, segs): thin fills, and straight edges of strokes.

    filled and stroked say that the path is painted so, and not nearly transparent.
    """
    box = ["x0", "y0", "x1", "y1"]
    kinds = dict(paths.dtypes)
    schema = pa.schema([*to_arrow_schema(paths.select(*PAGE).schema), ("axis", pa.string()), ("p", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64())])

    def run(batches):
        for batch in batches:
            out = []
            for doc, page, x0, y0, x1, y1, filled, stroked, segs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w, h = x1 - x0, y1 - y0
                if filled and h <= thick and w >= least:
                    out.append((doc, page, "h", (y0 + y1) / 2, x0, x1))
                elif filled and w <= thick and h >= least:
                    out.append((doc, page, "v", (x0 + x1) / 2, y0, y1))
                for ax, ay, bx, by in _edges(segs) if stroked else ():
                    dx, dy = abs(bx - ax), abs(by - ay)
                    if dy <= straight and dx >= least:
                        out.append((doc, page, "h", (ay + by) / 2, min(ax, bx), max(ax, bx)))
                    elif dx <= straight and dy >= least:
                        out.append((doc, page, "v", (ax + bx) / 2, min(ay, by), max(ay, by)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    use = paths.select(*PAGE, *(F.col(c).cast("double").alias(c) for c in box), "filled", "stroked", "segs")
    return use.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in PAGE) + ", axis string, p double, lo double, hi double")


#: How far a rule may fall short of an edge it bounds, and rules of one place lie apart.
COVER, SNAP = 2.5, 1.6


def _closed_cells(vs: list, hs: list) -> list[list[tuple[int, int]]]:
    """For each column band, the cells (lower line, upper line) with all four edges painted."""
    bounds = lambda line, lo, hi: any(a <= lo + COVER and b >= hi - COVER for a, b in line[1])
    out = []
    for left, right in zip(vs, vs[1:]):
        x0, x1 = left[0], right[0]
        rungs = [j for j, h in enumerate(hs) if bounds(h, x0, x1)] if x1 - x0 >= 1 else []
        tall = [(j, k) for j, k in zip(rungs, rungs[1:]) if hs[k][0] - hs[j][0] >= 1]
        out.append([(j, k) for j, k in tall if bounds(left, hs[j][0], hs[k][0]) and bounds(right, hs[j][0], hs[k][0])])
    return out


def _connected(bands: list[list[tuple[int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Cells (band, lower, upper) by group: one above the other in a band, or side by side in neighbouring ones."""
    up: dict = {}

    def root(c):
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    for i, band in enumerate(bands):
        for c in band:
            up[i, *c] = (i, *c)
        for c, d in zip(band, band[1:]):
            if c[1] == d[0]:
                up[root((i, *d))] = root((i, *c))
        if i:
            # cells of a band are in order and don't overlap
            ends = [c[1] for c in bands[i - 1]]
            for d in band:
                for c in bands[i - 1][bisect_right(ends, d[0]) :]:
                    if c[0] >= d[1]:
                        break
                    up[root((i, *d))] = root((i - 1, *c))
    groups: dict = {}
    for c in up:
        groups.setdefault(root(c), []).append(c)
    return list(groups.values())


def _axis(places: list[float]) -> list[float]:
    out: list[float] = []
    for p in sorted(places):
        if not out or p - out[-1] > SNAP:
            out.append(p)
    return out


def _one_table(f: tuple, g: tuple) -> bool:
    """Do two frames (xs, ys) touch, or stand above each other no farther than two rows apart?"""
    (fx, fy), (gx, gy) = f, g
    gap_x, gap_y = max(fx[0] - gx[-1], gx[0] - fx[-1]), max(fy[0] - gy[-1], gy[0] - fy[-1])
    if gap_x <= 3 and gap_y <= 3:
        return True
    narrow = max(min(fx[-1] - fx[0], gx[-1] - gx[0]), 1.0)
    row = max((y[-1] - y[0]) / max(len(y) - 1, 1) for y in (fy, gy))
    return max(min(fx[-1], gx[-1]) - max(fx[0], gx[0]), 0.0) >= narrow * 0.6 and gap_y <= row * 2


def frames_of(vs: list, hs: list) -> list[tuple[list[float], list[float]]]:
    """Frames (xs, ys) of vertical and horizontal lines (place, intervals), the parts of one table joined, top down."""
    out = []
    for cells in _connected(_closed_cells(vs, hs)):
        lines, columns = {j for c in cells for j in c[1:]}, {c[0] for c in cells}
        if len(cells) >= 4 and len(lines) >= 3 and len(columns) >= 2:
            xs, ys = [vs[i][0] for i in range(min(columns), max(columns) + 2)], [hs[j][0] for j in sorted(lines)]
            if xs[-1] - xs[0] >= 36 and ys[-1] - ys[0] >= 12:
                out.append((xs, ys))
    k = 0
    while k < len(out):
        other = next((j for j in range(k + 1, len(out)) if _one_table(out[k], out[j])), None)
        if other is None:
            k += 1
            continue
        xs, ys = out.pop(other)
        out[k] = (_axis(out[k][0] + xs), _axis(out[k][1] + ys))
        k = 0  # what is larger now may touch an earlier one
    return sorted(out, key=lambda f: (-f[1][-1], f[0][0]))


def _band_on(k: int, xs: list[float], vs: list, hs: list) -> list[int] | None:
    """The numbers of the xs that divide the band between horizontal lines k and k + 1 into groups of two columns or more.

    None if a line ends short, or a vertical enters the band without dividing it all the way.
    """
    if k + 1 >= len(hs):
        return None
    covers = lambda line, lo, hi: any(a <= lo + COVER and b >= hi - COVER for a, b in line[1])
    low, high = hs[k], hs[k + 1]
    if high[0] - low[0] <= COVER * 2 or not (covers(low, xs[0], xs[-1]) and covers(high, xs[0], xs[-1])):
        return None
    divides = set()
    for v in vs:
        if not xs[0] - SNAP <= v[0] <= xs[-1] + SNAP:
            continue
        column = next((k for k, x in enumerate(xs) if abs(x - v[0]) <= SNAP), None)
        if covers(v, low[0], high[0]):
            if column is None:
                return None
            divides.add(column)
        elif any(b > low[0] + COVER and a < high[0] - COVER for a, b in v[1]):
            return None
    found = sorted(divides)
    whole = len(found) >= 3 and found[0] == 0 and found[-1] == len(xs) - 1
    return found if whole and all(b - a >= 2 for a, b in zip(found, found[1:])) else None


def group_band(xs: list[float], ys: list[float], vs: list, hs: list) -> tuple[float, list[int]] | None:
    """(top, boundaries) of the one closed band of grouped columns on a frame; none if another stands on it."""
    at = next((k for k, h in enumerate(hs) if abs(h[0] - ys[-1]) <= SNAP), len(hs))
    band = _band_on(at, xs, vs, hs)
    if band is None or _band_on(at + 1, xs, vs, hs) is not None:
        return None
    return hs[at + 1][0], band


def longest(lines: list, most: int) -> list:
    """The lines of the largest painted extent, in their order: beyond `most`, a page is a map or a chart."""
    kept = sorted(range(len(lines)), key=lambda k: (-sum(b - a for a, b in lines[k][1]), k))[:most]
    return [lines[k] for k in sorted(kept)]


def frames(rules: DataFrame, most: int = 96) -> DataFrame:
    """(doc_id, page, frame, xs, ys, band_top, band): tables of two rows and columns or more that rules(doc_id, page, axis, p, lo, hi) close.

    axis is v or h. A frame's lines are those of its closed cells; a merged cell
    leaves a hole, not a break. band: the boundaries of the grouped band on top, if
    there is one. Of each axis the longest `most` lines of a page are used.
    """
    lines = grid_lines(rules.where("axis = 'v'")).withColumn("axis", F.lit("v")).unionByName(grid_lines(rules.where("axis = 'h'")).withColumn("axis", F.lit("h")))

    def start():
        seen: dict = {"v": {}, "h": {}}

        def step(axis, p, lo, hi):
            if axis is not None:
                seen[axis].setdefault(p, []).append((lo, hi))
                return []
            vs, hs = (longest(list(seen[a].items()), most) for a in "vh")
            made = frames_of(vs, hs)
            bands = [group_band(xs, ys, vs, hs) or (None, None) for xs, ys in made]
            return [(k, *f, *b) for k, (f, b) in enumerate(zip(made, bands, strict=True))]

        return step

    return folded(lines, PAGE, ["axis", "p", "lo"], ["axis", "p", "lo", "hi"], start, "frame int, xs array<double>, ys array<double>, band_top double, band array<int>")


# ---- figures


def graphic_ink(segs: Column) -> Column:
    """Does a path (array of (op, x, y), op M, L, C or Z) have a curve or a slanted line?"""
    none = F.lit(None).cast("double")
    zero = F.struct(none.alias("x"), none.alias("y"), none.alias("sx"), none.alias("sy"), F.lit(False).alias("hit"))

    def step(a: Column, s: Column) -> Column:
        close, move = s["op"] == "Z", s["op"] == "M"
        x, y = F.when(close, a["sx"]).otherwise(s["x"].cast("double")), F.when(close, a["sy"]).otherwise(s["y"].cast("double"))
        slant = F.coalesce((F.abs(x - a["x"]) > 0.34) & (F.abs(y - a["y"]) > 0.34), F.lit(False))
        return F.struct(x.alias("x"), y.alias("y"), F.when(move, x).otherwise(a["sx"]).alias("sx"), F.when(move, y).otherwise(a["sy"]).alias("sy"), (a["hit"] | (s["op"] == "C") | (~move & slant)).alias("hit"))

    return F.aggregate(segs, zero, step, lambda a: a["hit"])


def figure_clusters(paths: DataFrame) -> DataFrame:
    """(doc_id, page, cluster, x0, y0, x1, y1, n_paths, grade) of paths(doc_id, page, seq, x0..y1, segs, colors, rotate).

    A gap of more than 24 splits paths into clusters, from the top; fills of a whole
    page are left out, and so are clusters too small for any grade. strong: a
    figure; demoted: as large, but without curves, slanted lines or three saturated
    colors (array of arrays r, g, b), unless the page is turned by a quarter; weak:
    smaller.
    """
    wide, tall = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kept = paths.where(~((wide > 400) & (tall > 600) & (F.size("segs") <= 5)))
    w = Window.partitionBy(*PAGE).orderBy(F.col("y1").desc(), "seq")
    floor = F.min("y0").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = kept.withColumn("_new", F.when(F.col("y1") >= floor - 24, 0).otherwise(1)).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    high, low = (lambda c: F.array_max(c)), (lambda c: F.array_min(c))
    bright = F.filter(F.coalesce("colors", F.array().cast("array<array<int>>")), lambda c: (high(c) > 0) & ((high(c) - low(c)) / high(c) > 0.25))
    made = rows.groupBy(*PAGE, "cluster").agg(
        *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))),
        F.count("*").alias("n_paths"),
        F.max(graphic_ink(F.col("segs"))).alias("ink"),
        F.size(F.array_distinct(F.flatten(F.collect_set(bright)))).alias("palette"),
        F.max(F.col("rotate") % 180 != 0).alias("turned"),
    )
    large = (F.col("n_paths") >= 6) & (wide >= 72) & (tall >= 54)
    grade = F.when(large & (F.col("turned") | F.col("ink") | (F.col("palette") >= 3)), "strong").when(large, "demoted").when((F.col("n_paths") >= 2) & (wide >= 36) & (tall >= 24), "weak")
    return made.withColumn("grade", grade).where("grade is not null").drop("ink", "palette", "turned")


# ---- codes of stored text

# The signs of bytes 0x80 to 0xA0 where a stored text has no byte order mark.
HIGH = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�€"


def _utf16(code: Column) -> Column:
    """Text of upper-case hexadecimal UTF-16BE: halves of pairs that stand alone become U+FFFD, an odd byte is dropped."""
    units = F.regexp_extract_all(code, F.lit("([0-9A-F]{4})"), F.lit(1))
    lead, trail = (lambda u: F.coalesce(u.rlike("^D[89AB]"), F.lit(False))), (lambda u: F.coalesce(u.rlike("^D[C-F]"), F.lit(False)))

    def whole(us: Column) -> Column:
        return F.transform(us, lambda u, k: F.when((lead(u) & ~trail(F.get(us, k + 1))) | (trail(u) & ~(lead(F.get(us, k - 1)) & (k > 0))), F.lit("FFFD")).otherwise(u))

    return F.decode(F.unhex(F.array_join(F.transform(F.array(units), whole)[0], "")), "UTF-16BE")


def decode_text(b: Column) -> Column:
    """Text of stored bytes: UTF-16BE after a byte order mark, otherwise one sign a byte."""
    code = F.hex(b)
    single = F.translate(F.decode(b, "ISO-8859-1"), "".join(chr(0x80 + k) for k in range(len(HIGH))), HIGH)
    return F.when(code.startswith("FEFF"), _utf16(F.substr(code, F.lit(5)))).otherwise(single)


def retile(doctags: Column, tile: Column, tiles: Column) -> Column:
    """DocTags of one of `tiles` bands of a page with the y of every box (each second <loc_n>, n of 500) on the whole page."""
    mark = r"<loc_([0-9]+)>"
    values = F.regexp_extract_all(doctags, F.lit(mark), F.lit(1))

    def joined(x: Column) -> Column:
        value = lambda v, k: F.when(k % 2 == 1, F.coalesce(F.bround((tile * 500 + v.try_cast("bigint")) / tiles).cast("bigint").cast("string"), v)).otherwise(v.try_cast("bigint").cast("string"))
        marks = F.transform(x["v"], lambda v, k: F.concat(F.lit("<loc_"), F.coalesce(value(v, k), v), F.lit(">")))
        return F.array_join(F.transform(x["p"], lambda p, k: F.concat(p, F.coalesce(F.get(marks, k), F.lit("")))), "")

    both = F.struct(F.split(doctags, mark).alias("p"), values.alias("v"))
    return F.when(tiles <= 1, doctags).otherwise(F.transform(F.array(both), joined)[0])


def cmap_entries(cmaps: DataFrame, key: str, cmap: str = "cmap") -> DataFrame:
    """(key, code, text): what the bfchar and bfrange sections of a CMap's text say; of repeated codes the last.

    A range has at most 65,536 codes; those beyond Unicode are left out.
    """
    code = lambda h: F.conv(h, 16, 10).cast("long")
    text = lambda h: _utf16(F.upper(F.regexp_replace(h, r"\s", "")))
    sections = cmaps.select(key, F.posexplode(F.regexp_extract_all(cmap, F.lit(r"(?s)(beginbf(?:char|range).*?endbf(?:char|range))"), F.lit(1))).alias("s", "body"))
    chars = sections.where("body like 'beginbfchar%'").select(key, "s", F.posexplode(F.regexp_extract_all("body", F.lit(r"(<[0-9A-Fa-f\s]+>\s*<[0-9A-Fa-f\s]*>)"), F.lit(1))).alias("k", "e"))
    pair = lambda n: F.regexp_replace(F.regexp_extract("e", r"<([^>]*)>\s*<([^>]*)>", n), r"\s", "")
    one = chars.select(key, "s", "k", F.lit(0).alias("o"), code(pair(1)).alias("code"), text(pair(2)).alias("text"))
    ranges = sections.where("body like 'beginbfrange%'").select(key, "s", F.posexplode(F.regexp_extract_all("body", F.lit(r"(<[0-9A-Fa-f\s]+>\s*<[0-9A-Fa-f\s]+>\s*(?:<[0-9A-Fa-f\s]*>|\[[^\]]*\]))"), F.lit(1))).alias("k", "e"))
    ranges = ranges.withColumns({"lo": code(pair(1)), "hi": code(pair(2)), "to": F.regexp_extract("e", r"(?s)^<[^>]*>\s*<[^>]*>\s*(.*)$", 1)})
    listed = ranges.where("to like '[%'").select(key, "s", "k", "lo", F.posexplode(F.regexp_extract_all("to", F.lit("<([^>]*)>"), F.lit(1))).alias("o", "h"))
    listed = listed.select(key, "s", "k", "o", (F.col("lo") + F.col("o")).alias("code"), text(F.col("h")).alias("text"))
    first = F.ascii(text(F.regexp_extract("to", "<([^>]*)>", 1)))
    runs = ranges.where("to like '<%' and hi >= lo").withColumn("base", first).where(F.regexp_extract("to", "<([^>]*)>", 1) != "")
    runs = runs.select(key, "s", "k", "lo", "base", F.explode(F.sequence(F.lit(0), F.least(F.col("hi") - F.col("lo"), F.lit(65535)).cast("int"))).alias("o")).withColumn("p", F.col("base") + F.col("o"))
    runs = runs.where("p <= 1114111 and not p between 55296 and 57343")
    runs = runs.select(key, "s", "k", "o", (F.col("lo") + F.col("o")).alias("code"), F.decode(F.unhex(F.lpad(F.hex("p"), 8, "0")), "UTF-32").alias("text"))
    every = one.unionByName(listed).unionByName(runs)
    return every.groupBy(key, "code").agg(F.max_by("text", F.struct("s", "k", "o")).alias("text"))


def cid_widths(fonts: DataFrame, key: str, w: str = "w") -> DataFrame:
    """(key, cid, width) of a width array as text: `c [w ...]` and `first last w`; of repeated cids the last."""
    items = fonts.select(key, F.posexplode(F.regexp_extract_all(w, F.lit(r"([0-9]+\s*\[[^\]]*\]|[0-9]+\s+[0-9]+\s+[0-9.]+)"), F.lit(1))).alias("k", "e"))
    numbers = F.transform(F.regexp_extract_all("e", F.lit("([0-9.]+)"), F.lit(1)), lambda x: x.try_cast("double"))
    items = items.select(key, "k", F.contains("e", F.lit("[")).alias("listed"), numbers.alias("n"))
    listed = items.where("listed").select(key, "k", F.col("n")[0].alias("c"), F.posexplode(F.expr("slice(n, 2, size(n))")).alias("o", "width")).select(key, "k", (F.col("c") + F.col("o")).cast("int").alias("cid"), "width")
    ranges = items.where("not listed and n[1] >= n[0]").select(key, "k", F.explode(F.sequence(F.col("n")[0].cast("int"), F.least(F.col("n")[1], F.lit(65535)).cast("int"))).alias("cid"), F.col("n")[2].alias("width"))
    return listed.unionByName(ranges).groupBy(key, "cid").agg(F.max_by("width", "k").alias("width"))
