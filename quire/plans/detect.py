"""Queries over grids, heading lines, gutters, frames, figures and stored codes, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import classify as K
from quire.operators import detect

from . import scalars as S
from .scalars import count, e, m, q, r, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- grids

# Read by both engines, but for the name of what makes an array.
GRID = """CASE p_partkey % 9
    WHEN 0 THEN array(array(concat(p_name, ' ', p_type, ' as it was'), concat(p_type, ' with ', p_name)), array(concat('and ', p_name, ' and ', p_type), p_name))
    WHEN 1 THEN array(array(concat(p_name, ' ', p_type, ' which goes on'), '', concat(p_type, ' and its ', p_name)), array(concat('or ', p_name, ' or ', p_type, ' or so'), '', p_type))
    WHEN 2 THEN array(array(concat(p_name, ' and ', p_type, ' and ', p_name, ' at long last'), concat(p_type, ' was ', p_name, ' and not ', p_type, ' or ', p_name), concat(p_name, ' is ', p_type, ' is ', p_name, ' is ', p_type)), array(concat(p_name, ' on ', p_type, ' on ', p_name, ' on ', p_type), concat(p_type, ' to ', p_name, ' to ', p_type, ' to ', p_name), 'so'))
    WHEN 3 THEN array(array('x', '=', concat('(', p_size, '.1) y')), array('α', '+', concat(p_size, '(3.14)')))
    WHEN 4 THEN array(array('W0', concat('D', p_size % 10)), array('Y1', 'V'))
    WHEN 5 THEN array(array('X', '→', 'Y'), array('1', '2', concat(p_size % 10)))
    WHEN 6 THEN array(array(p_name, concat('α=0.', p_size)), array(p_type, concat(p_partkey, '.5')), array('98.48(7)', concat(p_size, ' (n=37)')))
    WHEN 7 THEN array(array(p_name), array(p_type, '', p_name))
    ELSE array(array(p_name, concat(p_size), concat(p_partkey)), array(p_type, '12.5', '(2)')) END"""
cell_words = "list_transform(cells, lambda c: len(list_filter(regexp_split_to_array(c, '\\s+'), lambda w: w <> '')))"
some = lambda pattern: f"len(list_filter(cells, lambda c: regexp_matches(c, {q(pattern)})))"
bare = r(r(r(r("c", r"\([^()]*\)"), r"\([^()]*\)"), r"\(.*$"), r"\)")


@query(
    "grid_verdict",
    f"""
WITH t AS (SELECT p_partkey, {GRID.replace("array(", "list_value(")} AS g FROM part),
     c AS (SELECT *, flatten(g) AS cells, len(g[1]) AS nc FROM t),
     w AS (SELECT *, list_filter({cell_words}, lambda n: n > 0) AS ws FROM c),
     f AS (SELECT p_partkey, nc, len(ws) AS n, list_sum(ws) / len(ws) AS mean, len(list_filter(ws, lambda n: n > 8)) AS long, {some(f"[{detect.OPERATORS}{detect.GREEK}]")} AS signs,
                  {some(f"[{detect.RELATIONS}]")} > 0 OR {some(r"^\s*\([0-9.]+\)\s*$")} > 0 AS relation, len(regexp_extract_all(array_to_string(cells, '|'), '\\p{{L}}{{3,}}')) AS named,
                  len(list_filter(cells, lambda c: regexp_matches({bare}, '[0-9]\\.[0-9]|[0-9]{{3}}'))) AS vals, {some(r"^\s*\p{L}")} AS lettered, {some(f"[{detect.ARROWS}]")} > 0 AS arrows, {some(r"[0-9]\.[0-9]")} > 0 AS decimals,
                  (SELECT bool_or(x.blank * 5 >= len(g) * 4) FROM (SELECT k, (SELECT count(*) FROM (SELECT unnest(g) AS row) WHERE trim(coalesce(row[k], '')) = '') AS blank FROM (SELECT unnest(range(1, nc + 1)) AS k)) x) AS void FROM w)
SELECT p_partkey, CASE WHEN nc <= 2 AND mean > 4 THEN 'prose-2col' WHEN nc = 3 AND mean > 4.5 AND void THEN 'gutter-title-3col' WHEN n >= 6 AND long * 3 >= n * 2 AND mean > 6 THEN 'prose-wide'
                       WHEN named <= n AND (signs * 2 >= n OR (signs >= 1 AND relation AND vals * 3 < n)) THEN 'equation' WHEN n >= 4 AND vals = 0 AND named = 0 AND lettered * 2 >= n THEN 'matrix'
                       WHEN n >= 6 AND arrows AND named * 3 <= n AND NOT decimals THEN 'diagram' END AS verdict FROM f
""",
)
def _(spark, d):
    return spread(table(spark, d, "part"), "p_partkey").select("p_partkey", detect.grid_verdict(F.expr(GRID)).alias("verdict"))


@query(
    "group_spans",
    """
WITH t AS (SELECT p_partkey, p_size % 3 + 2 AS a, p_size % 4 + 1 AS b, p_partkey % 5 <> 0 AS styled, p_partkey % 7 <> 0 AS named, p_partkey % 3 + 1 AS header FROM part)
SELECT p_partkey, CASE WHEN header >= 2 AND a + b >= 4 AND b >= 2 AND styled AND named THEN '0:' || a || ',' || a || ':' || b END AS spans FROM t
""",
)
def _(spark, d):
    k, a, b = F.col("p_partkey"), (F.col("p_size") % 3 + 2).cast("int"), (F.col("p_size") % 4 + 1).cast("int")
    places = F.sequence(F.lit(0), a + b - 1)
    top = F.transform(places, lambda i: F.when(i == 0, "first").when(i == a, "second").otherwise(" "))
    leaves = F.transform(places, lambda i: F.when((i == 1) & (k % 7 == 0), "").otherwise("leaf"))
    styled = F.transform(places, lambda i: (i != a) | (k % 5 != 0))
    spans = detect.group_spans(top, leaves, styled, k % 3 + 1, F.lit(9))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["span"].cast("string"))), ",").alias("spans"))


# ---- headings

LEAD = r"^\s*\S+\s*\S*\s*"
toks = "list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')"
real = f"len(list_filter({toks}, lambda w: len(regexp_extract_all(w, '[A-Za-z]')) >= 2))"
single = f"len(list_filter({toks}, lambda w: length({r('w', chr(94) + r'[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$')}) <= 1))"
bullet = f"({m('x', rf'^\s*[{K.BULLETS}]')} OR ({m('x', rf'^\s*[{K.WEAK}]\s')} AND {S.prose}))"
reference = f"({S.commas} >= 2 OR x LIKE '%.' OR ({S.year} AND {S.commas} >= 1) OR {m('x', r'\S\s* [A-Z]\.')})"
clause = "(" + " OR ".join([m("x", r",$"), m("x", rf"(?i)(?:^|\s)[^\p{{L}}\s]*(?:{K.TRAILING})[^\p{{L}}\s]*\s*$"), m(S.clause_core, r"\. [\p{Lu}(]"), m("x", rf"\S\s+[^\p{{L}}\s]*(?:{K.VERBS})[^\p{{L}}\s]*(?:\s|$)"), m("x", rf"^\s*[0-9]\S*\s+[^\p{{L}}\s]*(?i:{K.UNITS})[^\p{{L}}\s]*\s+(?:\S+\s+)*\p{{Ll}}")]) + ")"
among = lambda x, names: f"{x} IN ({', '.join(q(n) for n in names)})"
word, rest = f"lower({e('x', r'^(\p{L}*)', 1)})", r("x", r"^\p{L}*\s*")
no = " OR ".join([
    f"{count('x', r'\p{L}')} < 2", "contains(lower(x), 'et al')", "starts_with(lower(x), 'arxiv')", S.year, f"{count('x', r'(?:^| )[A-Z]\.')} >= 2",
    f"(n BETWEEN 2 AND 6 AND {among(f'lower(rtrim({toks}[-1], {q(".,:")}))', detect.BYLINE)})", S.dots, bullet,
    f"(real = 0 AND (equates OR signs >= 1 OR {single} * 2 >= n OR {count('x', '[0-9]')} * 10 > length({r('x', r'\s')}) * 4))",
    "(real = 1 AND equates)", "(signs >= 3 AND signs >= real + 2)", f"({among(word, detect.STATEMENTS)} AND ({rest} = '' OR {m(rest, '^[0-9]')} OR {m('x', '[.:]$')}))",
])
sec = f"CASE WHEN {m('x', r'^(?i:part )\s*[IVXivx]{1,5}[:.—,-]*(?:\s*$|\s+[^a-z\s])')} THEN 1 WHEN {m('x', r'^(?i:item )\s*[0-9]{1,2}[A-Za-z]{0,2}(?:\s*$|[.:]|\s+[^a-z\s])')} THEN 2 END"
depth = f"CASE WHEN {S.num} <> '' THEN least(3, 1 + length({r(S.num, '[^.]')})) WHEN {m('x', r'^\s*[IVXLCDM]{1,5}\. +\p{L}')} THEN 1 END"


@query(
    "detect_headings",
    f"""
WITH l AS (SELECT p_partkey AS id, p_partkey // 30 AS v, CASE WHEN p_partkey % 30 = 29 AND p_partkey // 30 % 2 = 1 THEN concat('Appendix B. ', p_name, CASE WHEN p_partkey // 30 % 4 = 1 THEN ' and all that follows, as it was found' ELSE '' END) ELSE {S.LINE} END AS raw FROM part),
     s AS (SELECT *, {e("raw", LEAD)} AS r1, v % 2 = 0 AS b1, v % 3 = 0 AS b2, (8 + v % 7) / 10.0 AS ratio, CASE WHEN v % 5 = 0 THEN 2 END AS tier, {r("raw", r"^\s+|\s+$")} AS x FROM l),
     u AS (SELECT *, substr(raw, length(r1) + 1) AS r2, trim(substr(raw, length(r1) + 1)) <> '' AS ink2, len({toks}) AS n, {real} AS real, {m("x", f"[{detect.EQUATES}]")} AS equates, {count("x", f"[{detect.FORMULA}]")} AS signs, {e("x", r"^\S+\s(.*)$", 1)} AS title, {r("x", r"(?i)^appendix\s+")} AS arest FROM s),
     p AS (SELECT *, CASE WHEN NOT b1 THEN 0 WHEN ink2 AND NOT b2 THEN 1 END AS thin, CASE WHEN b1 THEN 0 WHEN ink2 AND b2 THEN 1 END AS bold0, CASE WHEN b1 AND ink2 AND NOT b2 THEN 1 ELSE 2 END AS stop, {r("arest", r"^\S*\s*")} AS rest FROM u),
     f AS (SELECT *, ({no}) AS nothing, {sec} AS sec, {depth} AS depth, rtrim(CASE WHEN stop = 1 THEN r1 ELSE r1 || r2 END) AS lead,
                  n <= 12 AND NOT {reference} AND {m("title", r"^[^\p{L}]*\p{Lu}")} AND {count("title", r"\p{L}")} >= 3 AND ratio >= 0.92 AND NOT {m("x", rf"(?i)^\S+\s+[^\p{{L}}\s]*(?:{K.UNITS})[^\p{{L}}\s]*(?:\s|$)")} AS titled,
                  n <= 2 AND {among(f"rtrim(lower(x), {q('.:— -')})", detect.CANONICAL)} AS canonical,
                  starts_with(lower(x), 'appendix ') AND n <= 16 AND {m(e("arest", r"^(\S+)", 1), r"^[\p{L}\p{N}.:-]+$")} AND (rest = '' OR {m("rest", r"^[:.—\p{Lu}]")}) AS appendix,
                  NOT {reference} AND NOT (real >= 2 AND {clause}) AND NOT {m("x", r"^\p{Ll}")} AS plain FROM p),
     d AS (SELECT id, raw, CASE WHEN nothing THEN NULL WHEN n <= 16 AND sec IS NOT NULL THEN [sec, 2, 0]
                  WHEN titled AND depth IS NOT NULL THEN CASE WHEN bold0 IS NOT NULL AND stop < 2 AND {m("lead", "[.:]$")} THEN [depth, stop, 0] WHEN starts_with(x, '0') AND {m("coalesce(string_split(title, '. ')[2], '')", r"^[^\p{L}]*\p{Lu}")} THEN NULL ELSE [depth, 2, 0] END
                  WHEN canonical THEN [1, 2, 0]
                  WHEN appendix THEN [1, CASE WHEN len(list_filter(regexp_split_to_array(rest, '\\s+'), lambda w: w <> '')) > 6 AND (contains(rest, ',') OR {m("rest", r"(?:^|\s)(?:is|are|was|were)(?:\s|$)")}) AND length(r1) >= length({e("raw", r"(?i)^(\s*appendix\s+\S+)", 1)}) THEN 1 ELSE 2 END, 0]
                  WHEN n <= 16 AND NOT {m("x", "[.,;]$")} AND plain AND tier IS NOT NULL THEN [tier, 2, 1]
                  WHEN n <= 12 AND (thin IS NULL OR ratio >= 1.18) AND NOT {m("x", "[.,;:]$")} AND plain THEN [CASE WHEN ratio >= 1.5 THEN 1 WHEN ratio >= 1.2 THEN 2 ELSE 3 END, 2, 1]
                  WHEN bold0 < thin AND NOT {m("trim(r1)", r"^\p{Ll}")} AND NOT trim(r1) LIKE '%,' AND (len(list_filter(regexp_split_to_array(r1, '\\s+'), lambda w: w <> '')) BETWEEN 2 AND 8 OR ({m("trim(r1)", "[:.]$")} AND {count("r1", r"\p{L}")} >= 2)) THEN [3, 1, 2] END AS v FROM f)
SELECT id, CAST(v[1] AS INT) AS level, CAST(v[2] AS INT) AS n_runs, CASE v[3] WHEN 0 THEN 'reliable' WHEN 1 THEN 'style' WHEN 2 THEN 'run-in' END AS kind FROM d
""",
)
def _(spark, d):
    v, k = F.expr("p_partkey div 30"), F.col("p_partkey")
    raw = F.when((k % 30 == 29) & (v % 2 == 1), F.concat(F.lit("Appendix B. "), "p_name", F.when(v % 4 == 1, " and all that follows, as it was found").otherwise(""))).otherwise(F.expr(S.LINE))
    x = table(spark, d, "part").select(k.alias("id"), v.alias("v"), raw.alias("raw")).withColumn("r1", F.regexp_extract("raw", LEAD, 0))
    run = lambda t, b: F.struct(t.alias("text"), b.alias("bold"))
    runs = F.array(run(F.col("r1"), F.col("v") % 2 == 0), run(F.substr("raw", F.length("r1") + 1), F.col("v") % 3 == 0))
    made = x.select("id", runs.alias("runs"), (F.col("v") % 7 + 8).cast("double").alias("size"), F.lit(10.0).alias("body"), F.when(F.col("v") % 5 == 0, 2).alias("tier"))
    return detect.detect_headings(made).select("id", "level", "n_runs", "kind")


# ---- gutters


def facing(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as lines of a page: prose in two columns, some lines across, short cells on one baseline or apart."""
    c, n = F.col("o_custkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, d, "orders").select(c.alias("doc_id"), F.lit(1).alias("page"), n.alias("rn"))
    kind, left = F.col("doc_id") % 4, F.lit(50.0)
    across = (F.col("doc_id") % 4 == 1) & (F.col("rn") % 12 == 0)
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    s = o.select("*", sides).where(~(across & (F.col("side") == 1)))
    prose = kind <= 1
    return s.select(
        "doc_id", "page", (F.col("rn") * 2 + F.col("side")).alias("n"),
        F.when(F.col("side") == 0, left).otherwise(320.0).alias("x"),
        (F.lit(5000.0) - F.col("rn") * 14 - F.when((F.col("side") == 1) & (kind != 2), 2.0).otherwise(0.0)).alias("y"),
        F.lit(10.0).alias("size"),
        F.when(across, 470.0).when(prose, 200.0).otherwise(F.lit(190.0)).alias("width"),
        F.when(prose, "a line of many words goes on").otherwise("cell").alias("text"), F.lit(0.0).alias("angle"),
    )


@query(
    "central_split",
    """
WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, o_custkey % 4 AS kind FROM orders),
     s AS (SELECT *, kind = 1 AND rn % 12 = 0 AS across FROM (SELECT *, unnest([0, 1]) AS side FROM o)),
     b AS (SELECT doc_id, rn, kind, side, CASE side WHEN 0 THEN 50.0 ELSE 320 END AS x0, CASE side WHEN 0 THEN 50.0 ELSE 320 END + CASE WHEN across THEN 470 WHEN kind <= 1 THEN 200 ELSE 190 END AS x1 FROM s WHERE NOT (across AND side = 1)),
     p AS (SELECT doc_id, kind, min(x0) AS x0, max(x1) AS x1, max(rn) AS n FROM b GROUP BY doc_id, kind HAVING max(rn) >= 6),
     g AS (SELECT *, greatest((x1 - x0) / 200, 1) AS step, x0 + (x1 - x0) * 0.3 AS lo FROM p),
     c AS (SELECT *, lo + i * step AS spot FROM (SELECT *, unnest(range(0, CAST(floor((x1 - x0) * 0.4 / step) AS INT) + 1)) AS i FROM g)),
     k AS (SELECT c.doc_id, c.kind, c.n, c.i, c.spot, c.n - count(DISTINCT b.rn) AS clear FROM c LEFT JOIN b ON b.doc_id = c.doc_id AND b.x0 <= c.spot AND b.x1 >= c.spot GROUP BY c.doc_id, c.kind, c.n, c.i, c.spot),
     best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY clear DESC, i) AS r FROM k)
SELECT doc_id, 1 AS page, round(spot, 6) AS gutter, clear < n AS may_span FROM best WHERE r = 1 AND kind <> 2 AND clear >= n * 0.88 AND (kind <= 1 OR clear = n)
""",
)
def _(spark, d):
    return detect.central_split(facing(spark, d)).withColumn("gutter", F.round("gutter", 6))


# ---- frames


@query(
    "frames",
    """
WITH t AS (SELECT p_partkey AS doc_id, p_size % 3 + 1 AS c, p_partkey % 4 + 1 AS r, p_partkey % 3 AS k FROM part)
SELECT doc_id, 1 AS page, 0 AS frame, 40.0 * c AS x1, 100 + 20.0 * CASE WHEN k = 1 THEN r * 2 ELSE r END AS y1, c + 1 AS n_xs, CASE WHEN k = 1 THEN r * 2 ELSE r END + 1 AS n_ys FROM t WHERE c >= 2 AND CASE WHEN k = 1 THEN r * 2 ELSE r END >= 2 AND k < 2
UNION ALL SELECT doc_id, 1, 0, 40.0 * c, 100 + 20.0 * r, c + 1, r + 1 FROM t WHERE k = 2 AND c >= 2 AND r >= 2
""",
)
def _(spark, d):
    """A grid of c columns and r rows; k = 1: twice as many rows; k = 2: beside it, boxes that nothing closes."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("p_size") % 3 + 1).cast("int").alias("c"), (F.col("p_partkey") % 4 + 1).cast("int").alias("r"), (F.col("p_partkey") % 3).alias("k"))
    p = p.withColumn("r", F.when(F.col("k") == 1, F.col("r") * 2).otherwise(F.col("r")))
    rule = lambda axis, at, lo, hi: F.struct(F.lit(axis).alias("axis"), at.cast("double").alias("p"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    left, base, top, right = F.lit(0), F.lit(100), 100 + F.col("r") * 20, F.col("c") * 40
    v = F.transform(F.sequence(F.lit(0), F.col("c")), lambda i: rule("v", i * 40, base, top))
    h = F.transform(F.sequence(F.lit(0), F.col("r")), lambda j: rule("h", 100 + j * 20, left, right))
    open_ = F.when(F.col("k") == 2, F.array(*(rule("h", F.lit(600 + 20 * j), left, F.lit(200)) for j in range(4)))).otherwise(F.array().cast("array<struct<axis:string,p:double,lo:double,hi:double>>"))
    rules = p.select("doc_id", "page", F.inline(F.concat(v, h, open_)))
    found = detect.frames(rules)
    return found.select("doc_id", "page", "frame", F.element_at("xs", -1).alias("x1"), F.element_at("ys", -1).alias("y1"), F.size("xs").alias("n_xs"), F.size("ys").alias("n_ys"))


@query(
    "rules_of",
    """
WITH b AS (SELECT p_partkey AS doc_id, 1 AS page, p_size % 4 * 5.0 AS w, p_partkey % 5 * 4.0 AS h, p_partkey % 2 = 0 AS filled, p_partkey % 3 > 0 AS stroked FROM part),
     r AS (SELECT doc_id, page, 'h' AS axis, h / 2 AS p, 0.0 AS lo, w AS hi FROM b WHERE filled AND h <= 3 AND w >= 8 UNION ALL SELECT doc_id, page, 'v', w / 2, 0.0, h FROM b WHERE filled AND w <= 3 AND h >= 8
           UNION ALL SELECT doc_id, page, 'h', unnest([0.0, h]), 0.0, w FROM b WHERE stroked AND w >= 8 UNION ALL SELECT doc_id, page, 'v', unnest([w, 0.0]), 0.0, h FROM b WHERE stroked AND h >= 8)
SELECT doc_id, CAST(page AS INT) AS page, axis, CAST(p AS DOUBLE) AS p, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM r
""",
)
def _(spark, d):
    k, w, h, o = F.col("p_partkey"), (F.col("p_size") % 4 * 5).cast("double"), (F.col("p_partkey") % 5 * 4).cast("double"), F.lit(0.0)
    seg = lambda op, x, y: F.struct(F.lit(op).alias("op"), x.alias("x"), y.alias("y"))
    box = F.array(seg("M", o, o), seg("L", w, o), seg("L", w, h), seg("L", o, h), seg("Z", o, o))
    paths = table(spark, d, "part").select(k.alias("doc_id"), F.lit(1).alias("page"), o.alias("x0"), o.alias("y0"), w.alias("x1"), h.alias("y1"), (k % 2 == 0).alias("filled"), (k % 3 > 0).alias("stroked"), box.alias("segs"))
    return detect.rules_of(paths)


# ---- figures


@query(
    "figure_clusters",
    """
WITH p AS (SELECT user_id AS doc_id, event_id % 3 + 1 AS page, event_id AS seq, event_id % 61 * 10.0 AS x0, event_id % 997 * 40.0 AS y0, event_id % 61 * 10.0 + event_id % 7 * 70 AS x1, event_id % 997 * 40.0 + event_id % 11 * 65 AS y1, event_id % 13 = 0 AS curve, event_id % 7 AS hue FROM events),
     f AS (SELECT * FROM p WHERE NOT (x1 - x0 > 400 AND y1 - y0 > 600)),
     n AS (SELECT *, CASE WHEN y1 >= min(y0) OVER (PARTITION BY doc_id, page ORDER BY y1 DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 24 THEN 0 ELSE 1 END AS new FROM f),
     c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY y1 DESC, seq ROWS UNBOUNDED PRECEDING) AS cluster FROM n),
     g AS (SELECT doc_id, page, CAST(cluster AS INT) AS cluster, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_paths, bool_or(curve) AS ink, count(DISTINCT CASE WHEN hue > 2 THEN hue END) AS palette FROM c GROUP BY ALL),
     v AS (SELECT *, CASE WHEN n_paths >= 6 AND x1 - x0 >= 72 AND y1 - y0 >= 54 THEN CASE WHEN doc_id % 5 = 0 OR ink OR palette >= 3 THEN 'strong' ELSE 'demoted' END WHEN n_paths >= 2 AND x1 - x0 >= 36 AND y1 - y0 >= 24 THEN 'weak' END AS grade FROM g)
SELECT doc_id, page, cluster, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, n_paths, grade FROM v WHERE grade IS NOT NULL
""",
)
def _(spark, d):
    k = F.col("event_id")
    x, y = (k % 61 * 10).cast("double"), (k % 997 * 40).cast("double")
    seg = lambda op, a, b: F.struct(F.lit(op).alias("op"), a.cast("double").alias("x"), b.cast("double").alias("y"))
    segs = F.array(seg("M", x, y), F.when(k % 13 == 0, seg("C", x + 5, y + 5)).otherwise(seg("L", x + 5, y)), seg("Z", x, y))
    # hues 0 to 2 are black, grey and a wash
    color = F.when(k % 7 == 0, F.array(F.lit(0), F.lit(0), F.lit(0))).when(k % 7 == 1, F.array(F.lit(90), F.lit(90), F.lit(90))).when(k % 7 == 2, F.array(F.lit(204), F.lit(238), F.lit(255))).otherwise(F.array((k % 7 * 30).cast("int"), F.lit(10), F.lit(20)))
    paths = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (k % 3 + 1).cast("int").alias("page"), k.alias("seq"), x.alias("x0"), y.alias("y0"), (x + k % 7 * 70).alias("x1"), (y + k % 11 * 65).alias("y1"), segs.alias("segs"), F.array(color).alias("colors"), F.when(F.col("user_id") % 5 == 0, 90).otherwise(0).alias("rotate"))
    return detect.figure_clusters(paths)


# ---- codes of stored text


@query("decode_text", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' €é' WHEN 1 THEN p_name || '–™€é' WHEN 2 THEN p_name || '�x' ELSE '' END AS text FROM part")
def _(spark, d):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    mark = F.unhex(F.lit("FEFF"))
    # a lone half of a pair, and an odd byte at the end
    b = F.when(k == 0, F.concat(mark, F.encode(F.concat(name, F.lit(" €é")), "UTF-16BE"))).when(k == 1, F.concat(F.encode(name, "ISO-8859-1"), F.unhex(F.lit("8592A0E9")))).when(k == 2, F.concat(mark, F.encode(name, "UTF-16BE"), F.unhex(F.lit("D800007841")))).otherwise(F.unhex(F.lit("")))
    return table(spark, d, "part").select("p_partkey", detect.decode_text(b).alias("text"))


@query(
    "retile",
    """
WITH t AS (SELECT p_partkey, p_size AS v, p_partkey % 4 + 1 AS n, p_partkey % 3 AS k, p_name FROM part)
SELECT p_partkey, '<text><loc_' || v || '><loc_' || CASE n WHEN 1 THEN 7 ELSE CAST(round_even((k * 500 + 7) / n, 0) AS BIGINT) END || '><loc_500><loc_' || CASE n WHEN 1 THEN v ELSE CAST(round_even((k * 500 + v) / n, 0) AS BIGINT) END || '>' || p_name || '</text><loc_1>' AS doctags FROM t
""",
)
def _(spark, d):
    size = F.col("p_size").cast("string")
    tags = F.concat(F.lit("<text><loc_"), size, F.lit("><loc_7><loc_500><loc_"), size, F.lit(">"), "p_name", F.lit("</text><loc_1>"))
    return table(spark, d, "part").select("p_partkey", detect.retile(tags, F.col("p_partkey") % 3, F.col("p_partkey") % 4 + 1).alias("doctags"))


@query(
    "cmap_entries",
    """
WITH p AS (SELECT p_partkey, p_size FROM part),
     a AS (SELECT p_partkey, 3 AS code, 'ffi' AS text FROM p UNION ALL SELECT p_partkey, 4, chr(128512) FROM p UNION ALL SELECT p_partkey, CAST(p_size + 256 + k AS BIGINT), chr(CAST(913 + k AS INT)) FROM p, range(0, 3) r(k) UNION ALL SELECT p_partkey, 4096, 'x' FROM p UNION ALL SELECT p_partkey, 4097, 'yz' FROM p)
SELECT p_partkey, code, text FROM a
""",
)
def _(spark, d):
    h = lambda c: F.lpad(F.hex(c.cast("bigint")), 4, "0")
    s = F.col("p_size") + 256
    cmap = F.concat(F.lit("2 beginbfchar\n<0003> <0066>\n<0004> <D83D DE00>\nendbfchar 1 beginbfchar <0003> <006600660069> endbfchar\n2 beginbfrange <"), h(s), F.lit("> <"), h(s + 2), F.lit("> <0391>\n<1000> <1001> [<0078> <0079007A>] endbfrange"))
    return detect.cmap_entries(table(spark, d, "part").select("p_partkey", cmap.alias("cmap")), "p_partkey")


@query(
    "cid_widths",
    """
WITH a AS (SELECT p_partkey, 1 AS cid, 500.0 AS width FROM part UNION ALL SELECT p_partkey, 2, p_size FROM part UNION ALL SELECT p_partkey, CAST(10 + k AS INT), CASE k WHEN 1 THEN 9.0 ELSE 250.0 END FROM part, range(0, 4) r(k))
SELECT p_partkey, CAST(cid AS INT) AS cid, CAST(width AS DOUBLE) AS width FROM a
""",
)
def _(spark, d):
    w = F.concat(F.lit("1 [500 "), F.col("p_size").cast("string"), F.lit("] 10 13 250 11 [9]"))
    return detect.cid_widths(table(spark, d, "part").select("p_partkey", w.alias("w")), "p_partkey")
