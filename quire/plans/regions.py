"""Queries over rules, table regions, images, captions, glyphs and whole documents, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


from quire.operators import markup, regions
from quire.sources import containers

from .documents import HEADS, SPANS_SQL, elements, heads, positioned
from .scalars import table

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


# ---- rules


def rules(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (e % 3 + 1).cast("int").alias("page"), (e % 23 * 5).cast("double").alias("y"), (e % 97 * 6).cast("double").alias("x0"), (e % 97 * 6 + e % 53).cast("double").alias("x1"))


BANDS = """
WITH r AS (SELECT user_id AS doc_id, event_id % 3 + 1 AS page, event_id % 23 * 5 AS y, event_id % 97 * 6 AS x0, event_id % 97 * 6 + event_id % 53 AS x1 FROM events WHERE event_id % 53 > 0),
     n AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY doc_id, page, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2.5 THEN 0 ELSE 1 END AS new FROM r),
     i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS i FROM n),
     b AS (SELECT doc_id, page, CAST(min(x0) AS DOUBLE) AS x0, CAST(max(x1) AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y FROM i GROUP BY doc_id, page, y, i)
"""


@query("h_bands", BANDS + "SELECT * FROM b")
def _(spark, d):
    return regions.h_bands(rules(spark, d))


@query("grid_lines", BANDS + "SELECT doc_id, page, y AS p, count(*) AS pieces, sum(x1 - x0) AS extent FROM b GROUP BY ALL")
def _(spark, d):
    lines = regions.grid_lines(rules(spark, d).withColumnsRenamed({"y": "p", "x0": "lo", "x1": "hi"}))
    return lines.groupBy("doc_id", "page", "p").agg(F.count("*").alias("pieces"), F.sum(F.col("hi") - F.col("lo")).alias("extent"))


@query(
    "rule_banded",
    BANDS
    + """, t AS (SELECT DISTINCT user_id AS doc_id, event_id % 3 + 1 AS page, event_id % 20 AS run, event_id % 20 * 9.0 AS x0, event_id % 20 * 9.0 + event_id % 20 * 8 AS x1, event_id % 20 * 5.0 + 2 AS y0, event_id % 20 * 5.0 + 8 AS y1 FROM events)
SELECT t.doc_id, t.page, run, t.x1 - t.x0 >= 60 AND coalesce(bool_or(y > y1 AND y <= y1 + 10) AND bool_or(y < y0 AND y >= y0 - 10), false) AS banded
FROM t LEFT JOIN b ON b.doc_id = t.doc_id AND b.page = t.page AND least(b.x1, t.x1) - greatest(b.x0, t.x0) >= (t.x1 - t.x0) * 0.7 GROUP BY t.doc_id, t.page, run, t.x0, t.x1""",
)
def _(spark, d):
    e = F.col("event_id")
    k = e % 20
    runs = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (e % 3 + 1).cast("int").alias("page"), k.cast("int").alias("run"), (k * 9.0).alias("x0"), (k * 9.0 + k * 8).alias("x1"), (k * 5.0 + 2).alias("y0"), (k * 5.0 + 8).alias("y1"), F.lit(10.0).alias("pad")).distinct()
    return regions.rule_banded(runs, regions.h_bands(rules(spark, d))).select("doc_id", "page", "run", "banded")


# ---- tables


def framed(spark: SparkSession, d: str, name: str, shift: int) -> DataFrame:
    k = F.col(name)
    source = {"p_partkey": "part", "s_suppkey": "supplier"}[name]
    return table(spark, d, source).select((k % 17).alias("doc_id"), (k % 5).cast("int").alias("page"), k.alias("k"), (k % 13 * 30.0 + shift).alias("x0"), (k % 11 * 40.0).alias("y0"), (k % 13 * 30.0 + shift + 60 + k % 7 * 25).alias("x1"), (k % 11 * 40.0 + 30 + k % 3 * 30).alias("y1"))


def _framed_sql(name: str, source: str, shift: int) -> str:
    k = name
    return f"(SELECT {k} % 17 AS doc_id, {k} % 5 AS page, {k} AS k, {k} % 13 * 30.0 + {shift} AS x0, {k} % 11 * 40.0 AS y0, {k} % 13 * 30.0 + {shift} + 60 + {k} % 7 * 25 AS x1, {k} % 11 * 40.0 + 30 + {k} % 3 * 30 AS y1 FROM {source})"


FRAMES = f"""
WITH t AS {_framed_sql("p_partkey", "part", 0)}, f AS {_framed_sql("s_suppkey", "supplier", 5)},
     m AS (SELECT t.doc_id, t.page, t.k AS t, f.k AS f, greatest(least(t.x1, f.x1) - greatest(t.x0, f.x0), 0) AS w, greatest(least(t.y1, f.y1) - greatest(t.y0, f.y0), 0) AS h,
                  (t.x1 - t.x0) * (t.y1 - t.y0) AS ta, (f.x1 - f.x0) * (f.y1 - f.y0) AS fa, least(t.x1 - t.x0, f.x1 - f.x0) AS lw FROM t JOIN f ON t.doc_id = f.doc_id AND t.page = f.page),
     o AS (SELECT *, w * h >= ta * 0.5 AS ok FROM m WHERE w * h >= greatest(least(ta, fa), 1) * 0.5 OR (w >= greatest(lw, 1) * 0.6 AND h > 0)),
     over_ AS (SELECT DISTINCT doc_id, page, f FROM o WHERE NOT ok),
     gone AS (SELECT DISTINCT o.doc_id, o.page, o.t FROM o WHERE NOT EXISTS (SELECT 1 FROM over_ v WHERE v.doc_id = o.doc_id AND v.page = o.page AND v.f = o.f))
"""


@query("table_owners", FRAMES + "SELECT doc_id, page, t, f FROM o")
def _(spark, d):
    t, f = framed(spark, d, "p_partkey", 0).alias("t"), framed(spark, d, "s_suppkey", 5).alias("f")
    met = t.join(f, [F.col("t.doc_id") == F.col("f.doc_id"), F.col("t.page") == F.col("f.page"), regions.owns(regions.box_of("f"), regions.box_of("t"))])
    return met.select("t.doc_id", "t.page", F.col("t.k").alias("t"), F.col("f.k").alias("f"))


@query("reconcile_preferred", FRAMES + "SELECT doc_id, page, 'existing' AS source, k FROM t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = t.doc_id AND g.page = t.page AND g.t = t.k) UNION ALL SELECT doc_id, page, 'preferred', k FROM f WHERE NOT EXISTS (SELECT 1 FROM over_ v WHERE v.doc_id = f.doc_id AND v.page = f.page AND v.f = f.k)")
def _(spark, d):
    return regions.reconcile_preferred(framed(spark, d, "p_partkey", 0), framed(spark, d, "s_suppkey", 5)).select("doc_id", "page", "source", "k")


@query("lane_chains")
def _(spark, d):
    t = framed(spark, d, "p_partkey", 0).withColumn("lane", (F.col("k") % 3).cast("int"))
    return regions.lane_chains(t).select("doc_id", "page", "lane", "k", "chain")


@query("bind_contained", SPANS_SQL + ", g AS (SELECT *, y + size * 0.25 AS cy, x + 1 AS x1 FROM s WHERE abs(angle) < 0.01) SELECT doc_id, page, 0 AS grid, 1 - least(CAST(floor((cy - 300) / 200) AS INT), 1) AS row, least(CAST(floor((x + 0.5) / 100) AS INT), 5) AS col, n, 0 AS piece, text FROM g WHERE cy BETWEEN 300 AND 700 AND x <= 601")
def _(spark, d):
    spans = positioned(spark, d).withColumn("x1", F.col("x") + 1)
    grid = spans.select("doc_id", "page").distinct().select("*", F.lit(0).alias("grid"), F.array(*(F.lit(100.0 * i) for i in range(7))).alias("xs"), F.array(F.lit(300.0), F.lit(500.0), F.lit(701.0)).alias("ys"))
    return regions.bind_contained(spans, grid).where("true")


CLAIMS = """
WITH s AS (SELECT p_size AS doc_id, 1 AS page, p_partkey AS n, p_name || ' ' || p_type AS text FROM part),
     c AS (SELECT n, unnest([n % 5, 3 + n % 7]) AS lo, unnest([n % 5 + n % 4, 6 + n % 7]) AS hi FROM s),
     ch AS (SELECT doc_id, page, n, text, unnest(range(length(text))) AS i FROM s),
     f AS (SELECT *, EXISTS (SELECT 1 FROM c WHERE c.n = ch.n AND i >= lo AND i < hi) AS held FROM ch),
     g AS (SELECT *, i - row_number() OVER (PARTITION BY n ORDER BY i) AS g FROM f WHERE NOT held)
SELECT doc_id, page, n, CAST(min(i) AS INT) AS lo, substring(any_value(text), CAST(min(i) AS INT) + 1, CAST(count(*) AS INT)) AS text FROM g GROUP BY doc_id, page, n, g
"""


@query("prose_without_claims", CLAIMS)
def _(spark, d):
    n = F.col("p_partkey")
    spans = table(spark, d, "part").select(F.col("p_size").alias("doc_id"), F.lit(1).alias("page"), n.alias("n"), F.concat("p_name", F.lit(" "), "p_type").alias("text"))
    claims = spans.select("doc_id", "page", "n", F.explode(F.array(F.struct((F.col("n") % 5).alias("lo"), (F.col("n") % 5 + F.col("n") % 4).alias("hi")), F.struct((3 + F.col("n") % 7).alias("lo"), (6 + F.col("n") % 7).alias("hi")))).alias("c")).select("doc_id", "page", "n", "c.lo", "c.hi")
    return regions.prose_without_claims(spans, claims)


def fragments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k % 40).alias("doc_id"), (k / 40).cast("int").alias("page"), F.lit(0).alias("k"), F.col("p_brand").alias("signature"), F.lit(True).alias("leads"), F.lit(True).alias("ends"), (k % 2 == 0).alias("styled"), F.col("p_brand").alias("first_row"))


@query("table_continuations")
def _(spark, d):
    return regions.continuations(fragments(spark, d)).select("doc_id", "page", "k", "anchor_page", "skip")


@query("cells_array", "WITH c AS (SELECT o_custkey AS doc_id, 1 AS page, o_orderkey AS row, unnest([0, 1, 2]) AS cell, unnest([o_orderstatus, o_orderpriority, CAST(o_orderkey AS VARCHAR)]) AS text FROM orders), r AS (SELECT doc_id, page, row, string_agg(text, '|' ORDER BY cell) AS t FROM c GROUP BY ALL) SELECT doc_id, page, string_agg(t, '/' ORDER BY row) AS cells FROM r GROUP BY ALL")
def _(spark, d):
    o = table(spark, d, "orders")
    cells = o.select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), F.col("o_orderkey").alias("row"), F.posexplode(F.array("o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string"))).alias("cell", "text"))
    made = regions.cells_array(cells)
    return made.select("doc_id", "page", F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), "/").alias("cells"))


@query("dedup_evidence", "SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def _(spark, d):
    kinds = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    return kinds.select("user_id", F.array_join(F.array_distinct(F.transform("x", lambda e: e["event_type"])), ",").alias("kinds"))


@query(
    "header_depth",
    """WITH r AS (SELECT p_size AS k, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS row, p_partkey, p_partkey % 5 > 0 AS styled FROM part),
     n AS (SELECT *, CASE WHEN row >= 3 THEN 3 ELSE 1 + (p_partkey + row) % 3 END AS n FROM r),
     g AS (SELECT *, styled AND CASE WHEN row = 0 THEN n < 3 ELSE n > lag(n) OVER (PARTITION BY k ORDER BY row) END AS good FROM n),
     p AS (SELECT *, bool_and(good) OVER (PARTITION BY k ORDER BY row) AS upto FROM g)
SELECT 1 AS doc_id, k, CAST(coalesce(min(row + 1) FILTER (upto AND row > 0 AND n = 3), 1) AS INT) AS depth FROM p GROUP BY k""",
)
def _(spark, d):
    row = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1
    p = table(spark, d, "part").withColumn("row", row)
    filled = F.when(F.col("row") >= 3, 3).otherwise(1 + (F.col("p_partkey") + F.col("row")) % 3).cast("int")
    cells = F.concat(F.array_repeat(F.lit("x"), filled), F.array_repeat(F.lit(" "), 3 - filled))
    return regions.header_depth(p.select(F.lit(1).alias("doc_id"), F.col("p_size").alias("k"), "row", cells.alias("cells"), (F.col("p_partkey") % 5 > 0).alias("styled")))


@query(
    "ownership_hash",
    """
WITH b AS (SELECT p_partkey, list_transform(range(0, 16), lambda i: CAST((CASE WHEN i < 8 THEN CAST(p_partkey AS BIGINT) ELSE CAST(p_size AS BIGINT) END >> CAST(8 * (i % 8) AS BIGINT)) & 255 AS HUGEINT)) AS bytes FROM part)
SELECT p_partkey, lpad(lower(to_hex(CAST(list_reduce(list_prepend(CAST('14695981039346656037' AS HUGEINT), bytes), lambda h, x: (xor(h, x) * CAST(1099511628211 AS HUGEINT)) % CAST('18446744073709551616' AS HUGEINT)) AS UBIGINT))), 16, '0') AS hash FROM b
""",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", regions.ownership_hash(F.array("p_partkey", "p_size")).alias("hash"))


# ---- images and labels


def images(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    x, y = e % 61 * 10.0, e % 47 * 15.0
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (e % 3 + 1).cast("int").alias("page"), e.alias("n"), (e % 37).alias("object"), x.alias("x0"), y.alias("y0"), (x + e % 7 * 6).alias("x1"), (y + e % 5 * 8).alias("y1"))


IMAGES = "WITH i AS (SELECT user_id AS doc_id, event_id % 3 + 1 AS page, event_id AS n, event_id % 37 AS object, event_id % 61 * 10.0 AS x0, event_id % 47 * 15.0 AS y0, event_id % 61 * 10.0 + event_id % 7 * 6 AS x1, event_id % 47 * 15.0 + event_id % 5 * 8 AS y1 FROM events)"


@query("page_images", IMAGES + "SELECT doc_id, page, object, n, row_number() OVER (PARTITION BY doc_id, page ORDER BY n) - 1 AS index FROM (SELECT doc_id, page, object, min(n) AS n FROM i GROUP BY ALL)")
def _(spark, d):
    return regions.page_images(images(spark, d)).select("doc_id", "page", "object", "n", "index")


@query("image_coverage", IMAGES + ", p AS (SELECT DISTINCT user_id AS doc_id, unnest([1, 2, 3, 4]) AS page FROM events) SELECT p.doc_id, p.page, coalesce(max((x1 - x0) * (y1 - y0)), 0) / (612.0 * 792) AS coverage FROM p LEFT JOIN i USING (doc_id, page) GROUP BY ALL")
def _(spark, d):
    pages = table(spark, d, "events").select(F.col("user_id").alias("doc_id")).distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return regions.image_coverage(pages, images(spark, d))


@query(
    "tile_clusters",
    "WITH RECURSIVE "
    + IMAGES.removeprefix("WITH ")
    + """, a AS (SELECT a.doc_id, a.page, a.n AS u, b.n AS v FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.page = b.page AND a.x0 < b.x1 + 2 AND b.x0 < a.x1 + 2 AND a.y0 < b.y1 + 2 AND b.y0 < a.y1 + 2),
     r AS (SELECT doc_id, page, n, n AS c FROM i UNION SELECT r.doc_id, r.page, r.n, a.v FROM r JOIN a ON a.doc_id = r.doc_id AND a.page = r.page AND a.u = r.c)
SELECT doc_id, page, n, min(c) AS cluster FROM r GROUP BY ALL""",
)
def _(spark, d):
    return regions.tile_clusters(images(spark, d)).select("doc_id", "page", "n", "cluster")


@query("attach_labels", SPANS_SQL + ", f AS (SELECT unnest([1, 2, 3]) AS figure, unnest([0, 100, 50]) AS x0, unnest([500, 300, 200]) AS y0, unnest([200, 400, 300]) AS x1, unnest([700, 520, 320]) AS y1) SELECT doc_id, page, n, min(figure) AS figure, any_value(bold) AS in_table FROM s JOIN f ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL")
def _(spark, d):
    spans = positioned(spark, d)
    boxes = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("figure", "x0", "y0", "x1", "y1"), b, strict=True))) for b in ((1, 0.0, 500.0, 200.0, 700.0), (2, 100.0, 300.0, 400.0, 520.0), (3, 50.0, 200.0, 300.0, 320.0))))).alias("b")
    figures = spans.select("doc_id", "page").distinct().select("doc_id", "page", boxes).select("doc_id", "page", "b.*")
    return regions.attach_labels(spans.withColumn("in_table", F.col("bold")), figures)


@query("figure_gate", IMAGES + "SELECT doc_id, count(*) FILTER (object % 4 > 0) AS accepted, count(*) FILTER (object % 4 = 0 AND n % 2 = 0) AS suppressed, array_to_string(list_sort(coalesce(list(DISTINCT page) FILTER (object % 4 = 0 AND n % 2 = 0), [])), ',') AS pages FROM i GROUP BY doc_id")
def _(spark, d):
    figures = images(spark, d).select("doc_id", "page", (F.col("object") % 4 > 0).alias("strong"), (F.col("n") % 2 == 0).alias("demoted"))
    return regions.figure_gate(figures).withColumn("pages", F.array_join("pages", ","))


@query(
    "tolerant_gap",
    IMAGES
    + """, p AS (SELECT doc_id, page, min(x0) AS lo, max(x1) AS hi FROM i GROUP BY ALL HAVING max(x1) - min(x0) > 2),
     g AS (SELECT doc_id, page, hi, k, lo + k AS x FROM (SELECT *, unnest(range(1, CAST(ceil(hi - lo) AS BIGINT) + 1)) AS k FROM p)),
     c AS (SELECT g.doc_id, g.page, g.k, g.x, count(i.n) AS crossed FROM g LEFT JOIN i ON i.doc_id = g.doc_id AND i.page = g.page AND i.x0 < g.x AND i.x1 > g.x WHERE g.x < g.hi GROUP BY g.doc_id, g.page, g.k, g.x),
     f AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, page ORDER BY k) AS island FROM c WHERE crossed <= 2),
     w AS (SELECT doc_id, page, max(x) - min(x) AS width, (min(x) + max(x)) / 2 AS center FROM f GROUP BY doc_id, page, island),
     b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY width DESC, center) AS r FROM w)
SELECT doc_id, page, CAST(width AS DOUBLE) AS width, CAST(center AS DOUBLE) AS center FROM b WHERE r = 1 AND width > 0""",
)
def _(spark, d):
    return regions.tolerant_gap(images(spark, d).select("doc_id", "page", F.col("x0").alias("lo"), F.col("x1").alias("hi")), 2)


@query("tall_columns", IMAGES + ", c AS (SELECT doc_id, page, max(CASE WHEN (x0 + x1) * 0.5 < 300 THEN y1 END) AS lt, min(CASE WHEN (x0 + x1) * 0.5 < 300 THEN y0 END) AS lb, max(CASE WHEN (x0 + x1) * 0.5 >= 300 THEN y1 END) AS rt, min(CASE WHEN (x0 + x1) * 0.5 >= 300 THEN y0 END) AS rb FROM i GROUP BY ALL) SELECT doc_id, page, coalesce(least(lt, rt) - greatest(lb, rb) >= 60 * 8 AND lt IS NOT NULL AND rt IS NOT NULL, false) AS tall FROM c")
def _(spark, d):
    boxes = images(spark, d)
    cuts = boxes.select("doc_id", "page").distinct().select("*", F.lit(300.0).alias("cut"), F.lit(60.0).alias("med"))
    return regions.tall_columns(boxes.select("doc_id", "page", "x0", "y0", "x1", "y1"), cuts).select("doc_id", "page", "tall")


# ---- lines


def lines(spark: SparkSession, d: str) -> DataFrame:
    s = positioned(spark, d)
    n = F.col("n")
    return s.select("doc_id", "page", n.alias("ord"), (F.col("x") % 50).alias("x0"), F.col("y"), "size", "font", "text", (n % 11 == 0).alias("caption"), (n % 13 == 0).alias("breaks"), F.col("bold").alias("tier"), F.col("bold"))


@query("gather_captions")
def _(spark, d):
    return regions.gather_captions(lines(spark, d)).select("doc_id", "page", "ord", "caption_ord")


@query(
    "heading_continuations",
    "WITH RECURSIVE "
    + SPANS_SQL.removeprefix("WITH ")
    + """, l AS (SELECT doc_id, page, n AS ord, x % 50 AS x0, y, size, font, n % 3 < 2 AS tier, CASE WHEN n % 5 = 0 THEN text ELSE split_part(text, ' ', 1) END AS text, row_number() OVER (PARTITION BY doc_id, page ORDER BY n) AS rn FROM s),
     w AS (SELECT *, len(string_split(text, ' ')) AS words FROM l),
     f AS (SELECT doc_id, page, rn, ord, ord AS head, tier AS open, x0, y, size, font, words FROM w WHERE rn = 1
           UNION ALL SELECT w.doc_id, w.page, w.rn, w.ord, CASE WHEN on_ THEN f.head ELSE w.ord END, on_ OR w.tier, CASE WHEN on_ THEN f.x0 ELSE w.x0 END, CASE WHEN on_ THEN f.y ELSE w.y END, CASE WHEN on_ THEN f.size ELSE w.size END, w.font, CASE WHEN on_ THEN f.words + w.words ELSE w.words END
           FROM f JOIN w ON w.doc_id = f.doc_id AND w.page = f.page AND w.rn = f.rn + 1,
                LATERAL (SELECT f.open AND w.tier AND round(f.size) = round(w.size) AND f.font = w.font AND abs(f.y - w.y) < f.size * 1.8 AND abs(w.x0 - f.x0) < f.size * 1.5 AND f.words + w.words <= 16 AND NOT regexp_matches(w.text, '[0-9]$') AS on_))
SELECT doc_id, page, ord, head FROM f""",
)
def _(spark, d):
    n = F.col("ord")
    x = lines(spark, d).withColumn("tier", n % 3 < 2).withColumn("text", F.when(n % 5 == 0, F.col("text")).otherwise(F.split_part("text", F.lit(" "), F.lit(1))))
    return regions.heading_continuations(x).select("doc_id", "page", "ord", "head")


@query("header_at", SPANS_SQL + "SELECT doc_id, n AS ord FROM s WHERE NOT (n % 3 = 0 AND EXISTS (SELECT 1 FROM s b WHERE b.doc_id = s.doc_id AND b.n % 41 = 0 AND round(b.size) = round(s.size) AND b.bold = s.bold AND b.font = s.font))")
def _(spark, d):
    s = positioned(spark, d)
    verdicts = s.select("doc_id", F.col("n").alias("ord"), F.lit(1).alias("level"), F.when(F.col("n") % 3 == 0, "style").otherwise("reliable").alias("kind"), "size", "bold", "font")
    return regions.header_at(verdicts, s.where("n % 41 = 0")).select("doc_id", "ord")


@query("binds", "WITH p AS (SELECT p_partkey, substr('a(1.,-', p_partkey % 6 + 1, 1) AS p, substr('3x', p_partkey % 2 + 1, 1) AS q, substr(')4b%', p_partkey % 4 + 1, 1) AS n FROM part) SELECT p_partkey, n IN (')', '%') OR p = '(' OR (p IN ('.', ',', '-') AND n = '4' AND q = '3') AS binds FROM p")
def _(spark, d):
    k = F.col("p_partkey")
    pick = lambda s: F.substring(F.lit(s), (k % len(s) + 1).cast("int"), F.lit(1))
    return table(spark, d, "part").select("p_partkey", regions.binds(pick("a(1.,-"), pick("3x"), pick(")4b%")).alias("binds"))


@query("combining_marks", "SELECT p_partkey, CASE substr('~a´,', p_partkey % 4 + 1, 1) WHEN '~' THEN 771 WHEN '´' THEN 769 WHEN ',' THEN 806 END AS mark FROM part")
def _(spark, d):
    glyph = F.substring(F.lit("~a´,"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1))
    return table(spark, d, "part").select("p_partkey", F.conv(F.hex(F.encode(regions.mark_to_combining(glyph), "UTF-16BE")), 16, 10).cast("int").alias("mark"))


# ---- whole documents


@query("toc", HEADS + "SELECT doc_id, level, title, 0 AS page, id FROM h WHERE level <= 3 AND id <> ''")
def _(spark, d):
    nav = markup.build_nav(heads(spark, d)).withColumnRenamed("nav", "html")
    return regions.toc(nav).drop("n")


@query("outline", "SELECT o_custkey AS doc_id, o_orderkey AS n, o_orderkey % 4 + 1 AS level, o_orderpriority AS title, o_orderkey % 7 AS page, 'page-' || o_orderkey % 7 AS anchor FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    return regions.outline(table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("n"), (k % 4).alias("level"), F.col("o_orderpriority").alias("title"), (k % 7).alias("page")))


@query("page_text_of", "SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13))) >= 2 THEN text ELSE source END AS text FROM documents")
def _(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text", "source")
    return regions.page_text_of(pages, 1, "source")


CHUNKS = """
WITH c AS (SELECT o_custkey AS doc_id, o_orderkey % 7 AS chunk, 'c' || o_orderkey % 7 AS id, max(o_orderpriority) AS section, min(o_orderkey % 7) AS page_start, min(o_orderkey % 7) + 1 AS page_end, max(o_orderstatus) AS text FROM orders GROUP BY ALL),
     h AS (SELECT c_custkey AS doc_id, r AS rank, (c_custkey + r) % 9 AS row, 1.0 / (r + 1) AS score FROM customer, range(3) t(r))
"""


@query("expand_hits", CHUNKS + "SELECT h.doc_id, rank, id AS chunk_id, round(score, 6) AS score, section, page_start, page_end, 'p' || page_start AS label_start, CASE WHEN page_end < 7 THEN 'p' || page_end END AS label_end, text AS snippet FROM h JOIN c ON c.doc_id = h.doc_id AND row < 8 AND c.id = 'c' || row")
def _(spark, d):
    k = F.col("o_orderkey") % 7
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("chunk"), F.concat(F.lit("c"), k.cast("string")).alias("id"), "o_orderpriority", "o_orderstatus", F.col("o_orderkey").alias("ord"))
    chunks = o.groupBy("doc_id", "chunk", "id").agg(F.max("o_orderpriority").alias("section"), F.min("chunk").alias("page_start"), (F.min("chunk") + 1).alias("page_end"), F.array_sort(F.collect_list("ord")).alias("ords"), F.max("o_orderstatus").alias("text"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    hits = customers.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank")).select("doc_id", "rank", ((F.col("doc_id") + F.col("rank")) % 9).cast("int").alias("row"), (1.0 / (F.col("rank") + 1)).alias("score"))
    spaces = customers.withColumn("chunk_ids", F.array(*(F.lit(f"c{i}") for i in range(8))))
    labels = customers.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("page")).withColumn("label", F.concat(F.lit("p"), F.col("page").cast("string")))
    return regions.expand_hits(hits, spaces, chunks, chunks.select("doc_id", "chunk", "text"), labels).drop("ords")


@query("emit_json", "SELECT n_nationkey, '{' || chr(10) || '  \"a\": [' || chr(10) || '    ' || n_regionkey || chr(10) || '  ],' || chr(10) || '  \"n_name\": \"' || n_name || '\",' || chr(10) || '  \"n_nationkey\": ' || n_nationkey || chr(10) || '}' || chr(10) AS json FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", regions.emit_json(F.to_json(F.struct("n_name", "n_nationkey", F.array("n_regionkey").alias("a")))).alias("json"))


@query(
    "merge_adjacent_figures",
    """WITH e AS (SELECT p_size AS doc_id, 1 AS page, p_partkey AS ord, CASE p_partkey % 5 WHEN 0 THEN '<p>x</p>' WHEN 1 THEN '<figure><img src="a"></figure>' WHEN 2 THEN '<figure><figcaption>c</figcaption></figure>' WHEN 3 THEN '<figure><img src="b"></figure>' ELSE '<figure><figcaption>d</figcaption></figure>' END AS html FROM part),
     g AS (SELECT *, CASE WHEN contains(html, '<img') THEN 1 WHEN contains(html, '<figcaption') THEN 2 END AS k FROM e),
     n AS (SELECT *, lead(k) OVER w AS nk, lead(html) OVER w AS nh FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
     p AS (SELECT *, coalesce(k <> nk, false) AS pair FROM n),
     r AS (SELECT *, sum(CASE WHEN pair THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM p),
     t AS (SELECT *, pair AND row_number() OVER (PARTITION BY doc_id, run, pair ORDER BY ord) % 2 = 1 AS taken FROM r),
     o AS (SELECT *, coalesce(lag(taken) OVER (PARTITION BY doc_id ORDER BY ord), false) AS gone FROM t)
SELECT doc_id, page, ord, CASE WHEN taken THEN '<figure>' || regexp_extract(CASE WHEN k = 1 THEN html ELSE nh END, '<img[^>]*>') || regexp_extract(CASE WHEN k = 1 THEN nh ELSE html END, '<figcaption>.*</figcaption>') || '</figure>' ELSE html END AS html FROM o WHERE NOT gone""",
)
def _(spark, d):
    k = F.col("p_partkey")
    html = F.array(*(F.lit(x) for x in ("<p>x</p>", '<figure><img src="a"></figure>', "<figure><figcaption>c</figcaption></figure>", '<figure><img src="b"></figure>', "<figure><figcaption>d</figcaption></figure>")))[(k % 5).cast("int")]
    return regions.merge_adjacent_figures(table(spark, d, "part").select(F.col("p_size").alias("doc_id"), F.lit(1).alias("page"), k.alias("ord"), html.alias("html")))


@query(
    "doctags_html",
    """WITH b AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, ['heading', 'list_item', 'list_item', 'para', 'footnote', 'list_item', 'list_item'][o_orderkey % 7 + 1] AS tag, o_orderkey % 4 + 1 AS level, o_orderstatus AS text FROM orders),
     l AS (SELECT *, tag = 'list_item' AND coalesce(lag(tag) OVER w <> 'list_item', true) AS f, tag = 'list_item' AND coalesce(lead(tag) OVER w <> 'list_item', true) AS z FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
     h AS (SELECT doc_id, ord, CASE WHEN f THEN '<ul>' || chr(10) ELSE '' END || CASE tag WHEN 'heading' THEN '<h' || least(level + 1, 6) || ' id="sec-' || text || '">' || text || '</h' || least(level + 1, 6) || '>' WHEN 'list_item' THEN '<li>' || text || '</li>' WHEN 'footnote' THEN '<p class="footnote">' || text || '</p>' ELSE '<p>' || text || '</p>' END || chr(10) || CASE WHEN z THEN '</ul>' || chr(10) ELSE '' END AS h FROM l)
SELECT doc_id, string_agg(h, '' ORDER BY ord) AS html FROM h GROUP BY doc_id""",
)
def _(spark, d):
    b = elements(spark, d)
    return regions.doctags_html(b.select("doc_id", "ord", F.col("kind").alias("tag"), F.col("heading_level").alias("level"), F.regexp_extract("text", "<b>(.*)</b>", 1).alias("text")))


@query("externalize_images", "SELECT p_partkey AS doc_id, CASE WHEN t = 0 THEN NULL ELSE 'img/fig_01' || '.svg' END AS path, md5(CASE WHEN t = 0 THEN '<p>' || p_name || '</p><img src=\"img/fig_01.svg\"><img src=\"kept.png\">' ELSE '<svg><g/>' || p_size || '</svg>' END) AS digest FROM part, range(2) r(t)")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<p>"), "p_name", F.lit("</p><svg><g/>"), F.col("p_size").cast("string"), F.lit('</svg><img src="kept.png">')).alias("html"))
    return regions.externalize_images(p).select("doc_id", "path", F.md5("content").alias("digest"))


@query("to_html")
def _(spark, d):
    b = elements(spark, d)
    return regions.to_html(b.select("doc_id", "page").distinct(), b, "section")


@query("source_digest", "SELECT page_id, sha256(html) AS sha256, strlen(html) AS bytes FROM pages")
def _(spark, d):
    x = regions.source_digest(F.col("html").cast("binary"))
    return table(spark, d, "pages").select("page_id", x.alias("x")).select("page_id", "x.sha256", "x.bytes")


# ---- containers


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Containers of documents: a page, the lines as blocks, and the text as a member."""
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    lines_ = F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.format_string("b%04d", i + 1).alias("id"), F.lit("para").alias("kind"), F.lit(1).alias("page"), t.alias("text")))
    source = F.struct(F.col("source").alias("file"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.lit(1).alias("pages"), F.lit("2024-01-01T00:00:00Z").alias("generated_at"))
    fields = {"schema_version": F.lit(0), "source": source, "pages": F.array(F.struct(F.lit(1).alias("n"))), "blocks": lines_}
    rest = {k: F.array().cast("array<struct<id:string>>") for k in containers.REQUIRED if k not in fields}
    model_ = F.to_json(F.struct(*(v.alias(k) for k, v in (fields | rest).items())))
    made = containers.containers(docs.select("doc_id", model_.alias("model"), F.create_map(F.lit("text.txt"), F.col("text").cast("binary")).alias("members")))
    return made.select(F.col("doc_id").cast("string").alias("path"), "content")


LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS ord FROM documents"


@query("container_blocks", f"SELECT CAST(doc_id AS VARCHAR) AS path, ord, printf('b%04d', ord + 1) AS id, md5(text) AS digest FROM ({LINES})")
def _(spark, d):
    return containers.entity(boxes(spark, d), "blocks", "id string, kind string, page int, text string").select("path", "ord", "id", F.md5("text").alias("digest"))


@query("container_members", "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS bytes FROM documents")
def _(spark, d):
    return containers.member(boxes(spark, d), "text.txt").select("path", F.sha2("bytes", 256).alias("sha256"), F.octet_length("bytes").alias("bytes"))


@query("container_models", "SELECT CAST(doc_id AS VARCHAR) AS path, source AS file, sha256(coalesce(text, '')) AS sha256 FROM documents")
def _(spark, d):
    m = containers.models(boxes(spark, d))
    return m.select("path", F.get_json_object("model", "$.source.file").alias("file"), F.get_json_object("model", "$.source.sha256").alias("sha256"))



