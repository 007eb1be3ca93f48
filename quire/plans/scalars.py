"""Queries over column functions, each with the SQL that says the same by hand.

The driver's texts hardly hold captions, lists or headings, so the input is made
from columns of part by one expression that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import classify as K
from quire.functions import numeric as N
from quire.functions import text as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LINE = """CASE p_partkey % 30
    WHEN 0 THEN concat('Figure ', p_size, '.', p_partkey, ': ', p_name)
    WHEN 1 THEN concat('fig. ', p_size, 'b) shows ', p_name)
    WHEN 2 THEN concat('Table ', p_partkey, ' (continued)')
    WHEN 3 THEN concat('Table ', p_size, ' first illustrates ', p_name)
    WHEN 4 THEN concat('Figure B.', p_size, '. ', p_name)
    WHEN 5 THEN concat('Figure 3.', p_size, ' Overview . . . . . ', p_partkey)
    WHEN 6 THEN concat('• ', p_name)
    WHEN 7 THEN concat('− ', p_name, ' of the longer words')
    WHEN 8 THEN concat(p_size, '. ', p_name, ' and')
    WHEN 9 THEN concat(p_size, ') ', p_name)
    WHEN 10 THEN concat(p_size, '.', p_partkey % 7, ' ', upper(p_name))
    WHEN 11 THEN concat('A.', p_size, ' ', p_name)
    WHEN 12 THEN concat('IV. ', p_type)
    WHEN 13 THEN concat('Levoy, M. and ', p_name, ', 19', 10 + p_size)
    WHEN 14 THEN concat('PART II ', p_type)
    WHEN 15 THEN concat('Item ', p_size, 'A. ', p_name)
    WHEN 16 THEN concat('Part I of form ', p_name)
    WHEN 17 THEN concat(p_size, ' GeV at ', p_name)
    WHEN 18 THEN concat('1000 2000 ', p_partkey)
    WHEN 19 THEN 'Vp (m/s)'
    WHEN 20 THEN concat('x = ', p_size, ' + α')
    WHEN 21 THEN concat('<b>The steps of ', p_name, ':</b>')
    WHEN 22 THEN concat('We have ', p_name, ' set. Then it, was')
    WHEN 23 THEN concat('<a href="#sec-', p_size, '">', p_name, '</a> &amp;lt; &lt;b&gt;')
    WHEN 24 THEN concat('a>b <i>', p_name, '</i> &quot;q&quot; <')
    WHEN 25 THEN concat('**', p_name, '**')
    WHEN 26 THEN concat('  ', p_name, '   ', p_type, ' ')
    WHEN 27 THEN concat('[unclear] ', p_name, ' <loc_', p_size, '>[a[b]c]')
    WHEN 28 THEN concat('box ', p_size, '-', p_partkey, ' ', p_name)
    ELSE concat(p_name, ', Ltd.') END"""
WITH = f"WITH t AS (SELECT p_partkey AS id, {LINE} AS x FROM part)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """The rows dealt over all cores: small files of many rows make one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(LINE).alias("x"))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def m(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q(p)})"


def e(x: str, p: str, g: int = 0) -> str:
    return f"regexp_extract({x}, {q(p)}, {g})"


def r(x: str, p: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(p)}, {q(by)}, 'g')"


def count(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, {q(p)}))"


def on_lines(name: str, columns: dict[str, tuple[Callable[[Column], Column], str]]) -> None:
    """A query of functions of the line x: column -> (function of x, DuckDB expression)."""
    QUERIES[name] = lambda spark, d: lines(spark, d).select("id", *(c(F.col("x")).alias(k) for k, (c, _) in columns.items()))
    SQL[name] = f"{WITH} SELECT id, {', '.join(f'{s} AS {k}' for k, (_, s) in columns.items())} FROM t"


tag = lambda x: r(r(x, r"<[^>]*(>|$)"), ">")
squash = lambda x: r(x, r"\s+", " ")
un = lambda x: f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"

cap = K.CAPTION + K.NUMBER
is_cap = m("x", cap)
letter = e("x", K.CAPTION + r"[0-9]+(?:[.-][0-9]+)*([A-Za-z])(?:[^A-Za-z]|$)", 2)
is_fig = f"CASE WHEN {is_cap} THEN lower(trim({e('x', cap, 1)})) IN ('figure', 'fig.', 'fig', 'box') END"
tail = f"CASE WHEN {is_cap} THEN CASE WHEN {letter} <> '' THEN {r('x', cap + '[A-Za-z]')} ELSE {r('x', cap)} END END"
xref = f"({m('lower(x)', K.XREF)} AND {m(r('lower(x)', K.XREF), K.XREF_REST)})"
core = f"lower({r(tail, chr(94) + r'[^\p{L}\p{N}' + chr(39) + r']+|[^\p{L}\p{N}' + chr(39) + r']+$')})"
run_ = e(r(r("x", r"\s+$"), r"\s*[0-9]+$"), r"([.…· \t]*)$", 1)
dots = f"(length({r(run_, '[^.·]')}) + 3 * length({r(run_, '[^…]')}) >= 4)"
on_lines(
    "captions",
    {
        "is_figure": (lambda X: K.caption_is_figure(X), is_fig),
        "number": (lambda X: K.caption_number(X), f"CASE WHEN {is_cap} THEN {e('x', cap, 2)} || {letter} END"),
        "tail": (lambda X: K.caption_tail(X), tail),
        "xref": (lambda X: K.is_inline_xref(X), xref),
        "opens": (lambda X: K.opens_figure_caption(X), f"((coalesce({is_fig}, false) OR {m('x', r'(?i)^\s*(?:figure|fig\.|fig[ \t])\s*[a-z]{1,2}[.-]?[0-9]')}) AND NOT {xref})"),
        "continued": (lambda X: K.caption_is_continued(X), f"coalesce({core} IN ('continued', 'cont', 'cont''d'), false)"),
        "leaders": (lambda X: K.dotleader_tail(X), dots),
    },
)
number = r(e("trim(x)", r"(?i)^(?:table|figure|fig\.|fig)\s*([\p{L}\p{N}.]+)", 1), r"\.+$")
word = e("trim(x)", r"(?i)^(table|figure|fig\.|fig)", 1)
on_lines("caption_label", {"label": (lambda X: K.caption_label(X), f"CASE WHEN {word} <> '' AND {number} <> '' THEN {word} || ' ' || {number} END")})

weak = r("x", rf"^\s*[{K.WEAK}]")
prose = f"len(list_filter(regexp_split_to_array({weak}, '\\s+'), lambda w: w <> '')) >= 3 AND {count(weak, r'\p{L}')} >= 6"
bullets = K.BULLETS
on_lines(
    "lists",
    {
        "ordered": (lambda X: K.list_ordered(X), f"CASE WHEN {m('x', rf'^\s*[{bullets}]')} OR ({m('x', rf'^\s*[{K.WEAK}]\s')} AND {prose}) THEN false WHEN {m('x', K.ORDERED)} THEN true END"),
        "number": (lambda X: K.ordered_num(X), f"CAST(nullif({e('x', K.ORDERED, 1)}, '') AS INT)"),
        "bare": (lambda X: K.strip_marker(X), r(r("x", rf"^\s*[{bullets}{K.WEAK}]*\s*"), r"^[0-9]+[.)]\s*")),
        "introduces": (lambda X: K.introduces_list(X), f"({r(tag('x'), r'\s+$')} LIKE '%:')"),
    },
)
num = e("x", K.NUMBERED, 1)
trimmed = r("x", r"^\s+|\s+$")
first = r(e(trimmed, r"^(\S+)", 1), r"\.+$")
letters, upper = count(trimmed, r"\p{L}"), count(trimmed, r"\p{Lu}")
depth = f"len(list_filter(string_split({first}, '.'), lambda p: p <> ''))"
on_lines(
    "heading_marks",
    {
        "numbered": (lambda X: K.numbered_level(X), f"CASE WHEN {num} <> '' THEN least(3, 1 + length({r(num, '[^.]')})) END"),
        "roman": (lambda X: K.roman_section(X), f"CASE WHEN {m('x', r'^\s*[IVXLCDM]{1,5}\. +\p{L}')} THEN 1 END"),
        "sec": (lambda X: K.sec_anchor(X), f"CASE WHEN {m('x', r'^(?i:part )\s*[IVXivx]{1,5}[:.—,-]*(?:\s*$|\s+[^a-z\s])')} THEN 1 WHEN {m('x', r'^(?i:item )\s*[0-9]{1,2}[A-Za-z]{0,2}(?:\s*$|[.:]|\s+[^a-z\s])')} THEN 2 END"),
        "doctags": (
            lambda X: K.doctags_level(X),
            f"CASE WHEN length({trimmed}) < 3 OR length({trimmed}) > 75 THEN NULL WHEN {m(first, r'^[0-9.]*[0-9][0-9.]*$')} AND {m(trimmed, r'^\S+\s+\S')} THEN least(greatest({depth}, 1), 4) WHEN {letters} > 0 AND {upper} * 100 >= {letters} * 85 AND NOT {trimmed} LIKE '%.' THEN 1 END",
        ),
        "size": (lambda X: K.size_level((F.col("id") % 20) / 10), "CASE WHEN (id % 20) / 10 >= 1.5 THEN 1 WHEN (id % 20) / 10 >= 1.2 THEN 2 ELSE 3 END"),
    },
)
commas = f"length({r('x', '[^,]')})"
year = m("x", "(?:19|20)[0-9][0-9]")
clause_core = r("x", r"^\s*(?:[0-9][0-9.]*|[IVXLCDM]+|[A-Z])\.\s+")
on_lines(
    "references",
    {
        "has_year": (lambda X: K.has_year(X), year),
        "initials": (lambda X: K.initials_count(X), count("x", r"(?:^| )[A-Z]\.")),
        "reference": (lambda X: K.looks_like_reference(X), f"({commas} >= 2 OR x LIKE '%.' OR ({year} AND {commas} >= 1) OR {m('x', r'\S\s* [A-Z]\.')})"),
        "clause": (
            lambda X: K.looks_like_clause(X),
            "(" + " OR ".join([m("x", r",$"), m("x", rf"(?i)(?:^|\s)[^\p{{L}}\s]*(?:{K.TRAILING})[^\p{{L}}\s]*\s*$"), m(clause_core, r"\. [\p{Lu}(]"), m("x", rf"\S\s+[^\p{{L}}\s]*(?:{K.VERBS})[^\p{{L}}\s]*(?:\s|$)"), m("x", rf"^\s*[0-9]\S*\s+[^\p{{L}}\s]*(?i:{K.UNITS})[^\p{{L}}\s]*\s+(?:\S+\s+)*\p{{Ll}}")]) + ")",
        ),
    },
)
toks = f"list_filter(regexp_split_to_array({trimmed}, '\\s+'), lambda w: w <> '')"
ticks = f"len(list_filter({toks}, lambda w: regexp_matches(w, '^[0-9.,–%-]{{1,6}}$')))"
flat = r(tag("x"), r"^\s+|\s+$")
on_lines(
    "figure_text",
    {
        "axis": (lambda X: K.is_axis_label(X), f"({trimmed} <> '' AND (({ticks} >= 1 AND {ticks} * 2 >= len({toks})) OR (len({toks}) <= 2 AND strlen({trimmed}) <= 14 AND contains({trimmed}, '(') AND contains({trimmed}, ')'))))"),
        "numeric": (lambda X: K.is_num_token(F.split_part(X, F.lit(" "), F.lit(1))), f"({m('split_part(x, chr(32), 1)', '[0-9]')} AND {m('split_part(x, chr(32), 1)', r'^[0-9.,%+±()*-]+$')})"),
        "math": (lambda X: K.is_math_fragment(X), f"(length({flat}) > 0 AND length({flat}) <= 60 AND {count(flat, r'\p{L}{2,}')} <= 1 AND ({m(flat, '[' + K.MATH + K.GREEK + ']')} OR length({flat}) <= 2 OR NOT {m(flat, r'\p{L}')}))"),
        "text_image": (lambda X: K.is_text_image(X), f"(length({r(tag('x'), r'\s')}) >= 8)"),
        "gate": (lambda X: K.gate_says_text(F.col("id") % 40, F.col("id") % 11, F.col("id") % 60), "(id % 40 >= 25 OR id % 11 >= 8 OR id % 60 >= 40)"),
    },
)
plain = f"CASE WHEN contains(x, '<') THEN replace(replace(replace(replace(replace({r('x', '<[^>]+>')}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''') ELSE x END"
on_lines(
    "markup",
    {
        "joined": (lambda X: T.strip_tags(X), tag("x")),
        "closed": (lambda X: T.strip_tags(X, "close"), r(r(r("x", "<[^>]*>", ">"), "<[^>]*$"), ">", " ")),
        "plain": (lambda X: T.plain(X), plain),
        "unescaped": (lambda X: T.unescape_entities(X), un("x")),
        "inline": (lambda X: T.strip_inline(X), un(tag("x"))),
        "escaped": (lambda X: T.esc(X), "replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"),
        "escaped_text": (lambda X: T.esc_text(X), "replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"),
        "attribute": (lambda X: T.esc_attr(X), "replace(replace(replace(x, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;')"),
        "cell": (lambda X: T.md_cell(X), r(r"replace(replace(x, chr(10), ' '), '|', '\|')", r"^\s+|\s+$")),
        "unbold": (lambda X: T.strip_full_bold(X), f"CASE WHEN {e(trimmed, r'(?s)^\*\*(.+)\*\*$', 1)} <> '' AND NOT contains({e(trimmed, r'(?s)^\*\*(.+)\*\*$', 1)}, '**') THEN {e(trimmed, r'(?s)^\*\*(.+)\*\*$', 1)} ELSE {trimmed} END"),
    },
)
lab = f"CASE WHEN {m(trimmed, r'(?i)^(figure|fig\.|fig )')} AND {m(trimmed, '[:–-]')} THEN {r(trimmed, r'^[^:–-]*[:–-]')} ELSE {trimmed} END"
dashed = r(r(r(f"({lab})", r"^\s+|\s+$"), r"[^A-Za-z0-9]+", "-"), "^-")
on_lines(
    "slugs",
    {
        "slug": (lambda X: T.slug(X), r("x", r"[^A-Za-z0-9._-]", "-")),
        "section": (lambda X: T.section_slug(X), r("'sec-' || " + r("lower(x)", r"[^A-Za-z0-9._-]", "-"), r"^-+|-+$")),
        "number": (lambda X: T.num_id(X), "translate(replace(x, '.', '-'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
        "caption": (lambda X: T.caption_slug(X), r(f"lower(left({dashed}, 20))", r"^-+|-+$")),
        "title_key": (lambda X: T.title_key(X), r("lower(x)", r"[^\p{L}\p{N}]")),
        "demote_key": (lambda X: T.demote_key(X), f"trim({squash('lower(' + r(tag('x'), r'^\s*[\p{L}\p{N}.]*') + ')')})"),
        "anchor": (lambda X: T.md_anchor(F.concat(F.lit("#sec-"), X)), "'#' || x"),
    },
)
on_lines(
    "spaces",
    {
        "collapsed": (lambda X: T.collapse_ws(X), squash("x")),
        "normal": (lambda X: T.normalize_ws(X), f"trim({squash('x')})"),
        "squeezed": (lambda X: T.squeeze_blanks(F.concat(X, F.lit("  \n\n\n\n"), X, F.lit("\n\n"))), f"{r(r(r('x || chr(32) || chr(32) || chr(10) || chr(10) || chr(10) || chr(10) || x || chr(10) || chr(10)', r'(?m)[ \t]+$'), r'\n{3,}', chr(10) * 2), r'\n+$')} || chr(10)"),
        "word_like": (lambda X: T.word_like_count(X), f"len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '' AND len(regexp_extract_all(w, '[\\p{{L}}\\p{{N}}]')) >= 2))"),
        "proxy": (lambda X: T.token_proxy(X), "greatest(1, length(x) // 4)"),
        "wrapped": (lambda X: T.join_wrapped(F.concat(X, F.lit("ab-\ncd \n e"))), r(r("x || 'ab-' || chr(10) || 'cd ' || chr(10) || ' e'", r"(\p{L})[-\x{AD}][ \t]*\n[ \t]*(\p{Ll})", r"\1\2"), r"[ \t]*\n[ \t]*", " ")),
        "adjacent": (lambda X: T.glyph_adjacent((F.col("id") % 17 - 8).cast("double"), F.lit(10.0)), "(id % 17 - 8 <= 2 AND id % 17 - 8 >= -3.5)"),
    },
)
legible = "list_reduce(list_prepend(row(0, 0, 0), list_transform(regexp_extract_all(x, '[<>\\[\\]\\p{L}\\p{N}]'), lambda c: row(0, 0, 0))), lambda a, b: a)"
depth_free = r(r(r(r("x", r"<[^<>]*>"), r"\[[^\[\]]*\]"), r"\[[^\[\]]*\]"), r"[^\p{L}\p{N}]")
on_lines("legible", {"legible": (lambda X: K.legible_chars(X), f"length({depth_free})"), "outcome": (lambda X: K.ocr_outcome(K.legible_chars(X), F.lit(30)), f"CASE WHEN length({depth_free}) / 30.0 >= 0.5 THEN 'ocr_ok' WHEN length({depth_free}) / 30.0 >= 0.05 THEN 'ocr_partial' ELSE 'ocr_illegible' END")})


def garbled(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and the same without vowels, for every fifth id."""
    t = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("text", f"[{K.VOWELS}]", "")).otherwise(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source", t.alias("t"))
    producer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Scan "), "source")).otherwise(F.col("source"))
    docs = docs.withColumn("garbled", K.is_garbled(F.col("t")))
    bad = F.col("garbled")
    return docs.select("doc_id", "garbled", K.is_ocr_producer(producer).alias("producer"), K.ocr_decision(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 10) / 10, F.col("n_chars"), producer, bad).alias("decision"))


words_sql = "list_filter(list_transform(regexp_split_to_array(t, '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}]', '', 'g')), lambda w: length(w) >= 3)"
QUERIES["garbled"] = garbled
SQL["garbled"] = f"""
WITH d AS (SELECT doc_id, n_chars, trim(CASE WHEN doc_id % 5 = 0 THEN regexp_replace(text, '[{K.VOWELS}]', '', 'g') ELSE text END, ' ' || chr(10) || chr(9)) AS t,
                  CASE WHEN doc_id % 3 = 0 THEN 'Scan ' || source ELSE source END AS p FROM documents),
     w AS (SELECT *, {words_sql} AS ws FROM d),
     g AS (SELECT *, length(t) >= 200 AND (len(ws) >= 20 AND len(list_filter(ws, lambda w: NOT regexp_matches(w, '[{K.VOWELS}]'))) * 100 >= len(ws) * 18) AS garbled, regexp_matches(lower(p), '{K.PRODUCERS}') AS producer FROM w)
SELECT doc_id, garbled, producer, CASE WHEN doc_id % 2 <> 0 THEN 'not_needed' WHEN n_chars < 120 OR (doc_id % 10 >= 5 AND n_chars <= 900) THEN 'needs_ocr' WHEN producer OR garbled THEN 'drop_and_ocr' ELSE 'not_needed' END AS decision FROM g
"""

# ---- numbers

QUERIES["page_labels"] = lambda spark, d: table(spark, d, "customer").select(
    "c_custkey",
    N.page_label(F.array(*(F.lit(x) for x in ("D", "r", "R", "a", "A", "")))[(F.col("c_custkey") % 6).cast("int")], F.when(F.col("c_custkey") % 4 == 0, F.lit("p-")), F.col("c_custkey") % 130).alias("label"),
)
roman_sql = "repeat('m', CAST(n // 1000 AS INT)) || (['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'])[n // 100 % 10 + 1] || (['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'])[n // 10 % 10 + 1] || (['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'])[n % 10 + 1]"
alpha_sql = "CASE WHEN n > 0 THEN repeat(chr(CAST(97 + (n - 1) % 26 AS INT)), CAST((n - 1) // 26 + 1 AS INT)) ELSE '' END"
SQL["page_labels"] = f"""
WITH c AS (SELECT c_custkey, c_custkey % 130 AS n, c_custkey % 6 AS s, CASE WHEN c_custkey % 4 = 0 THEN 'p-' ELSE '' END AS p FROM customer),
     b AS (SELECT *, {roman_sql} AS ro, {alpha_sql} AS al FROM c)
SELECT c_custkey, nullif(p || CASE s WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN ro WHEN 2 THEN upper(ro) WHEN 3 THEN al WHEN 4 THEN upper(al) ELSE '' END, '') AS label FROM b
"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    x = F.col("l_quantity")
    a = N.box(x, x + 1, x + 20, x + 30)
    b = N.box(F.col("l_linenumber") * 7.0, F.lit(10.0), F.col("l_linenumber") * 7.0 + 25, F.col("l_discount") * 500)
    i, u, n = N.box_intersect(a, b), N.box_union(a, F.when(F.col("l_linenumber") != 1, b)), N.normalized_box(a, F.lit(100.0), F.lit(50.0))
    t = N.turned(x, F.col("l_tax") * 100, F.lit(200.0), F.lit(100.0), (F.col("l_linenumber") * 90).cast("int"))
    rows = li.select(i["x0"].alias("ix0"), i["y1"].alias("iy1"), u["x1"].alias("ux1"), N.overlap_area(a, b).alias("area"), N.box_contains(a, F.lit(30.0), F.lit(35.0)).alias("inside"), n["top"].alias("top"), t["x"].alias("tx"), t["y"].alias("ty"))
    return rows.groupBy("inside").agg(F.count("*").alias("n"), *(F.round(F.sum(c), 3).alias(c) for c in ("ix0", "iy1", "ux1", "area", "top", "tx", "ty")))


QUERIES["boxes"] = boxes
SQL["boxes"] = """
WITH l AS (SELECT l_quantity AS x, l_linenumber AS k, l_discount * 500 AS by1, l_tax * 100 AS y, l_linenumber * 7.0 AS bx0 FROM lineitem),
     r AS (SELECT greatest(x, bx0) AS ix0, least(x + 30, by1) AS iy1, CASE WHEN k = 1 THEN x + 20 ELSE greatest(x + 20, bx0 + 25) END AS ux1,
                  greatest(0, least(x + 20, bx0 + 25) - greatest(x, bx0)) * greatest(0, least(x + 30, by1) - greatest(x + 1, 10)) AS area,
                  30 BETWEEN x AND x + 20 AND 35 BETWEEN x + 1 AND x + 30 AS inside, least(1, greatest(0, 1 - (x + 30) / 50)) AS top,
                  CASE k * 90 % 360 WHEN 90 THEN y WHEN 180 THEN 200 - x WHEN 270 THEN 100 - y ELSE x END AS tx,
                  CASE k * 90 % 360 WHEN 90 THEN 200 - x WHEN 180 THEN 100 - y WHEN 270 THEN x ELSE y END AS ty FROM l)
SELECT inside, count(*) AS n, round(sum(ix0), 3) AS ix0, round(sum(iy1), 3) AS iy1, round(sum(ux1), 3) AS ux1, round(sum(area), 3) AS area, round(sum(top), 3) AS top, round(sum(tx), 3) AS tx, round(sum(ty), 3) AS ty FROM r GROUP BY inside
"""
del legible
