"""Literal cases of the column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import classify as K
from quire.functions import numeric as N
from quire.functions import text as T


def value(spark, wanted, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(columns.values())], [*names]).select(wanted).head()[0]


@pytest.mark.parametrize(("brk", "want"), [("join", "ABab"), ("open", " A  B ab"), ("close", " A  B a b")])
def test_strip_tags(spark, brk, want):
    assert value(spark, T.strip_tags(F.col("x"), brk), x="<td>A</td><td>B</td>a>b<unclosed") == (want + " " if brk == "open" else want.replace("  ", "  "))


CASES = [
    (T.plain, "a &amp; b", "a &amp; b"),
    (T.plain, "<b>x</b> &amp;lt;", "x <"),
    (T.strip_inline, "<b>x</b> &amp;lt;", "x &lt;"),
    (T.collapse_ws, " a \t\n b ", " a b "),
    (T.normalize_ws, "  a \n b ", "a b"),
    (T.slug, "cite.de vlin_é", "cite.de-vlin_-"),
    (T.section_slug, "É 1. Intro!", "sec---1.-intro"),
    (T.num_id, "6.2.1A", "6-2-1a"),
    (T.caption_slug, "Figure 5.7: The Grand Overview of Things", "the-grand-overview-o"),
    (T.title_key, "Smart “Quotes”, 2", "smartquotes2"),
    (T.demote_key, "12 A  Title", "a title"),
    (T.demote_key, "Introduction here", "here"),
    (T.token_proxy, "abc", 1),
    (T.word_like_count, "a bb 1 c3 --", 2),
    (T.strip_full_bold, "**a**", "a"),
    (T.strip_full_bold, "**a** b **c**", "**a** b **c**"),
    (T.md_anchor, "#sec-x", "#x"),
    (T.squeeze_blanks, "a  \n\n\n\nb\n\n", "a\n\nb\n"),
    (T.join_wrapped, "exam-\nple of\nlines", "example of lines"),
    (T.visible_text, "<p>a<svg><text>no</text></svg></p><p>b &amp; c</p>", "a b & c"),
    (K.caption_number, "Figure 6.2.1: x", "6.2.1"),
    (K.caption_number, "Fig. 1A x", "1A"),
    (K.caption_number, "Table 1 Plot", "1"),
    (K.caption_number, "Cuadro 0.1-1. y", "0.1-1"),
    (K.caption_number, "Figures", None),
    (K.caption_label, "Table 3: x", "Table 3"),
    (K.is_inline_xref, "Figure 2 shows x", True),
    (K.is_inline_xref, "Figure 4 Overview of x", False),
    (K.is_inline_xref, "Fig 4b) shows", True),
    (K.is_inline_xref, "Table 2 also shows", True),
    (K.opens_figure_caption, "Figure B.1. x", True),
    (K.caption_is_continued, "Table 2 (continued)", True),
    (K.caption_is_continued, "Figure 5. Continuation of it", False),
    (K.dotleader_tail, "Overview . . . . 95", True),
    (K.dotleader_tail, "A title… 9", False),
    (K.list_ordered, "• x", False),
    (K.list_ordered, "− 1", None),
    (K.list_ordered, "12) y", True),
    (K.list_ordered, "3.1 z", None),
    (K.list_ordered, "2014) z", None),
    (K.strip_marker, "12) y", "y"),
    (K.numbered_level, "2.1.3 Title", 3),
    (K.numbered_level, "28.4", None),
    (K.numbered_level, "A.2 Proof", 2),
    (K.roman_section, "IV. Methods", 1),
    (K.sec_anchor, "Item 1A. Risk", 2),
    (K.sec_anchor, "PART II", 1),
    (K.sec_anchor, "Part I of form", None),
    (K.looks_like_reference, "Levoy, M., x", True),
    (K.looks_like_reference, "System Architecture", False),
    (K.looks_like_clause, "158 GeV at level", True),
    (K.looks_like_clause, "1. Introduction", False),
    (K.looks_like_clause, "a thing of", True),
    (K.is_axis_label, "Vp (m/s) 1000 2000", True),
    (K.is_math_fragment, "x = 3", True),
    (K.is_math_fragment, "real prose words", False),
    (K.is_ocr_producer, "ABBYY FineReader", True),
    (K.legible_chars, "<loc_1>ab[unclear [x]]c>", 3),
    (K.doctags_level, "3.1.2 Title", 3),
    (K.doctags_level, "ALL CAPS HEAD", 1),
    (K.doctags_level, "plain line", None),
]


@pytest.mark.parametrize(("function", "given", "want"), CASES, ids=lambda x: getattr(x, "__name__", None))
def test_cases(spark, function, given, want):
    assert value(spark, function(F.col("x")), x=given) == want


@pytest.mark.parametrize(("image", "cover", "n", "producer", "bad", "want"), [(False, 0.9, 0, "scan", True, "not_needed"), (True, 0.1, 50, "", False, "needs_ocr"), (True, 0.6, 800, "", False, "needs_ocr"), (True, 0.1, 2000, "Kofax", False, "drop_and_ocr"), (True, 0.1, 2000, "TeX", True, "drop_and_ocr"), (True, 0.1, 2000, "TeX", False, "not_needed")])
def test_ocr_decision(spark, image, cover, n, producer, bad, want):
    assert value(spark, K.ocr_decision(*(F.col(c) for c in "abcde")), a=image, b=cover, c=n, d=producer, e=bad) == want


def test_labels_and_vectors(spark):
    assert [value(spark, N.roman(F.col("n")), n=i) for i in (1, 4, 9, 40, 1994)] == ["i", "iv", "ix", "xl", "mcmxciv"]
    assert [value(spark, N.alpha(F.col("n"), True), n=i) for i in (1, 26, 27, 53)] == ["A", "Z", "AA", "AAA"]
    assert value(spark, N.l2_normalize(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert value(spark, T.data_uri(F.col("x"))["ext"], x="data:image/png;base64,QUJD") == "png"
    assert value(spark, T.data_uri(F.col("x")), x="data:text/plain,hello") is None
    assert value(spark, T.table_md(F.col("c")), c=[["a", "b|"], ["c"]]) == "| a | b\\| |\n| --- | --- |\n| c |  |"
