"""Literal cases of the verdicts and folds that SQL covers only in part, and that the queries' inputs tell something."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quire.operators import detect as D
from quire.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize(("name", "column", "least"), [("grid_verdict", "verdict", 7), ("detect_headings", "kind", 4), ("group_spans", "spans", 3), ("central_split", "may_span", 2), ("figure_clusters", "grade", 2)])
def test_answers_differ(spark, name, column, least):
    assert registry.queries()[name](spark, SF).select(column).distinct().count() >= least


@pytest.mark.parametrize(
    ("grid", "verdict"),
    [
        ([["one two three four five", "six seven eight nine ten"]], "prose-2col"),
        ([["a", "=", "b"], ["c", "+", "(2)"]], "equation"),
        ([["α=0.90", "Model"], ["0.91", "27450"], ["0.31", "120"]], None),
        ([["1 1 2", "= 1 1 2"], ["x (3.1)", "+ y"]], "equation"),
        ([["W", "D"], ["Y", "W"]], "matrix"),
        ([["X", "→", "Y"], ["1", "2", "3"]], "diagram"),
        ([["Name", "n"], ["one", "27450"]], None),
        ([], None),
        ([[]], None),
        ([[None, "word"], ["word"]], None),
    ],
)
def test_grid_verdict(spark, grid, verdict):
    df = spark.createDataFrame([(grid,)], "g array<array<string>>")
    assert df.select(D.grid_verdict(F.col("g"))).head()[0] == verdict


def test_outside_brackets(spark):
    rows = [("a(b(c)d)e", "ae"), ("1(x", "1"), ("1)2(3)4", "124"), ("", ""), ("((x)", "")]
    got = spark.createDataFrame(rows, "t string, want string").select(D.outside_brackets(F.col("t")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize(
    ("runs", "size", "tier", "want"),
    [
        ([("3.1 Method", False)], 10.0, None, (2, 1, "reliable")),
        ([("2 ", True), ("Bold lead. ", True), ("The body goes on", False)], 10.0, None, (1, 2, "reliable")),
        ([("2 We do not show", False)], 8.0, None, None),
        ([("158 GeV at 95% Confidence", False)], 10.0, None, None),
        ([("0.3 Behind the model. This is", False)], 10.0, None, None),
        ([("Abstract.", False)], 10.0, None, (1, 1, "reliable")),
        ([("Appendix ", True), ("B", True), (" Proofs", False)], 10.0, None, (1, 3, "reliable")),
        ([("Appendix E. ", True), ("The resulting values are arranged in the way", False)], 10.0, None, (1, 1, "reliable")),
        ([("PART II Items", False)], 10.0, None, (1, 1, "reliable")),
        ([("Results and More", True)], 10.0, None, (3, 1, "style")),
        ([("Results and More", False)], 16.0, None, (1, 1, "style")),
        ([("Results and More:", False)], 10.0, 2, (2, 1, "style")),
        ([("Results and More", False)], 10.0, None, None),
        ([("Encoder:", True), (" The encoder", False)], 10.0, None, (3, 1, "run-in")),
        ([("B", True), ("ut then", False)], 10.0, None, None),
        ([("Theorem 1.1.", True)], 10.0, None, None),
        ([("The ATLAS Collaboration", True)], 10.0, None, None),
        ([("• Mineral resources", True)], 10.0, None, None),
        ([("∂ t ∂ z", True)], 10.0, None, None),
        ([("J. Cui, H. Yan", True)], 10.0, None, None),
        ([("9 Total income ....... 9", True)], 10.0, None, None),
        ([("  ", True)], 10.0, None, None),
        ([], 10.0, None, None),
    ],
)
def test_detect_headings(spark, runs, size, tier, want):
    lines = spark.createDataFrame([(runs, size, 10.0, tier)], "runs array<struct<text:string,bold:boolean>>, size double, body double, tier int")
    got = D.detect_headings(lines).head()
    assert (None if got.kind is None else (got.level, got.n_runs, got.kind)) == want


def test_headings_keep_other_columns(spark):
    lines = spark.createDataFrame([(7, [("Abstract", False)], 10.0, 10.0, None)], "id long, runs array<struct<text:string,bold:boolean>>, size double, body double, tier int")
    assert D.detect_headings(lines).columns == ["id", "runs", "size", "body", "tier", "level", "n_runs", "kind"]


def lattice(xs, ys):
    return [(x, [(ys[0], ys[-1])]) for x in xs], [(y, [(xs[0], xs[-1])]) for y in ys]


def test_frames():
    vs, hs = lattice([0.0, 40.0, 80.0], [0.0, 20.0, 40.0])
    assert D.frames_of(vs, hs) == [([0.0, 40.0, 80.0], [0.0, 20.0, 40.0])]
    assert D.frames_of(vs[:2], hs) == []  # a file of boxes
    assert D.frames_of(vs, hs[:2]) == []  # a strip
    assert D.frames_of([], []) == []
    # a rule that ends short leaves its cells open: three are left, too few
    short = [hs[0], hs[1], (40.0, [(0.0, 40.0)])]
    assert D.frames_of(vs, short) == []
    # a band without inner verticals between two parts of one table
    ys = [0.0, 20.0, 40.0, 60.0, 80.0, 100.0]
    inner = (40.0, [(0.0, 40.0), (60.0, 100.0)])
    assert D.frames_of([(0.0, [(0.0, 100.0)]), inner, (80.0, [(0.0, 100.0)])], [(y, [(0.0, 80.0)]) for y in ys]) == [([0.0, 40.0, 80.0], ys)]


def test_longest_lines():
    lines = [(0.0, [(0.0, 5.0)]), (1.0, [(0.0, 3.0), (4.0, 9.0)]), (2.0, [(0.0, 1.0)]), (3.0, [(0.0, 5.0)])]
    assert [p for p, _ in D.longest(lines, 2)] == [0.0, 1.0] and D.longest(lines, 9) == lines and D.longest([], 2) == []


def test_frames_far_apart(spark):
    rules = []
    for base in (0.0, 500.0):
        rules += [("v", x, base, base + 40) for x in (0.0, 40.0, 80.0)] + [("h", base + y, 0.0, 80.0) for y in (0.0, 20.0, 40.0)]
    df = spark.createDataFrame([(1, 1, *r) for r in rules], "doc_id int, page int, axis string, p double, lo double, hi double")
    got = sorted((r.frame, r.ys) for r in D.frames(df).collect())
    assert got == [(0, [500.0, 520.0, 540.0]), (1, [0.0, 20.0, 40.0])]


def test_graphic_ink(spark):
    rows = [
        ([("M", 0.0, 0.0), ("L", 9.0, 0.0), ("L", 9.0, 9.0), ("Z", None, None)], True),  # the closing edge is slanted
        ([("M", 0.0, 0.0), ("L", 9.0, 0.0), ("L", 9.0, 9.0), ("L", 0.0, 9.0), ("Z", None, None)], False),
        ([("M", 0.0, 0.0), ("C", 1.0, 1.0)], True),
        ([("M", 0.0, 0.0), ("M", 9.0, 9.0), ("L", 9.0, 20.0)], False),
        ([("L", 5.0, 5.0)], False),
        ([], False),
    ]
    df = spark.createDataFrame(rows, "segs array<struct<op:string,x:double,y:double>>, want boolean")
    got = df.select(D.graphic_ink(F.col("segs")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize("b", [b"", b"plain", b"\xfe\xff", b"\xfe\xff\x00a\xd8\x3d\xde\x00", b"\xfe\xff\xd8\x00\xd8\x3d\xde\x00\xde\x00", b"\xfe\xff\xdc\x00\x00a\x00", b"\xe9\xa1"])
def test_decode_text(spark, b):
    want = b[2:].decode("utf-16-be", "replace") if b[:2] == b"\xfe\xff" and len(b) % 2 == 0 else None
    got = spark.createDataFrame([(bytearray(b),)], "b binary").select(D.decode_text(F.col("b"))).head()[0]
    assert got == (b.decode("latin-1") if b[:2] != b"\xfe\xff" else want if want is not None else "�a")


def test_cmap_and_widths(spark):
    cmaps = [(1, "1 beginbfrange <0000> <FFFFFFFF> <0041> endbfrange"), (2, "beginbfchar <01> <0041> endbfchar beginbfrange <01> <01> [<0042>] endbfrange"), (3, ""), (4, None), (5, "beginbfrange <05> <04> <0041> <06> <06> <> endbfrange"), (6, "beginbfrange <00> <02> <D7FF> endbfrange")]
    got = D.cmap_entries(spark.createDataFrame(cmaps, "id int, cmap string"), "id")
    assert got.where("id = 1").count() == 65536 - 2048 and {(r.id, r.code, r.text) for r in got.where("id > 1").collect()} == {(2, 1, "B"), (6, 0, "퟿")}
    w = spark.createDataFrame([(1, "3 [1 2] 4 6 7.5"), (2, ""), (3, None), (4, "9 8 5")], "id int, w string")
    assert {(r.id, r.cid, r.width) for r in D.cid_widths(w, "id").collect()} == {(1, 3, 1.0), (1, 4, 7.5), (1, 5, 7.5), (1, 6, 7.5)}


def test_shared_baselines():
    import numpy as np

    one, apart = (np.array([10.0, 10.2]), np.array([10.1])), (np.array([10.0]), np.array([12.0]))
    none = (np.array([10.0]), np.array([]))
    assert D.shared_baselines([apart] * 3, 10.0) and D.shared_baselines([one] * 2 + [apart] * 2, 10.0) and D.shared_baselines([none] * 9, 10.0)
    assert not D.shared_baselines([one] + [apart] * 3, 10.0)


@pytest.mark.parametrize(("n", "width", "text", "lower", "want"), [(6, 200.0, "four words in here", 0.0, (True, False)), (6, 200.0, "a cell", 0.0, None), (6, 200.0, "a cell", 3.0, (True, False)), (5, 200.0, "four words in here", 0.0, None), (6, 450.0, "four words in here", 0.0, None)])
def test_central_split(spark, n, width, text, lower, want):
    spans = [(1, 1, 2 * i + s, 50.0 + 270 * s, 700.0 - 14 * i - lower * s, 10.0, width, text, 0.0) for i in range(n) for s in (0, 1)]
    df = spark.createDataFrame(spans, "doc_id int, page int, n long, x double, y double, size double, width double, text string, angle double")
    got = D.central_split(df).collect()
    assert [(250.0 < r.gutter < 320.0, r.may_span) for r in got] == ([want] if want else [])


def test_group_band():
    xs, ys = [0.0, 40.0, 80.0, 120.0, 160.0], [0.0, 20.0, 40.0]
    whole = [(0.0, 60.0)]
    vs = [(x, whole if x in (0.0, 80.0, 160.0) else [(0.0, 40.0)]) for x in xs]
    hs = [(y, [(0.0, 160.0)]) for y in (*ys, 60.0)]
    assert D.group_band(xs, ys, vs, hs) == (60.0, [0, 2, 4])
    assert D.group_band(xs, ys, vs, hs[:3]) is None  # no line above
    assert D.group_band(xs, ys, [(x, whole) for x in xs], hs) is None  # groups of one column
    assert D.group_band(xs, ys, [*vs, (100.0, [(42.0, 55.0)])], hs) is None  # a vertical that ends within
    assert D.group_band(xs, ys, vs, [*hs[:3], (60.0, [(0.0, 100.0)])]) is None  # a short line above
    two = [(x, [(0.0, 80.0)] if x in (0.0, 80.0, 160.0) else [(0.0, 40.0)]) for x in xs]
    assert D.group_band(xs, ys, two, [*hs, (80.0, [(0.0, 160.0)])]) is None  # a second band


def test_rules_of_open_and_curved_paths(spark):
    seg = "array<struct<op:string,x:double,y:double>>"
    rows = [
        (1, 1, 0.0, 0.0, 50.0, 50.0, False, True, [("M", 0.0, 0.0), ("L", 50.0, 0.5), ("L", 20.0, 50.0), ("Z", None, None)]),
        (2, 1, 0.0, 0.0, 50.0, 50.0, False, True, [("M", 0.0, 0.0), ("C", 50.0, 9.0), ("L", 50.0, 50.0)]),
        (3, 1, 0.0, 0.0, 50.0, 2.0, True, False, [("M", 0.0, 0.0)]),
        (4, 1, 0.0, 0.0, 5.0, 2.0, True, True, []),
        (5, 1, 0.0, 0.0, 50.0, 2.0, False, False, None),
    ]
    paths = spark.createDataFrame(rows, f"doc_id long, page int, x0 double, y0 double, x1 double, y1 double, filled boolean, stroked boolean, segs {seg}")
    got = sorted((r.doc_id, r.axis, r.p, r.lo, r.hi) for r in D.rules_of(paths).collect())
    assert got == [(1, "h", 0.25, 0.0, 50.0), (2, "v", 50.0, 9.0, 50.0), (3, "h", 1.0, 0.0, 50.0)]
    assert D.rules_of(paths.limit(0)).count() == 0
