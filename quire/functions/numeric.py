"""Column functions over numbers, boxes, labels and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of Roman numerals, largest first.
_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: Column, upper: bool = False) -> Column:
    """Roman numeral; empty for 0 and below."""
    digit = lambda place: F.floor(n / place) % 10
    out = F.repeat(F.lit("m"), F.greatest(F.floor(n / 1000), F.lit(0)).cast("int"))
    for place, (one, five, ten) in ((100, "cdm"), (10, "xlc"), (1, "ivx")):
        names = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        out = F.concat(out, F.array(*(F.lit(x) for x in names))[digit(place).cast("int")])
    out = F.when(n > 0, out).otherwise("")
    return F.upper(out) if upper else out


def alpha(n: Column, upper: bool = False) -> Column:
    """a..z, then the letter twice, three times and so on; empty for 0 and below."""
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ" if upper else "abcdefghijklmnopqrstuvwxyz"), ((n - 1) % 26 + 1).cast("int"), F.lit(1))
    return F.when(n > 0, F.repeat(letter, (F.floor((n - 1) / 26) + 1).cast("int"))).otherwise("")


def page_label(style: Column, prefix: Column, value: Column) -> Column:
    """Label of a page in a range of labels: style D, r, R, a, A or none; null if nothing is left."""
    body = F.when(style == "D", value.cast("string")).when(style == "r", roman(value)).when(style == "R", roman(value, True)).when(style == "a", alpha(value)).when(style == "A", alpha(value, True)).otherwise("")
    return F.nullif(F.concat(F.coalesce(prefix, F.lit("")), body), F.lit(""))


# ---- boxes: structs x0, y0, x1, y1


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def box_intersect(a: Column, b: Column) -> Column:
    """May be turned inside out when the boxes are apart."""
    return box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def box_union(a: Column, b: Column) -> Column:
    """The smallest box around both; a null box adds nothing."""
    both = box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def overlap_area(a: Column, b: Column) -> Column:
    i = box_intersect(a, b)
    return F.greatest(F.lit(0.0), i["x1"] - i["x0"]) * F.greatest(F.lit(0.0), i["y1"] - i["y0"])


def box_contains(a: Column, x: Column, y: Column) -> Column:
    return x.between(a["x0"], a["x1"]) & y.between(a["y0"], a["y1"])


def turned(x: Column, y: Column, w: Column, h: Column, rotate: Column) -> Column:
    """A point of a w by h page after a turn of 0, 90, 180 or 270 degrees, as struct x, y."""
    r = (rotate % 360 + 360) % 360
    nx = F.when(r == 90, y).when(r == 180, w - x).when(r == 270, h - y).otherwise(x)
    ny = F.when(r == 90, w - x).when(r == 180, h - y).when(r == 270, x).otherwise(y)
    return F.struct(nx.alias("x"), ny.alias("y"))


def normalized_box(b: Column, w: Column, h: Column) -> Column:
    """left, top, right, bottom as fractions of the page, the origin at the top."""
    cut = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return F.struct(cut(b["x0"] / w).alias("left"), cut(1 - b["y1"] / h).alias("top"), cut(b["x1"] / w).alias("right"), cut(1 - b["y0"] / h).alias("bottom"))


def from_unit_box(b: Column, w: Column, h: Column) -> Column:
    """A box in fractions with the origin at the top, in points with the origin at the bottom."""
    return box(b["x0"] * w, (1 - b["y1"]) * h, b["x1"] * w, (1 - b["y0"]) * h)


def width_or_estimate(width: Column, text: Column, size: Column) -> Column:
    return F.when(width > 0, width).otherwise(F.length(text) * size * 0.5)


def affine(m: Column, x: Column, y: Column) -> Column:
    """A point through the matrix struct a, b, c, d, e, f."""
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def upper_median(values: Column) -> Column:
    """The upper one of the two middle values; values is an array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


# ---- vectors: array<float or double>


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def pack_vector(v: Column) -> Column:
    """Little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(v)


def unpack_vector(b: Column, dimension: int) -> Column:
    """The inverse; a payload of another size is an error."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            if len(x) != 4 * dimension:
                raise ValueError(f"{len(x)} bytes are not {dimension} floats")
            return np.frombuffer(x, "<f4")

        return s.map(one)

    return run(b)


def printed(v: Column, places: int) -> Column:
    """The numbers of an array with so many decimals, rounded as C does: by their exact value, halves to even. Nulls stay."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [None if y is None else f"{y:.{places}f}" for y in x])

    return run(v)
