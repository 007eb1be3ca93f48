"""Operators over ordered rows: islands, running heads, medians, gaps, bands, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import classify as K
from quire.functions import text as T


def islands(rows: DataFrame, by: list[str], order: str, same: Column) -> DataFrame:
    """rows with island: a new number wherever same (of a row, against the one before) isn't true."""
    w = Window.partitionBy(*by).orderBy(order)
    first = F.lag(F.lit(True)).over(w).isNull()
    return rows.withColumn("island", F.sum(F.when(first | ~F.coalesce(same, F.lit(False)), 1).otherwise(0)).over(w))


def merge_runs(blocks: DataFrame, member: Column, least: int = 2, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*by, ord, n, text): runs of at least `least` neighbouring members become one row, joined by spaces; other rows stay."""
    w = Window.partitionBy(*by).orderBy("ord")
    rows = blocks.withColumn("member", F.coalesce(member, F.lit(False)))
    marked = islands(rows, list(by), "ord", F.col("member") & F.lag("member").over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    whole = marked.groupBy(*by, "island").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), parts.alias("texts"))
    if least <= 2:
        return whole.select(*by, "ord", "n", F.array_join("texts", " ").alias("text"))
    short = whole.where(F.col("n") < least).select(*by, F.posexplode("texts").alias("at", "text"), "ord").select(*by, (F.col("ord") + F.col("at")).alias("ord"), F.lit(1).cast("long").alias("n"), "text")
    return whole.where(F.col("n") >= least).select(*by, "ord", "n", F.array_join("texts", " ").alias("text")).unionByName(short)


def merge_math_fragments(blocks: DataFrame) -> DataFrame:
    """Runs of two or more paragraphs that are pieces of formulas become one."""
    return merge_runs(blocks, (F.col("kind") == "para") & K.is_math_fragment(F.col("text")))


def demote_running_heads(blocks: DataFrame, least: int = 3) -> DataFrame:
    """Headings whose key occurs `least` times or more become paragraphs, but for the first heading of level 1 with that key."""
    key = F.when(F.col("kind") == "heading", T.demote_key(F.col("text")))
    b = blocks.withColumn("key", key)
    long = F.octet_length("key") >= 4
    b = b.withColumn("times", F.when(long, F.count("key").over(Window.partitionBy("doc_id", "key"))))
    top = F.col("heading_level") == 1
    b = b.withColumn("first_top", F.min(F.when(top, F.col("ord"))).over(Window.partitionBy("doc_id", "key")))
    demote = (F.col("kind") == "heading") & (F.coalesce("times", F.lit(0)) >= least) & ~F.coalesce(top & (F.col("ord") == F.col("first_top")), F.lit(False))
    return b.withColumn("demoted", demote).withColumn("kind", F.when(demote, "para").otherwise(F.col("kind"))).withColumn("heading_level", F.when(~demote, F.col("heading_level"))).drop("key", "times", "first_top")


def colon_lists(lines: DataFrame, reach: int = 24) -> DataFrame:
    """lines with in_list: numbered items under a line that ends in a colon, or later in the numbered run of such an item.

    The run is walked back by number over the `reach` lines on either side.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    x = lines.withColumn("n", K.ordered_num(F.col("text"))).withColumn("under", F.coalesce(F.regexp_replace(F.lag("text").over(w), r"\s+$", "").endswith(":"), F.lit(False)))
    near = F.collect_list(F.struct("ord", "n", "under")).over(w.rowsBetween(-reach, reach - 1))
    x = x.withColumn("near", F.when(F.col("n").isNotNull(), F.filter(near, lambda r: r["n"].isNotNull())))
    has = lambda k: F.exists("near", lambda r: r["n"] == k)
    back = F.aggregate(F.sequence(F.lit(1), F.lit(2 * reach)), F.col("n"), lambda first, _: F.when((first > 1) & has(first - 1), first - 1).otherwise(first))
    x = x.withColumn("first", F.when(F.col("n").isNotNull(), back))
    led = F.element_at(F.transform(F.array_sort(F.filter("near", lambda r: r["n"] == F.col("first"))), lambda r: r["under"]), 1)
    return x.withColumn("in_list", F.coalesce(F.col("n").isNotNull() & (F.col("under") | ((F.col("first") < F.col("n")) & led)), F.lit(False))).drop("near", "first", "under")


def enumerated_runs(lines: DataFrame, before: int = 8, after: int = 15, least: int = 3) -> DataFrame:
    """lines with in_run: plain numbered items whose numbers are part of `least` or more consecutive ones nearby.

    Items with an early colon (within 45 characters) are labelled headings and don't count.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    n = F.when(~F.contains(F.substring("text", 1, 45), F.lit(":")), K.ordered_num(F.col("text")))
    x = lines.withColumn("n", n)
    x = x.withColumn("near", F.collect_set("n").over(w.rowsBetween(-before, after)))
    has = lambda k: F.array_contains("near", k)
    walk = lambda sign: F.aggregate(F.sequence(F.lit(1), F.lit(before + after)), F.lit(0), lambda k, _: F.when(has(F.col("n") + sign * (k + 1)), k + 1).otherwise(k))
    run = F.when(F.col("n").isNotNull(), 1 + walk(-1) + walk(1))
    return x.withColumn("in_run", F.coalesce(run >= least, F.lit(False))).drop("near")


def toc_lines(lines: DataFrame, reach: int = 3) -> DataFrame:
    """lines with in_toc: captions whose own line, or one of the next few, ends in leader dots."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(0, reach)
    dots = F.max(K.dotleader_tail(F.col("text")).cast("int")).over(w) == 1
    return lines.withColumn("in_toc", K.is_caption(F.col("text")) & dots)


def first_of(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first row of each key in order (a distinct that keeps which)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def notes(lines: DataFrame) -> DataFrame:
    """(doc_id, note, n_lines, text): lines grouped into notes, a new one at each leading number of one or two digits."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    x = lines.withColumn("note", F.sum(F.col("text").rlike(r"^\s*[0-9]{1,2}[.)]?\s").cast("int")).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"])
    return x.groupBy("doc_id", "note").agg(F.count("*").alias("n_lines"), F.array_join(parts, " ").alias("text"))


# ---- numbers along a line


def widest_gap(spans: DataFrame, by: str) -> DataFrame:
    """(by, gap, at): the widest hole in the union of the intervals lo..hi; no row for a key without a hole."""
    w = Window.partitionBy(by).orderBy("lo", "hi")
    x = spans.withColumn("edge", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("lo > edge")
    x = x.withColumn("gap", F.col("lo") - F.col("edge"))
    return x.groupBy(by).agg(F.max("gap").alias("gap"), F.min_by("edge", F.struct(-F.col("gap"), "edge")).alias("at"))


def column_bands(spans: DataFrame, by: str, bridge: int) -> DataFrame:
    """(by, lo, hi): bands where more than `bridge` intervals overlap: a sweep over starts and ends."""
    ends = spans.select(by, F.col("lo").alias("x"), F.lit(1).alias("d")).unionAll(spans.select(by, F.col("hi").alias("x"), F.lit(-1).alias("d")))
    steps = ends.groupBy(by, "x").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(by).orderBy("x")
    cover = steps.withColumn("c", F.sum("d").over(w)).withColumn("next", F.lead("x").over(w)).where("next is not null").withColumn("in", F.col("c") > bridge)
    marked = islands(cover, [by], "x", F.col("in") & F.lag("in").over(w)).where("in")
    return marked.groupBy(by, "island").agg(F.min("x").alias("lo"), F.max("next").alias("hi")).drop("island")


def pitch_breaks(rows: DataFrame, by: str, factor: float = 2.5, least: int = 2) -> DataFrame:
    """(by, y): rows before a gap of factor times the (upper) median gap, with `least` rows on both sides; y falls down the page."""
    w = Window.partitionBy(by).orderBy(F.col("y").desc())
    x = rows.withColumn("gap", F.col("y") - F.lead("y").over(w)).withColumn("n", F.row_number().over(w)).withColumn("all", F.count("*").over(Window.partitionBy(by)))
    mid = x.groupBy(by).agg(F.array_sort(F.collect_list("gap")).alias("g")).select(by, F.get("g", F.floor(F.size("g") / 2).cast("int")).alias("median"))
    return x.join(mid, by).where((F.col("gap") >= factor * F.col("median")) & (F.col("n") >= least) & (F.col("all") - F.col("n") >= least)).select(by, "y")


def weighted_median(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """The smallest value at which half of the weight is reached."""
    w = Window.partitionBy(by)
    x = rows.withColumn("upto", F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum(weight).over(w))
    return x.where(F.col("upto") * 2 >= F.col("all")).groupBy(by).agg(F.min(value).alias("median"))


def author_notes(names: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, name, affiliation): names(doc_id, name, marks array) and places(doc_id, mark, place) by equal marks, joined by '; '."""
    hit = names.select("doc_id", "name", F.posexplode("marks").alias("n", "mark")).join(places, ["doc_id", "mark"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "place"))), lambda x: x["place"])
    return names.select("doc_id", "name").join(hit.groupBy("doc_id", "name").agg(F.array_join(parts, "; ").alias("affiliation")), ["doc_id", "name"], "left")


def outline_links(outline: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, n, title, heading): each outline entry's heading, by equal title keys, else the first heading of eight or more
    characters whose key begins the entry's.

    Each key is sought once a document, and of the headings with one key only the
    first counts. The second kind is an equi join too: by a hash of the key's
    beginnings, of the lengths that the document's headings have.
    """
    o = outline.select("doc_id", "n", "title", T.title_key(F.col("title")).alias("key"))
    keys = o.select("doc_id", "key").distinct()
    h = headings.select("doc_id", T.title_key(F.col("title")).alias("hkey"), "ord", F.col("id").alias("heading"))
    first = h.groupBy("doc_id", "hkey").agg(F.min(F.struct("ord", "heading")).alias("m"))
    exact = keys.join(first.withColumnRenamed("hkey", "key"), ["doc_id", "key"]).select("doc_id", "key", F.struct(F.lit(0).alias("rank"), "m").alias("m"))
    long = first.where(F.octet_length("hkey") >= 8).select("doc_id", F.length("hkey").alias("l"), F.xxhash64("hkey").alias("hash"), "hkey", "m")
    lengths = long.groupBy("doc_id").agg(F.collect_set("l").alias("ls"))
    starts = keys.join(lengths, "doc_id").select("doc_id", "key", F.explode(F.filter("ls", lambda l: l <= F.length("key"))).alias("l"))
    starts = starts.withColumn("hash", F.xxhash64(F.substring(F.col("key"), F.lit(1), F.col("l"))))
    loose = starts.join(long, ["doc_id", "l", "hash"]).where(F.startswith(F.col("key"), F.col("hkey"))).select("doc_id", "key", F.struct(F.lit(1).alias("rank"), "m").alias("m"))
    best = exact.unionAll(loose).groupBy("doc_id", "key").agg(F.min("m")["m"]["heading"].alias("heading"))
    return o.join(best, ["doc_id", "key"], "left").select("doc_id", "n", "title", "heading")
