"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask picks some of the tokens of a window and ignores the others, so a seed
survives substitutions at the ignored places. The seeds of the benchmark (with
item and place) are the small side: while there are at most MOST of them they
are broadcast and a document's seeds are looked up where it is read; beyond
that, the join is shuffled. Each hit gives an alignment of document and item,
and the verification compares all tokens of the item along it: no token may be
inserted or deleted, but up to a fifth may differ. Where parts of items count
too, matches around the hits of alignments near each other are joined, so that
inserted and deleted tokens and items cut short don't hide an overlap.

Texts never move: everything up to the verified pairs happens in the scan's
stage, and only (document, item, start) triples are grouped. Documents with a
hit are read once more for the verification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Places of a window that count (1). Of five tokens or more with a fifth changed, one of these masks finds
#: four: either four in a row are left, or all runs are of at most three, which only leaves 5 to 7, 10, 11
#: and 15 tokens, where the others find them (tests try all patterns). From seven tokens on the first two do.
SEEDS = ("1111", "11101", "11011", "10111")
#: Seeds of a benchmark, or hits, that may be broadcast: 24 bytes each.
MOST = 1_000_000
#: Tokens of the shortest part of an item that counts as an overlap, where parts count.
PART = 13
#: Tokens that may be inserted or deleted between the pieces of one overlap.
DRIFT = 8
# What parts words: all but letters and digits.
_BETWEEN = "[^\\\\p{L}\\\\p{N}]+"


def _tokens(column: str) -> str:
    """64-bit hashes of the lower-cased words of a text; none for null."""
    return f"transform(filter(split(lower(coalesce({column}, '')), '{_BETWEEN}'), w -> w <> ''), w -> xxhash64(w))"


def _windows(rows: DataFrame, h: str, keep: list[str], span: int) -> DataFrame:
    """A row for each place i of the array h with the span hashes from there, c0 and so on (null beyond the end)."""
    cols = [F.expr(f"slice({h}, {k + 1}, size({h}))").alias(f"c{k}") for k in range(span)]
    shifted = rows.select(*keep, *cols)
    at = shifted.select(*keep, F.posexplode(F.arrays_zip(*(f"c{k}" for k in range(span)))).alias("i", "w"))
    return at.select(*keep, "i", *(F.col(f"w.c{k}").alias(f"c{k}") for k in range(span)))


def _keys(masks: list[str]) -> Column:
    """One hash for each mask, null where the window passes the end."""
    return F.array(*(F.when(F.col(f"c{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(k), *(F.col(f"c{p}") for p, c in enumerate(m) if c == "1"))) for k, m in enumerate(masks)))


def overlaps(docs: DataFrame, benchmark: DataFrame, percent: int = 80, masks: tuple[str, ...] | None = None, id_: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", part: int | None = None) -> DataFrame:
    """(doc_id, item_id, n_item_tokens, n_matched, start): pairs whose best alignment has percent of the item's tokens.

    n_matched is of the best alignment, start the place in the document (in
    tokens, from 0, negative if the item begins before it) of the first best one.
    The masks are SEEDS, as many as the shortest item needs; they find every such
    pair while percent is 80 or more. Items shorter than the masks are found if
    their whole sequence occurs; items without tokens, and null texts, match nothing; so do rows and items without an
    id. Rows that repeat an id count as one. Other columns are ignored.

    With part, also pairs that share part of an item: percent of at least part
    tokens in a row, or percent of the item with tokens inserted or deleted. Then
    n_matched counts the matches of alignments at most DRIFT apart, and start is
    of the first of these.
    """
    scratch = Scratch(docs.sparkSession, "overlaps")
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.expr(_tokens(f"`{item_text}`")).alias("b")).where("size(b) > 0 and item_id is not null")
    lengths = sorted(r[0] for r in items.select(F.size("b")).distinct().collect())
    if masks is None:
        masks = SEEDS if any(5 <= n < 7 for n in lengths) else SEEDS[:2]
    span = max(len(m) for m in masks)
    short = [n for n in lengths if n < span]
    every = [*masks, *("1" * n for n in short)]  # a whole short item is a seed of its own
    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    seeds = _windows(items.select("item_id", "b", F.size("b").alias("n")), "b", ["item_id", "n"], span)
    seeds = seeds.select("item_id", "n", F.col("i").alias("j"), F.posexplode(_keys(every)).alias("m", "key"))
    whole = (F.col("j") == 0) & (F.col("n") == F.array(*(F.lit(len(x)) for x in every))[F.col("m")])
    seeds = seeds.where(F.col("key").isNotNull() & ((F.col("m") < len(masks)) | whole)).select("key", "item_id", "j").distinct()
    words = rows.select("doc_id", F.expr(_tokens("text")).alias("h"))
    probes = _windows(words, "h", ["doc_id"], span).select("doc_id", "i", F.explode(_keys(every)).alias("key")).where("key is not null")
    seeds = scratch.write(seeds, "seeds")
    hits = probes.join(F.broadcast(seeds) if seeds.count() <= MOST else seeds, "key")
    hits = scratch.write(hits.select("doc_id", "item_id", F.expr("i - j").alias("start")).distinct(), "hits")
    # verification: only documents with a hit are read again
    few = hits.count() <= MOST
    near = rows.join(F.broadcast(hits) if few else hits, "doc_id").join(items, "item_id").withColumn("h", F.expr(_tokens("text")))
    match = F.expr("transform(array(h), g -> transform(b, (x, k) -> case when start + k >= 0 and get(g, start + cast(k as int)) = x then 1 else 0 end))[0]")  # the words, once a row
    aligned = near.select("doc_id", "item_id", "start", F.size("b").alias("n"), match.alias("m")).withColumn("same", F.expr("aggregate(m, 0, (s, x) -> s + x)"))
    found = aligned.where(f"same * 100 >= n * {percent}") if part is None else _joined(aligned, percent, part)
    # most matches, then the smallest start, in one number
    code = F.col("same").cast("long") * (1 << 32) + (1 << 31) - F.col("start")
    best = found.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_item_tokens"), F.max(code).alias("code"))
    return best.select("doc_id", "item_id", "n_item_tokens", F.shiftright("code", 32).cast("int").alias("n_matched"), ((1 << 31) - F.col("code").bitwiseAND(F.lit((1 << 32) - 1))).cast("int").alias("start"))


def _joined(aligned: DataFrame, percent: int, part: int) -> DataFrame:
    """The rows (doc_id, item_id, start, n, m, same) from which on an overlap is found, with same of all alignments it joins.

    A match counts if four of five tokens in a row around it match on its
    alignment. Tokens of the item and of the document count once each, so
    repeated words don't pass for more.
    """
    near5 = "exists(sequence(greatest(k - 4, 0), least(k, greatest(n - 5, 0))), a -> aggregate(slice(o, a + 1, 5), 0, (s, y) -> s + y) * 5 >= 4 * least(n, 5))"
    # rows with one id (equal texts, where texts are told apart by their hash) have an alignment once: its best
    once = aligned.groupBy("doc_id", "item_id", "start", "n").agg(F.max(F.struct("same", "m")).alias("x")).select("doc_id", "item_id", "start", "n", "x.m", "x.same")
    sure = once.withColumn("v", F.expr(f"transform(array(m), o -> filter(sequence(0, n - 1), k -> o[k] = 1 and {near5}))[0]")).where(f"size(v) > 0 or same * 100 >= n * {percent}")
    w = Window.partitionBy("doc_id", "item_id").orderBy("start").rangeBetween(0, DRIFT)
    both = sure.withColumn("items", F.array_distinct(F.flatten(F.collect_list("v").over(w))))
    both = both.withColumn("places", F.size(F.array_distinct(F.flatten(F.collect_list(F.expr("transform(v, k -> k + start)")).over(w)))))
    both = both.withColumn("all", F.greatest("same", F.least(F.size("items"), "places")))
    whole = f"all * 100 >= n * {percent}"
    # a stretch begins and ends with a match
    sums = "aggregate(sequence(0, n - 1), array(0), (s, k) -> concat(s, array(element_at(s, -1) + int(array_contains(items, k)))))"
    some = f"exists(array({sums}), t -> exists(sequence({part}, n), z -> exists(sequence(0, n - z), a -> t[a + 1] > t[a] and t[a + z] > t[a + z - 1] and (t[a + z] - t[a]) * 100 >= z * {percent})))"
    return both.where(f"{whole} or case when n >= {part} and least(size(items), places) * 100 >= {part * percent} then {some} else false end").select("doc_id", "item_id", "start", "n", F.col("all").alias("same"))


def without_overlaps(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_: str = "doc_id", text: str = "text", part: int | None = None) -> DataFrame:
    """docs without those that hold an item of the benchmark (or, with part, that much of one).

    Rows are told apart by the 64-bit hash of their text, so those that repeat an
    id, or have none, are judged like all others. Other columns stay as they are,
    whatever their names. No rows give no rows; without items all rows stay.
    """
    key = F.xxhash64(F.col(text).cast("string"))
    bad = overlaps(docs.select(key.alias("doc_id"), F.col(text).cast("string").alias("text")), benchmark, percent, part=part)
    bad = Scratch(docs.sparkSession, "overlapping").write(bad.select("doc_id").distinct(), "texts")
    few = bad.count() <= MOST
    left, right = docs.alias("a"), (F.broadcast(bad) if few else bad).alias("b")
    return left.join(right, F.xxhash64(F.col(f"a.`{text}`").cast("string")) == F.col("b.doc_id"), "left_anti").select(docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items of the benchmark."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return overlaps(docs, benchmark)


def _sql_keys(t: str, i: str) -> str:
    one = [f"CASE WHEN {i} + {len(m)} <= len({t}) THEN concat_ws(' ', '{k}', {', '.join(f'{t}[{i} + {p + 1}]' for p, c in enumerate(m) if c == '1')}) END" for k, m in enumerate(SEEDS[:2])]
    return f"[{', '.join(one)}]"


#: The same in SQL (the items of the benchmark tables have seven tokens or more).
OP2_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS h FROM documents),
     b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM benchmark),
     dp AS (SELECT doc_id, h, unnest(range(len(h))) AS i FROM d),
     bp AS (SELECT item_id, t, unnest(range(len(t))) AS j FROM b),
     dk AS (SELECT doc_id, i, unnest({_sql_keys("h", "i")}) AS key FROM dp),
     bk AS (SELECT item_id, j, unnest({_sql_keys("t", "j")}) AS key FROM bp),
     hit AS (SELECT DISTINCT doc_id, item_id, i - j AS start FROM dk JOIN bk USING (key)),
     al AS (SELECT doc_id, item_id, start, len(t) AS n, len(list_filter(range(len(t)), lambda k: start + k >= 0 AND start + k < len(h) AND h[start + k + 1] = t[k + 1])) AS same
            FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)),
     ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY same DESC, start) AS r FROM al WHERE same * 100 >= n * 80)
SELECT doc_id, item_id, n AS n_item_tokens, same AS n_matched, start FROM ok WHERE r = 1
"""
