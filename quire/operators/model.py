"""The document model over whole corpora: blocks, sections, indexes, chunks, reading and finding.

Blocks are rows (doc_id, ord, id, kind, page, section, text, ...); ord is the
authoritative reading order within a document. Every operator is DataFrame to
DataFrame and works on all documents at once; one document is a filter. Folds
that cannot be windows (the heading stack, greedy chunks) run over a document's
ordered rows as they stream by, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quire.functions import classify as K
from quire.functions import text as T


def _order() -> object:
    return Window.partitionBy("doc_id").orderBy("ord")


def line_blocks(docs: DataFrame, per_page: int = 40) -> DataFrame:
    """Text documents as blocks: a line is a block, per_page lines are a page; blank lines are no blocks.

    A document's lines are numbered within its row, so nothing is shuffled.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t, i: F.struct(i.alias("line"), t.alias("text")))
    x = docs.select("doc_id", F.posexplode(F.filter(lines, lambda b: F.trim(b["text"]) != "")).alias("n", "b")).select("doc_id", (F.col("n") + 1).alias("ord"), "b.line", "b.text")
    kind = F.when(K.numbered_level(F.col("text")).isNotNull(), "heading").when(K.list_ordered(F.col("text")).isNotNull(), "list_item").when(K.is_caption(F.col("text")), "caption").otherwise("para")
    return x.select("doc_id", "ord", F.format_string("b%04d", "ord").alias("id"), kind.alias("kind"), (F.floor(F.col("line") / per_page) + 1).cast("int").alias("page"), "text", F.when(kind == "heading", K.numbered_level(F.col("text"))).alias("heading_level"))


def folded(rows: DataFrame, key: list[str], order: list, columns: list[str], start: Callable, out: str) -> DataFrame:
    """A fold over each group's ordered rows: (key, out) of all that start()'s function yields.

    rows come sorted, one after the other, to step(*columns), which returns a list of
    tuples of out; step(None, ...) ends a group. Time and memory grow with a
    group's rows, never with their square, and no group is held as a whole.
    """
    kinds = dict(rows.dtypes)
    schema = to_arrow_schema(StructType.fromDDL(", ".join([f"`{k}` {kinds[k]}" for k in key]) + ", " + out))
    n = len(key)

    def run(batches):
        held, group, step = [], None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != row[:n] or step is None:
                    if step is not None:
                        held += [group + x for x in step(*[None] * len(columns))]
                    group, step = row[:n], start()
                held += [group + x for x in step(*row[n:])]
            if len(held) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if step is not None:
            held += [group + x for x in step(*[None] * len(columns))]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    dealt = rows.repartition(*key).sortWithinPartitions(*key, *order).select(*key, *columns)
    return dealt.mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in key]) + ", " + out)


def mapped(rows: DataFrame, each: Callable, out: str, at_most: int = 4 << 20) -> DataFrame:
    """(out) of all tuples that each(*row) gives, in batches of about at_most bytes.

    Rows become Python values a few at a time, so memory doesn't grow with the rows
    of an Arrow batch but for the batch itself.
    """
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches):
        held, size = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            few = max(1, min(64, at_most * batch.num_rows // max(batch.nbytes, 1)))
            for lo in range(0, batch.num_rows, few):
                for row in zip(*(c.to_pylist() for c in batch.slice(lo, few).columns), strict=True):
                    for x in each(*row):
                        held.append(x)
                        size += 64 * len(x) + sum(len(v) for v in x if isinstance(v, (str, bytes)))
                        if size >= at_most:
                            yield made()
                            held, size = [], 0
        if held:
            yield made()

    return rows.mapInArrow(run, out)


# ---- sections


def section_tree(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, top, parent, path): the heading stack after each heading, as the ords of headings.

    A heading closes those of its level or deeper and opens itself unless its text
    is blank. path is the stack from the outermost, without the heading itself.
    """
    heads = blocks.where("kind = 'heading'").select("doc_id", F.col("ord").cast("int").alias("ord"), F.coalesce("heading_level", F.lit(1)).cast("int").alias("level"), (F.trim("text") == "").alias("blank"))

    def start():
        stack: list[tuple[int, int]] = []

        def step(at, level, blank):
            if at is None:
                return []
            while stack and stack[-1][1] >= level:
                stack.pop()
            path = [o for o, _ in stack]
            above = path[-1] if path else None
            if blank:
                return [(at, above, None, path)]
            stack.append((at, level))
            return [(at, at, above, path)]

        return step

    return folded(heads, ["doc_id"], ["ord"], ["ord", "level", "blank"], start, "ord int, top int, parent int, path array<int>")


def attribute_sections(blocks: DataFrame) -> DataFrame:
    """blocks with section_ord, the open heading at or before each (null before the first)."""
    tree = section_tree(blocks).select("doc_id", "ord", F.struct("top").alias("state"))
    joined = blocks.join(tree, ["doc_id", "ord"], "left")
    return joined.withColumn("section_ord", F.last("state", ignorenulls=True).over(_order())["top"]).drop("state")


def mint_ids(rows: DataFrame, base: str) -> DataFrame:
    """rows(doc_id, ord, base) with final_id: base, base-2, base-3, skipping ids that are taken, in order.

    The rule skips literal ids, so it is a fold over one document's ids.
    """

    def start():
        used, following = set(), {}

        def step(at, b):
            if at is None:
                return []
            # suffixes that were taken stay taken, so going on from the last one finds the same
            n, name = following.get(b, 1), b
            if name in used or n > 1:
                n = max(n, 2)
                while (name := f"{b}-{n}") in used:
                    n += 1
            used.add(name)
            following[b] = n + 1
            return [(at, name)]

        return step

    made = folded(rows.select("doc_id", "ord", base), ["doc_id"], ["ord"], ["ord", base], start, f"ord {dict(rows.dtypes)['ord']}, final_id string")
    return rows.join(made, ["doc_id", "ord"])


def sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, id, level, title, parent, page_start, page_end): ranges cover all blocks of the subtree."""
    tree = section_tree(blocks).where("top = ord")
    heads = blocks.where("kind = 'heading'").select("doc_id", "ord", F.col("heading_level").alias("level"), T.strip_inline(F.col("text")).alias("title"), "page")
    named = mint_ids(tree.join(heads, ["doc_id", "ord"]).withColumn("base", T.section_slug(T.trim_ws(F.col("title")))), "base")
    ids = named.select("doc_id", F.col("ord").alias("parent"), F.col("final_id").alias("parent_id"))
    return named.join(ids, ["doc_id", "parent"], "left").join(section_ranges(blocks), ["doc_id", "ord"], "left").select("doc_id", "ord", F.col("final_id").alias("id"), "level", "title", F.col("parent_id").alias("parent"), "page_start", "page_end")


def section_ranges(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, page_start, page_end): pages of each section's blocks and of its descendants'."""
    owned = attribute_sections(blocks).where("section_ord is not null").groupBy("doc_id", F.col("section_ord").alias("ord")).agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    up = owned.join(section_tree(blocks), ["doc_id", "ord"]).select("doc_id", F.explode(F.concat("path", F.array("ord"))).alias("ord"), "lo", "hi")
    return up.groupBy("doc_id", "ord").agg(F.min("lo").alias("page_start"), F.max("hi").alias("page_end"))


def subtree(blocks: DataFrame) -> DataFrame:
    """(doc_id, root, ord): every section with itself and its descendants."""
    tree = section_tree(blocks).where("top = ord")
    return tree.select("doc_id", F.explode(F.concat("path", F.array("ord"))).alias("root"), "ord")


def blocks_of_section(blocks: DataFrame, root: Column | int) -> DataFrame:
    """The blocks of a section and of those under it."""
    inside = subtree(blocks).where(F.col("root") == root).select("doc_id", F.col("ord").alias("section_ord"))
    return attribute_sections(blocks).join(inside, ["doc_id", "section_ord"], "left_semi")


# ---- indexes and neighbours


def page_index(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "page").agg(_ordered("id").alias("ids"))


def _ordered(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", column))), lambda x: x[column])


def kind_index(blocks: DataFrame) -> DataFrame:
    """Tables, figures and footnotes in order, with page and label."""
    return blocks.where("kind in ('table', 'figure', 'footnote')").select("doc_id", "kind", "ord", "id", "page", "label")


def coverage(blocks: DataFrame) -> DataFrame:
    """(doc_id, sectioned, unsectioned): the share of blocks in a section (1 without blocks) and the ids of the others."""
    b = attribute_sections(blocks)
    loose = F.transform(F.array_sort(F.collect_list(F.when(F.col("section_ord").isNull(), F.struct("ord", "id")))), lambda x: x["id"])
    return b.groupBy("doc_id").agg(F.avg(F.col("section_ord").isNotNull().cast("int")).alias("sectioned"), loose.alias("unsectioned"))


def index_drift(stored: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of a stored page index that differ from a fresh one; empty if it holds."""
    fresh, stored = (x.select("doc_id", "page", F.array_join("ids", ",").alias("ids")) for x in (page_index(blocks), stored))
    return fresh.exceptAll(stored).withColumn("side", F.lit("fresh")).unionAll(stored.exceptAll(fresh).withColumn("side", F.lit("stored")))


def neighbours(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "ord", "id", F.lag("id").over(_order()).alias("prev"), F.lead("id").over(_order()).alias("next"))


def context(blocks: DataFrame, n: int) -> DataFrame:
    """The ids of n blocks on either side, without the block's own."""
    before, after = (F.collect_list("id").over(_order().rowsBetween(*r)) for r in ((-n, -1), (1, n)))
    return blocks.select("doc_id", "ord", "id", F.concat(before, after).alias("context"))


# ---- finding and reading


@dataclass
class Found:
    """Matches, and how much was searched: a row for each document, also for those without a match."""

    hits: DataFrame
    coverage: DataFrame


def find(blocks: DataFrame, query: str, regex: bool = False, kind: str | None = None, pages: list[int] | None = None, limit: int | None = None) -> Found:
    """The first match in each block's text, regardless of case; start and end count from 0.

    regex takes Java's syntax. limit cuts the hits of each document, never the
    coverage. Blocks without text are searched and their pages reported.
    """
    scope = blocks
    if pages is not None:
        scope = scope.where(F.col("page").isin(pages))
    if kind is not None:
        scope = scope.where(F.col("kind") == kind)
    t = F.coalesce(T.plain(F.col("text")), F.lit(""))
    scope = scope.withColumn("seen", t)
    if regex:
        # one pattern says whether, where and how long
        pattern = F.lit(f"(?i){query}")
        at = F.regexp_instr("seen", pattern) - 1
        scope = scope.withColumn("start", F.when(at >= 0, at)).withColumn("end", F.col("start") + F.length(F.regexp_substr("seen", pattern)))
    else:
        at = F.instr(F.lower("seen"), query.lower()) - 1
        scope = scope.withColumn("start", F.when(at >= 0, at)).withColumn("end", F.col("start") + len(query))
    scope = scope.withColumn("start", F.when(T.trim_ws(F.col("seen")) != "", F.col("start")))
    hits = scope.where("start is not null")
    total = F.count("start")
    empty = F.array_sort(F.array_except(F.collect_set("page"), F.collect_set(F.when(T.trim_ws(F.col("seen")) != "", F.col("page")))))
    cover = scope.groupBy("doc_id").agg(total.alias("matches"), F.count("*").alias("searched_blocks"), F.countDistinct("page").alias("searched_pages"), empty.alias("no_text_pages"))
    hits = hits.select("doc_id", "ord", "id", "kind", "page", "start", "end", T.snippet(F.col("seen"), F.col("start"), F.col("end")).alias("snippet"))
    if limit is not None:
        hits = hits.withColumn("n", F.row_number().over(_order())).where(F.col("n") <= limit).drop("n")
    return Found(hits, cover)


def bounded_read(blocks: DataFrame, max_chars: int = 6000, md: Column | None = None) -> DataFrame:
    """(doc_id, n_blocks, markdown, next_id): blocks from the first until max_chars, at least one; next_id resumes."""
    b = blocks.withColumn("md", md if md is not None else F.coalesce(T.plain(F.col("text")), F.lit("")))
    b = b.withColumn("upto", F.sum(F.length("md") + 2).over(_order())).withColumn("first", F.row_number().over(_order()) == 1)
    # the sum never falls, so the blocks shown are a prefix
    b = b.withColumn("shown", F.col("first") | (F.col("upto") <= max_chars))
    parts = F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("ord", "md"))))
    return b.groupBy("doc_id").agg(F.count_if("shown").alias("n_blocks"), F.trim(F.array_join(F.transform(parts, lambda x: x["md"]), "\n\n")).alias("markdown"), F.min(F.when(~F.col("shown"), F.struct("ord", "id")))["id"].alias("next_id"))


def resume(blocks: DataFrame, doc_id: object, from_id: str) -> DataFrame:
    """The blocks of a document from an id on; an unknown id is an error."""
    own = blocks.where(F.col("doc_id") == doc_id)
    at = own.where(F.col("id") == from_id).agg(F.min("ord").alias("at"))
    loud = F.when(F.col("at").isNotNull(), F.col("at")).otherwise(F.raise_error(F.lit(f"{from_id} is not in this selection")))
    return own.crossJoin(F.broadcast(at)).where(F.col("ord") >= loud).drop("at")


def resolve_pages(pages: DataFrame, spec: str) -> DataFrame:
    """Page numbers of each document for N, N-M or labels, from pages(doc_id, n, label); a label with a dash is tried whole first.

    The result has a row for each page, or one with a null page for a document in which the spec has no meaning.
    """

    def one(token: str) -> Column:
        return F.min(F.when(F.col("n") == int(token), F.col("n"))) if token.isdigit() else F.min(F.when(F.col("label") == token, F.col("n")))

    spec = spec.strip()
    lo, _, hi = (x.strip() for x in spec.partition("-"))
    found = pages.groupBy("doc_id").agg(one(spec).alias("whole"), one(lo).alias("lo"), (one(hi) if hi else F.lit(None)).alias("hi"))
    span = F.when(F.col("whole").isNotNull(), F.array("whole")).when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.sequence(F.least("lo", "hi"), F.greatest("lo", "hi")))
    return found.select("doc_id", F.explode_outer(span).alias("page"))


# ---- chunks


def derive_chunks(blocks: DataFrame, target: int = 400, tokens: Column | None = None) -> DataFrame:
    """(doc_id, chunk, id, ords, section, page_start, page_end): runs of blocks within a section up to about target tokens.

    A chunk ends where the section changes or the next block would pass the
    target; a larger block is a chunk of its own. blocks need section. This sum
    restarts at every chunk, so it is a fold over the document's ordered blocks.
    """
    cost = tokens if tokens is not None else T.token_proxy(T.trim_ws(F.coalesce(T.plain(F.col("text")), F.lit(""))))
    rows = blocks.select("doc_id", F.col("ord").cast("int").alias("ord"), cost.cast("int").alias("tok"), F.col("section").cast("string").alias("section"), F.col("page").cast("int").alias("page"))

    def start():
        chunk, size, ords, pages, own = 0, 0, [], [], None

        def close():
            return [(chunk, f"c{chunk:04d}", list(ords), own, min(pages, default=0), max(pages, default=0))] if ords else []

        def step(at, tok, section, page):
            nonlocal chunk, size, own
            if at is None:
                return close()
            done = []
            if not chunk or section != own or size + tok > target:
                done = close()
                chunk, size, own = chunk + 1, 0, section
                ords.clear()
                pages.clear()
            size += tok
            ords.append(at)
            if page is not None:
                pages.append(page)
            return done

        return step

    return folded(rows, ["doc_id"], ["ord"], ["ord", "tok", "section", "page"], start, "chunk int, id string, ords array<int>, section string, page_start int, page_end int")


def chunk_text(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, chunk, text): the blocks' text, blank ones left out, joined by blank lines."""
    said = blocks.select("doc_id", "ord", T.trim_ws(F.coalesce(T.plain(F.col("text")), F.lit(""))).alias("t"))
    parts = chunks.select("doc_id", "chunk", F.explode_outer("ords").alias("ord")).join(said, ["doc_id", "ord"], "left")
    texts = F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("ord", "t"))))
    return parts.groupBy("doc_id", "chunk").agg(F.array_join(F.transform(texts, lambda x: x["t"]), "\n\n").alias("text"))


def stale_chunks(stored: DataFrame, blocks: DataFrame, target: int = 400) -> DataFrame:
    """(doc_id, stale): do stored chunks differ from fresh ones?"""
    shape = lambda c: c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "ords"))).alias("x"))
    fresh, old = shape(derive_chunks(blocks, target)), shape(stored).withColumnRenamed("x", "y")
    return fresh.join(old, "doc_id", "full").select("doc_id", (~F.col("x").eqNullSafe(F.col("y"))).alias("stale"))


def info(blocks: DataFrame) -> DataFrame:
    """A row of totals for each document."""
    kinds = {k: F.count_if(F.col("kind") == k) for k in ("heading", "para", "list_item", "table", "figure", "footnote", "caption")}
    return blocks.groupBy("doc_id").agg(F.max("page").alias("pages"), F.count("*").alias("blocks"), *(c.alias(f"n_{k}") for k, c in kinds.items()))


def tally(rows: DataFrame, column: str) -> DataFrame:
    """Rows for each value, nulls left out: OCR decisions, outcomes, asset storage."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
