"""Markup operators: an HTML forest as rows, Markdown from it, DocTags blocks, repairs of rendered text.

Parsers are row-at-a-time by nature and run in Arrow batches; every document is
parsed on its own, so nothing is shuffled.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.operators.model import mapped

# Fixed names of elements without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<![^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Elem:
    __slots__ = ("attrs", "kids", "raw", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], raw: str | None = None):
        self.tag, self.attrs, self.raw, self.kids = tag, attrs, raw, []


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)}


def decoder(references: tuple[str, ...] | None) -> Callable[[str], str]:
    """What decodes character references in text: all of HTML's, or only those named, with their semicolon."""
    if references is None:
        return _html.unescape
    named = re.compile(f"&(?:{'|'.join(map(re.escape, references))});")
    return lambda t: named.sub(lambda m: _html.unescape(m[0]), t)


def forest(source: str, references: tuple[str, ...] | None = None) -> list:
    """Elements and strings; script and style are dropped, svg is kept verbatim, an end tag closes the nearest open one."""
    root, decode = Elem("", {}), decoder(references)
    stack, at = [root], 0
    while at < len(source):
        m = _TAG.search(source, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].kids.append(decode(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ("script", "style"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag == "svg":
            depth, pos = 1, at
            for x in re.compile(r"<(/?)svg\b[^>]*>", re.I).finditer(source, at):
                depth += -1 if x[1] else 1
                pos = x.end()
                if not depth:
                    break
            else:
                pos = len(source)
            stack[-1].kids.append(Elem("svg", attributes(m[3]), source[m.start() : pos]))
            at = pos
            continue
        e = Elem(tag, attributes(m[3].rstrip("/")))
        stack[-1].kids.append(e)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(e)
    if at < len(source):
        stack[-1].kids.append(decode(source[at:]))
    return root.kids


def nodes(pages: DataFrame, id_: str = "page_id", html: str = "html", references: tuple[str, ...] | None = None) -> DataFrame:
    """(id, ord, depth, parent, tag, attrs, text): a row for each element (tag) or text (no tag), in document order.

    references: the names of the character references that are decoded in texts, all if not given.
    """

    def each(key, source):
        stack = [(k, 0, None) for k in reversed(forest(source or "", references))]
        n = 0
        while stack:
            x, depth, parent = stack.pop()
            if isinstance(x, str):
                yield key, n, depth, parent, None, None, x
            else:
                yield key, n, depth, parent, x.tag, list(x.attrs.items()), x.raw
                stack.extend((k, depth + 1, n) for k in reversed(x.kids))
            n += 1

    return mapped(pages.select(id_, html), each, f"`{id_}` {dict(pages.dtypes)[id_]}, ord int, depth int, parent int, tag string, attrs map<string,string>, text string")


def links(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """(id, n, href, kind): anchors with an href, quoted either way or bare, in order; uri, internal (#...) or remote (a file)."""
    anchor = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    found = F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(1))
    href = F.col("href")
    kind = F.when(href.rlike(r"(?i)^(https?|ftp|mailto):"), "uri").when(href.startswith("#"), "internal").otherwise("remote")
    return pages.select(id_, F.posexplode(found).alias("n", "href")).withColumn("href", F.regexp_replace("href", r"""^["']|["']$""", "")).withColumn("kind", kind)


def text_of(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(id_, T.visible_text(F.col(html)).alias("text"))


# ---------------------------------------------------------------- Markdown


def _inline(kids: list) -> str:
    out = []
    for k in kids:
        if isinstance(k, str):
            out.append(re.sub(r"\s+", " ", k))
            continue
        inner = _inline(k.kids)
        tag = k.tag
        if tag in ("b", "strong"):
            out.append(f"**{inner.strip()}**" if inner.strip() else inner)
        elif tag in ("i", "em"):
            out.append(f"*{inner.strip()}*" if inner.strip() else inner)
        elif tag == "code":
            out.append(f"`{inner}`")
        elif tag == "a":
            href = k.attrs.get("href", "")
            href = "#" + href[5:] if href.startswith("#sec-") else href
            out.append(f"[{inner.strip()}]({href})" if href and inner.strip() else inner)
        elif tag in ("sup", "sub"):
            out.append(f"<{tag}>{inner}</{tag}>")
        elif tag == "br":
            out.append("  \n")
        elif tag == "img":
            out.append(f"![{k.attrs.get('alt', '')}]({k.attrs.get('src', '')})")
        elif tag == "svg":
            continue
        else:
            out.append(inner)
    return "".join(out)


def _list(e: Elem, depth: int) -> list[str]:
    out, n = [], 1
    for k in e.kids:
        if isinstance(k, str) or k.tag != "li":
            continue
        own = [x for x in k.kids if isinstance(x, str) or x.tag not in ("ul", "ol")]
        out.append("  " * depth + (f"{n}. " if e.tag == "ol" else "- ") + _inline(own).strip())
        n += 1
        for x in k.kids:
            if not isinstance(x, str) and x.tag in ("ul", "ol"):
                out += _list(x, depth + 1)
    return out


def _find(e: Elem, tag: str) -> list[Elem]:
    return [y for k in e.kids if not isinstance(k, str) for y in ([k] if k.tag == tag else _find(k, tag))]


def _table(e: Elem) -> str:
    grid: dict[tuple[int, int], str] = {}
    for r, tr in enumerate(_find(e, "tr")):
        c = 0
        for cell in tr.kids:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                continue
            while (r, c) in grid:
                c += 1
            span = [max(1, min(4096, int(v))) if (v := cell.attrs.get(a, "1")).isdigit() else 1 for a in ("rowspan", "colspan")]
            text = _inline(cell.kids).strip().replace("\n", " ").replace("|", "\\|")
            for i in range(span[0]):
                for j in range(span[1]):
                    grid.setdefault((r + i, c + j), text)
            c += span[1]
    if not grid:
        return ""
    height, width = max(r for r, _ in grid) + 1, max(c for _, c in grid) + 1
    lines = ["| " + " | ".join(grid.get((r, c), "") for c in range(width)) + " |" for r in range(height)]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


_FLOW = frozenset("html body main article section div nav header footer aside figure figcaption p h1 h2 h3 h4 h5 h6 ul ol table pre blockquote hr dl dt dd form".split())


def markdown(source: str | None) -> str:
    """GitHub Markdown of an HTML fragment or page; head, title and meta leave nothing."""
    blocks: list[str] = []

    def flow(kids: list) -> None:
        held: list = []

        def flush() -> None:
            text = _inline(held).strip()
            if text:
                blocks.append(text)
            held.clear()

        for k in kids:
            if isinstance(k, str) or k.tag not in _FLOW:
                if isinstance(k, str) or k.tag not in ("head", "title", "meta", "link"):
                    if not isinstance(k, str) and any(not isinstance(x, str) and x.tag in _FLOW for x in k.kids):
                        flush()
                        flow(k.kids)
                    else:
                        held.append(k)
                continue
            flush()
            if len(k.tag) == 2 and k.tag[0] == "h" and k.tag[1].isdigit():
                text = _inline(k.kids).strip()
                whole = re.fullmatch(r"\*\*((?:(?!\*\*).)+)\*\*", text, re.S)
                if text:
                    blocks.append("#" * int(k.tag[1]) + " " + (whole[1] if whole else text))
            elif k.tag in ("ul", "ol"):
                items = _list(k, 0)
                if items:
                    blocks.append("\n".join(items))
            elif k.tag == "table":
                blocks.append(_table(k))
            elif k.tag == "pre":
                inner = "".join(x if isinstance(x, str) else _plain(x) for x in k.kids).strip("\n")
                blocks.append(f"```\n{inner}\n```")
            elif k.tag == "hr":
                blocks.append("---")
            elif k.tag == "figcaption":
                text = _inline(k.kids).strip()
                if text:
                    blocks.append(f"*{text}*")
            else:
                flow(k.kids)
        flush()

    flow(forest(source or ""))
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(b for b in blocks if b)).rstrip() + "\n"


def _plain(e: Elem) -> str:
    return "".join(k if isinstance(k, str) else _plain(k) for k in e.kids)


def to_markdown(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(markdown)

    return run(c)


# ---------------------------------------------------------------- DocTags

_DOC = re.compile(r"<(section_header_level_\d|text|title|list_item|caption|footnote|code|formula|page_header|page_footer|otsl|picture|paragraph)>(.*?)</\1>", re.S)
_LOC = re.compile(r"<loc_\d+>")
# Fixed names of DocTags elements, by the model's kinds.
_KINDS = {"text": "para", "paragraph": "para", "formula": "para", "title": "heading", "list_item": "list_item", "caption": "caption", "footnote": "footnote", "code": "code", "otsl": "table", "picture": "figure", "page_header": "para", "page_footer": "para"}


def doctags_blocks(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ord, kind, level, text): typed blocks of recognised pages; without any known element, each line is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, t in zip(pdf[id_], pdf[text], strict=True):
                found = [(m[1], m[2]) for m in _DOC.finditer(t or "")] or [("text", line) for line in _LOC.sub("", t or "").split("\n") if line.strip()]
                for n, (tag, body) in enumerate(found):
                    head = tag.startswith("section_header")
                    kind = "heading" if head else _KINDS.get(tag, "para")
                    level = min(int(tag[-1]) + 1, 6) if head else 1 if tag == "title" else None
                    rows.append((key, n, kind, level, _LOC.sub("", body).strip()))
            out = pd.DataFrame(rows, columns=[id_, "ord", "kind", "level", "text"])
            out["level"] = out["level"].astype("Int32")
            yield out

    return docs.select(id_, text).mapInPandas(run, f"{id_} {dict(docs.dtypes)[id_]}, ord int, kind string, level int, text string")


# ---------------------------------------------------------------- repairs


def kept_of_loops(items: list[str], longest: int, times: int, long: int | None = None) -> list[int]:
    """Places that stay when each cycle of 1..longest items that comes `times` times or more in a row is kept once.

    With long, a cycle of several items needs one of that many characters, or one repeat more.
    """
    n, i, out = len(items), 0, []
    if len(set(items)) == n:
        return list(range(n))
    while i < n:
        for p in range(1, min(longest, (n - i) // 2) + 1):
            if items[i] != items[i + p]:
                continue
            end = i + p
            while end < n and items[end] == items[end - p]:
                end += 1
            reps = (end - i) // p
            if reps >= times and (p == 1 or long is None or reps > times or any(len(x) >= long for x in items[i : i + p])):
                out += range(i, i + p)
                i += reps * p
                break
        else:
            out.append(i)
            i += 1
    return out


def _untagged(line: str) -> str:
    """What a line says outside <...>, by which lines are compared: the boxes of a repeated line differ."""
    if "<" not in line and ">" not in line:
        return line.strip()
    out, depth = [], 0
    for part in re.split("([<>])", line):
        if part == "<":
            depth += 1
        elif part == ">":
            depth = max(depth - 1, 0)
        elif not depth:
            out.append(part)
    return "".join(out).strip()


def collapse_loops(c: Column) -> Column:
    """Text without the loops that recognisers fall into: repeated lines, tags aside, then repeated words within a line."""

    def words(line):
        w = line.split(" ")
        if len(w) < 6:
            return line
        kept = kept_of_loops(w, 4, 3)
        return line if len(kept) == len(w) else " ".join([w[i] for i in kept])

    def one(t):
        if t is None:
            return None
        lines = t.split("\n")
        return "\n".join([words(lines[i]) for i in kept_of_loops([_untagged(x) for x in lines], 8, 3, 4)])

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # few texts at a time are Python strings
            for lo in range(0, len(batch), 64):
                yield pa.array([one(t) for t in batch.slice(lo, 64).to_pylist()], pa.string())

    return run(c)


def merge_adjacent_links(c: Column) -> Column:
    """Neighbouring anchors of one address become one (a backreference, repeated until nothing changes)."""
    step = lambda x: F.regexp_replace(x, r'(<a href="([^"]*)"[^>]*>)((?:(?!</a>|<a ).)*)</a>(\s*)<a href="\2"[^>]*>', "$1$3$4")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(c, F.lit("</a>")))), c, lambda x, _: step(x))


def dedup_ids(c: Column) -> Column:
    """Ids of a page made unique, in document order: id, id-2, id-3, without meeting ids that are there."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            used, following = set(), {}

            def fresh(m):
                raw = m[1]
                n = following.get(raw, 1)
                name = raw
                if n > 1 or raw in used:
                    n = max(n, 2)
                    while (name := f"{raw}-{n}") in used:
                        n += 1
                used.add(name)
                following[raw] = n + 1
                return f'id="{name}"'

            return re.sub(r'id="([^"]*)"', fresh, t)

        return s.map(one)

    return run(c)


def pair_figures(a: Column, b: Column) -> Column:
    """Two neighbouring figures as one if one is graphic only and the other caption only (whose id stays); else null."""
    graphic = lambda f: f.rlike("<img|<svg")
    caption = lambda f: F.contains(f, F.lit("<figcaption"))
    pair = (graphic(a) & ~caption(a) & caption(b) & ~graphic(b)) | (caption(a) & ~graphic(a) & graphic(b) & ~caption(b))
    g, c = F.when(graphic(a), a).otherwise(b), F.when(graphic(a), b).otherwise(a)
    attrs = lambda f: F.trim(F.regexp_extract(f, "^<figure([^>]*)>", 1))
    inner = lambda f: F.regexp_extract(f, "(?s)^<figure[^>]*>(.*)</figure>$", 1)
    attr = F.coalesce(F.nullif(attrs(c), F.lit("")), F.nullif(attrs(g), F.lit("")))
    return F.when(pair, F.concat(F.lit("<figure"), F.coalesce(F.concat(F.lit(" "), attr), F.lit("")), F.lit(">"), inner(g), inner(c), F.lit("</figure>")))


def build_nav(sections: DataFrame) -> DataFrame:
    """(doc_id, nav): nested links to the sections(doc_id, ord, level, title, id).

    Levels 1 and 2 are top entries, those of level 3 a list within the last top
    entry (or top entries before the first), deeper ones are left out; an entry
    without an id is plain text.
    """
    link = F.concat(F.lit('<a href="#'), F.col("id"), F.lit('">'), T.esc(F.col("title")), F.lit("</a>"))
    item = F.concat(F.lit('<li data-level="'), F.col("level").cast("string"), F.lit('">'), F.when(F.coalesce("id", F.lit("")) == "", T.esc(F.col("title"))).otherwise(link))
    kept = sections.where("level <= 3").withColumn("item", item)
    w = Window.partitionBy("doc_id").orderBy("ord")
    top = F.col("level") <= 2
    kept = kept.withColumn("group", F.sum(top.cast("int")).over(w))
    # one entry for each top section with its children; group 0 holds what comes before the first
    rows = kept.groupBy("doc_id", "group").agg(F.min("ord").alias("ord"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "level", "item"))), lambda x: F.struct(x["level"].alias("level"), x["item"].alias("item"))).alias("x"))
    closed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(x["item"], F.lit("</li>"))), "")
    under = F.filter("x", lambda x: x["level"] > 2)
    nested = F.concat(F.get("x", 0)["item"], F.when(F.size(under) > 0, F.concat(F.lit("<ul>"), closed(under), F.lit("</ul>"))).otherwise(""), F.lit("</li>"))
    rows = rows.withColumn("h", F.when(F.col("group") == 0, closed(F.col("x"))).otherwise(nested))
    return rows.groupBy("doc_id").agg(F.concat(F.lit("<nav><ul>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "h"))), lambda x: x["h"]), ""), F.lit("</ul></nav>\n")).alias("nav"))
