"""Column functions over text and inline markup.

Each takes and returns Columns; a null argument gives null unless said otherwise.
White space means Unicode white space, which Java's regular expressions reach by
the class WS below.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed set: the characters of Unicode's White_Space.
WS = r"[\s\x0B\x85   -     　]"


def _chain(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def strip_tags(c: Column, brk: str = "join") -> Column:
    """Text outside <...>; an unclosed < takes all that follows, a stray > is dropped.

    brk: join leaves nothing for a tag, open a space where each tag opens, close
    a space for each > (also for one that closes no tag).
    """
    if brk == "join":
        return F.regexp_replace(F.regexp_replace(c, r"<[^>]*(>|$)", ""), ">", "")
    if brk == "open":
        # every < of a run of them opens anew
        opened = F.regexp_replace(c, r"<", " <")
        return F.regexp_replace(F.regexp_replace(opened, r"<[^ >]*(?: (?!<)[^ >]*)*(?=(?: <|>|$))>?", ""), ">", "")
    if brk == "close":
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ">"), r"<[^>]*$", ""), ">", " ")
    raise ValueError("brk is join, open or close")


def unescape_entities(c: Column) -> Column:
    """The five entities, the ampersand last, so that nothing is decoded twice."""
    return _chain(c, ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain(c: Column) -> Column:
    """The query view of inline markup: tags go and entities are decoded, the ampersand first, but only if there is a <."""
    decoded = _chain(F.regexp_replace(c, r"<[^>]+>", ""), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
    return F.when(F.contains(c, F.lit("<")), decoded).otherwise(c)


def strip_inline(c: Column) -> Column:
    return unescape_entities(strip_tags(c))


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one space; the ends keep theirs."""
    return F.regexp_replace(c, f"{WS}+", " ")


def normalize_ws(c: Column) -> Column:
    return F.trim(collapse_ws(c))


def esc_text(c: Column) -> Column:
    return _chain(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def esc(c: Column) -> Column:
    return _chain(esc_text(c), ('"', "&quot;"))


def esc_attr(c: Column) -> Column:
    return _chain(c, ("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"))


def slug(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "-")


def section_slug(c: Column) -> Column:
    """The id of a section before collisions are settled."""
    return F.regexp_replace(F.concat(F.lit("sec-"), slug(F.lower(c))), r"^-+|-+$", "")


def num_id(c: Column) -> Column:
    return F.translate(F.replace(c, F.lit("."), F.lit("-")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def caption_slug(c: Column) -> Column:
    """A caption without its label, as up to about twenty letters, digits and single dashes."""
    t = trim_ws(c)
    body = F.when(t.rlike(r"(?i)^(figure|fig\.|fig )") & t.rlike("[:–-]"), F.regexp_replace(t, r"^[^:–-]*[:–-]", "")).otherwise(t)
    dashed = F.regexp_replace(F.regexp_replace(trim_ws(body), r"[^A-Za-z0-9]+", "-"), r"^-", "")
    return F.regexp_replace(F.lower(F.substring(dashed, 1, 20)), r"^-+|-+$", "")


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def demote_key(c: Column) -> Column:
    """The key under which running heads recur: without the leading letters, digits and dots."""
    return normalize_ws(F.lower(F.regexp_replace(strip_tags(c), r"^\s*[\p{L}\p{N}.]*", "")))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def is_word_like(w: Column) -> Column:
    return F.regexp_count(w, F.lit(r"[\p{L}\p{N}]")) >= 2


def word_like_count(c: Column) -> Column:
    return F.size(F.filter(words(c), is_word_like))


def token_proxy(c: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def md_cell(c: Column) -> Column:
    return trim_ws(_chain(F.coalesce(c, F.lit("")), ("\n", " "), ("|", "\\|")))


def table_md(cells: Column, text: Column | None = None) -> Column:
    """A pipe table of array<array<string>>, rows padded to the longest; without cells the text or a placeholder."""
    width = F.aggregate(cells, F.lit(0), lambda m, r: F.greatest(m, F.size(r)))
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, md_cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.array_join(F.concat(F.array(row(cells[0]), rule), F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), row)), "\n")
    fallback = F.lit("_[table]_") if text is None else F.coalesce(F.nullif(text, F.lit("")), F.lit("_[table]_"))
    return F.when(F.coalesce(F.size(cells), F.lit(0)) > 0, body).otherwise(fallback)


def search_text(kind: Column, text: Column, cells: Column, caption: Column) -> Column:
    """What find sees of a block: its plain text, a table's cells, a caption."""
    return F.concat_ws("\n", F.nullif(plain(text), F.lit("")), F.when((kind == "table") & (F.size(cells) > 0), F.array_join(F.transform(F.flatten(cells), lambda x: F.coalesce(x, F.lit(""))), " ")), F.nullif(caption, F.lit("")))


def block_md(kind: Column, text: Column, level: Column, cells: Column, caption: Column, label: Column, image: Column) -> Column:
    """One block as the query markdown shows it."""
    t = plain(F.coalesce(text, F.lit("")))
    cap = F.coalesce(F.nullif(caption, F.lit("")), F.nullif(label, F.lit("")), F.lit("figure"))
    hashes = F.repeat(F.lit("#"), F.least(F.coalesce(F.nullif(level, F.lit(0)), F.lit(1)), F.lit(6)))
    fenced = F.concat(F.lit("```\n"), F.regexp_replace(t, r"\n+$", ""), F.lit("\n```"))
    return (
        F.when(kind == "heading", F.regexp_replace(F.concat_ws(" ", hashes, t), f"{WS}+$", ""))
        .when(kind == "list_item", F.concat(F.lit("- "), t))
        .when(kind == "table", table_md(cells, text))
        .when(kind == "figure", F.when(F.coalesce(image, F.lit("")) != "", F.concat(F.lit("!["), cap, F.lit("]("), image, F.lit(")"))).otherwise(F.concat(F.lit("_[figure: "), cap, F.lit("]_"))))
        .when(kind == "caption", F.when(t != "", F.concat(F.lit("_"), t, F.lit("_"))).otherwise(""))
        .when(kind == "footnote", F.when(t != "", F.concat(F.lit("> "), t)).otherwise(""))
        .when(kind == "code", F.when(trim_ws(t) != "", fenced).otherwise(""))
        .otherwise(t)
    )


def snippet(text: Column, start: Column, end: Column, width: int = 80) -> Column:
    """The match in «», with what fits around it in about width characters. start and end count from 0."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    half = F.greatest(F.lit(0), F.floor((F.lit(width) - (end - start)) / 2).cast("int"))
    lo, hi = F.greatest(F.lit(0), start - half), F.least(F.length(flat), end + half)
    part = lambda a, b: F.substr(flat, a + 1, b - a)
    return trim_ws(F.concat(F.when(lo > 0, "…").otherwise(""), part(lo, start), F.lit("«"), part(start, end), F.lit("»"), part(end, hi), F.when(hi < F.length(flat), "…").otherwise("")))


def strip_svg(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<svg.*?</svg>", "")


def visible_text(c: Column) -> Column:
    """Text of a page body: no drawings, tags as spaces, entities decoded, single spaces."""
    return normalize_ws(unescape_entities(strip_tags(strip_svg(c), "open")))


def strip_full_bold(c: Column) -> Column:
    t = trim_ws(c)
    inner = F.regexp_extract(t, r"(?s)^\*\*(.+)\*\*$", 1)
    return F.when((inner != "") & ~F.contains(inner, F.lit("**")), inner).otherwise(t)


def md_anchor(c: Column) -> Column:
    return F.regexp_replace(c, r"^#sec-", "#")


def squeeze_blanks(c: Column) -> Column:
    """Single blank lines, no spaces at line ends, one newline at the end."""
    ends = F.regexp_replace(F.regexp_replace(c, r"\r\n", "\n"), r"[^\S\n]+(?=\n|$)", "")
    return F.concat(F.regexp_replace(F.regexp_replace(ends, r"\n{3,}", "\n\n"), r"\n+$", ""), F.lit("\n"))


def data_uri(c: Column) -> Column:
    """struct(bytes, ext) of a base64 data URI, null for anything else."""
    meta, data = F.regexp_extract(c, r"^data:([^,]*),", 1), F.regexp_replace(c, r"^data:[^,]*,", "")
    mime = F.split_part(meta, F.lit(";"), F.lit(1))
    ext = F.when(mime == "image/png", "png").when(mime.isin("image/jpeg", "image/jpg"), "jpg").when(mime == "image/gif", "gif").when(mime == "image/webp", "webp").when(mime == "image/svg+xml", "svg").otherwise("bin")
    raw = F.try_to_binary(trim_ws(data), F.lit("base64"))
    return F.when(c.rlike(r"^data:[^,]*base64[^,]*,") & raw.isNotNull(), F.struct(raw.alias("bytes"), ext.alias("ext")))


def join_wrapped(c: Column) -> Column:
    """Wrapped lines as one: a hyphen between a letter and a lower-case letter on the next line goes, other breaks are spaces."""
    return F.regexp_replace(F.regexp_replace(c, r"(\p{L})[-­][ \t]*\n[ \t]*(\p{Ll})", "$1$2"), r"[ \t]*\n[ \t]*", " ")


def glyph_adjacent(gap: Column, size: Column) -> Column:
    return (gap <= size * 0.2) & (gap >= size * -0.35)


# Fixed lists of frequent words, the evidence for a language.
_STOP = {
    "eng": "the of and to in is that it was for on are as with be by this from at or".split(),
    "por": "de a o que e do da em um para com não uma os no se na por mais as dos".split(),
    "nor": "og i jeg det at en et den til er som på de med han av ikke der så var".split(),
    "deu": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split(),
    "fra": "de la le et les des en un du une que est pour qui dans sur pas au par avec".split(),
    "spa": "de la que el en y a los se del las un por con no una su para es al".split(),
}


def detect_language(c: Column, least: float = 0.55) -> Column:
    """The language whose frequent words make up most of those found, null below the least share or five words."""
    every = sorted({w for v in _STOP.values() for w in v})
    among = lambda ws, known: F.filter(ws, lambda w: w.isin(known))
    found = among(words(F.lower(F.coalesce(c, F.lit("")))), every)

    def verdict(ws: Column) -> Column:
        shares = F.array(*(F.struct((F.size(among(ws, v)) / F.greatest(F.size(ws), F.lit(1))).alias("share"), F.lit(k).alias("name")) for k, v in _STOP.items()))
        best = F.array_max(shares)
        return F.when((F.size(ws) >= 5) & (best["share"] >= least), best["name"])

    return F.transform(F.array(found), verdict)[0]
