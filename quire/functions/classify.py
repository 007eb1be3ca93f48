"""Column functions that judge a line or a text: captions, lists, headings, references, OCR quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_tags, trim_ws, words

# ---- captions. The patterns are kept to what Java and RE2 read alike.
CAPTION = r"(?i)^\s*(figure|fig\.|cuadro|table|fig[ \t]|box[ \t])\s*"
NUMBER = r"([0-9]+(?:[.-][0-9]+)*)"
# Fixed stems that make a sentence of a reference.
PREDICATES = "show|summari|present|plot|compar|illustrat|depict|report|list|give|provide|denote|display|demonstrat|describe|confirm|indicat|suggest|impl|exhibit|contain|yield|mark|reveal|we |it |is |are |can |highlight|visuali"
XREF = r"^\s*(?:figure|fig\.|fig|cuadro|table|tab\.|box)\s*[0-9][0-9.a-z]*"
XREF_REST = rf"^(?:\s*,|[) ]*(?:{PREDICATES})|[) ]*[a-z][^ ]* (?:{PREDICATES}))"


def is_caption(c: Column) -> Column:
    return c.rlike(CAPTION + NUMBER)


def caption_is_figure(c: Column) -> Column:
    return F.when(is_caption(c), F.lower(F.trim(F.regexp_extract(c, CAPTION + NUMBER, 1))).isin("figure", "fig.", "fig", "box"))


def _letter(c: Column) -> Column:
    return F.regexp_extract(c, CAPTION + r"[0-9]+(?:[.-][0-9]+)*([A-Za-z])(?:[^A-Za-z]|$)", 2)


def caption_number(c: Column) -> Column:
    """6.2.1, 0.1-1 or 1A; null if the line is no caption."""
    return F.when(is_caption(c), F.concat(F.regexp_extract(c, CAPTION + NUMBER, 2), _letter(c)))


def caption_tail(c: Column) -> Column:
    head = CAPTION + NUMBER
    return F.when(is_caption(c), F.when(_letter(c) != "", F.regexp_replace(c, head + "[A-Za-z]", "")).otherwise(F.regexp_replace(c, head, "")))


def caption_label(c: Column) -> Column:
    """'Table 3' of a caption as the model stores it, with the word as written."""
    t = trim_ws(c)
    word, number = F.regexp_extract(t, r"(?i)^(table|figure|fig\.|fig)", 1), F.regexp_extract(t, r"(?i)^(?:table|figure|fig\.|fig)\s*([\p{L}\p{N}.]+)", 1)
    number = F.regexp_replace(number, r"\.+$", "")
    return F.when((word != "") & (number != ""), F.concat(word, F.lit(" "), number))


def is_inline_xref(c: Column) -> Column:
    """'Figure 2 shows': a sentence that refers, not a caption."""
    low = F.lower(c)
    return low.rlike(XREF) & F.regexp_replace(low, XREF, "").rlike(XREF_REST)


def opens_figure_caption(c: Column) -> Column:
    strict = F.coalesce(caption_is_figure(c), F.lit(False))
    return (strict | c.rlike(r"(?i)^\s*(?:figure|fig\.|fig[ \t])\s*[a-z]{1,2}[.-]?[0-9]")) & ~is_inline_xref(c)


def caption_is_continued(c: Column) -> Column:
    core = F.lower(F.regexp_replace(caption_tail(c), r"^[^\p{L}\p{N}']+|[^\p{L}\p{N}']+$", ""))
    return F.coalesce(core.isin("continued", "cont", "cont'd"), F.lit(False))


def dotleader_tail(c: Column) -> Column:
    """Does the line end in four or more leader dots (an ellipsis counts three), with or without a page number?"""
    t = F.regexp_replace(F.regexp_replace(c, r"\s+$", ""), r"\s*[0-9]+$", "")
    run = F.regexp_extract(t, r"([.…· \t]*)$", 1)
    return F.length(F.regexp_replace(run, "[^.·]", "")) + 3 * F.length(F.regexp_replace(run, "[^…]", "")) >= 4


# ---- lists
BULLETS = r"•◦▪‣\x{95}\x{85}"
WEAK = "·−–*"
ORDERED = r"^\s*([0-9]{1,2})[.)](?:[^0-9]|$)"


def list_ordered(c: Column) -> Column:
    """True for an ordered marker, false for a bullet, null for neither."""
    rest = F.regexp_replace(c, rf"^\s*[{WEAK}]", "")
    prose = (F.size(words(rest)) >= 3) & (F.regexp_count(rest, F.lit(r"\p{L}")) >= 6)
    return F.when(c.rlike(rf"^\s*[{BULLETS}]") | (c.rlike(rf"^\s*[{WEAK}]\s") & prose), F.lit(False)).when(c.rlike(ORDERED), F.lit(True))


def ordered_num(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, ORDERED, 1), F.lit("")).cast("int")


def strip_marker(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"^\s*[{BULLETS}{WEAK}]*\s*", ""), r"^[0-9]+[.)]\s*", "")


# ---- headings
NUMBERED = r"^\s*((?:[0-9]+|[A-Z])(?:\.[0-9]+)*)\.? +\p{L}"


def numbered_level(c: Column) -> Column:
    """Depth (to 3) of a leading section number or appendix letter with a title after it."""
    number = F.regexp_extract(c, NUMBERED, 1)
    return F.when(number != "", F.least(F.lit(3), 1 + F.length(F.regexp_replace(number, r"[^.]", ""))))


def roman_section(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*[IVXLCDM]{1,5}\. +\p{L}"), F.lit(1))


def has_year(c: Column) -> Column:
    return c.rlike("(?:19|20)[0-9][0-9]")


def initials_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?:^| )[A-Z]\."))


def looks_like_reference(c: Column) -> Column:
    commas = F.length(F.regexp_replace(c, "[^,]", ""))
    return (commas >= 2) | c.endswith(".") | (has_year(c) & (commas >= 1)) | c.rlike(r"\S\s* [A-Z]\.")


def sec_anchor(c: Column) -> Column:
    """1 for 'PART II ...', 2 for 'Item 1A. ...', null when a sentence goes on in lower case."""
    part = r"^(?i:part )\s*[IVXivx]{1,5}[:.—,-]*(?:\s*$|\s+[^a-z\s])"
    item = r"^(?i:item )\s*[0-9]{1,2}[A-Za-z]{0,2}(?:\s*$|[.:]|\s+[^a-z\s])"
    return F.when(c.rlike(part), F.lit(1)).when(c.rlike(item), F.lit(2))


# Fixed word lists of unfinished and of finite clauses.
TRAILING = "and|or|but|with|of|that|which|the|a|an|to|for|in|on|at|by|as|from|into|than|where|while"
VERBS = "is|are|was|were|have|has|had|been|be|set|shows|show|due|using|based"
UNITS = "gev|tev|mev|kev|ev|kg|mhz|ghz|khz|hz|nm|mm|cm|km|ms"


def looks_like_clause(c: Column) -> Column:
    core = F.regexp_replace(c, r"^\s*(?:[0-9][0-9.]*|[IVXLCDM]+|[A-Z])\.\s+", "")
    return (
        c.rlike(r",$")
        | c.rlike(rf"(?i)(?:^|\s)[^\p{{L}}\s]*(?:{TRAILING})[^\p{{L}}\s]*\s*$")
        | core.rlike(r"\. [\p{Lu}(]")
        | c.rlike(rf"\S\s+[^\p{{L}}\s]*(?:{VERBS})[^\p{{L}}\s]*(?:\s|$)")
        | c.rlike(rf"^\s*[0-9]\S*\s+[^\p{{L}}\s]*(?i:{UNITS})[^\p{{L}}\s]*\s+(?:\S+\s+)*\p{{Ll}}")
    )


def size_level(ratio: Column) -> Column:
    return F.when(ratio >= 1.5, 1).when(ratio >= 1.2, 2).otherwise(3)


def doctags_level(c: Column) -> Column:
    """Level of a recognised line that reads as a heading: dotted depth, or mostly capitals."""
    t = trim_ws(c)
    n = F.length(t)
    first = F.regexp_replace(F.regexp_extract(t, r"^(\S+)", 1), r"\.+$", "")
    depth = F.size(F.filter(F.split(first, r"\."), lambda p: p != ""))
    letters, upper = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"\p{Lu}"))
    return F.when((n < 3) | (n > 75), F.lit(None)).when(first.rlike(r"^[0-9.]*[0-9][0-9.]*$") & t.rlike(r"^\S+\s+\S"), F.least(F.greatest(depth, F.lit(1)), F.lit(4))).when((letters > 0) & (upper * 100 >= letters * 85) & ~t.endswith("."), F.lit(1))


def is_axis_label(c: Column) -> Column:
    t = trim_ws(c)
    tokens = words(t)
    ticks = F.size(F.filter(tokens, lambda w: w.rlike(r"^[0-9.,–%-]{1,6}$")))
    title = (F.size(tokens) <= 2) & (F.octet_length(t) <= 14) & F.contains(t, F.lit("(")) & F.contains(t, F.lit(")"))
    return (t != "") & (((ticks >= 1) & (ticks * 2 >= F.size(tokens))) | title)


def is_num_token(c: Column) -> Column:
    return c.rlike(r"[0-9]") & c.rlike(r"^[0-9.,%+±()*-]+$")


# Fixed sets of signs and letters of formulas.
MATH = r"=+\-−–×÷·≤≥≠≈∝∫∑∏√∈∉⊂⊆∂∇∞()\[\]{}|/^_<>"
GREEK = "αβγδεζηθικλμνξπρστυϕφχψωΓΔΘΛΞΠΣΦΨΩ"


def is_math_fragment(c: Column) -> Column:
    t = trim_ws(strip_tags(c))
    n = F.length(t)
    return (n > 0) & (n <= 60) & (F.regexp_count(t, F.lit(r"\p{L}{2,}")) <= 1) & (t.rlike(f"[{MATH}{GREEK}]") | (n <= 2) | ~t.rlike(r"\p{L}"))


def introduces_list(c: Column) -> Column:
    return F.regexp_replace(strip_tags(c), r"\s+$", "").endswith(":")


# ---- recognised text
# Fixed names of producers and fixed vowels.
PRODUCERS = "tesseract|abbyy|finereader|ocrmypdf|ocr|scan|scansnap|kofax|omnipage|readiris|adobe acrobat capture|paperport"
VOWELS = "aeiouáéíóúâêôãõàAEIOUÁÉÍÓÚ"


def is_garbled(c: Column) -> Column:
    """Broken characters, or too many words of three letters or more without a vowel; letters alone are left once, then counted."""

    def verdict(t: Column, letters: Column) -> Column:
        n = F.length(t)
        real = F.regexp_count(letters, F.lit(r"\S{3,}"))
        mute = F.regexp_count(letters, F.lit(rf"(?<!\S)[^\s{VOWELS}]{{3,}}(?!\S)"))
        broken = n - F.length(F.translate(t, "�", ""))
        return (n >= 200) & ((broken * 200 >= n) | ((real >= 20) & (mute * 100 >= real * 18)))

    both = F.transform(F.array(trim_ws(c)), lambda t: F.struct(t.alias("t"), F.regexp_replace(t, r"[^\p{L}\s]+", "").alias("l")))
    return F.transform(both, lambda x: verdict(x["t"], x["l"]))[0]


def is_ocr_producer(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(PRODUCERS), F.lit(False))


def ocr_decision(has_image: Column, coverage: Column, n_text: Column, producer: Column, garbled: Column) -> Column:
    return F.when(~has_image, "not_needed").when((n_text < 120) | ((coverage >= 0.5) & (n_text <= 900)), "needs_ocr").when(is_ocr_producer(producer) | garbled, "drop_and_ocr").otherwise("not_needed")


def legible_chars(c: Column) -> Column:
    """Letters and digits outside <...> and [...], with nesting: a fold over the characters that matter."""
    marks = F.regexp_extract_all(c, F.lit(r"([<>\[\]\p{L}\p{N}])"), F.lit(1))
    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("s"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        a = F.when(x == "<", acc["a"] + 1).when(x == ">", F.greatest(acc["a"] - 1, F.lit(0))).otherwise(acc["a"])
        s = F.when(x == "[", acc["s"] + 1).when(x == "]", F.greatest(acc["s"] - 1, F.lit(0))).otherwise(acc["s"])
        return F.struct(a.alias("a"), s.alias("s"), (acc["n"] + F.when((acc["a"] == 0) & (acc["s"] == 0) & ~x.isin("<", ">", "[", "]"), 1).otherwise(0)).alias("n"))

    return F.aggregate(marks, zero, step, lambda acc: acc["n"])


def ocr_outcome(legible: Column, full: Column) -> Column:
    share = legible / F.greatest(full, F.lit(1))
    return F.when(share >= 0.5, "ocr_ok").when(share >= 0.05, "ocr_partial").otherwise("ocr_illegible")


def is_text_image(c: Column) -> Column:
    return F.length(F.regexp_replace(strip_tags(c), r"\s", "")) >= 8


def gate_says_text(raw_words: Column, conf_chars: Column, ink: Column) -> Column:
    return (raw_words >= 25) | (conf_chars >= 8) | (ink >= 40)
