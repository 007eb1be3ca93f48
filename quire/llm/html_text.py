"""Main text of web pages by composite text density over the DOM.

Every node has characters C, tags T, characters in links LC and tags of links
LT (of its subtree). Its density is

    C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LB / CB * C + e))

with LB / CB of the whole body and every zero divisor taken as one (without any
link on a page, the lower logarithm is such a zero). The density
sum of a node is the sum over its children. The node with the largest sum is the
main one; the smallest density on its path up to the body is the threshold, and
every other subtree that reaches it and has no part in boilerplate joins in.

Boilerplate (menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts, styles) is known by element, role, or the words of id and
class, and leaves the tree before densities are taken. Words alone don't remove
what holds an h1 or main element. Words that articles use for parts of their own
(legal, related, discussion) are only evidence inside a main element: links or a
scrap of text have to come with them. A form that holds an h1, a main element,
an article or most of the text stays. A main node inside an
article or main element stands for that element, which the page's first
h1 joins. One page is one row: pages never meet, so nothing is shuffled; the time
for a page grows in proportion to its length, however deep its elements nest.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed sets of element names.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head script style noscript template title nav header footer aside form button select option textarea input fieldset iframe noembed noframes xmp object embed applet canvas svg annotation annotation-xml audio video map dialog menu".split())
#: An open element of the key closes when one of the values opens in it.
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"}}
SCOPE = frozenset("table td th ul ol dl div article section main aside body html blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
#: Words of an id or class that name boilerplate.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsbygoogle banner banners sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs topbar toolbar masthead footer sidebar sidebars aside rail widget widgets "
    "notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond replies discussion reactions "
    "share sharing social related recommended recommendations trending pagination pager skip search legal copyright disclaimer".split()
)
#: Of these, words that an article may use for a part of its own.
PARTS = frozenset("discussion related legal copyright disclaimer search social rail share sharing promotion overlay recommended recommendations trending reactions".split())
_CELLS = frozenset("td th tr thead tbody".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Characters from which on a part of a main element outweighs its words, unless half of it is links; below, it must be a sentence.
PROSE = 60
_SENTENCE = re.compile(r"(?:\S+\s+){3,}\S+[.!?…][\"'”’»)]*\s*$")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Node:
    __slots__ = ("c", "density", "drop", "freed", "inside", "kids", "lc", "lt", "main", "part", "soft", "sum", "t", "tag", "up")

    def __init__(self, tag: str, up: Node | None = None, drop: bool = False, main: bool = False, soft: bool = False, part: bool = False):
        self.tag, self.up, self.drop, self.main, self.soft, self.part, self.kids = tag, up, drop, main, soft, part, []
        self.inside = up is not None and (up.inside or up.main)
        self.freed = 0


def _boilerplate(tag: str, attrs: str, inside: bool) -> tuple[bool, bool, bool, bool]:
    """(leaves the tree, is a main element, leaves it only for a word of its id or class or as a form, has only words of PARTS)."""
    form = tag in ("form", "fieldset")
    if tag in DROPPED and not form and not (tag == "header" and inside):
        return True, False, False, False
    main = tag in ("article", "main")
    if not attrs or tag in ("html", "body"):
        return form, main, form, False
    said: set[str] = set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False, False, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False, False, False
        if name == "role":
            if value.lower() in ROLES:
                return True, False, False, False
            main = main or value.lower() in ("main", "article")
        elif name in ("id", "class") and not main:
            said |= WORDS.intersection(_SPLIT.split(_CAMEL.sub(" ", value).lower()))
        elif name == "itemprop" and value.lower() == "articlebody":
            main = True
    if said and tag not in ("article", "main"):
        return True, False, True, said <= PARTS and not form
    return form, main, form, False


class _Open:
    """The elements that are open, and where on the stack each tag, each scope, and each that others close is."""

    def __init__(self, root: Node):
        self.stack, self.at, self.scopes, self.gates = [root], {}, [0], [0]

    def push(self, x: Node) -> None:
        k = len(self.stack)
        self.stack.append(x)
        self.at.setdefault(x.tag, []).append(k)
        if x.tag in SCOPE:
            self.scopes.append(k)
        if x.tag in SCOPE or x.tag in CLOSES:
            self.gates.append(k)

    def close(self, k: int) -> None:
        """Closes what is open from place k on."""
        while len(self.stack) > k:
            x = self.stack.pop()
            self.at[x.tag].pop()
            if x.tag in SCOPE:
                self.scopes.pop()
            if x.tag in SCOPE or x.tag in CLOSES:
                self.gates.pop()

    def end(self, tag: str) -> None:
        places = self.at.get(tag)
        if places and (tag in BLOCK or places[-1] >= self.scopes[-1]):
            self.close(places[-1])

    def begin(self, tag: str) -> None:
        """Closes what an element of this tag closes as it opens."""
        k = len(self.stack) - 1
        while k:
            x = self.stack[k]
            if tag in CLOSES.get(x.tag, ()):
                self.close(k)
                if x.tag not in _CELLS or tag == x.tag:
                    return
                k -= 1
                continue
            if x.tag in SCOPE or tag not in BLOCK:
                return
            # the gates are few: closed by their own kind, or by any block
            g = len(self.gates) - 1
            while self.gates[g] >= k:
                g -= 1
            k = self.gates[g]


def parse(page: str) -> Node:
    """A lenient DOM: unclosed p, li, cells and formatting close where HTML closes them; stray ends are ignored."""
    root = Node("html")
    at, open_, pos, n = root, _Open(root), 0, len(page)
    stack = open_.stack
    last = page.rfind(">")
    while pos < n:
        m = _TOKEN.search(page, pos) if pos <= last or "<!--" in page[pos:] else None
        if m is None:
            stack[-1].kids.append(page[pos:])
            break
        if m.start() > pos:
            stack[-1].kids.append(page[pos : m.start()])
        pos = m.end()
        name = m[3] or m[6]
        if name is None:
            if m[1] is not None:
                stack[-1].kids.append(m[1])
            continue
        name, close, attrs = name.lower(), m[2] or m[5], m[4] or m[7] or ""
        if close:
            open_.end(name)
            continue
        if name == "html":
            continue
        if name == "body":
            if at is root:
                open_.close(1)
                at = Node("body", root)
                root.kids.append(at)
                open_.push(at)
            elif len(stack) == 1:
                open_.push(at)  # a repeated body goes on in the first
            continue
        open_.begin(name)
        node = stack[-1]
        if name in VOID:
            node.kids.append(Node(name, node, name in DROPPED))
            continue
        drop, main, soft, part = _boilerplate(name, attrs, node.inside or node.main)
        if name in ("h1", "main", "article"):
            # a word in a class doesn't outweigh the title or main element within, nor a form an article
            up, rank = node, 1 if name == "article" else 2
            while up is not None and up.freed < rank:
                up.drop = up.drop and not (up.soft and (name != "article" or up.tag in ("form", "fieldset")))
                up.freed, up = rank, up.up
        new = Node(name, node, drop, main, soft, part)
        node.kids.append(new)
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, pos)
            if end is None:
                pos = n
            else:
                gt = page.find(">", end.end() - 1)
                pos = n if gt < 0 else gt + 1
            continue
        if not attrs.endswith("/") or name not in ("svg", "path", "g", "use", "rect", "circle"):
            open_.push(new)
    if at is not root:
        # what strays before or after the body is part of it
        k = root.kids.index(at)
        at.kids = root.kids[:k] + at.kids + root.kids[k + 1 :]
        root.kids = [at]
        for x in at.kids:
            if x.__class__ is Node:
                x.up = at
    return root


def _rescue(root: Node) -> None:
    """Keeps parts of an article that only words of an id or class would remove, and forms that hold most of the text."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in x.kids if k.__class__ is Node and (k.soft or not k.drop))
    soft = [x for x in order if x.soft and x.drop]
    if not soft:
        return
    for x in reversed(order):
        x.c = x.lc = 0
        for k in x.kids:
            if k.__class__ is not Node:
                x.c += len(k.strip())
            elif not k.drop:
                x.c += k.c
                x.lc += k.lc
        if x.tag == "a":
            x.lc = x.c
        if x.part and x.drop and x.inside and x.lc * 2 < x.c:
            x.drop = x.c < PROSE and not _SENTENCE.search(_blocks(x.kids))
    rest = root.c
    for x in soft:
        if x.drop and x.tag in ("form", "fieldset") and x.c - x.lc > rest:
            x.drop = False
            rest += x.c


def density(c: int, t: int, lc: int, lt: int, rate: float) -> float:
    """The composite density of c characters and t tags, of which lc and lt in links; rate: the body's link characters a character."""
    base = math.log(math.log(c / max(c - lc, 1) * lc + rate * c + math.e))
    return c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / (base or 1.0)


def _measure(root: Node) -> None:
    """c, t, lc, lt of each node, bottom up, without recursion."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in x.kids if k.__class__ is Node and not k.drop)
    for x in reversed(order):
        c = t = lc = lt = 0
        for k in x.kids:
            if k.__class__ is Node:
                if not k.drop:
                    c += k.c
                    t += k.t + 1
                    lc += k.lc
                    lt += k.lt + (k.tag == "a")
            else:
                c += len(k) if "&" not in k else len(html.unescape(k))
                c -= len(k) - len(k.strip())
        if x.tag == "a":
            lc, lt = c, t
        x.c, x.t, x.lc, x.lt = c, t, lc, lt
    body = next((k for k in root.kids if k.__class__ is Node and k.tag == "body"), root)
    rate = body.lc / max(body.c, 1)
    for x in order:
        if not x.c:
            x.density = 0.0
            continue
        x.density = density(x.c, x.t, x.lc, x.lt, rate)
    for x in order:
        x.sum = sum(k.density for k in x.kids if k.__class__ is Node and not k.drop)


def _blocks(nodes: list[Node]) -> str:
    """Blocks in page order, white space inside one turned into a space, joined by a newline."""
    out, cur = [], []

    def flush() -> None:
        text = " ".join("".join(cur).split())
        if text:
            out.append(text)
        cur.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif x.__class__ is str:
                cur.append(html.unescape(x) if "&" in x else x)
            elif not x.drop:
                block = x.tag in BLOCK
                if block:
                    flush()
                    stack.append(None)
                elif x.tag == "br":
                    cur.append(" ")
                stack.extend(reversed(x.kids))
        flush()
    return "\n".join(out)


def main_text(page: str | None) -> str:
    """The main text of a page; empty for a page that is null or empty or has none."""
    if not page:
        return ""
    root = parse(page)
    _rescue(root)
    _measure(root)
    body = next((k for k in root.kids if k.__class__ is Node and k.tag == "body"), root)
    order, stack = [], [body]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in reversed(x.kids) if k.__class__ is Node and not k.drop)
    best = max(order, key=lambda x: x.sum)
    if best.sum <= 0:
        best = body
    threshold, x = best.density, best
    while x is not None and x is not body:
        threshold, x = min(threshold, x.density), x.up
    threshold = min(threshold, body.density)
    up = best
    while up is not None:
        if up.main:
            best = up
        up = up.up
    chosen = {id(best)}
    # other subtrees as dense as the path, unless they hold the main one; and the page's title
    above, x = set(), best
    while x is not None:
        above.add(id(x))
        x = x.up
    stack = [body]
    while stack:
        x = stack.pop()
        if id(x) in above:
            if x is not best:
                stack.extend(k for k in x.kids if k.__class__ is Node and not k.drop)
        elif x.density >= threshold > 0 and x.lc * 2 < x.c:
            chosen.add(id(x))
    title = next((x for x in order if x.tag == "h1"), None) if best.main else None
    up = title
    while up is not None and id(up) not in chosen:
        up = up.up
    if title is not None and up is None:
        chosen.add(id(title))
    return _blocks([x for x in order if id(x) in chosen])


def extract_text(pages: DataFrame, id_: str = "page_id", url: str = "url", html_: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each page; null html and pages without text give '' and 0.

    Null ids and urls stay null; repeated pages give a row each; other columns are ignored.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=schema)

    return pages.select(F.col(id_).cast("long"), F.col(url).cast("string"), F.col(html_).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
