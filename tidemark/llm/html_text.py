"""Main text of web pages by tag-path ratios.

A page becomes a list of blocks, each with its root-to-leaf path of block tags (and classes) and its text. For every path
the characters and the punctuation marks per block are aggregated; along the page these ratios are smoothed with the
neighbouring blocks, fused into one figure and weighted by how much of the path's text is outside links. Paths below a
threshold, relative to the page's best path, go. What tags and roles mark as menu, header, footer, sidebar, dialog, script
or style never counts. Where classes, ids or a form tag name a menu, notice, advert, comment and the like, paths weigh a
twentieth, unless elements in the named one hold most of the page's text: such names are of layouts and wrappers. Where
the markup marks the article, paths inside weigh more and paths outside less, by the share of the page's text inside; all
of them have to pass the threshold.

Null and empty html give an empty text. Unclosed tags, comments and quotes are read as browsers do, roughly: a paragraph
ends where the next block starts, an unclosed comment or script runs to the end. Pages are read whole, at any depth and
length. Repeated pages are rows of their own, an empty table gives no rows, and columns that aren't asked for don't matter.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, slices, table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>""", re.S)
#: One attribute with its value, so that names inside of values are never taken for attributes.
ATTR = re.compile(r"""([^\s"'<>/=][^\s<>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "ruby", "rt", "rp", "nobr"}
NEVER = {"head", "script", "style", "title", "textarea", "noscript", "template", "nav", "header", "footer", "aside", "button", "select", "option", "fieldset", "dialog", "iframe", "svg", "canvas", "object", "menu", "noembed", "noframes", "xmp", "audio", "video", "map"}
NEVER_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: What a class or id names that is hardly ever main text. The last word of a name says what it is: a site-header is a
#: header, but ad-free, legal-history or side-by-side are none of these.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "sponsor", "sponsored", "sponsors", "promo", "promos", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "notifications", "alert", "popup", "modal", "overlay",
    "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "widgets", "footer", "header", "masthead", "topbar",
    "comment", "comments", "commentlist", "respond", "discussion", "disqus", "reply", "replies", "share", "sharing", "social", "related", "recommended", "recommendations",
    "newsletter", "subscribe", "subscription", "signup", "login", "form", "search", "toolbar", "pagination", "pager", "copyright", "legal", "disclaimer",
}
#: Words at the end of a name that say where or what kind of box, not what is in it.
TAILS = {"area", "bar", "block", "body", "bottom", "box", "buttons", "container", "content", "group", "holder", "icons", "inner", "item", "items", "left", "links", "list", "outer", "panel", "posts", "right", "section", "slot", "stories", "top", "unit", "wrap", "wrapper", "zone"}
#: Words that tell of a layout with or without such a box.
ABOUT = {"has", "no", "not", "with", "without"}
PARTS = re.compile(r"[A-Z]?[^\W_A-Z\d]+|[A-Z]+")
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "figcaption", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPE = {"table", "ul", "ol", "dl", "article", "section", "div", "body", "html", "main", "select", "td", "th", "blockquote"}
#: A path's fused figure must reach this share of the page's best.
SHARE = 0.15
#: Paths with more than this share of their characters in links are lists of links.
LINKS = 0.6
#: Where all of a page's text is in its marked article, paths inside weigh so many times as much, and paths outside as much less.
ARTICLE = 2.0
#: What names that tell against main text leave of a path's figure.
NAMED = 0.05
MARKS = re.compile(r"[.,;:!?…。，、；：！？]")


def names_against(names: str) -> bool:
    """Whether one of the classes or ids names what is hardly ever main text."""
    for name in names.split():
        words = [w.lower() for w in PARTS.findall(name)]
        while len(words) > 1 and words[-1] in TAILS:
            words.pop()
        if words and words[-1] in NAMES and not ABOUT.intersection(words):
            return True
    return False


def blocks_of(page: str) -> tuple[list[tuple[int, bool, bool, int, str, int]], list[int]]:
    """(number of the path, never counts, inside the marked article, named element, text, characters in links) of all blocks in page order.

    Elements whose names tell against main text are numbered from 1 on; a block has the innermost one around it, or 0, and
    that number negative where the text is the element's own. The second result has, for each of them, the next one around it.
    """
    out: list[tuple[int, bool, bool, int, str, int]] = []
    around = [0]
    paths: dict[tuple[int, str, str], int] = {}  # a path's number by the path around it, the tag and its first class
    # an open tag: its name, the number of its path, whether its content never counts, whether it is in the article, the named element
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
    # where in the stack the open tags of each name are, and those that end a search
    places: defaultdict[str, list[int]] = defaultdict(list)
    scopes: list[int] = []
    parts: list[str] = []
    links = linked = 0

    def close() -> None:
        nonlocal linked
        if parts and (text := " ".join("".join(parts).split())):
            _, path, never, inside, named = stack[-1]
            own = len(stack) > 1 and named != stack[-2][4]
            out.append((path, never, inside, -named if own else named, text, linked))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    def end(to: int) -> None:
        close()
        for name, *_ in reversed(stack[to:]):
            places[name].pop()
            if name in SCOPE:
                scopes.pop()
        del stack[to:]

    def find(names: tuple[str, ...], scope: bool) -> int:
        k = max((places[x][-1] for x in names if places.get(x)), default=0)
        return 0 if scope and scopes and k < scopes[-1] else k

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if not stack[-1][2]:
            say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA[") and not stack[-1][2]:
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        name, ends, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ends:
            if name in INLINE:
                if name == "a" and links:
                    links -= 1
            elif name == "br":
                parts.append(" ")
            elif k := find((name,), False):
                end(k)
            else:
                close()
            continue
        if name in INLINE:
            if name == "a":
                links = 1
            continue
        if name in VOID:
            if name == "hr":
                close()
            elif name in ("br", "wbr"):
                parts.append(" " if name == "br" else "")
            continue
        if name in CLOSES_P and (k := find(("p",), True)):
            end(k)
        elif name in CLOSES and (k := find(CLOSES[name], True)):
            while j := find(CLOSES[name], True):
                k = j
                end(k)
        else:
            close()
        held: dict[str, str] = {}
        for a, b, c, d in ATTR.findall(attrs) if attrs else ():
            held.setdefault(a.lower(), b or c or d)  # the first one counts
        _, path, never, inside, named = stack[-1]
        names = f"{held.get('class', '')} {held.get('id', '')}"
        role = held.get("role", "").lower()
        body = name in ("html", "body")
        # a page's own header and the like may stand inside the article: they never count either
        never = never or name in NEVER or role in NEVER_ROLE or "hidden" in held
        if not never and not body and (name == "form" or role == "form" or names_against(names)):
            around.append(named)
            named = len(around) - 1
        inside = inside or name in ("article", "main") or role in ("main", "article")
        if name in RAW:
            close()
            m = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = m.end() if m else n
            continue
        if name == "a":
            links = 0
        path = paths.setdefault((path, name, (held.get("class", "").split() or [""])[0]), len(paths) + 1)
        places[name].append(len(stack))
        if name in SCOPE:
            scopes.append(len(stack))
        stack.append((name, path, never, inside, named))
    close()
    return out, around


def told_against(found: list[tuple[int, bool, bool, int, str, int]], around: list[int]) -> list[bool]:
    """For each named element, whether its name counts: not where elements in it hold more than half of the page's text outside links."""
    held = [0.0] * len(around)
    for _, never, inside, named, text, n in found:
        if not never:
            held[named if named >= 0 else around[-named]] += max(0, len(text) - n) * (ARTICLE if inside else 1)
    for k in range(len(around) - 1, 0, -1):  # an element has a larger number than those around it
        held[around[k]] += held[k]
    return [k > 0 and 2 * x <= held[0] for k, x in enumerate(held)]


def content_paths(found: list[tuple[int, bool, bool, int, str, int]], against: list[bool]) -> set[tuple[int, bool, bool]]:
    """The paths, each with whether it is inside the marked article and named against, whose weighted ratio passes."""
    kept = [((path, inside, against[abs(named)]), text, n) for path, never, inside, named, text, n in found if not never]
    size, marks, count, linked, plain = (defaultdict(float) for _ in range(5))
    for key, text, n in kept:
        size[key] += len(text)
        marks[key] += len(MARKS.findall(text))
        count[key] += 1
        linked[key] += n
        plain[key[1]] += max(0, len(text) - n) * (NAMED if key[2] else 1)
    # the mark of the article is worth as much as the share of the page's text that it holds: a marked teaser is worth little
    trust = 1 + (ARTICLE - 1) * plain[True] / ((plain[True] + plain[False]) or 1.0)
    ratio = [(size[key] / count[key], marks[key] / count[key]) for key, *_ in kept]
    best: dict[tuple[int, bool, bool], float] = defaultdict(float)
    for k, (key, *_) in enumerate(kept):
        near = [(w, ratio[k + d]) for d, w in ((-2, 0.06), (-1, 0.24), (0, 0.4), (1, 0.24), (2, 0.06)) if 0 <= k + d < len(kept)]
        total = sum(w for w, _ in near)
        length, punctuation = (sum(w * r[j] for w, r in near) / total for j in (0, 1))
        outside = 1 - min(1.0, linked[key] / size[key])
        # smoothing lends a heading the weight of its paragraphs, but a path must also stand for itself
        fused = math.sqrt(length * (0.5 + punctuation)) * outside * math.sqrt(min(1.0, size[key] / count[key] / 20))
        best[key] = max(best[key], fused * (NAMED if key[2] else 1))
    most = max(best.values(), default=0.0)
    # in the article, lists of links have no punctuation; elsewhere, they may
    lists = {key for key in size if linked[key] > LINKS * size[key] and not (key[1] and marks[key])}
    return {key for key, x in best.items() if x > 0 and key not in lists and (x * trust if key[1] else x / trust) >= SHARE * most}


def main_text(page: str | None) -> str:
    """The main text: content blocks in page order, two line ends between them."""
    if not page:
        return ""
    found, around = blocks_of(page)
    against = told_against(found, around)
    paths = content_paths(found, against)
    return "\n\n".join(text for path, never, inside, named, text, _ in found if not never and (path, inside, against[abs(named)]) in paths)


def extract_text(pages: DataFrame, *, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The key columns and ``text`` of every row of ``pages``."""
    bounded_batches(pages.sparkSession)
    few = pages.select(*keys, F.col(html).cast("string").alias("html_"))
    kind = T.StructType([*few.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html_"):
                made = pa.array([main_text(x) for x in batch.column("html_").to_pylist()], type=pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=kind.names)

    return few.mapInArrow(run, kind)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    made = extract_text(table(spark, sf_dir, "pages"))
    return made.withColumn("n_chars", F.length("text").cast("long"))
