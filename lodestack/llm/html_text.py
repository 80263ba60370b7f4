"""Operator 1: main text of web pages by line-block distribution.

A page becomes lines: markup is stripped, block tags end a line, scripts, styles and comments vanish, and so do lines inside
containers that by tag, role, id or class are no article (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments). A line's weight is the length of its text without white space; lines that mostly stand in links weigh nothing.

Over the lines' weights a window of WINDOW lines slides. Text begins at the surge point, where a window's sum first reaches the
threshold (or the page's highest sum, if that is lower), and ends at the dive point, after the last such window. All weighing
lines between are kept, in page order.

The windows run over every page; an article or main part that the page marks only changes weights. Its lines weigh MARKED more,
so that three in a row are dense and short paragraphs and lists at its ends stay; lines outside it weigh an OUTSIDE-th, and are
kept only if they reach the threshold by themselves. Where the paragraphs outside have more than TEASER times its text, the mark is
a teaser's: the other lines then have their own weights, and those inside the mark, but for the page's heading, an OUTSIDE-th.

Defined results: null or empty html gives empty text; a page cut off in a tag loses that tag, one cut off in a script what
follows; a quoted value ends at its quote only if white space, a slash or > follows, otherwise (a quote left open, or one inside a
bare value) the tag ends at its first >; repeated rows stay; an empty table gives an empty result; other columns are ignored; a very
long page is read whole, in one pass.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, parallel, slices

WINDOW, THRESHOLD = 3, 80
#: What a line in a marked main part weighs more, and by what a line outside the marked part is divided.
MARKED, OUTSIDE = -(-THRESHOLD // WINDOW), 4
#: How much more text the paragraphs outside a marked part must have for the mark to count for nothing, and the size of a paragraph.
TEASER, PARAGRAPH = 2, 40
#: Least share of a line's text in links that makes it a menu.
LINKS = 0.6
#: Elements whose text is never shown as text.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "textarea", "select", "math", "canvas", "audio", "video"}
#: Containers that are no article.
BESIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
#: Parts of class names and ids: those of no article, wherever they stand; those that also stand in names of an article's sections; those
#: of no article outside one; and those that only say what a part of the page is made of.
NAMES = re.compile(
    r"ad|ads|advert\w*|adsense|adbox|sponsor\w*|promo\w*|cookies?|cookie\w+|consent|gdpr|popup|modal|newsletter|subscribe\w*|subscription|signup|login|paywall|"
    r"nav\w*|menu\w*|breadcrumbs?|toolbar|sidebar\w*|aside|widgets?|share|sharing|comments?|commentlist|disqus|replies|footer|sitefooter|pagefooter|pagination|pager",
    re.I,
)
WEAK = re.compile(
    r"banner|notice\w*|notification|alert|overlay|side|widget\w+|related|recommend\w*|social|discussion|reply|respond|responses?|reviews|copyright|legal|disclaimer|tags|search\w*|form",
    re.I,
)
HEADERS = re.compile("header|masthead|topbar", re.I)
MADE_OF = re.compile(
    r"\d+|[a-z]|site|page|global|top|bottom|left|right|main|primary|secondary|article|post|posts|articles|stories|story|user|customer|reader|box|bar|list|links?|items?|wrap|wrapper|container|block|area|"
    r"section|region|panel|inner|outer|content|body|text|title|heading|buttons?|btn|icons?|media|feed|col|column|row|group|holder|slot|unit|zone|thread|count|policy|message|more|new|js|fixed|sticky",
    re.I,
)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|teaser|related)(?=$|[\s_-])", re.I)
MAIN = re.compile(r"^(?:main|content|primary)$|(?:^|[\s_-])(?:article-?(?:body|content|text)|post-?(?:body|content)|entry-?content|main-?content|story-?body)(?=$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:=\s*+\"[^\"]*+\"(?=[\s/>])|=\s*+'[^']*+'(?=[\s/>])|[^>=]++|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|(?<=[\s/\"']))(class|id|role|hidden|aria-hidden|itemprop)(?=[\s=/>]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


class _Lines:
    """Lines of a page with the state of the containers around them."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, bool, bool, bool]] = []  # text, length in links, beside, main, the page's heading
        self.parts: list[str] = []
        self.linked = 0
        self.open: list[tuple[str, bool, bool]] = []  # tag, beside, main

    def state(self) -> tuple[bool, bool]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (False, False)

    def add(self, text: str) -> None:
        if text:
            text = unescape(text)
            self.parts.append(text)
            if any(t == "a" for t, _, _ in self.open[-4:]):
                self.linked += len("".join(text.split()))

    def end(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.linked, *self.state(), bool(self.open) and self.open[-1][0] == "h1"))
        self.parts, self.linked = [], 0


def _named(value: str, names: re.Pattern, weak: re.Pattern | None = None) -> bool:
    """Whether a class or id has one of the names as a part, or a weak one beside parts that say nothing else (social-links, not social-history)."""
    for name in value.split():
        parts = [x for x in re.split("[_-]+", name) if x]
        if any(names.fullmatch(x) for x in parts):
            return True
        if weak and any(weak.fullmatch(x) for x in parts) and all(weak.fullmatch(x) or MADE_OF.fullmatch(x) or HEADERS.fullmatch(x) for x in parts):
            return True
    return False


def _beside(tag: str, attributes: str, in_main: bool, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no article, and whether it is the main part."""
    beside, main = tag in BESIDE or tag == "header" and not in_main, tag in ("article", "main")
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or (m[4] or "").strip("\"'")
            if name == "role":
                beside, main = beside or value.lower() in ROLES, main or value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                beside = True
            elif name == "itemprop":
                main = main or value == "articleBody"
            elif tag in ("article", "main"):
                beside = beside or bool(COMMENT.search(value)) or in_article and "review" in re.split(r"[\s_-]+", value.lower())
            elif tag not in ("html", "body", "h1"):
                named = bool(MAIN.search(value))
                main = main or named
                beside = beside or not named and (_named(value, NAMES, WEAK) or not in_main and _named(value, HEADERS))
    return beside, main and not beside


def lines(html: str) -> list[tuple[str, int, bool, bool, bool]]:
    """(text, characters in links, beside the article, in a marked main part, in the page's heading) of every line."""
    out, at, n = _Lines(), 0, len(html)
    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        out.add(html[at : m.start()])
        at = m.end()
        tag = (m[1] or "").lower()
        if not tag:
            continue
        closing = html[m.start() + 1] == "/"
        if tag in SILENT and not closing and not (m[2] or "").rstrip().endswith("/"):
            if tag in ("script", "style", "textarea", "title", "noscript", "iframe", "svg", "template"):
                stop = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else n
            continue
        if tag not in INLINE:
            out.end()
        if closing:
            for k in range(len(out.open) - 1, -1, -1):
                if out.open[k][0] == tag:
                    if tag in INLINE and any(t not in INLINE for t, _, _ in out.open[k:]):
                        break  # an inline tag does not end the blocks inside it
                    del out.open[k:]
                    break
        elif tag not in VOID:
            if tag == "p" and out.open and out.open[-1][0] == "p":
                out.open.pop()
            beside, main = out.state()
            b, a = _beside(tag, m[2] or "", main, main and any(t == "article" for t, _, _ in out.open))
            out.open.append((tag, beside or b, main or a))
    if at < n:
        rest = html[at:]
        cut = rest.rfind("<")
        out.add(rest if cut < 0 or not re.match(r"</?[a-zA-Z!]|</?\Z", rest[cut:]) else rest[:cut])
    out.end()
    return out.lines


def main_text(html: str) -> str:
    found = [x for x in lines(html) if not x[2]] if html else []
    inside, outside = 0, 0
    for text, linked, _, main, _ in found:
        size = len(text) - text.count(" ")
        inside += size if main else 0
        outside += size if not main and size >= PARAGRAPH and linked < LINKS * size else 0
    teaser, marked = outside > TEASER * inside, any(main for _, _, _, main, _ in found)
    weights, least = [], []  # what a line weighs, and what it must weigh to be kept
    for text, linked, _, main, heading in found:
        size = len(text) - text.count(" ")
        apart = marked and main == teaser and not (heading and teaser)  # outside the part that has the article
        weights.append(size + MARKED if main and not teaser else 0 if linked >= LINKS * size else size // OUTSIDE if apart else size)
        least.append(THRESHOLD if apart else 1)
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    if not sums or not max(sums):
        return ""
    dense = [i for i, total in enumerate(sums) if total >= min(THRESHOLD, max(sums))]
    return " ".join(found[i][0] for i in range(dense[0], min(dense[-1] + WINDOW, len(found))) if weights[i] >= least[i])


RESULT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text), n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = parallel(rows)

    def run(batches):
        for part, values in slices(batches, column="html"):
            out = [main_text(h) for h in values]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], RESULT.names)

    return map_arrow(rows, run, RESULT)
