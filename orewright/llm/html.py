"""Main text of web pages: the best contiguous region of words and tags.

A page becomes a sequence of words and tags. Words score positive or negative and tags negative, by where they stand
(inside a link, a heading, a list, an article or main element, or outside of these on a page that has them); the weights
are log-odds counted over labelled pages. One linear scan finds the contiguous region with the greatest sum, and its
blocks are the text.

Some elements are never content, whatever their size and wherever they stand: by their role (menus, forms, scripts, asides,
footers, headers outside of an article or main element), by a class or id that as a whole names nothing but such a part ("ad",
"cookie-notice", but not "notice-board"), and reader comments: what is named so as a whole, and blocks that repeat side by
side, each with an author and a date but no heading. A name is no such sign on an element that holds the page's article, main
or first heading. Inside an article these elements cost a region nothing, so text on both sides of them stays together.

The labelled pages are the table's own pages that mark their content with an `article` or `main` element (at most
`SAMPLE` of them, chosen by a hash of page_id), together with the built-in ones of `LAYOUTS`, which cover pages without
such elements and text outside of them. A page marks its content if its first h1 stands in such an element; without any h1, if it
has a main element or only one article.

Results for odd input: null and empty html give the empty text; broken markup (tags left open, stray ends, a missing
end of the page) is read as far as it goes; very long pages are read whole; rows that repeat a page_id get a row each;
an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 500

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)

_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
#: An element of the first kind ends where one of the second begins, up to the nearest element of the third.
_ENDED_BY = {
    "p": (_BLOCK - {"body", "html", "head", "li", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend", "summary", "figcaption", "dd", "dt"} | {"li", "dd", "dt", "td", "th", "tr"}, {"button", "td", "th", "caption", "object"}),
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "th": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "tr": ({"tr", "tbody", "tfoot"}, {"table"}),
    "option": ({"option", "optgroup"}, {"select", "datalist"}),
}
_NEVER = {
    "nav", "footer", "aside", "form", "button", "select", "option", "input", "menu", "dialog", "script", "style", "head", "title",
    "noscript", "template", "iframe", "textarea", "svg", "canvas", "audio", "video", "object", "embed", "map", "datalist", "fieldset",
    "xmp", "noembed", "noframes",
}
_NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert", "toolbar", "button", "tablist"}
# Words that name a part of a page that is not its article, words that only say which or what kind of box, and
# whole names of reader comments. A name counts if all its words are of the first two kinds and one is of the first.
_PART_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promoted", "promotion", "banner", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "sidenav", "footer", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent",
    "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social",
    "related", "recommended", "recommendations", "pagination", "pager", "searchbox", "paywall", "outbrain", "taboola", "copyright",
}
_BOX_WORDS = {
    "box", "block", "container", "wrapper", "wrap", "inner", "outer", "area", "section", "left", "right", "top", "bottom", "bar", "row", "column", "col", "list",
    "links", "link", "buttons", "button", "icons", "slot", "unit", "widget", "site", "page", "global", "primary", "secondary", "main", "posts", "articles", "stories",
    "items", "item", "form", "panel", "module", "region", "header", "text", "content", "body", "this", "media",
}
_COMMENT_NAMES = {
    "comment", "comments", "comment list", "commentlist", "comment section", "comments section", "comments area", "comment area", "comments list", "comment thread",
    "comments thread", "comment body", "comment wrapper", "comments wrapper", "comments container", "comment item", "reader comments", "user comments", "disqus",
    "disqus thread", "respond", "replies", "reply list", "responses",
}
_CONTENT_NAMES = {"article", "content", "main", "post", "entry", "story", "body", "text"}
_AUTHOR_NAMES = {"author", "username", "user name", "user", "commenter", "poster", "comment author", "fn", "by"}
_DATE_NAMES = {"date", "time", "timestamp", "posted", "ago", "comment date", "comment meta", "datetime"}
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Element:
    tag: str
    never: bool = False
    named: tuple = ()  # numbers of the elements around whose names say that they are no content
    around: tuple = ()  # numbers of the blocks around
    number: int = 0
    landmark: str = ""
    link: bool = False
    heading: bool = False
    list: bool = False
    # What stands in it so far, and its blocks that have an author and a date but no heading, by tag.
    author: bool = False
    date: bool = False
    headed: bool = False
    posts: dict = field(default_factory=dict)


@dataclass
class Run:
    """A stretch of text with what surrounds it; `words` of it count in the score."""

    text: str
    words: int
    where: tuple
    never: bool
    named: tuple
    around: tuple

    @property
    def content(self) -> bool:
        return self.where[0] in ("article", "main")


@dataclass
class Page:
    items: list = field(default_factory=list)  # Run, or ("tag", name, starts a block)
    labelled: bool = False
    released: set = field(default_factory=set)  # elements that hold the article, whatever their names
    posts: set = field(default_factory=set)  # blocks that repeat with author and date
    first_h1: str | None = None  # the landmark around it
    marks: list = field(default_factory=list)  # outermost article and main elements


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), references.unescape(a or b or c))
    return out


def _names(found: dict[str, str]) -> set[str]:
    """An element's classes and id, each as its words in lower case."""
    whole = [*found.get("class", "").split(), found.get("id", "")]
    return {" ".join(x.lower() for x in _NAME_PART.findall(name)) for name in whole} - {""}


def _is_part(name: str) -> bool:
    words = set(name.split())
    return bool(words & _PART_NAMES) and words <= _PART_NAMES | _BOX_WORDS


def _element(tag: str, attributes: str, inside: Element, number: int) -> Element:
    e = Element(tag, inside.never, inside.named, inside.around, number, inside.landmark, inside.link or tag == "a", inside.heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6"), inside.list or tag in ("ul", "ol", "menu"))
    found = _attributes(attributes) if attributes.strip() else {}
    role = found.get("role", "").lower()
    names = _names(found)
    e.author = bool(names & _AUTHOR_NAMES) or tag == "cite" or found.get("rel", "").lower() == "author" or found.get("itemprop", "").lower() == "author"
    e.date = bool(names & _DATE_NAMES) or tag == "time"
    e.headed = e.heading and not inside.heading
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
    comments = tag not in ("html", "body", "main") and (names & _COMMENT_NAMES or found.get("itemprop", "").lower() == "comment" or found.get("itemtype", "").lower().endswith("schema.org/comment"))
    if tag in _NEVER or role in _NEVER_ROLES or hidden or comments or (tag == "header" and not inside.landmark):
        e.never = True
    elif tag not in ("html", "body", "main") and any(map(_is_part, names)):
        e.named = (*e.named, number)
    if tag in ("li", "div", "article", "section", "dd", "tr"):
        e.around = (*e.around, number)
    if not e.never:
        if tag == "article" or tag == "main" or role in ("article", "main"):
            e.landmark = "article" if tag == "article" or role == "article" else inside.landmark or "main"
        elif not e.landmark and names & _CONTENT_NAMES | {w for n in names for w in n.split()} & _CONTENT_NAMES and tag in ("div", "section", "td"):
            e.landmark = "named"
    return e


def read(page: str | None) -> Page:
    """The page's words and tags in order. Elements left open end where their surroundings do."""
    out, stack, at, raw = Page(), [Element("")], 0, page or ""

    def text(a: int, b: int) -> None:
        if a < b:
            top = stack[-1]
            plain = references.unescape(raw[a:b])
            where = (top.landmark, top.link, top.heading, top.list)
            out.items.append(Run(plain, 0 if top.tag in _RAW else len(plain.split()), where, top.never, top.named, top.around))

    def end_from(k: int) -> None:
        """Ends the elements of the stack from the k-th on, telling each one's surroundings what it held."""
        while len(stack) > k:
            e, above = stack.pop(), stack[-1]
            if e.author and e.date and not e.headed and e.around != above.around:
                own = above.posts.setdefault(e.tag, [])
                own.append(e.number)
                if len(own) > 1:
                    out.posts.update(own)
            above.author, above.date, above.headed = above.author or e.author, above.date or e.date, above.headed or e.headed

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                end_from(k)
                return
            if stack[k].tag in ("td", "th", "table", "article", "main", "nav", "aside", "footer", "section") and tag not in _BLOCK:
                return

    for m in iter(lambda: _TOKEN.search(raw, at), None):
        text(at, m.start())
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            if m.group().startswith("<![CDATA["):
                text(m.start() + 9, m.end() - 3)
            continue
        end, tag, attributes = m.group(1) or m.group(4), name.lower(), (m.group(3) or m.group(6) or "")
        out.items.append(("tag", tag, tag in _BLOCK))
        if end:
            close(tag)
            continue
        for k in range(len(stack) - 1, 0, -1):
            open_tag = stack[k].tag
            by, fence = _ENDED_BY.get(open_tag, ((), ()))
            if tag in by:
                end_from(k)
            elif open_tag in ("td", "th", "table", "ul", "ol", "dl", "button", "article", "section", "div", "nav", "aside", "footer", "main", "select", "body"):
                break
        element = _element(tag, attributes, stack[-1], len(out.items))
        if not element.never:
            if tag == "h1" and out.first_h1 is None:
                out.first_h1 = element.landmark
                out.released.update(element.named)
            if element.landmark in ("article", "main") and stack[-1].landmark not in ("article", "main"):
                out.marks.append(element.landmark)
                out.released.update(element.named)
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b", re.I).search(raw, at)
            at = stop.start() if stop else len(raw)
        if tag not in _VOID and not (attributes.rstrip().endswith("/") and tag not in _BLOCK and tag not in _RAW):
            stack.append(element)
    text(at, len(raw))
    end_from(1)
    settle(out)
    return out


def settle(page: Page) -> None:
    """Judge by the whole page: names on what holds the article deny nothing, repeated posts are comments unless there is nothing
    else, and where the page marks its content, other places are outside of it."""
    left = []
    for x in page.items:
        if isinstance(x, Run) and not x.never:
            x.never = not page.released.issuperset(x.named)
            left += [] if x.never else [x]
    if any(x.words and page.posts.isdisjoint(x.around) for x in left):
        for x in left:
            x.never = not page.posts.isdisjoint(x.around)
        left = [x for x in left if not x.never]
    page.labelled = page.first_h1 in ("article", "main") if page.first_h1 is not None else "main" in page.marks or len(page.marks) == 1
    page.labelled = page.labelled and any(x.words and x.content for x in left)
    if page.labelled:
        for x in left:
            if not x.content:
                x.where = ("outside", *x.where[1:])


#: Labelled layouts, most without article elements: html; each word that starts with "c" is content.
LAYOUTS = (
    "<body><div><a>n</a> <a>n</a> <a>n</a></div><h1>c c c</h1><p>c c c c c c c c c c c c c c c c c c c c</p><p>c c c c c c c c c c c c <a>c c</a> c c c c c c</p><div><a>n</a> <a>n</a></div><div>n n n n</div></body>",
    "<body><table><tr><td><ul><li><a>n n</a><li><a>n</a></ul></td><td><h2>c c</h2>c c c c c c c c c c c c c c c<p>c c c c c c c c c c c c c c c c c<ul><li>c c c c c</li><li>c c c c c c</li></ul></td></tr></table><p><a>n n n</a></p></body>",
    "<body><div><ul><li><a>n</a></li><li><a>n</a></li></ul></div><div class='post-content'><h1>c c c c</h1><p>c c c c c c c c c c c c c c c</p><blockquote>c c c c c c c c</blockquote><p>c c c c c c c c c c c c c c c c c</p></div><ul><li><a>n n</a></li><li><a>n n n</a></li></ul></body>",
    "<body><p>n n n n <a>n n</a></p><ul><li>n n</li><li><a>n n n</a></li></ul><h3>n n</h3><article><h1>c c c</h1><p>c c c c c c c c c c c c c c c c c <a>c c c</a></p><ul><li>c c c c</li><li><a>c c</a></li></ul></article><p>n n n n n n <a>n n</a></p><h2>n n n</h2><p>n n n n n n n n n n n n</p></body>",
    "<body><p>n n n <a>n n</a></p><main><h1>c c c</h1><p>c c c c c c c c c c c c c c c c c <a>c c c</a></p><ul><li>c c c c</li><li><a>c c</a></li></ul></main><p>n n n n <a>n</a></p></body>",
)


def tally(pages: list[Page], own: bool) -> tuple[Counter, Counter]:
    """Words inside and outside the content by where they stand. own: pages that name their content themselves."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for item in page.items:
            if isinstance(item, Run) and item.words and not item.never:
                if own:
                    (inside if item.content else outside)[item.where] += item.words
                else:
                    good = sum(w.startswith("c") for w in item.text.split())
                    inside[item.where] += good
                    outside[item.where] += item.words - good
    return inside, outside


#: A word that is never content (outside of an article; inside one it costs nothing), and a tag: small, so that a region can
#: pass over a figure's markup or an inner advert.
NEVER_WEIGHT, BLOCK_WEIGHT, INLINE_WEIGHT = -0.6, -0.3, -0.1


def learn(inside: Counter, outside: Counter) -> dict:
    """The weight of a word by where it stands: log-odds of content, kept within two."""
    return {w: max(-2.0, min(2.0, math.log((inside[w] + 0.5) / (outside[w] + 0.5)))) for w in inside.keys() | outside.keys()}


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous part with the greatest sum (half open; empty if no sum is positive); at ties the first, then longest."""
    best, at, begin, total = 0.0, (0, 0), 0, 0.0
    for i, s in enumerate(scores):
        if total <= 0 and s > 0:
            begin, total = i, 0.0
        total += s
        if total > best or (total == best and best > 0 and at[0] == begin):
            best, at = total, (begin, i + 1)
    return at


def scores_of(items: list, weights: dict) -> list[float]:
    """What each word run and tag adds to a region. A place that no labelled page has counts by its landmark and link alone."""
    out = []
    for item in items:
        if isinstance(item, Run):
            w = weights.get(item.where)
            if w is None:
                w = weights.get((item.where[0], item.where[1], False, False), -0.5 if item.where[1] else 0.5)
            out.append(item.words * (w if not item.never else 0.0 if item.where[0] in ("article", "main", "named") else NEVER_WEIGHT))
        else:
            out.append(BLOCK_WEIGHT if item[2] else INLINE_WEIGHT)
    return out


def main_text(page: str | None, weights: dict) -> str:
    """The blocks of the best region, one line each, without the elements that are never content."""
    parsed = read(page)
    begin, end = region(scores_of(parsed.items, weights))
    blocks, parts = [], []
    for item in parsed.items[begin:end]:
        if isinstance(item, Run):
            if not item.never:
                parts.append(item.text)
        elif item[2]:
            blocks.append("".join(parts))
            parts = []
        elif item[1] == "br":
            parts.append(" ")
    blocks.append("".join(parts))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict:
    """Weights counted over labelled pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            parsed = [p for p in (read(x.as_py()) for x in batch["html"]) if p.labelled]
            for total, part in zip((inside, outside), tally(parsed, own=True)):
                total.update(part)
        keys = sorted(inside.keys() | outside.keys())
        yield pa.record_batch(
            {
                "landmark": pa.array([k[0] for k in keys], pa.string()),
                "link": pa.array([k[1] for k in keys], pa.bool_()),
                "heading": pa.array([k[2] for k in keys], pa.bool_()),
                "list": pa.array([k[3] for k in keys], pa.bool_()),
                "inside": pa.array([inside[k] for k in keys], pa.int64()),
                "outside": pa.array([outside[k] for k in keys], pa.int64()),
            }
        )

    some = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    chosen = pages.select("page_id", "html").join(F.broadcast(some), "page_id").select("html")  # at most `sample` ids
    schema = "landmark string, link boolean, heading boolean, list boolean, inside long, outside long"
    totals = chosen.mapInArrow(count, schema).groupBy("landmark", "link", "heading", "list").sum("inside", "outside").collect()
    inside, outside = tally([read(x) for x in LAYOUTS], own=False)
    for r in totals:
        inside[tuple(r[:4])] += r[4]
        outside[tuple(r[:4])] += r[5]
    return learn(inside, outside)


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    weights = fit(pages, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch["html"]]
            n = pa.array(map(len, texts), pa.int64())
            yield pa.record_batch({"page_id": batch["page_id"].cast(pa.int64()), "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": n})

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
