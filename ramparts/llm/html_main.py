"""Main text of a page by line-block distribution.

Markup is stripped into lines, one per block element; boundaries of containers leave ``WINDOW`` empty lines.
Parts that are never the article (menus, forms, scripts, adverts, comments and the like, by element or by class
and id words) go with their markup. Over the rest, the block value of a line is the length of text outside
links in the ``WINDOW`` lines from it. Values rise at a surge point, where a run of lines of value begins that
reaches ``SURGE``, and fall to nothing at its dive point. The text from the first surge to the last dive is kept;
if no run reaches ``SURGE``, the run with the highest value is. Lines inside an article or main element, where
one has text, are the only ones that count; they form one run, links included. So do those of articles inside a
part left out, if no other has text and theirs is longer than all text outside: the class of a wrapper says little.

Elements end as in HTML: with their end tag, with the start of what cannot stand in them (an omitted ``</p>`` or
``</li>``), or with the element around them.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts.llm.common import bounded_batches

WINDOW = 3
SURGE = 80

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[A-Za-z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "object", "select", "button", "math", "canvas"}
_NOISE = {"nav", "aside", "form", "menu", "dialog"}
_EDGE = {"header", "footer"}
_CONTAINERS = {"html", "head", "body", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "table", "ul", "ol", "dl", "menu", "dialog"}
_BLOCKS = _CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "caption", "thead", "tbody", "tfoot", "blockquote", "pre", "figure",
                         "figcaption", "address", "hr", "fieldset", "details", "summary", "legend", "center", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_NOISE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "menu", "menus", "nav", "navbar",
                "navigation", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "aside", "widget", "widgets", "related", "recommended", "share", "sharing", "social", "cookie",
                "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "form",
                "comment", "comments", "respond", "reply", "replies", "discussion", "disqus", "pagination", "pager", "toolbar", "masthead", "topbar", "copyright", "disclaimer", "skip"}
_EDGE_WORDS = {"header", "footer"}
# parts whose articles are never the page's
_REMARKS = re.compile(r"(?<![a-z])(?:related|recommended|comments?|respond|reply|replies|discussion|disqus)(?![a-z])")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CELLS, _TABLE = {"td", "th"}, {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
_ITEM_EDGE = _BLOCKS - {"address", "div", "p"}
# what an opened element ends: (elements that end, elements that this does not reach beyond)
_ENDS = ({n: [({"p"}, _BLOCKS)] for n in _BLOCKS} | {n: [({"p"}, _BLOCKS), (_HEADINGS, _BLOCKS)] for n in _HEADINGS}
         | {"li": [({"li"}, _ITEM_EDGE), ({"p"}, _BLOCKS)]} | {n: [({"dt", "dd"}, _ITEM_EDGE), ({"p"}, _BLOCKS)] for n in ("dt", "dd")}
         | {n: [(_CELLS, {"table", "tr"})] for n in _CELLS} | {"tr": [(_CELLS, {"table", "tr"}), ({"tr"}, {"table"})]}
         | {n: [({"thead", "tbody", "tfoot"}, {"table"})] for n in ("thead", "tbody", "tfoot")})
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_STATES = {"has", "with", "no", "without", "js", "is"}
_WORDS = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _noise(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element cannot be part of the article."""
    if name in _NOISE or name in _EDGE and not inside:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            for one in value.split():
                words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", one))
                if words and words[0] not in _STATES and any(w in _NOISE_WORDS or w in _EDGE_WORDS and not inside for w in words):
                    return True
        elif key == "role" and value in _ROLES or key == "style" and "display:none" in value.replace(" ", "") or key == "aria-hidden" and value == "true" and name != "i":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|$|=)", re.sub(r"""=\s*(?:"[^"]*"|'[^']*')""", "=", attributes)))


def _edge(name: str) -> set[str]:
    """Elements that an end tag does not reach beyond."""
    if name in ("article", "main", "section", "body", "html", "table"):
        return set()
    if name in _TABLE:
        return {"table"}
    if name not in _BLOCKS:
        return _BLOCKS
    return {"table", "td", "th", "caption"} | ({"ul", "ol", "menu"} if name == "li" else set())


def lines_of(page: str | None) -> list[tuple[str, int, int]]:
    """Lines (text, length outside links, place); an empty text stands for a container's boundary.

    Places are 0 outside articles, 1 inside one, 2 inside one of a part that is left out.
    """
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    plain: list[str] = []
    # open elements; parts left out and articles in them, each as (number of elements around it, whether left out)
    stack: list[str] = []
    opened: Counter[str] = Counter()
    parts_out: list[tuple[int, bool]] = []
    remarks = False
    at, links = 0, 0
    page = page or ""

    def skipped():
        return bool(parts_out) and parts_out[-1][1]

    def place():
        return 2 if len(parts_out) > 1 else int(opened["article"] + opened["main"] > 0)

    def cut(size):
        for n in stack[size:]:
            opened[n] -= 1
        del stack[size:]
        while parts_out and parts_out[-1][0] >= size:
            parts_out.pop()

    def close(names, edge):
        if any(opened[n] > 0 for n in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in names:
                    return cut(k)
                if stack[k] in edge:
                    return None

    def flush():
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                lines.append((text, len(_SPACE.sub(" ", html.unescape("".join(plain))).strip()), place()))
            parts.clear()
            plain.clear()

    def add(text):
        if text and not skipped():
            parts.append(text)
            if not links:
                plain.append(text)

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        add(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing, void = bool(m[1]), name in _VOID or m[3].endswith("/")
        if name in _RAW and not closing and not void:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if name in _BLOCKS:
                flush()
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            add(" ")
        boundary = name in _CONTAINERS and (name not in ("ul", "ol", "dl", "table") or not place())
        if name in _BLOCKS:
            flush()
            links = 0
        if boundary and closing and not skipped():
            lines.append(("", 0, place()))
        if closing:
            close({name}, _edge(name))
            continue
        for names, edge in _ENDS.get(name, ()):
            close(names, edge)
        if boundary and not skipped():
            lines.append(("", 0, place()))
        if void:
            continue
        noise = False
        if not skipped():
            noise = _noise(name, m[3], place() > 0)
            if noise:
                if not parts_out:
                    remarks = bool(_REMARKS.search(m[3].lower()))
                parts_out.append((len(stack), True))
        elif name in ("article", "main") and len(parts_out) == 1 and not opened["article"] + opened["main"]:
            if stack[parts_out[0][0]] not in ("div", "section") or name == "main" and not remarks:
                parts_out.clear()
            elif not remarks:
                parts_out.append((len(stack), False))
        if name in _BLOCKS or noise or parts_out and stack[parts_out[-1][0]:parts_out[-1][0] + 1] == [name]:
            stack.append(name)
            opened[name] += 1
    add(page[at:])
    flush()
    return lines


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The kept lines of one page, joined by line ends."""
    lines = lines_of(page)
    wanted = 1 if any(place == 1 and text for text, _, place in lines) else 0
    if not wanted and sum(len(text) for text, _, place in lines if place == 2) > sum(size for _, size, place in lines if not place):
        wanted = 2
    if wanted:
        # an article has no boundaries inside, and its links are part of it
        kept = [(text, len(text)) for text, _, place in lines if place == wanted and text]
    else:
        kept = [(text, size) for text, size, place in lines if not place]
    spread: list[tuple[str, int]] = []
    for text, size in kept:
        spread += [(text, size)] if text else [("", 0)] * window
    value, total = [0] * len(spread), 0
    for i in range(len(spread) - 1, -1, -1):
        total += spread[i][1] - (spread[i + window][1] if i + window < len(spread) else 0)
        value[i] = total
    runs, i = [], 0
    while i < len(spread):
        if not value[i]:
            i += 1
            continue
        j = i
        while j < len(spread) and value[j]:
            j += 1
        runs.append((max(value[i:j]), i, j))
        i = j
    if not runs:
        return ""
    high = [r for r in runs if r[0] >= surge] or [max(runs, key=lambda r: r[0])]
    inside = [r for r in runs if high[0][1] <= r[1] <= high[-1][1]]
    return "\n".join(spread[k][0] for _, a, b in inside for k in range(a, b) if spread[k][0])


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in ``out`` (a column of that name is replaced).

    A null or empty page, or one without text outside links and markup, gives an empty text. Cut-off pages are read
    to their end. Repeated rows give equal texts; an empty table gives no rows. Nothing depends on other columns.
    """
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in column], dtype="object")
    return pages.withColumn(out, text_of(F.col(html_col)))
