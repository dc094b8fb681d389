"""Main text of web pages by line-block distribution (operator 5).

Markup is stripped to one line per block of text. Lines of page furniture (by element or by the words of class, id and
role), lines of mostly links unless within a marked article and, where the page marks its article, lines outside it have
length zero. Lengths are
summed over sliding windows of lines; the text starts where the sums surge and ends where they dive to nothing.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import whole

# Names of HTML elements, and words that name page furniture in class, id or role.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "math", "canvas", "title")
FURNITURE = ("nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "header")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav",
    "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
MARKS = (
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "pagination", "popup", "promo", "recommended", "related", "replies", "search", "share", "sharing", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "widget", "complementary", "header", "masthead",
)

#: Class words that say what an element stands beside, not what it is.
BESIDE = frozenset(("with", "has", "no", "without"))
#: An element without an end tag ends where one of these begins, or where what holds it ends.
ENDED_BY = {"p": frozenset(BLOCKS), "li": frozenset(("li",)), "dd": frozenset(("dd", "dt")), "dt": frozenset(("dd", "dt")), "tr": frozenset(("tr",)),
            "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr"))}
HOLDERS = frozenset(("ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot"))

# Possessive throughout: no character is read by two alternatives, so that a cut or broken tag costs no second try.
ATTRIBUTES = r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
#: Comments and elements whose text is never shown, whichever begins first.
UNSHOWN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^<>]*+>|<({'|'.join(RAW)})\b{ATTRIBUTES}>.*?(?:</\1\s*+>|(?=<body\b)|\Z)", re.S | re.I)
#: A tag that the page's end has cut off.
CUT = re.compile(r"<[/a-zA-Z][^<>]*+\Z")
TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({ATTRIBUTES})>")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WINDOW, LEAST_UNMARKED = 3, 80


def lines_of(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """((text, length that counts, inside the marked article) of each block, whether the page marks an article)."""
    page = CUT.sub("", UNSHOWN.sub(lambda m: " " if m[1] else "", page))
    lines, parts, links = [], [], 0
    hidden, hidden_depth, held, article, link, marked = None, 0, 0, 0, 0, False

    def close():
        nonlocal parts, links
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, 0 if hidden or links * 2 > len(text) and not article else len(text), article > 0))
        parts, links = [], 0

    at = 0
    for m in [*TAG.finditer(page), None]:
        chunk = page[at : m.start() if m else len(page)]
        if chunk and not hidden:
            chunk = html.unescape(chunk)
            parts.append(chunk)
            links += len(chunk.strip()) if link else 0
        if not m:
            break
        at = m.end()
        closing, name = m[1], m[2].lower()
        if name == "a" and not hidden:
            link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        if name in BLOCKS:
            close()
        if hidden in ENDED_BY:
            if name in HOLDERS:
                held += -1 if closing else 1
            if held <= 0 and (name in ENDED_BY[hidden] and not closing or held < 0 or hidden == "p" and name in BLOCKS and name != "p"):
                hidden, link = None, 0  # its end tag was left out
        if name in ("article", "main"):
            hidden = None  # an article starts and ends in plain sight, whatever was left open before
            article, marked = max(0, article + (-1 if closing else 1)), True
        elif hidden:
            if name == hidden:
                hidden_depth += -1 if closing else 1
                if hidden_depth == 0:
                    close()
                    hidden = None
                    link = 0
        elif not closing and name not in VOID and _is_furniture(name, m[3], article > 0):
            hidden, hidden_depth, held = name, 1, 0
            lines.append(("", 0, article > 0))
    close()
    return lines, marked


def _is_furniture(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is page furniture by its name or class; inside the article a header or an id is not."""
    if name in FURNITURE:
        return name != "header" or not inside
    if name in ("body", "html") or not attributes:
        return False
    marks = MARK_SET - {"header"} if inside else MARK_SET
    for which, *value in NAMED.findall(attributes):
        if inside and which.lower() == "id":
            continue  # the name of a part of the article, for links to it
        for token in "".join(value).lower().split():
            words = set(re.split(r"[^a-z0-9]+", token))
            if words & marks and not words & BESIDE:
                return True
    return False


MARK_SET = frozenset(MARKS)


def main_text(page: str) -> str:
    """Blocks between surge and dive, in page order, joined by two line ends."""
    lines, marked = lines_of(page)
    if not lines:
        return ""
    sizes = [n if inside or not marked else 0 for _, n, inside in lines]
    if marked and not any(sizes):  # lines of links only, within the article
        sizes = [len(t) if inside else 0 for t, _, inside in lines]
    least = 1 if marked else LEAST_UNMARKED
    sums = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    kept, running = [], False
    for (text, _, _), size, ahead in zip(lines, sizes, sums, strict=True):
        if not running and size and ahead >= least:
            running = True  # surge
        elif running and not ahead:
            running = False  # dive
        if running and size:
            kept.append(text)
    if not kept and not marked:  # a page of short lines has no surge: its longest stretch is what there is
        kept = [t for (t, _, _), size in zip(lines, sizes, strict=True) if size]
    return "\n\n".join(kept)


RESULT = pa.struct([("text", pa.string()), ("n_chars", pa.int64())])


def extract(rows: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). Null and empty pages give the empty text.

    Whole pages are read, however long; repeated rows repeat; other columns are not read; nothing is shuffled.
    """

    @F.arrow_udf("text string, n_chars long")
    def texts(pages: pa.Array) -> pa.Array:
        found = [main_text(p) for p in pages.to_pylist()]
        return pa.array([{"text": t, "n_chars": len(t)} for t in found], RESULT)

    return rows.select(F.col(key).alias("page_id"), F.col(url).alias("url"), texts(whole(page)).alias("t")).select(
        "page_id", "url", "t.*"
    )
