"""HTML pages to text and to typed evidence (FN-25..27), as column expressions.

One regular expression cuts markup into tokens: comments, whole raw elements (script,
style), tags, character references and text. Text and evidence are read off the tokens.
An element ends at its first end tag; one that is never closed runs to the end of the page.
Only JSON-LD, whose nesting has no fixed depth, is walked in Python, and only on pages
that hold a job posting.
"""

from __future__ import annotations

import functools
import html.entities
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import LINE_END, blank, constant_map, first_seen, squeeze, strip, with_value

# Tags that start and end a line, elements whose content is never shown,
# and the names under which a page states its title and its site.
BLOCK_TAGS = (
    "address", "article", "blockquote", "br", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ol", "p",
    "section", "table", "tr", "ul",
)
HIDDEN_TAGS = ("script", "style", "noscript", "template", "svg")
TITLE_KEYS = ("og:title", "twitter:title", "title")
SITE_KEYS = ("og:site_name", "application-name", "site_name")

REST_OF_TAG = "(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
TAG = f"</?[A-Za-z]{REST_OF_TAG}"
COMMENT = "<!--.*?(?:-->|\\z)|<[!?][^>]*+>"
RAW_ELEMENT = f"<(?:script|style)\\b{REST_OF_TAG}.*?(?:</(?:script|style)\\s*+>|\\z)"
ATTRIBUTE = "([^\\s\"'<>/=]+)(?:\\s*+=\\s*+(\"[^\"]*+\"|'[^']*+'|[^\\s\"'>]*+))?"
LEADING_NAME = "^</?([A-Za-z][A-Za-z0-9-]*)"
DATA_SCRIPT = (
    "(?is)<script\\b(?=[^>]*\\btype\\s*=\\s*[\"']?\\s*application/ld\\+json\\b)"
    f"{REST_OF_TAG}(.*?)(?:</script\\s*+>|\\z)"
)


# ---------------------------------------------------------------- character references
@functools.cache
def _old_names() -> str:
    """Names that also count without their semicolon, longest first."""
    names = [name for name in html.entities.html5 if not name.endswith(";")]
    return "|".join(sorted(names, key=len, reverse=True))


@functools.cache
def _windows_controls() -> dict[str, str]:
    """Numbers of the C1 range stand for what Windows-1252 has in their place."""
    found = {}
    for code in range(0x80, 0xA0):
        char = bytes([code]).decode("cp1252", "ignore")
        if char:
            found[str(code)] = char
    return found


def _reference_pattern() -> str:
    return f"&(?:#[0-9]++;?|#[xX][0-9A-Fa-f]++;?|[A-Za-z][A-Za-z0-9]*+;|(?:{_old_names()}))"


def _numbered(reference: Column) -> Column:
    digits = F.regexp_extract(reference, "([0-9A-Fa-f]+);?$", 1)
    base = F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
    code = F.coalesce(base.try_cast("long"), F.lit(0x110000))
    known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code)), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(constant_map(_windows_controls()), code.cast("string")), char, F.lit("\ufffd"))


def _decoded(token: Column) -> Column:
    """The text of one token that is a character reference; others stay."""
    table = constant_map(html.entities.html5)
    name = F.substr(token, F.lit(2))
    stem = F.regexp_extract(name, f"^(?:{_old_names()})", 0)
    partly = F.concat(F.try_element_at(table, stem), F.substr(name, F.length(stem) + 1))
    named = F.coalesce(F.try_element_at(table, name), partly, token)
    return (
        F.when(~token.startswith("&") | (F.length(token) == 1), token)
        .when(token == "&amp;", "&")  # by far the most frequent one
        .when(token.startswith("&#"), _numbered(token))
        .otherwise(named)
    )


def unescape(c: Column) -> Column:
    """Character references of a text without tags; a text without `&` is not cut up."""
    pieces = F.regexp_extract_all(c, F.lit(f"{_reference_pattern()}|[^&]++|&"), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, _decoded), "")).otherwise(c)


# ---------------------------------------------------------------- FN-25
def tokens(markup: Column) -> Column:
    """array<string> that joins to the page again."""
    pattern = f"(?is){COMMENT}|{RAW_ELEMENT}|{TAG}|{_reference_pattern()}|[^<&]++|[<&]"
    return F.regexp_extract_all(blank(markup), F.lit(pattern), F.lit(0))


def _line_form(token: Column) -> Column:
    name = F.lower(F.regexp_extract(token, LEADING_NAME, 1))
    opens_item = (name == "li") & ~token.startswith("</")
    raw = F.regexp_replace(F.regexp_replace(token, f"(?is)^<{REST_OF_TAG}", ""), "(?i)</(?:script|style)\\s*>$", "")
    of_tag = (
        F.when(name.isin("script", "style"), raw)
        .when(opens_item, "\n- ").when(name.isin(*BLOCK_TAGS), "\n").otherwise("")
    )
    is_tag = token.startswith("<") & (F.length(token) > 1)
    return F.when(is_tag, of_tag).otherwise(_decoded(token))


def html_to_text(markup: Column | str) -> Column:
    """FN-25: block tags end lines, list items get a dash, blank runs shrink to one. NULL: empty."""
    markup = F.col(markup) if isinstance(markup, str) else markup
    flat = F.array_join(F.transform(tokens(markup), _line_form), "")
    flat = F.translate(flat, "\u00a0\t", "  ")
    lines = F.transform(F.split(flat, LINE_END), lambda x: strip(F.regexp_replace(x, " +", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


# ---------------------------------------------------------------- FN-26
def shown_markup(markup: Column) -> Column:
    """The page without comments and without elements that are never shown."""
    hidden = f"<({'|'.join(HIDDEN_TAGS)})\\b{REST_OF_TAG}.*?(?:</\\1\\s*+>|\\z)"
    return F.regexp_replace(blank(markup), f"(?is){COMMENT}|{hidden}", " ")


def inner_text(fragment: Column) -> Column:
    """Text of a piece of shown markup: tags part words, white space is one space."""
    return squeeze(unescape(F.regexp_replace(fragment, f"(?s){TAG}", " ")))


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's first attribute of that name, decoded; empty when absent."""
    inside = F.regexp_replace(F.regexp_replace(tag, "^<[A-Za-z0-9]+", ""), "/?>$", "")
    names = F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(2))
    value = F.get(values, F.array_position(names, name).cast("int") - 1)
    return unescape(F.coalesce(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit("")))


def elements(markup: Column, name: str) -> Column:
    """array<struct<tag, inner>>: every element of a name, up to its first end tag."""
    pattern = f"(?is)(<{name}\\b{REST_OF_TAG})(.*?)</{name}\\s*+>"
    tags, inner = (F.regexp_extract_all(markup, F.lit(pattern), F.lit(group)) for group in (1, 2))
    return F.arrays_zip(tags.alias("tag"), inner.alias("inner"))


def _meta_contents(markup: Column, keys: tuple[str, ...]) -> Column:
    tags = F.regexp_extract_all(markup, F.lit(f"(?is)<meta\\b{REST_OF_TAG}"), F.lit(0))

    def read(tag: Column) -> Column:
        named = [F.nullif(attribute(tag, a), F.lit("")) for a in ("property", "name", "itemprop")]
        return F.struct(
            F.lower(F.trim(F.coalesce(*named, F.lit("")))).alias("key"), squeeze(attribute(tag, "content")).alias("content")
        )

    wanted = F.filter(F.transform(tags, read), lambda m: m["key"].isin(*keys) & (m["content"] != ""))
    return with_value(F.transform(wanted, lambda m: m["content"]), lambda found: first_seen(found))


def _button_texts(markup: Column) -> Column:
    pattern = f"(?is)<button\\b{REST_OF_TAG}.*?</button\\s*+>|<input\\b{REST_OF_TAG}"
    found = F.regexp_extract_all(markup, F.lit(pattern), F.lit(0))

    def read(piece: Column) -> Column:
        pressed = F.lower(attribute(piece, "type")).isin("button", "submit")
        return F.when(~piece.rlike("(?i)^<input"), inner_text(piece)).when(pressed, squeeze(attribute(piece, "value")))

    return with_value(F.filter(F.transform(found, read), lambda x: x != ""), lambda found: first_seen(found))


POSTINGS = T.ArrayType(
    T.StructType(
        [
            T.StructField("title", T.StringType()), T.StructField("company", T.StringType()),
            T.StructField("valid_through", T.StringType()), T.StructField("direct_apply", T.BooleanType()),
            T.StructField("url", T.StringType()),
        ]
    )
)


def postings_in(scripts) -> list[dict]:
    """FN-27: fields of every object typed JobPosting in a page's JSON-LD, outer before inner.

    Titles and descriptions are texts and are not searched; a script that is no JSON counts as absent.
    """

    def plain(value):
        return " ".join(str(value).split()) if isinstance(value, (str, int, float)) and value else ""

    waiting = []
    for script in reversed(scripts):
        try:
            waiting.append(json.loads(script))
        except ValueError:
            pass
    found = []
    while waiting:
        node = waiting.pop()
        if isinstance(node, list):
            waiting += reversed(node)
        if not isinstance(node, dict):
            continue
        waiting += reversed([child for key, child in node.items() if key not in ("title", "description")])
        kinds = node.get("@type")
        if "jobposting" in [str(kind).lower() for kind in (kinds if isinstance(kinds, list) else [kinds])]:
            employer = node.get("hiringOrganization")
            found.append(
                {
                    "title": plain(node.get("title")),
                    "company": plain(employer.get("name") if isinstance(employer, dict) else employer),
                    "valid_through": plain(node.get("validThrough")),
                    "direct_apply": node.get("directApply") is True,
                    "url": plain(node.get("url")),
                }
            )
    return found


@F.pandas_udf(POSTINGS)
def _postings(scripts: pd.Series) -> pd.Series:
    return scripts.map(lambda found: [] if found is None else postings_in(found))


def parse_page(markup: Column | str, content_type: Column | str) -> Column:
    """FN-26: one struct of page evidence; plain text has visible text only, NULL counts as empty."""
    markup, content_type = (F.col(c) if isinstance(c, str) else c for c in (markup, content_type))
    is_text = content_type.eqNullSafe("text/plain")
    page = F.when(is_text, "").otherwise(blank(markup))
    scripts = F.regexp_extract_all(page, F.lit(DATA_SCRIPT), F.lit(1))
    postings = _postings(F.when(page.rlike("(?i)jobposting"), scripts))

    def read(parts: Column) -> Column:
        shown = parts["shown"]
        titles = F.transform(elements(shown, "title"), lambda x: inner_text(x["inner"]))
        links = F.transform(
            elements(shown, "a"),
            lambda x: F.struct(inner_text(x["inner"]).alias("text"), F.trim(attribute(x["tag"], "href")).alias("href")),
        )
        return F.struct(
            squeeze(F.array_join(titles, " ")).alias("document_title"),
            F.when(is_text, squeeze(markup)).otherwise(inner_text(shown)).alias("visible_text"),
            _meta_contents(shown, TITLE_KEYS).alias("meta_titles"),
            _meta_contents(shown, SITE_KEYS).alias("site_names"),
            links.alias("links"),
            _button_texts(shown).alias("buttons"),
            F.coalesce(parts["postings"], F.array().cast(POSTINGS)).alias("postings"),
        )

    return with_value(F.struct(shown_markup(page).alias("shown"), postings.alias("postings")), read)
