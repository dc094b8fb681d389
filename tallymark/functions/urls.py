"""URL keys and crawl gates (FN-15, FN-16, FLT-12, FLT-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, strip, with_value

# Query keys that only track the click (besides every utm_* key).
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "msclkid")

SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
AUTHORITY = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
PATH = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = "^[^?#]*\\?([^#]*)"


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, SCHEME))


def host_of(url: Column) -> Column:
    """Lower-case host without user data, port or brackets."""
    return F.lower(
        F.regexp_extract(_part(url, AUTHORITY), "^(?:.*@)?(\\[[^\\]]*\\]|[^:]*)", 1)
    ).alias("host")


def port_of(url: Column) -> Column:
    return F.regexp_extract(_part(url, AUTHORITY), ":([0-9]*)$", 1)


def path_of(url: Column) -> Column:
    return _part(url, PATH)


def _encode(c: Column) -> Column:
    """Form encoding with ~ left alone and * encoded."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def normalized_query(query: Column) -> Column:
    """Pairs without trackers, ordered by (lower key, value), encoded again."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            F.lower(_decode(F.regexp_extract(p, "^([^=]*)", 1))).alias("fold"),
            _decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value"),
            _decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"),
        ),
    )
    kept = F.filter(
        pairs, lambda p: ~p["fold"].startswith("utm_") & ~p["fold"].isin(*TRACKING_KEYS)
    )
    # Position as the last field keeps equal (fold, value) pairs in their order.
    ordered = F.array_sort(
        F.transform(kept, lambda p, i: F.struct(p["fold"], p["value"], i.alias("at"), p["key"]))
    )
    return F.array_join(
        F.transform(ordered, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))), "&"
    )


#: Addresses that are their own key: lower-case scheme and host, no port, query, fragment, empty path step or last slash.
OWN_KEY = "\\Ahttps?://[a-z0-9.-]+(?:/[A-Za-z0-9._~%+,;=-]+)+\\z"


def normalize_url(c: Column) -> Column:
    """FN-15: one key for URLs that differ in tracking, case of host, port or slashes only.

    Most addresses are their own key by one pattern; each part of the others is read once.
    """

    def key(p: Column) -> Column:
        default_port = (
            (p["port"] == "")
            | ((p["scheme"] == "http") & (p["port"] == "80"))
            | ((p["scheme"] == "https") & (p["port"] == "443"))
        )
        netloc = F.when(default_port, p["host"]).otherwise(F.concat(p["host"], F.lit(":"), p["port"]))
        path = F.when(p["path"] == "", F.lit("/")).when(p["path"] != "/", F.regexp_replace(p["path"], "/+$", "")).otherwise(p["path"])
        query = F.when(p["query"] == "", "").otherwise(normalized_query(p["query"]))
        return F.concat(
            F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(F.lit("")),
            with_value(netloc, lambda n: F.when(n != "", F.concat(F.lit("//"), n)).otherwise(F.lit(""))),
            path,
            with_value(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))),
        )

    def read(url: Column) -> Column:
        parts = F.struct(
            scheme_of(url).alias("scheme"), host_of(url).alias("host"), port_of(url).alias("port"),
            F.regexp_replace(path_of(url), "/{2,}", "/").alias("path"), _part(url, QUERY).alias("query"),
        )
        return F.when(url == "", F.lit("")).otherwise(with_value(parts, key))

    return F.when(blank(c).rlike(OWN_KEY), c).otherwise(with_value(strip(blank(c)), read))


# Paths of careers home and search pages.
CAREERS_PATHS = ("career", "careers", "job-search", "jobs", "search", "search-jobs")
CAREERS_ENDINGS = ("careers", "jobs", "search")


def generic_careers_url(c: Column) -> Column:
    """FN-16: the address of a site's careers home or search page rather than one listing."""
    path = F.lower(F.regexp_replace(path_of(blank(c)), "^/+|/+$", ""))
    last = F.regexp_extract(path, "([^/]*)$", 1)
    return (path == "") | path.isin(*CAREERS_PATHS) | last.isin(*CAREERS_ENDINGS)


def valid_listing_url(c: Column) -> Column:
    return scheme_of(c).isin("http", "https") & (host_of(c) != "")


MAX_PAGE_BYTES = 750_000
CONTENT_TYPES = ("text/html", "application/xhtml+xml", "text/plain")


def crawl_reject_reason(
    url: Column, content_type: Column, content_encoding: Column, size: Column
) -> Column:
    """FLT-13: first reason a fetched page is not read; NULL for a good one."""
    raw = strip(blank(url))
    authority = _part(raw, AUTHORITY)
    port = port_of(raw)
    host = F.regexp_replace(host_of(raw), "\\.$", "")
    standard = F.when(scheme_of(raw) == "https", F.lit("443")).otherwise(F.lit("80"))
    kind = F.lower(F.trim(F.regexp_extract(blank(content_type), "^([^;]*)", 1)))
    return (
        F.when(raw == "", "missing_url")
        .when(~valid_listing_url(raw), "invalid_url")
        .when(F.contains(authority, F.lit("@")), "embedded_credentials")
        .when(authority.rlike(":[^0-9\\]]+$"), "invalid_port")
        .when((port != "") & (port != standard), "non_standard_port")
        .when((host == "localhost") | host.endswith(".localhost"), "localhost")
        .when(~kind.isin(*CONTENT_TYPES), "unsupported_content_type")
        .when(~F.lower(blank(content_encoding)).isin("", "identity"), "unsupported_encoding")
        .when(size > MAX_PAGE_BYTES, "too_large")
    )
