"""PAGE: is a listing page still open, and is it the right page?

The page is parsed once; every later step is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import listing as L
from ..functions.html import parse_page
from ..functions.similarity import title_similarity
from ..functions.text import collapsed, company_text, first_seen, squeeze
from ..functions.urls import crawl_reject_reason, generic_careers_url
from ..operators.spread import fence

SEGMENT = "\\s+[|–—]\\s+|\\s+-\\s+"
OPEN_TITLE, OPEN_COMPANY = 0.65, 0.55


def crawl(pages: DataFrame) -> DataFrame:
    """SRC-05 and FLT-13: body hash and the reason a page is not read."""
    return pages.withColumns(
        {
            "body_sha256": F.sha2("body", 256),
            "reject_reason": crawl_reject_reason(
                F.col("final_url"), F.col("content_type"), F.col("content_encoding"), F.octet_length("body")
            ),
        }
    )


def interpret_pages(pages: DataFrame, as_of: str) -> DataFrame:
    """pages: page_id, title, company (expected), final_url, status_code, content_type, body."""
    rows = pages.withColumn("p", parse_page("body", "content_type"))
    return interpret_parsed(rows, as_of)


def _candidates(rows: DataFrame) -> DataFrame:
    texts = lambda c, source: F.transform(c, lambda x: F.struct(x.alias("text"), F.lit(source).alias("source")))
    whole = F.col("p.document_title")
    segments = F.filter(
        F.transform(F.split(whole, SEGMENT), squeeze), lambda s: (s != "") & (s != whole)
    )
    titles = F.concat(
        texts(F.transform("p.postings", lambda x: x["title"]), "json_ld"),
        texts(F.col("p.meta_titles"), "meta_title"),
        texts(F.array(whole), "document_title"),
        texts(segments, "document_title"),
    )
    companies = F.concat(
        texts(F.transform("p.postings", lambda x: x["company"]), "json_ld"), texts(F.col("p.site_names"), "site_name")
    )
    unique = lambda c: first_seen(
        F.filter(c, lambda x: F.trim(x["text"]) != ""), lambda x: F.concat(x["source"], F.lit(":"), F.lower(x["text"]))
    )
    return rows.withColumns({"_titles": unique(titles), "_companies": unique(companies)})


def _best(expected: Column, candidates: Column) -> Column:
    """Most similar candidate, the first of equals."""
    scored = F.transform(
        candidates,
        lambda c, i: F.struct(
            title_similarity(expected, c["text"]).alias("score"), (-i).alias("place"), c["text"], c["source"]
        ),
    )
    return F.array_max(F.filter(scored, lambda s: s["score"] > 0))


def interpret_parsed(rows: DataFrame, as_of: str) -> DataFrame:
    today = F.to_date(F.lit(as_of))
    rows = _candidates(rows)
    rows = rows.withColumns(
        {
            "_t": _best(F.col("title"), F.col("_titles")),
            "_c": _best(F.col("company"), F.col("_companies")),
            "_visible": collapsed(F.col("p.visible_text")),
        }
    )
    seen_title = (collapsed(F.col("title")) != "") & F.contains("_visible", collapsed(F.col("title")))
    seen_company = (company_text(F.col("company")) != "") & F.contains(
        company_text(F.col("p.visible_text")), company_text(F.col("company"))
    )
    score = lambda c, seen, floor: F.when(
        seen, F.greatest(F.coalesce(F.col(f"{c}.score"), F.lit(0.0)), F.lit(floor))
    ).otherwise(F.coalesce(F.col(f"{c}.score"), F.lit(0.0)))
    rows = rows.withColumns(
        {
            "title_score": score("_t", seen_title, 0.92),
            "company_score": score("_c", seen_company, 0.9),
            "detected_title": F.coalesce("_t.text", F.when(seen_title, F.col("title")), F.lit("")),
            "detected_company": F.coalesce("_c.text", F.when(seen_company, F.col("company")), F.lit("")),
            "closed_signals": L.phrases_in(F.col("_visible"), L.CLOSED_PHRASES),
            "expired_signals": L.phrases_in(F.col("_visible"), L.EXPIRED_PHRASES),
            "generic_signals": L.phrases_in(F.col("_visible"), L.GENERIC_PAGE_PHRASES),
            "apply_actions": _apply_actions(),
            "json_match": F.exists(
                "p.postings", lambda x: title_similarity(F.col("title"), x["title"]) >= OPEN_TITLE
            )
            & F.exists(
                "p.postings", lambda x: title_similarity(F.col("company"), x["company"], True) >= OPEN_COMPANY
            ),
            "_json_date": F.array_min(F.transform("p.postings", lambda x: L.page_date(x["valid_through"]))),
        }
    )
    rolling = F.size(L.phrases_in(F.col("_visible"), L.PAGE_ROLLING_PHRASES)) > 0
    unstated = F.size(L.phrases_in(F.col("_visible"), L.PAGE_NO_DEADLINE_PHRASES)) > 0
    cued = L.cued_date(F.col("p.visible_text"))
    rows = rows.withColumn(
        "deadline_status",
        F.when(F.col("_json_date").isNotNull(), "confirmed").when(rolling, "rolling").when(unstated, "not_stated")
        .when(cued.isNotNull(), "confirmed").otherwise("unknown"),
    ).withColumn("deadline", F.when(F.col("deadline_status") == "confirmed", F.coalesce("_json_date", cued)))
    return fence(_classified(rows, today), "pages_interpreted").drop("_titles", "_companies", "_t", "_c", "_visible", "_json_date")


def _apply_actions() -> Column:
    links = F.filter(
        "p.links",
        lambda x: x["text"].rlike(L.APPLY_PATTERN)
        | (F.lower(x["href"]).rlike(L.APPLY_HREF) & F.contains(F.lower(x["text"]), F.lit("apply"))),
    )
    buttons = F.filter("p.buttons", lambda x: x.rlike(L.APPLY_PATTERN))
    direct = F.filter("p.postings", lambda x: x["direct_apply"])
    return F.array_distinct(
        F.concat(
            F.transform(links, lambda x: F.concat(F.lit("link:"), x["text"], F.lit(":"), x["href"])),
            F.transform(buttons, lambda x: F.concat(F.lit("button:"), x)),
            F.transform(direct, lambda x: F.concat(F.lit("json_ld:"), x["url"])),
        )
    )


def _classified(rows: DataFrame, today: Column) -> DataFrame:
    title, company = F.col("title_score"), F.col("company_score")
    passed = F.coalesce(F.col("deadline") < today, F.lit(False))
    expired = (F.size("expired_signals") > 0) | passed
    closed = F.size("closed_signals") > 0
    broken = F.col("status_code").isin(404, 410)
    wrong = F.array_compact(
        F.array(
            F.when((title < 0.45) & (F.size("generic_signals") > 0), "generic_page"),
            F.when((title < 0.45) & generic_careers_url(F.col("final_url")), "careers_url"),
            F.when((F.size("_titles") > 0) & (title < 0.35), "title_mismatch"),
        )
    )
    apply = F.size("apply_actions") > 0
    is_open = (
        F.col("status_code").between(200, 399) & (title >= OPEN_TITLE) & (company >= OPEN_COMPANY)
        & (apply | F.col("json_match"))
    )
    status = (
        F.when(expired, "expired").when(closed, "closed").when(broken, "link_broken")
        .when(F.size(wrong) > 0, "wrong_page").when(is_open, "open").otherwise("unverified")
    )
    confidence = (
        F.when(status == "expired", F.when((title >= OPEN_TITLE) | passed, "high").otherwise("medium"))
        .when(status == "closed", F.when(title >= OPEN_TITLE, "high").otherwise("medium"))
        .when(status == "link_broken", "high").when(status == "wrong_page", "medium")
        .when(status == "open", F.when(apply & F.col("json_match"), "high").otherwise("medium"))
        .otherwise("low")
    )
    return rows.withColumns(
        {
            "wrong_page_signals": wrong, "apply_action_found": apply, "listing_status": status,
            "confidence": confidence, "deadline_passed": passed,
        }
    )
