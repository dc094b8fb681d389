"""Not-modified revisits of a web archive (operator 6), resolved by an as-of join.

A revisit record holds no body: its response was "304 not modified". It is answered by the latest earlier full response
of the same canonical URL, if that one's validators agree; the revisit's own headers that RFC 9111 lets a 304 update
replace those of the stored response, the rest of them stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Time is cut into so many slices: state crosses slices as one row for each URL and slice, so that no URL, however
#: common, is ordered in one task.
SLICES = 256

# Query keys that name no other content, and headers that a 304 may not change.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="
FIXED_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")


def canonical(url: Column) -> Column:
    """Scheme, "www." and "m.", fragment, tracking keys, a closing slash and ".html" do not make another resource."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "#.*$", "")
    plain = F.regexp_replace(plain, "^[a-z][a-z0-9+.-]*://", "")
    plain = F.regexp_replace(plain, "^(www|m)\\.", "")
    path = F.regexp_replace(F.substring_index(plain, "?", 1), "(/|\\.html?)$", "")
    query = F.regexp_extract(plain, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(F.size(kept) > 0, F.concat(path, F.lit("?"), F.array_join(kept, "&"))).otherwise(path)


def resolve(records: DataFrame) -> DataFrame:
    """Answer each revisit.

    `records`: record_id, url, at (long), revisit (boolean), etag, modified (string), headers (map of lower-case names).
    Gives for each revisit: record_id, url_key, response_id, status, headers.
    status: "resolved"; "changed" if a validator that both have differs; "unknown" if they have none in common;
    "orphan" if there is no earlier full response. Only "resolved" ones get the stored headers merged.
    A null url is the empty one; a null `at` comes first; of responses at one time the largest record_id is the latest, and
    a response at the very time of a revisit is not earlier. Repeated rows repeat. No bodies are shuffled.
    """
    span = records.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    low = span["low"] or 0
    width = max(1, ((span["high"] or 0) - low) // SLICES + 1)
    facts = F.struct("at", "record_id", "etag", "modified", F.map_entries("headers").alias("entries"))
    rows = written(
        records.withColumns(
            {"url_key": canonical(F.col("url")), "at": F.coalesce("at", F.lit(low - 1))}
        ).withColumn("slice", F.floor((F.col("at") - F.lit(low)) / F.lit(width))), "records",
    )
    full = F.when(~F.col("revisit"), facts)
    # The latest response of each slice, and for each slice with rows the one before it.
    ends = rows.groupBy("url_key", "slice").agg(F.max(full).alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = written(ends.select("url_key", "slice", F.last("last", ignorenulls=True).over(earlier).alias("carried")), "carried")
    # Within a slice, in time order; RANGE leaves out what happens at the same time.
    inside = Window.partitionBy("url_key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("inner", F.max(full).over(inside)).where("revisit")
    found = seen.join(carried, ["url_key", "slice"]).withColumn("hit", F.coalesce("inner", "carried"))
    same = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a) == F.col(b))
    tag, day = same("etag", "hit.etag"), same("modified", "hit.modified")
    # A strong validator decides; the date only counts where there is no tag on both sides.
    agreed = F.coalesce(tag, day)
    status = F.when(F.col("hit").isNull(), "orphan").when(agreed.isNull(), "unknown").when(agreed, "resolved").otherwise("changed")
    none = F.create_map().cast("map<string,string>")
    allowed = F.map_filter("headers", lambda k, v: ~k.isin(*FIXED_HEADERS) & v.isNotNull())
    stored = F.map_filter(F.map_from_entries("hit.entries"), lambda k, v: ~F.map_contains_key(F.coalesce("headers", none), k) | k.isin(*FIXED_HEADERS))
    merged = F.map_concat(F.coalesce(stored, none), F.coalesce(allowed, none))
    return found.withColumn("status", status).select(
        "record_id", "url_key", F.col("hit.record_id").alias("response_id"), "status",
        F.when(F.col("status") == "resolved", merged).alias("headers"),
    )


def crawl_of_pages(pages: DataFrame) -> DataFrame:
    """Two crawls told by `pages`: every row is a full response, and every row is asked for again half a table later.

    The tag is made of the page, the date of its half; the second answer has no body and a new date and age. Pages of one
    canonical URL that change in between make revisits whose validators no longer agree.
    """
    half = F.lit((pages.agg(F.max("page_id")).first()[0] or 0) // 2 + 1)
    tag = F.md5(F.coalesce("html", F.lit("")))
    base = pages.select("page_id", "url", tag.alias("etag"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    first = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 2).alias("at"), F.lit(False).alias("revisit"), "etag",
        F.lit(None).cast("string").alias("modified"),
        F.create_map(F.lit("content-length"), F.col("size"), F.lit("date"), F.col("page_id").cast("string"), F.lit("server"), F.lit("first")).alias("headers"),
    )
    again = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", ((F.col("page_id") + half) * 2 + 1).alias("at"), F.lit(True).alias("revisit"),
        "etag", F.lit(None).cast("string").alias("modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), (F.col("page_id") + half).cast("string")).alias("headers"),
    )
    return first.unionByName(again)


def revisits_of_pages(pages: DataFrame) -> DataFrame:
    """record_id, page_id, url_key, response_id, status and the merged headers as one sorted text."""
    found = resolve(crawl_of_pages(pages))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", F.floor(F.col("record_id") / 2).cast("long").alias("page_id"), "url_key", "response_id", "status", F.coalesce(told, F.lit("")).alias("headers"))
