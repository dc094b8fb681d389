"""Duplicate candidates by key priority (JOIN-09, JOIN-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import listing_text_sha256, role_sha256
from ..functions.text import blank
from ..functions.urls import normalize_url
from .ordered import previous_by_key
from .spread import settle

# Strength of a reason, and whether it blocks.
REASONS = {"exact_url": (3, True), "exact_text": (2, True), "same_role": (1, False)}


def with_keys(rows: DataFrame, url="job_url", text=None, title="title", company="company", location="location") -> DataFrame:
    """FN-15/17 key columns of a record; blank keys are NULL so that they never join."""
    empty = lambda c: F.when(c != "", c)
    keys = {
        "url_key": empty(normalize_url(F.col(url))),
        "role_key": empty(role_sha256(F.col(title), F.col(company), F.col(location))),
    }
    if text is not None:
        keys["text_key"] = listing_text_sha256(F.col(text))
    return rows.withColumns(keys)


def tracked_duplicates(candidates: DataFrame, tracked: DataFrame, history: DataFrame) -> DataFrame:
    """JOIN-09: tracked records a candidate repeats, one row per pair with the strongest reason.

    candidates: candidate_id, url_key, text_key, role_key
    tracked: job_id, title, company, url_key, role_key
    history: job_id, url_key, text_key of earlier extraction runs
    """
    urls = tracked.select("job_id", "url_key").unionByName(history.select("job_id", "url_key")).distinct()
    sides = (
        ("exact_url", "url_key", urls),
        ("exact_text", "text_key", history.select("job_id", "text_key").distinct()),
        ("same_role", "role_key", tracked.select("job_id", "role_key")),
    )
    hits = None
    for reason, key, side in sides:
        found = (
            candidates.where(F.col(key).isNotNull()).select("candidate_id", key)
            .join(side.where(F.col(key).isNotNull()), key)
            .select("candidate_id", "job_id", F.lit(REASONS[reason][0]).alias("priority"))
        )
        hits = found if hits is None else hits.unionByName(found)
    best = hits.where("candidate_id <> job_id").groupBy("candidate_id", "job_id").agg(F.max("priority").alias("priority"))
    named = F.when(F.col("priority") == 3, "exact_url").when(F.col("priority") == 2, "exact_text").otherwise("same_role")
    return best.join(tracked.select("job_id", "title", "company"), "job_id").select(
        "candidate_id", "job_id", "title", "company", named.alias("reason"), (F.col("priority") > 1).alias("blocking"),
        "priority",
    )


def duplicate_summary(pairs: DataFrame) -> DataFrame:
    """Per candidate: how many duplicates, whether one blocks, and the strongest (SRT-07)."""
    order = F.struct((-F.col("priority")).alias("p"), F.lower("company"), F.lower("title"), "job_id")
    return pairs.groupBy("candidate_id").agg(
        F.count("*").alias("candidates"),
        F.max("blocking").alias("blocking"),
        F.min_by("job_id", order).alias("first_job_id"),
        F.min_by("reason", order).alias("first_reason"),
    )


#: The key column of each reason.
KEYS = {"exact_url": "url_key", "exact_text": "text_key", "same_role": "role_key"}


def key_classes(tracked: DataFrame, history: DataFrame) -> DataFrame:
    """Tracked records by key: one row per (reason, key) with its size and its first two records, never the members.

    tracked: job_id, title, company, url_key, role_key; history: job_id, url_key, text_key of earlier extraction runs. A
    record counts once in a class. Records are ordered by company, title and id; a hot key is combined before its shuffle.
    """
    named = tracked.select("job_id", F.lower("company").alias("company"), F.lower("title").alias("title"))
    sides = [
        tracked.select(F.lit("exact_url").alias("reason"), F.col("url_key").alias("key"), "job_id"),
        history.select(F.lit("exact_url").alias("reason"), F.col("url_key").alias("key"), "job_id"),
        history.select(F.lit("exact_text").alias("reason"), F.col("text_key").alias("key"), "job_id"),
        tracked.select(F.lit("same_role").alias("reason"), F.col("role_key").alias("key"), "job_id"),
    ]
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    members = rows.where("key IS NOT NULL AND key <> ''").distinct().join(named, "job_id").withColumn("member", F.struct("company", "title", "job_id"))
    first = settle(members.groupBy("reason", "key").agg(F.count("*").alias("size"), F.min("member").alias("first")))
    other = members.join(first.where("size > 1").select("reason", "key", "first"), ["reason", "key"]).where(F.col("member") != F.col("first"))
    second = other.groupBy("reason", "key").agg(F.min("member").alias("second"))
    return first.join(second, ["reason", "key"], "left")


def tracked_classes(candidates: DataFrame, classes: DataFrame, same: bool = False) -> DataFrame:
    """JOIN-09 and SRT-07 without pairs: per candidate the links by each key, the strongest reason and its first record.

    candidates: candidate_id, url_key, text_key, role_key; `same` says that the candidates are the tracked records
    themselves, so that none links to itself. One row per candidate: url_links, text_links, role_links, reason and
    first_job_id (null without a link), blocking.
    """
    asked = F.array(*[F.struct(F.lit(r).alias("reason"), F.lit(REASONS[r][0]).alias("priority"), F.col(c).alias("key")) for r, c in KEYS.items()])
    rows = candidates.select("candidate_id", F.explode(asked).alias("k")).select("candidate_id", "k.*").where("key IS NOT NULL AND key <> ''")
    hit = rows.join(classes, ["reason", "key"])
    own = F.col("first.job_id") == F.col("candidate_id") if same else F.lit(False)
    hit = hit.withColumns({"links": F.col("size") - (1 if same else 0), "pick": F.when(own, F.col("second.job_id")).otherwise(F.col("first.job_id"))}).where("links > 0")
    links = lambda r: F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("links"))), F.lit(0))
    best = F.max(F.struct("priority", "reason", "pick"))
    found = hit.groupBy("candidate_id").agg(*[links(r).alias(c.replace("_key", "_links")) for r, c in KEYS.items()], best.alias("best"))
    counts = [c.replace("_key", "_links") for c in KEYS.values()]
    return candidates.select("candidate_id").join(found, "candidate_id", "left").select(
        "candidate_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.col("best.reason").alias("reason"),
        F.coalesce(F.col("best.priority") > 1, F.lit(False)).alias("blocking"), F.col("best.pick").alias("first_job_id"),
    )


def linked_groups(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """key, component_id: the least key that can be reached over shared values of any of the columns.

    The least label spreads over the groups of each column and then follows its own label, so that the rounds grow with
    the logarithm of the longest chain in the usual case. A group is never expanded: its least label is an aggregate,
    joined back. Every round is written to the shared folder. Null and empty values link nothing; keys are distinct.
    """
    values = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in columns])
    links = settle(rows.select(F.col(key).alias("id"), F.explode(values).alias("v")).select("id", "v.*").where("value IS NOT NULL AND value <> ''"))
    labels = settle(rows.select(F.col(key).alias("id"), F.col(key).alias("label")))
    while True:
        held = links.join(labels, "id")
        least = held.groupBy("kind", "value").agg(F.min("label").alias("least"))
        near = links.join(least, ["kind", "value"]).groupBy("id").agg(F.min("least").alias("near"))
        moved = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.coalesce("near", "label").alias("label"))
        ahead = moved.select(F.col("id").alias("label"), F.col("label").alias("ahead"))
        found = settle(moved.join(ahead, "label").select("id", "old", F.least("label", "ahead").alias("label")))
        labels = found.select("id", "label")
        if found.where("old <> label").isEmpty():
            return labels.select(F.col("id").alias(key), F.col("label").alias("component_id"))


def earlier_discovery(rows: DataFrame, order: tuple[str, ...], bucket: Column) -> DataFrame:
    """JOIN-10: the latest earlier row with the same listing id, else URL, else text.

    rows: opp_id, provider, external_id, url_key, text_key and the order columns. Each
    key is looked up on its own and the strongest one found wins.
    """
    result = rows
    keys = (
        ("provider_external_id", ["provider", "external_id"]),
        ("exact_url", ["url_key"]),
        ("exact_text", ["text_key"]),
    )
    for name, columns in keys:
        keyed = rows.select("opp_id", *columns, *[o for o in order if o not in columns and o != "opp_id"])
        for c in columns:
            keyed = keyed.where(F.col(c).isNotNull() & (blank(F.col(c)) != ""))
        found = previous_by_key(keyed, columns, order, bucket, ["opp_id"], "_prior").select(
            "opp_id", F.col("_prior.opp_id").alias(f"_{name}")
        )
        result = result.join(found.where(F.col(f"_{name}").isNotNull()), "opp_id", "left")
    prior = F.coalesce(*[F.col(f"_{name}") for name, _ in keys])
    reason = F.when(F.lit(False), "")
    for name, _ in keys:
        reason = reason.when(F.col(f"_{name}").isNotNull(), name)
    return result.withColumns({"duplicate_of": prior, "duplicate_reason": reason.otherwise("")}).drop(
        *[f"_{name}" for name, _ in keys]
    )
