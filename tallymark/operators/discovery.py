"""Discovery inbox: validity, relevance, life cycle of sources (FLT-10, FLT-12, JOIN-11, JOIN-12, AGG-09..11, PRJ-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank, strip, with_value, words_only
from ..functions.urls import valid_listing_url
from .ordered import top_k

MIN_TEXT = 40


def validity(rows: DataFrame) -> DataFrame:
    """FLT-12: reject reason of an opportunity, NULL for a valid one."""
    url = strip(blank(F.col("source_url")))
    reason = (
        F.when((strip(blank(F.col("external_id"))) == "") & (url == ""), "no_identifier")
        .when((url != "") & ~valid_listing_url(url), "invalid_url")
        .when(F.length(strip(blank(F.col("raw_text")))) < MIN_TEXT, "text_too_short")
    )
    return rows.withColumn("reject_reason", reason)


def require_valid(rows: DataFrame) -> DataFrame:
    """The strict form: the first invalid row fails the job."""
    checked = validity(rows)
    guard = F.when(F.col("reject_reason").isNotNull(), F.raise_error(F.concat(F.lit("invalid opportunity: "), F.col("reject_reason"))))
    return checked.where(F.coalesce(guard.cast("boolean"), F.lit(True))).drop("reject_reason")


def _overlap(a: Column, b: Column) -> Column:
    """Either folded phrase inside the other, neither blank."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def relevance(rows: DataFrame, preferences: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """JOIN-11: broad_match / unknown / outside, against the preferences of each row's searcher.

    preferences: on..., target_roles, target_industries, preferred_locations (arrays),
    preferred_arrangement, preferred_employment. Phrases are folded once for each searcher, hints once for each row.
    """
    empty = F.array().cast("array<string>")
    lists = {"title": "target_roles", "industry": "target_industries", "location": "preferred_locations"}
    held = preferences.select(
        *on,
        *[F.filter(F.transform(F.coalesce(F.col(c), empty), words_only), lambda p: p != "").alias(f"_{c}") for c in lists.values()],
        *[(F.size(F.coalesce(F.col(c), empty)) > 0).alias(f"_has_{c}") for c in lists.values()],
        words_only(F.col("preferred_arrangement")).alias("_arrangement"), words_only(F.col("preferred_employment")).alias("_employment"),
    )
    hits = rows.join(held, list(on))
    any_of = lambda hint, wanted: with_value(words_only(F.col(hint)), lambda h: F.exists(wanted, lambda p: _overlap(h, p)))
    for hint, wanted in lists.items():
        hits = hits.withColumn(f"_{hint}", (F.size(f"_{wanted}") > 0) & any_of(f"{hint}_hint", f"_{wanted}"))
    flexible = F.col("_arrangement").isin("", "flexible")
    hits = hits.withColumns({
        "_desk": flexible | _overlap(words_only(F.col("arrangement_hint")), F.col("_arrangement")),
        "_hours": (F.col("_employment") == "") | _overlap(words_only(F.col("employment_hint")), F.col("_employment")),
    })
    role, industry, place, desk, hours = (F.col(c) for c in ("_title", "_industry", "_location", "_desk", "_hours"))
    primary = F.col("_has_target_roles") | F.col("_has_target_industries")
    anything = primary | F.col("_has_preferred_locations") | ~flexible | (F.col("_employment") != "")
    label = (
        F.when(role | industry, "broad_match")
        .when(~anything, "unknown")
        .when(~primary & (place | (desk & hours)), "broad_match")
        .otherwise("outside")
    )
    reasons = F.array_compact(
        F.array(
            F.when(role, "title"),
            F.when(industry, "industry"),
            F.when(place, "location"),
            F.when(~flexible & desk, "arrangement"),
            F.when((F.col("_employment") != "") & hours, "employment"),
        )
    )
    return hits.withColumns({"relevance": label, "relevance_reasons": reasons}).select(
        *rows.columns, "relevance", "relevance_reasons"
    )


def reconcile(sightings: DataFrame, fetches: DataFrame) -> DataFrame:
    """JOIN-12: state of every (source, external_id) after all successful fetches.

    sightings: source_key, external_id, run_at (rows of successful runs count)
    fetches: source_key, run_at, status; a failed fetch neither closes nor opens.
    A listing that disappeared is closed at the first successful fetch without it and
    opened again when it is seen later, so only the last sighting decides.
    """
    done = fetches.where("status = 'success'").select("source_key", "run_at").distinct()
    # One row per source and run: the window never sees listings.
    timeline = done.withColumn(
        "_closed_at", F.lead("run_at").over(W.partitionBy("source_key").orderBy("run_at"))
    )
    seen = (
        sightings.select("source_key", "external_id", "run_at")
        .join(done, ["source_key", "run_at"], "left_semi")
        .groupBy("source_key", "external_id")
        .agg(F.min("run_at").alias("first_seen_at"), F.max("run_at").alias("last_seen_at"))
    )
    return (
        seen.join(timeline.withColumnRenamed("run_at", "last_seen_at"), ["source_key", "last_seen_at"])
        .select(
            "source_key", "external_id", "first_seen_at", "last_seen_at", F.col("_closed_at").alias("closed_at"),
            F.col("_closed_at").isNull().alias("is_active"),
        )
    )


def reconcile_step(prior: DataFrame, current: DataFrame, successful: DataFrame, run_at: str) -> DataFrame:
    """One run of JOIN-12 over stored rows: prior rows seen again, gone, or of a source not fetched.

    prior: source_key, external_id, is_active, last_seen_at, closed_at
    current: source_key, external_id of this run; successful: source_key
    """
    now = F.lit(run_at).cast("timestamp")
    marked = (
        prior.join(successful.select("source_key", F.lit(True).alias("_fetched")).distinct(), "source_key", "left")
        .join(
            current.select("source_key", "external_id", F.lit(True).alias("_seen")).distinct(),
            ["source_key", "external_id"], "left",
        )
    )
    fetched, again = F.col("_fetched").isNotNull(), F.col("_seen").isNotNull()
    updated = marked.select(
        "source_key", "external_id",
        F.when(fetched, F.lit(False)).otherwise(F.col("is_active")).alias("is_active"),
        F.when(fetched & again, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(fetched & again, F.lit(None).cast("timestamp"))
        .when(fetched & F.col("closed_at").isNull(), now)
        .otherwise(F.col("closed_at")).alias("closed_at"),
    )
    fresh = current.join(successful, "source_key", "left_semi").select(
        "source_key", "external_id", F.lit(True).alias("is_active"), now.alias("last_seen_at"),
        F.lit(None).cast("timestamp").alias("closed_at"),
    )
    return updated.unionByName(fresh)


def run_status(attempts: DataFrame) -> DataFrame:
    """AGG-11: completed / partial / failed with the joined errors of a run.

    A run has as many attempts as sources, so its error list is short.
    """
    failed = F.col("status") == "failed"
    message = F.concat_ws(": ", "source_key", F.when(blank(F.col("error")) != "", F.col("error")).otherwise("failed"))
    return (
        attempts.groupBy("run_id")
        .agg(
            F.bool_or(F.col("status") == "success").alias("_ok"),
            F.bool_or(failed).alias("_bad"),
            F.array_join(F.sort_array(F.collect_list(F.when(failed, message))), "; ").alias("errors"),
        )
        .select(
            "run_id",
            F.when(F.col("_ok") & F.col("_bad"), "partial").when(F.col("_bad"), "failed").otherwise("completed").alias("status"),
            "errors",
        )
    )


def run_counters(rows: DataFrame, keys=("run_id",)) -> DataFrame:
    """AGG-10."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("results"),
        F.count_if(F.col("status") == "new").alias("new"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
        F.count_if(F.col("relevance") == "outside").alias("outside"),
    )


def inbox(rows: DataFrame, bucket: str, limit: int = 100) -> DataFrame:
    """FLT-10 and SRT-08: the newest rows of a status, or of those that need action."""
    if bucket == "needs_action":
        rows = rows.where(F.col("status").isin("new", "ready", "processing_failed"))
    elif bucket:
        rows = rows.where(F.col("status") == bucket)
    return rows.orderBy(F.desc("discovered_at"), F.desc("opp_id")).limit(limit)


def newest_per_source(feed: DataFrame, k: int) -> DataFrame:
    """WIN-10: the k most recently updated listings of each source."""
    return top_k(feed, ["source_key"], [F.desc("updated_at"), F.desc("external_id")], k)


# ---------------------------------------------------------------- PRJ-12
STATES = ("new", "duplicate", "ready", "sent", "processed", "processing_failed", "ignored")


def transition(state: Column, action: Column, blocking: Column) -> Column:
    """Next state, NULL for a forbidden step. `override` rides along as state suffix '+'."""
    plain = F.regexp_replace(state, "\\+$", "")
    kept = state.endswith("+")
    mark = F.when(kept, F.lit("+")).otherwise("")
    sendable = plain.isin("new", "ready", "processing_failed") & (~blocking | kept)
    target = (
        F.when((action == "ignore") & ~plain.isin("processed", "sent"), F.lit("ignored"))
        .when((action == "restore") & (plain == "ignored"), F.when(blocking & ~kept, "duplicate").otherwise("ready"))
        .when((action == "send") & sendable, F.lit("sent"))
        .when(action == "process", F.lit("processed"))
        .when((action == "release") & (plain == "sent"), F.when(kept, "ready").otherwise("new"))
        .when((action == "fail") & sendable, F.lit("processing_failed"))
    )
    return F.when((action == "retain") & (plain == "duplicate"), F.lit("ready+")).otherwise(F.concat(target, mark))


def fold_actions(opportunities: DataFrame, actions: DataFrame) -> DataFrame:
    """PRJ-12: final state and number of refused actions per opportunity.

    Every action maps each of the 14 (state, override) pairs to another, so a run of
    actions is a 14-entry table and tables compose. Actions are folded per (key,
    bucket) and the few bucket tables per key, so a hot key is spread over tasks.
    opportunities: opp_id, status, blocking; actions: opp_id, bucket, at, seq, action
    """
    states = [s + m for m in ("", "+") for s in STATES]
    start = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(0).cast("long").alias("refused")) for s in states])

    def step(table: Column, action: Column) -> Column:
        def move(entry: Column) -> Column:
            to = transition(entry["state"], action["action"], action["blocking"])
            return F.struct(
                F.coalesce(to, entry["state"]).alias("state"),
                (entry["refused"] + F.when(to.isNull(), 1).otherwise(0)).cast("long").alias("refused"),
            )

        return F.transform(table, move)

    index = F.array(*[F.lit(s) for s in states])

    def chain(table: Column, following: Column) -> Column:
        def move(entry: Column) -> Column:
            to = F.get(following["table"], (F.array_position(index, entry["state"]) - 1).cast("int"))
            return F.struct(to["state"].alias("state"), (entry["refused"] + to["refused"]).alias("refused"))

        return F.transform(table, move)

    known = actions.join(opportunities.select("opp_id", "blocking"), "opp_id")
    per_bucket = (
        known.groupBy("opp_id", "bucket")
        .agg(F.array_sort(F.collect_list(F.struct("at", "seq", "action", "blocking"))).alias("a"))
        .select("opp_id", "bucket", F.aggregate("a", start, step).alias("table"))
    )
    per_key = (
        per_bucket.groupBy("opp_id")
        .agg(F.array_sort(F.collect_list(F.struct("bucket", "table"))).alias("t"))
        .select("opp_id", F.aggregate("t", start, chain).alias("table"))
    )
    done = opportunities.join(per_key, "opp_id", "left")
    end = F.get("table", (F.array_position(index, F.col("status")) - 1).cast("int"))
    return done.select(
        "opp_id",
        F.regexp_replace(F.coalesce(end["state"], F.col("status")), "\\+$", "").alias("status"),
        F.coalesce(end["state"].endswith("+"), F.lit(False)).alias("override"),
        F.coalesce(end["refused"], F.lit(0)).alias("refused"),
    )
