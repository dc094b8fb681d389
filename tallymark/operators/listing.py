"""Listing freshness and row constraints (PRJ-01..08, PRJ-11, FLT-02..06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from .ordered import global_rank

VERIFICATION_MAX_AGE_DAYS = 7
DUE_SOON_DAYS = 7

# Labels of states.
DEADLINE_LABELS = {
    "unknown": "Unknown",
    "confirmed": "Confirmed date",
    "rolling": "Rolling / open until filled",
    "not_stated": "No deadline stated",
}
LISTING_LABELS = {
    "unverified": "Unverified",
    "open": "Open",
    "closed": "Closed by employer",
    "expired": "Expired",
    "link_broken": "Broken link",
    "wrong_page": "Wrong company page",
}
PREDICTED_RATING = {
    "STRONG MATCH": "strong",
    "GOOD MATCH": "good",
    "POSSIBLE MATCH": "possible",
    "WEAK MATCH": "weak",
    "DISQUALIFIED": "not_eligible",
}


def choose(c: Column, mapping: dict, default=None) -> Column:
    """A small fixed lookup as an expression."""
    result = F.when(F.lit(False), F.lit(default))
    for key, value in mapping.items():
        result = result.when(c == key, F.lit(value))
    return result.otherwise(F.lit(default))


def with_deadline_state(postings: DataFrame, as_of: str) -> DataFrame:
    """PRJ-01."""
    today = F.to_date(F.lit(as_of))
    days = F.when(F.col("deadline_status") == "confirmed", F.datediff("application_deadline", today))
    past, ahead = F.abs(days), days
    label = (
        F.when(days < 0, F.concat(F.lit("Expired "), past.cast("string"), F.when(past == 1, " day").otherwise(" days"), F.lit(" ago")))
        .when(days == 0, "Deadline today")
        .when(days == 1, "Deadline tomorrow")
        .when(days > 1, F.concat(F.lit("Deadline in "), ahead.cast("string"), F.lit(" days")))
        .otherwise(choose(F.col("deadline_status"), DEADLINE_LABELS, "Unknown"))
    )
    return postings.withColumns(
        {
            "days_remaining": days,
            "is_overdue": F.coalesce(days < 0, F.lit(False)),
            "due_soon": F.coalesce(days.between(0, DUE_SOON_DAYS), F.lit(False)),
            "deadline_label": label,
        }
    )


def with_listing_state(postings: DataFrame) -> DataFrame:
    """PRJ-02, after PRJ-01."""
    status = F.when(
        F.col("is_overdue") & F.col("listing_status").isin("open", "unverified"), "expired"
    ).otherwise(F.col("listing_status"))
    return postings.withColumn("effective_status", status).withColumns(
        {
            "is_available": F.col("effective_status") == "open",
            "has_link_problem": F.col("effective_status").isin("link_broken", "wrong_page"),
            "is_unavailable": F.col("effective_status").isin("closed", "expired", "link_broken", "wrong_page"),
            "effective_label": choose(F.col("effective_status"), LISTING_LABELS, "Unverified"),
        }
    )


def with_verification_need(postings: DataFrame, as_of: str) -> DataFrame:
    """PRJ-03, after PRJ-02."""
    oldest = F.date_sub(F.to_date(F.lit(as_of)), VERIFICATION_MAX_AGE_DAYS)
    need = (
        F.when(F.col("effective_status") == "unverified", True)
        .when(F.col("effective_status") != "open", False)
        .when(F.col("deadline_status") == "unknown", True)
        .when(F.col("listing_last_verified").isNull(), True)
        .otherwise(F.col("listing_last_verified") < oldest)
    )
    return postings.withColumn("needs_verification", need)


def listing_state(postings: DataFrame, as_of: str) -> DataFrame:
    """PRJ-01..03 in one projection."""
    return with_verification_need(with_listing_state(with_deadline_state(postings, as_of)), as_of)


def posting_violations(postings: DataFrame) -> DataFrame:
    """PRJ-04: promoted deadline status and the list of broken constraints."""
    promoted = F.when(F.col("application_deadline").isNotNull(), "confirmed").otherwise(
        F.coalesce(F.col("deadline_status"), F.lit("unknown"))
    )
    checks = F.array(
        F.when((promoted == "confirmed") & F.col("application_deadline").isNull(), "confirmed_without_date"),
        F.when(F.col("application_deadline") < F.col("date_posted"), "deadline_before_posting"),
        F.when(F.col("max_years") < F.col("min_years"), "max_years_below_min"),
        F.when((F.col("listing_status") == "open") & (blank(F.col("job_url")) == ""), "open_without_url"),
    )
    return postings.withColumn("deadline_status", promoted).withColumn("violations", F.array_compact(checks))


def split_quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with violations."""
    broken = F.size("violations") > 0
    return checked.where(~broken), checked.where(broken)


def has_content(requirements: DataFrame) -> DataFrame:
    """PRJ-05: whether a requirement record says anything, and its experience range."""
    text = [c for c in ("role_family", "industry", "work_authorization", "notes") if c in requirements.columns]
    lists = [
        c
        for c in (
            "required_skills", "preferred_skills", "required_education", "preferred_education",
            "responsibilities", "certifications", "hard_disqualifiers",
        )
        if c in requirements.columns
    ]
    filled = F.lit(False)
    for c in text:
        filled = filled | (F.trim(blank(F.col(c))) != "")
    for c in lists:
        filled = filled | F.coalesce(F.exists(c, lambda x: F.trim(x) != ""), F.lit(False))
    filled = (
        filled
        | (F.coalesce(F.col("seniority_level"), F.lit("unknown")) != "unknown")
        | F.col("min_years").isNotNull()
        | F.col("max_years").isNotNull()
    )
    return requirements.withColumns({"has_content": filled, "experience_range": experience_range()})


def experience_range(low: str = "min_years", high: str = "max_years") -> Column:
    a, b = F.col(low), F.col(high)
    return (
        F.when(a.isNotNull() & b.isNotNull(), F.concat(a.cast("string"), F.lit("–"), b.cast("string"), F.lit(" years")))
        .when(a.isNotNull(), F.concat(a.cast("string"), F.lit("+ years")))
        .when(b.isNotNull(), F.concat(F.lit("Up to "), b.cast("string"), F.lit(" years")))
        .otherwise("Not specified")
    )


def agreement_status(predicted_class: Column, human_rating: Column) -> Column:
    """PRJ-06."""
    rating = choose(predicted_class, PREDICTED_RATING)
    return F.when(rating.isNull(), "NEEDS EVIDENCE").when(rating == human_rating, "ALIGNED").otherwise("REVIEW")


def run_state(runs: DataFrame) -> DataFrame:
    """PRJ-07: clamped duration and the finished / needs review flags."""
    seconds = F.col("completed_at").cast("double") - F.col("started_at").cast("double")
    return runs.withColumns(
        {
            "duration_seconds": F.when(F.col("completed_at").isNotNull(), F.greatest(F.lit(0.0), seconds)),
            "is_finished": F.col("status").isin("completed", "needs_review", "failed"),
            "needs_manual_review": (F.col("status") == "needs_review") | (F.col("review_status") == "pending"),
        }
    )


def can_send_to_processing() -> Column:
    """PRJ-08 over the columns of an opportunity."""
    blocked = F.coalesce(F.exists("duplicate_details", lambda d: d["blocking"]), F.lit(False))
    return (
        F.col("source_is_active")
        & F.col("source_closed_at").isNull()
        & F.col("status").isin("new", "ready", "processing_failed")
        & (~blocked | F.col("duplicate_override"))
    )


def review_prefill(postings: DataFrame, runs: DataFrame) -> DataFrame:
    """PRJ-11: what a reviewer starts from, the detected or the saved values."""
    detected = (
        (F.col("run_status") != "failed")
        & (F.col("review_status") == "pending")
        & (F.col("detected_listing_status") != "unverified")
    )
    pick = lambda found, saved: F.when(detected, F.col(found)).otherwise(F.col(saved))
    return runs.join(postings, "job_id").select(
        "run_id",
        "job_id",
        F.when(blank(F.col("final_url")) != "", F.col("final_url")).otherwise(F.col("job_url")).alias("job_url"),
        pick("detected_listing_status", "listing_status").alias("listing_status"),
        pick("detected_deadline_status", "deadline_status").alias("deadline_status"),
        pick("detected_deadline", "application_deadline").alias("application_deadline"),
        detected.alias("from_detection"),
    )


def apply_decisions(postings: DataFrame, decisions: DataFrame, as_of: str) -> DataFrame:
    """PRJ-11: fold the latest accepted decision of each posting into it."""
    fields = ["job_url", "listing_status", "deadline_status", "application_deadline"]
    latest = decisions.groupBy("job_id").agg(
        F.max_by(F.struct(*fields), F.struct("decided_at", "decision_id")).alias("_accepted")
    )
    accepted = F.col("_accepted").isNotNull()
    joined = postings.join(latest, "job_id", "left")
    updates = {f: F.when(accepted, F.col(f"_accepted.{f}")).otherwise(F.col(f)) for f in fields}
    updates["listing_last_verified"] = F.when(accepted, F.to_date(F.lit(as_of))).otherwise(
        F.col("listing_last_verified")
    )
    return joined.withColumns(updates).drop("_accepted")


# ---------------------------------------------------------------- filters
STATUSES = (
    "discovered", "saved", "preparing", "applied", "interview", "offer", "rejected", "withdrawn", "closed",
)
FIT_CLASSES = {
    "strong": ("STRONG MATCH", "GOOD MATCH"),
    "possible": ("POSSIBLE MATCH",),
    "weak": ("WEAK MATCH",),
    "disqualified": ("DISQUALIFIED",),
    "needs_review": ("LOW CONFIDENCE", "NEEDS REQUIREMENTS"),
}
TRACKS = {
    "priority": "PRIORITY ROLE",
    "adjacent": "ADJACENT OPPORTUNITY",
    "outside": "OUTSIDE PRIORITY",
}


def search(postings: DataFrame, requirements: DataFrame, text: str, posting_columns, requirement_columns) -> DataFrame:
    """FLT-01: postings where any column of the pair contains the text, in any case."""
    needle = F.lower(F.lit(text.strip()))
    hit = F.lit(False)
    for c in [*posting_columns, *requirement_columns]:
        hit = hit | F.contains(F.lower(blank(F.col(c))), needle)
    joined = postings.join(requirements.select("job_id", *requirement_columns), "job_id", "left")
    return joined.where(hit).dropDuplicates(["job_id"]).select(*postings.columns)


def by_status(postings: DataFrame, status: str) -> DataFrame:
    """FLT-02: an unknown status filters nothing."""
    return postings.where(F.col("status") == status) if status in STATUSES else postings


def by_source(postings: DataFrame, bucket: str, calibration: str, validation: str) -> DataFrame:
    """FLT-03."""
    known = {"validation": validation, "calibration": calibration}
    if bucket in known:
        return postings.where(F.col("source") == known[bucket])
    if bucket == "other":
        return postings.where(~F.col("source").isin(calibration, validation))
    return postings


def by_listing(postings: DataFrame, bucket: str) -> DataFrame:
    """FLT-04 over PRJ-01..03 columns."""
    rules = {
        "open": F.col("is_available") & ~F.col("needs_verification"),
        "needs_verification": F.col("needs_verification"),
        "deadline_soon": F.col("due_soon"),
        "unavailable": F.col("is_unavailable") & ~F.col("has_link_problem"),
        "link_problem": F.col("has_link_problem"),
    }
    return postings.where(rules[bucket]) if bucket in rules else postings


def by_fit(scored: DataFrame, bucket: str) -> DataFrame:
    """FLT-05: blind rows always pass."""
    if bucket not in FIT_CLASSES:
        return scored
    return scored.where(F.col("blind") | F.col("classification").isin(*FIT_CLASSES[bucket]))


def by_track(scored: DataFrame, bucket: str) -> DataFrame:
    """FLT-06: blind rows always pass."""
    return scored.where(F.col("blind") | (F.col("track") == TRACKS[bucket])) if bucket in TRACKS else scored


def by_review(scored: DataFrame, labels: DataFrame, bucket: str) -> DataFrame:
    """FLT-07."""
    if bucket == "reviewed":
        return scored.join(labels.select("job_id"), "job_id", "left_semi")
    if bucket == "unreviewed":
        return scored.join(labels.select("job_id"), "job_id", "left_anti")
    if bucket in ("aligned", "disagree"):
        wanted = "ALIGNED" if bucket == "aligned" else "REVIEW"
        matching = labels.where(agreement_status(F.col("predicted_class"), F.col("human_rating")) == wanted)
        return scored.join(matching.select("job_id"), "job_id", "left_semi")
    return scored


def mask_blind(scored: DataFrame, labels: DataFrame, holdout: str) -> DataFrame:
    """FLT-09: hold back score, class and track of unlabelled holdout rows."""
    marked = scored.join(labels.select("job_id", F.lit(True).alias("_labelled")), "job_id", "left")
    marked = marked.withColumn("blind", (F.col("source") == holdout) & F.col("_labelled").isNull())
    hide = lambda c: F.when(~F.col("blind"), F.col(c))
    return marked.withColumns({c: hide(c) for c in ("score", "classification", "track")}).drop("_labelled")


# ---------------------------------------------------------------- sorts
def sort_order(rows: DataFrame, order: str, reset_for_blind: bool = True) -> list[Column]:
    """SRT-01..05. Score orders fall back to company order while blind rows are present."""
    ids = [F.asc(c) for c in ("job_id", "profile_id") if c in rows.columns]
    if order in ("match_high", "match_low") and reset_for_blind and not rows.where("blind").isEmpty():
        order = "company"
    by = {
        "match_high": [
            F.desc(~F.col("blind")), F.desc(F.col("classification") != "DISQUALIFIED"), F.desc("has_requirements"),
            F.desc("score"), F.desc("coverage"), F.desc("created_at"),
        ],
        "match_low": [F.asc("blind"), F.asc(~F.col("has_requirements")), F.asc("score"), F.asc(F.lower("company"))],
        "deadline": [F.asc_nulls_last("application_deadline"), F.asc(F.lower("company"))],
        "company": [F.asc(F.lower("company")), F.asc(F.lower("title"))],
        "newest": [F.desc("created_at")],
    }
    # Built only where asked for: the rows of one order need not have the columns of another.
    return [*by[order], *ids]


def sort_rows(rows: DataFrame, order: str, reset_for_blind: bool = True) -> DataFrame:
    """The rows in their order, for a screen of them; see `ranked_rows` for all."""
    return rows.orderBy(*sort_order(rows, order, reset_for_blind))


def ranked_rows(rows: DataFrame, order: str, reset_for_blind: bool = True) -> DataFrame:
    """All rows with their place in the order, by ranges of it, so that no task sorts or counts them all."""
    return global_rank(rows, sort_order(rows, order, reset_for_blind), "rank")
