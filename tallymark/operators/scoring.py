"""Category scores, weights, classes and tracks (AGG-01..04, FN-29, FN-31, JOIN-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from ..functions.text import blank, normalize_text
from .listing import choose

CATEGORIES = (
    "role", "required_skills", "preferred_skills", "education", "experience", "industry",
    "location_arrangement", "employment_type",
)
# Weights of the base rule, the live model A and the compared model B.
BASE_WEIGHTS = {
    "role": 20, "required_skills": 25, "preferred_skills": 10, "education": 15,
    "experience": 15, "industry": 5, "location_arrangement": 5, "employment_type": 5,
}
MODEL_A = {
    "role": 10, "required_skills": 20, "preferred_skills": 10, "education": 15,
    "experience": 15, "industry": 20, "location_arrangement": 5, "employment_type": 5,
}
MODEL_B = {**MODEL_A, "required_skills": 25, "industry": 15}
MODELS = {"industry_balanced": MODEL_A, "skills_priority": MODEL_B}

MIN_COVERAGE = 35
CLASS_STEPS = ((80, "STRONG MATCH"), (65, "GOOD MATCH"), (50, "POSSIBLE MATCH"))

PROFILE_YEARS = {"entry_level": 1, "early_career": 3, "mid_level": 6, "senior": 12}
# How a seniority suits the levels entry_level, early_career, mid_level, senior.
SENIORITY_FIT = {
    "internship": (1.0, 1.0, 1.0, 1.0),
    "entry_level": (1.0, 1.0, 1.0, 1.0),
    "early_career": (0.70, 1.0, 1.0, 1.0),
    "mid_level": (0.20, 0.50, 1.0, 1.0),
    "senior": (0.0, 0.20, 0.60, 1.0),
    "lead_manager": (0.0, 0.10, 0.50, 0.85),
}
LEVEL_LABELS = {
    "entry_level": "Entry level", "early_career": "Early career (1–3 years)", "mid_level": "Mid level", "senior": "Senior",
}
ARRANGEMENT_LABELS = {"onsite": "On-site", "hybrid": "Hybrid", "remote": "Remote", "flexible": "Flexible"}
EMPLOYMENT_LABELS = {
    "full_time": "Full-time", "part_time": "Part-time", "contract": "Contract", "internship": "Internship",
    "temporary": "Temporary", "unknown": "Unknown",
}

NEEDS_SPONSORSHIP = "need sponsorship|needs sponsorship|require sponsorship|requires sponsorship"
NO_SPONSORSHIP = "no sponsorship|cannot sponsor|unable to sponsor|sponsorship not available"


def classify(score: Column, coverage: Column, blocked: Column) -> Column:
    """FN-31."""
    result = F.when(blocked, "DISQUALIFIED").when(coverage < MIN_COVERAGE, "LOW CONFIDENCE")
    for step, name in CLASS_STEPS:
        result = result.when(score >= step, name)
    return result.otherwise("WEAK MATCH")


def weighed_sums(parts: dict[str, tuple[Column, Column]], weights: dict[str, int]) -> tuple[Column, Column]:
    """AGG-02 across category columns: key -> (fraction, available). Returns the available and the earned weight."""
    total = earned = F.lit(0.0)
    for key, (fraction, available) in parts.items():
        bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))
        total = total + F.when(available, F.lit(float(weights[key]))).otherwise(0.0)
        earned = earned + F.when(available, weights[key] * bounded).otherwise(0.0)
    return total, earned


def score_of_sums(total: Column, earned: Column) -> tuple[Column, Column]:
    """Score and coverage of the two sums."""
    return F.when(total > 0, half_even(100 * earned / total)).otherwise(F.lit(0)), half_even(total)


def weighted_score(parts: dict[str, tuple[Column, Column]], weights: dict[str, int]) -> tuple[Column, Column]:
    """AGG-02 in one step: score and coverage."""
    return score_of_sums(*weighed_sums(parts, weights))


def weighted_score_rows(rows: DataFrame, keys, weight="weight", earned="earned", available="available") -> DataFrame:
    """AGG-02 over one row per category."""
    on = F.sum(F.when(F.col(available), F.col(weight)).otherwise(0.0))
    got = F.sum(F.when(F.col(available), F.col(earned)).otherwise(0.0))
    return rows.groupBy(*keys).agg(on.alias("_on"), got.alias("_got")).select(
        *keys,
        F.when(F.col("_on") > 0, half_even(100 * F.col("_got") / F.col("_on"))).otherwise(F.lit(0)).alias("score"),
        half_even(F.col("_on")).alias("coverage"),
    )


def requirement_coverage(matches: DataFrame, keys) -> DataFrame:
    """AGG-01: mean strength and counts per category, over all items including missing ones."""
    count = lambda kind: F.count_if(F.col("match_type") == kind)
    return matches.groupBy(*keys).agg(
        F.avg("strength").alias("fraction"),
        count("direct").alias("direct"),
        count("related").alias("related"),
        count("semantic").alias("semantic"),
        count("missing").alias("missing"),
    )


def two_part(first: Column, first_on: Column, second: Column, second_on: Column, shares) -> tuple[Column, Column]:
    """AGG-03/04: weighted mean of two parts over those that are known."""
    a, b = shares
    on = F.when(first_on, F.lit(a)).otherwise(0.0) + F.when(second_on, F.lit(b)).otherwise(0.0)
    got = F.when(first_on, a * first).otherwise(0.0) + F.when(second_on, b * second).otherwise(0.0)
    return F.when(on > 0, got / on).otherwise(F.lit(0.0)), on > 0


def experience_match(min_years: Column, seniority: Column, level: Column) -> dict[str, Column]:
    """FN-29: fraction, match type, evidence, concept and availability."""
    years = choose(level, PROFILE_YEARS, 1)
    by_years = F.when(min_years <= years, 1.0).when(min_years == years + 1, 0.60).otherwise(0.0)
    fit = F.when(F.lit(False), 0.0)
    for name, row in SENIORITY_FIT.items():
        for known, value in zip(PROFILE_YEARS, row):
            fit = fit.when((seniority == name) & (level == known), value)
    fit = fit.otherwise(0.0)
    stated = min_years.isNotNull()
    fraction = F.when(stated, by_years).otherwise(fit)
    kind = F.when(
        stated, F.when(by_years == 1.0, "direct").when(by_years > 0, "related").otherwise("missing")
    ).otherwise(F.when(fit >= 0.85, "direct").when(fit >= 0.45, "related").otherwise("missing"))
    concept = F.when(
        stated,
        F.when(by_years == 1.0, "Experience level").when(by_years > 0, "Near experience range").otherwise(""),
    ).otherwise("Seniority level")
    return {
        "fraction": fraction,
        "match_type": kind,
        "evidence": F.when(fraction > 0, choose(level, LEVEL_LABELS, "")).otherwise(""),
        "concept": concept,
        "available": stated | (F.coalesce(seniority, F.lit("unknown")) != "unknown"),
    }


def arrangement_match(arrangement: Column, preferred: Column) -> dict[str, Column]:
    same = (preferred == "flexible") | (preferred == arrangement)
    partly = ((preferred == "hybrid") & (arrangement == "onsite")) | (
        (preferred == "onsite") & (arrangement == "hybrid")
    )
    kind = F.when(same, "direct").when(partly, "related").otherwise("missing")
    return {
        "match_type": kind,
        "strength": F.when(same, 1.0).when(partly, 0.60).otherwise(0.0),
        "evidence": F.when(kind != "missing", choose(preferred, ARRANGEMENT_LABELS, "")).otherwise(""),
        "concept": F.when(same, "Work arrangement").when(partly, "Partly on-site").otherwise(""),
        "available": F.coalesce(arrangement, F.lit("unknown")) != "unknown",
    }


def needs_sponsorship(authorization: Column) -> Column:
    return normalize_text(authorization).rlike(NEEDS_SPONSORSHIP)


def denies_sponsorship(authorization: Column) -> Column:
    return normalize_text(authorization).rlike(NO_SPONSORSHIP)


def deal_breaker_hits(deal_breakers: Column, norm_text: Column) -> Column:
    """JOIN-14: deal breakers whose FN-01 form occurs in an FN-01 text."""
    return F.filter(
        F.coalesce(deal_breakers, F.array().cast("array<string>")),
        lambda b: (normalize_text(b) != "") & F.contains(norm_text, normalize_text(b)),
    )


def searchable_text(*columns: Column) -> Column:
    """FN-01 of everything a posting says, joined by line ends."""
    return normalize_text(F.concat_ws("\n", *[blank(c) for c in columns]))
