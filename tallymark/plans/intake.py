"""INTAKE: listing text to a typed record (FN-18..22, WIN-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import listing as L
from ..functions.text import blank, strip
from ..operators.spread import fence

PARSER_VERSION = "tallymark-intake-1"


def extract_listings(listings: DataFrame, text: str = "raw_text") -> DataFrame:
    """One record per listing: job fields, requirement lists, warnings. No shuffle, no Python."""
    rows = listings.withColumn("_lines", L.clean_lines(F.col(text)))
    rows = rows.withColumn("_keys", F.transform("_lines", L.heading_key))
    lines, keys = F.col("_lines"), F.col("_keys")
    labelled = L.labeled_value(lines, L.TITLE_LABELS)
    place = L.labeled_value(lines, L.LOCATION_LABELS)
    alone = F.get(
        F.filter(F.slice(lines, 1, 12), lambda x: F.lower(x).isin("remote", "hybrid", "on-site", "onsite")), F.lit(0)
    )
    rows = rows.withColumns(
        {
            "title": F.when(labelled != "", labelled).otherwise(L.first_title(lines)),
            "company": L.labeled_value(lines, L.COMPANY_LABELS),
            "location": F.when(place != "", place).otherwise(F.coalesce(alone, F.lit(""))),
            "required_skills": L.section(lines, keys, L.SECTION_HEADINGS["required_skills"]),
            "preferred_skills": L.section(lines, keys, L.SECTION_HEADINGS["preferred_skills"]),
            "responsibilities": L.section(lines, keys, L.SECTION_HEADINGS["responsibilities"]),
            "authorization": L.authorization_lines(lines),
            "employment_type": L.employment_type(F.col(text)),
            "work_arrangement": L.work_arrangement(F.col(text)),
            "_deadline": L.deadline(F.col(text)),
            "description": strip(blank(F.col(text))),
        }
    )
    hard = F.array_join("authorization", "\n").rlike(L.HARD_DISQUALIFIER)
    rows = rows.withColumns(
        {
            "role_family": F.col("title"),
            "seniority_level": L.seniority(F.col("title"), F.col(text)),
            "required_education": L.education_lines(F.col("required_skills")),
            "hard_disqualifiers": F.when(hard, F.col("authorization")).otherwise(F.slice("authorization", 1, 0)),
            "deadline_status": F.col("_deadline.status"),
            "application_deadline": F.col("_deadline.date"),
            "warnings": F.array_compact(
                F.array(
                    F.when(F.col("company") == "", "company_not_detected"),
                    F.when(F.col("title") == "", "title_not_detected"),
                    F.when(F.size("required_skills") == 0, "no_qualifications_section"),
                )
            ),
        }
    )
    return fence(rows, "listings_read").drop("_lines", "_keys", "_deadline")
