"""DISCOVER: feed payloads to inbox rows (SRC-04, SNK-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import listing_text_sha256, role_sha256
from ..functions.urls import normalize_url
from ..operators.discovery import relevance, validity
from ..operators.duplicates import earlier_discovery, key_classes, tracked_classes
from ..operators.spread import fence, kept


def duplicates_and_relevance(
    rows: DataFrame, preferences: DataFrame, on: tuple[str, ...], order: tuple[str, ...], bucket: Column,
    tracked: DataFrame | None = None, history: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """SNK-02: valid rows with duplicate state, relevance and status, and the refused rows.

    A row is a duplicate of an earlier discovery (JOIN-10) or of a tracked record with its address or its text (JOIN-09,
    columns of `tracked_classes`); a tracked record of the same role is named, but does not block. `tracked` and `history`
    are those of `key_classes`; the rows then also carry title_hint, company_hint and location_hint.
    """
    checked = fence(validity(rows), "rows_checked")
    refused = F.col("reject_reason").isNotNull()
    keys = {"url_key": F.nullif(normalize_url(F.col("source_url")), F.lit("")), "text_key": listing_text_sha256(F.col("raw_text"))}
    # Every lookup below reads the keys: they are made once for each row.
    checked = kept(checked.withColumns({name: F.when(~refused, key) for name, key in keys.items()}), "checked")
    keyed = checked.where(~refused).drop("reject_reason")
    refused = checked.where(refused).drop(*keys)
    linked = earlier_discovery(keyed, order, bucket)
    blocked = F.col("duplicate_of").isNotNull()
    if tracked is not None:
        role = role_sha256(F.col("title_hint"), F.col("company_hint"), F.col("location_hint"))
        asked = keyed.select(F.col("opp_id").alias("candidate_id"), "url_key", "text_key", role.alias("role_key"))
        found = tracked_classes(asked, key_classes(tracked, history))
        linked = linked.join(found.withColumnsRenamed({"candidate_id": "opp_id", "reason": "tracked_reason", "first_job_id": "tracked_job_id", "blocking": "tracked_blocks"}), "opp_id")
        blocked = blocked | F.col("tracked_blocks")
    judged = relevance(linked, preferences, on)
    return judged.withColumn("status", F.when(blocked, "duplicate").otherwise("new")), refused
