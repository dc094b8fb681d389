"""Registries of feed providers and listing verifiers (UDF-02, UDF-03): functions from table to table with a fixed contract.

A provider answers a search with opportunities, a verifier observes listings. Both are registered under a key and run by it;
what they return is brought to the contract's columns, and a row that breaks it comes back as a row with its category.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, strip
from ..operators.discovery import validity

OPPORTUNITY = (
    "external_id", "source_url", "title_hint", "company_hint", "location_hint", "employment_hint", "arrangement_hint",
    "industry_hint", "seniority_hint", "raw_text",
)
#: Columns of an observation with their values where a verifier does not give them.
OBSERVATION: dict[str, tuple[str, object]] = {
    "status": ("string", "needs_review"), "final_url": ("string", ""), "http_status_code": ("int", None), "detected_job_title": ("string", ""),
    "detected_company": ("string", ""), "detected_listing_status": ("string", "unverified"), "detected_deadline_status": ("string", "unknown"),
    "detected_deadline": ("date", None), "apply_action_found": ("boolean", None), "confidence": ("string", "unknown"),
    "review_status": ("string", "pending"), "evidence": ("string", ""),
}


@dataclass(frozen=True)
class Provider:
    key: str
    label: str
    version: str
    discover: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Verifier:
    version: str
    verify: Callable[[DataFrame], DataFrame]


_providers: dict[str, Provider] = {}
_verifiers: dict[str, Verifier] = {}


def register_provider(key: str, label: str, version: str, discover: Callable[[DataFrame], DataFrame]) -> Provider:
    """UDF-02: `discover` takes the search (see `search_query`) and returns rows with some or all OPPORTUNITY columns."""
    if not key.strip() or not version.strip():
        raise ValueError("a provider needs a key and a version")
    _providers[key] = Provider(key, label, version, discover)
    return _providers[key]


def register_verifier(version: str, verify: Callable[[DataFrame], DataFrame]) -> Verifier:
    """UDF-03: `verify` takes job_id, job_url, title, company and returns job_id with some or all OBSERVATION columns."""
    _verifiers[version] = Verifier(version, verify)
    return _verifiers[version]


def discover_with(key: str, search: DataFrame) -> DataFrame:
    """A provider's opportunities, each with its provider and, where it breaks the contract, a reject_reason (FLT-12)."""
    if key not in _providers:
        raise KeyError(f"provider {key!r} is not registered")
    provider = _providers[key]
    found = provider.discover(search)
    text = {c: strip(blank(F.col(c))) if c in found.columns else F.lit("") for c in OPPORTUNITY}
    rows = validity(found.select(*[c.alias(name) for name, c in text.items()]))
    return rows.withColumns({"provider": F.lit(provider.key), "provider_label": F.lit(provider.label), "provider_version": F.lit(provider.version)})


def verify_with(version: str, jobs: DataFrame) -> DataFrame:
    """One observation for each job; a job that the verifier gives none for, or that has no address, is an error row.

    error_category: input (no complete http address), no_observation, or null. Of several observations of a job the first
    by status counts.
    """
    if version not in _verifiers:
        raise KeyError(f"verifier {version!r} is not registered")
    url = strip(blank(F.col("job_url")))
    usable = url.rlike("^(?i)https?://[^/?#\\s]+")
    asked = jobs.select("job_id", "job_url", "title", "company", usable.alias("_usable"))
    found = _verifiers[version].verify(asked.where("_usable").drop("_usable"))
    columns = [_given(found, c, kind, value).alias(c) for c, (kind, value) in OBSERVATION.items()]
    seen = found.select("job_id", F.struct(*columns).alias("o")).groupBy("job_id").agg(F.min("o").alias("o"))
    rows = asked.join(seen, "job_id", "left")
    category = F.when(~F.col("_usable"), "input").when(F.col("o").isNull(), "no_observation")
    absent = {c: F.lit(value).cast(kind) for c, (kind, value) in OBSERVATION.items()}
    absent["status"] = F.lit("failed")
    return rows.select(
        "job_id", category.alias("error_category"), F.lit(version).alias("verifier_version"),
        *[F.when(category.isNull(), F.col(f"o.{c}")).otherwise(absent[c]).alias(c) for c in OBSERVATION],
    )


def _given(rows: DataFrame, name: str, kind: str, value) -> Column:
    default = F.lit(value).cast(kind)
    return F.coalesce(F.col(name).cast(kind), default) if name in rows.columns else default


def url_readiness(jobs: DataFrame) -> DataFrame:
    """A verifier that goes by the address alone and asks for a review."""
    return jobs.select("job_id", F.col("job_url").alias("final_url"), F.lit("low").alias("confidence"), F.lit("The address is complete; no page was read.").alias("evidence"))
