"""Claims, profile snapshots and overlays (WIN-04..08, WIN-13, JOIN-18, JOIN-23, JOIN-24, AGG-17..19, UDTF-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, first_seen, split_lines, squeeze, with_value
from .ordered import earliest_by_key, latest_by_key, next_by_key

SCALARS = (
    "identity.full_name", "identity.email", "identity.phone", "identity.location", "profile.professional_summary",
)
ENTRIES = {
    "profile.education": "education", "profile.experience": "experience", "profile.projects": "projects",
    "profile.certifications": "certifications", "profile.leadership": "leadership",
}
LISTS = {"identity.links": "links", "profile.skills": "skills"}


def supersede(claims: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], bucket: Column, at: str) -> DataFrame:
    """WIN-04: each claim is active until a newer one with the same key was approved."""
    linked = next_by_key(claims, keys, order, bucket, [at], "following")
    return linked.withColumns(
        {"superseded_at": F.col(f"following.{at}"), "is_active": F.col("following").isNull()}
    ).drop("following")


def identity_key(path: Column, claim_key: Column, semantic_key: Column) -> Column:
    """WIN-05: a scalar is its path, an entry its slot, a list item its meaning."""
    return (
        F.when(path.isin(*SCALARS), F.concat(F.lit("scalar|"), path))
        .when(path.isin(*ENTRIES), F.concat(F.lit("entry|"), claim_key))
        .otherwise(F.concat(F.lit("list|"), semantic_key))
    )


def last_claims(claims: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """WIN-05: the last claim of each key, and how many older ones were collapsed per profile."""
    last = latest_by_key(claims, keys, order)
    collapsed = (
        claims.groupBy(*keys).agg((F.count("*") - 1).alias("n")).groupBy(keys[0]).agg(F.sum("n").alias("collapsed"))
    )
    return last, collapsed


def distinct_values(rows: DataFrame, keys: tuple[str, ...], value: str, order: tuple[str, ...]) -> DataFrame:
    """WIN-06: first row of each normalised value."""
    keyed = rows.withColumn("_value", F.lower(squeeze(F.col(value))))
    return earliest_by_key(keyed, [*keys, "_value"], order).drop("_value")


def compose_profiles(claims: DataFrame) -> DataFrame:
    """AGG-19: one nested profile per profile_id from its active claims.

    claims: profile_id, claim_id, claim_key, field_path, section, semantic_key, approved_at,
    text, heading, subheading, dates, details. Claims are brought down to one per identity
    and value before they are gathered, so a profile's arrays hold its distinct values only.
    """
    keyed = claims.withColumn("_identity", identity_key(F.col("field_path"), F.col("claim_key"), F.col("semantic_key")))
    last, collapsed = last_claims(keyed, ("profile_id", "_identity"), ("approved_at", "claim_id"))
    path = F.col("field_path")
    # An e-mail field may hold several addresses; each counts as a value of its own.
    pieces = F.when(
        path == "identity.email", F.filter(F.transform(F.split("text", "[|\\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    ).otherwise(F.array(F.trim(blank(F.col("text")))))
    values = last.withColumn("_value", F.explode(pieces))
    entry = F.to_json(F.struct("heading", "subheading", "dates", "details"))
    normal = F.lower(F.when(path.isin(*ENTRIES), entry).otherwise(F.col("_value")))
    order = ("section", "field_path", "approved_at", "claim_id")
    distinct = earliest_by_key(
        values.withColumns({"_normal": normal}), ["profile_id", "field_path", "_normal"], order
    ).where((F.col("_value") != "") | path.isin(*ENTRIES))
    rank = F.struct(*order, F.col("_normal")).alias("rank")

    def gather(p: str, value: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(path == p, F.struct(rank, value.alias("value")))))
        return F.transform(rows, lambda r: r["value"])

    scalar = lambda p: F.coalesce(F.max_by(F.when(path == p, F.col("_value")), F.when(path == p, F.struct("approved_at", "claim_id"))), F.lit(""))
    whole = F.struct(*[blank(F.col(c)).alias(c) for c in ("heading", "subheading", "dates")], "details")
    composed = distinct.groupBy("profile_id").agg(
        F.struct(
            scalar("identity.full_name").alias("full_name"),
            gather("identity.email", F.col("_value")).alias("emails"),
            scalar("identity.phone").alias("phone"),
            scalar("identity.location").alias("location"),
            gather("identity.links", F.col("_value")).alias("links"),
        ).alias("identity"),
        F.struct(
            scalar("profile.professional_summary").alias("professional_summary"),
            *[gather(p, whole).alias(name) for p, name in ENTRIES.items()],
            gather("profile.skills", F.col("_value")).alias("skills"),
        ).alias("profile"),
        F.count_distinct("claim_id").alias("source_claims"),
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("collapsed") > 0, "older_claims_collapsed"),
            F.when(F.col("identity.full_name") == "", "no_full_name"),
            F.when(F.size("profile.education") == 0, "no_education"),
            F.when(F.size("profile.skills") == 0, "no_skills"),
            F.when(F.size("profile.experience") == 0, "no_experience"),
        )
    )
    return (
        composed.join(collapsed, "profile_id")
        .withColumn("warnings", warnings)
        .withColumn("fingerprint", F.sha2(F.to_json(F.struct("identity", "profile")), 256))
    )


def next_versions(composed: DataFrame, snapshots: DataFrame) -> DataFrame:
    """AGG-18: new snapshots with the next version; known fingerprints are reused, not written again."""
    fresh = composed.join(snapshots.select("profile_id", "fingerprint"), ["profile_id", "fingerprint"], "left_anti")
    newest = snapshots.groupBy("profile_id").agg(F.max("version").alias("_v"))
    return (
        fresh.join(newest, "profile_id", "left")
        .withColumn("version", (F.coalesce("_v", F.lit(0)) + 1).cast("int"))
        .withColumn("status", F.lit("draft"))
        .drop("_v")
    )


def snapshot_lineage(snapshots: DataFrame, used: str = "claims") -> DataFrame:
    """JOIN-24: one row per claim a snapshot was made from, with its position."""
    return snapshots.select("profile_id", "version", F.posexplode(used).alias("position", "claim")).select(
        "profile_id", "version", "position", "claim.*"
    )


def snapshot_status(snapshots: DataFrame, activations: DataFrame) -> DataFrame:
    """WIN-07: the snapshot activated last is active, earlier ones are archived, the rest are drafts."""
    last = activations.groupBy("profile_id").agg(
        F.max_by("version", F.struct("activated_at", "version")).alias("_active")
    )
    ever = activations.groupBy("profile_id", "version").agg(F.max("activated_at").alias("activated_at"))
    status = (
        F.when(F.col("version") == F.col("_active"), "active")
        .when(F.col("activated_at").isNotNull(), "archived")
        .otherwise("draft")
    )
    return (
        snapshots.join(ever, ["profile_id", "version"], "left").join(last, "profile_id", "left")
        .withColumn("status", status).drop("_active")
    )


def stale_reviews(reviews: DataFrame, order: tuple[str, ...], bucket: Column) -> DataFrame:
    """WIN-08: an open review goes stale once a newer one exists or its source text changed."""
    linked = next_by_key(reviews, ["profile_id"], order, bucket, [order[-1]], "following")
    stale = F.col("status").isin("pending", "in_review") & (
        F.col("following").isNotNull() | (F.col("source_sha") != F.col("source_sha_now"))
    )
    return linked.withColumn("status", F.when(stale, "stale").otherwise(F.col("status"))).drop("following")


def active_documents(documents: DataFrame) -> DataFrame:
    """WIN-13: one row per (profile, text); the last activated one is active, else the first uploaded.

    documents: profile_id, document_id, sha, uploaded_at, activated_at (NULL when never)
    """
    unique = earliest_by_key(documents, ["profile_id", "sha"], ["uploaded_at", "document_id"])
    chosen = unique.groupBy("profile_id").agg(
        F.coalesce(
            F.max_by("document_id", F.when(F.col("activated_at").isNotNull(), F.struct("activated_at", "document_id"))),
            F.min_by("document_id", F.struct("uploaded_at", "document_id")),
        ).alias("_active")
    )
    return unique.join(chosen, "profile_id").withColumn("is_active", F.col("document_id") == F.col("_active")).drop("_active")


def decision_counts(claims: DataFrame, key: str = "review_id") -> DataFrame:
    """AGG-17."""
    return (
        claims.groupBy(key).pivot("decision", ["pending", "approved", "rejected"]).count().na.fill(0)
    )


# ---------------------------------------------------------------- extraction to claims
CLAIM = "struct<claim_key:string,field_path:string,section:string,claim_type:string,position:int,text:string," \
        "heading:string,subheading:string,dates:string,details:array<string>,fallback:string>"


def extraction_claims(extractions: DataFrame) -> DataFrame:
    """UDTF-01: claims of an extraction as rows.

    extractions: review_id, identity struct, profile struct as produced by the resume plan.
    """
    none = F.array().cast("array<string>")
    no_entry = [F.lit("").alias("heading"), F.lit("").alias("subheading"), F.lit("").alias("dates"), none.alias("details")]

    def claim(key, path, section, kind, position, text=None, entry=None) -> Column:
        what = [
            key.alias("claim_key"), F.lit(path).alias("field_path"), F.lit(section).alias("section"),
            F.lit(kind).alias("claim_type"), position.cast("int").alias("position"),
        ]
        if entry is None:
            return with_value(squeeze(text), lambda v: F.struct(*what, v.alias("text"), *no_entry, v.alias("fallback")))
        names = ("heading", "subheading", "dates")
        details = F.filter(F.transform(entry["details"], squeeze), lambda x: x != "")
        spoken = lambda e: F.array_join(F.filter(F.concat(F.array(*[e[n] for n in names]), e["details"]), lambda x: x != ""), "\n")
        tidy = F.struct(*[squeeze(entry[n]).alias(n) for n in names], details.alias("details"))
        return with_value(
            tidy,
            lambda e: F.struct(*what, F.lit("").alias("text"), *[e[n].alias(n) for n in (*names, "details")], spoken(e).alias("fallback")),
        )

    parts = [
        F.array(claim(F.lit(f"identity.{name}"), f"identity.{name}", "identity", "scalar", F.lit(i), F.col(f"identity.{name}")))
        for i, name in enumerate(("full_name", "email", "phone", "location"))
    ]
    parts.append(
        F.transform(
            "identity.links",
            lambda x, i: claim(F.concat(F.lit("identity.links."), i.cast("string")), "identity.links", "identity", "list_item", i + 10, x),
        )
    )
    parts.append(
        F.array(claim(F.lit("profile.professional_summary"), "profile.professional_summary", "summary", "scalar", F.lit(0), F.col("profile.professional_summary")))
    )

    def entry_claims(path: str, name: str) -> Column:
        slot = lambda i: F.concat(F.lit(path + "."), i.cast("string"))
        return F.transform(path, lambda e, i: claim(slot(i), path, name, "entry", i, entry=e))

    parts += [entry_claims(path, name) for path, name in ENTRIES.items()]
    parts.append(
        F.transform(
            "profile.skills",
            lambda x, i: claim(F.concat(F.lit("profile.skills."), i.cast("string")), "profile.skills", "skills", "list_item", i, x),
        )
    )
    rows = extractions.select("review_id", F.explode(F.concat(*parts)).alias("c")).select("review_id", "c.*")
    return rows.where("fallback <> ''")


def pair_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """JOIN-18: the k-th claim of a field takes its k-th evidence; list items share the first.

    claims: review_id, field_path, claim_type, position, fallback; evidence: review_id,
    field_path, position, source_text, note. Ranks are within one review's field.
    """
    from pyspark.sql import Window as W

    turn = F.row_number().over(W.partitionBy("review_id", "field_path").orderBy("position"))
    ranked = claims.withColumn("_k", F.when(F.col("claim_type") == "list_item", F.lit(1)).otherwise(turn))
    queue = evidence.withColumn("_k", turn).select("review_id", "field_path", "_k", "source_text", "note")
    return (
        ranked.join(queue, ["review_id", "field_path", "_k"], "left")
        .withColumn("source_text", F.when(blank(F.col("source_text")) != "", F.col("source_text")).otherwise(F.col("fallback")))
        .withColumn("note", blank(F.col("note")))
        .drop("_k")
    )


# ---------------------------------------------------------------- JOIN-23
def render_entry(entry: Column) -> Column:
    parts = F.concat(F.array(entry["heading"], entry["subheading"], entry["dates"]), entry["details"])
    return F.array_join(F.filter(F.transform(parts, squeeze), lambda x: x != ""), "; ")


def merge_lines(*groups: Column) -> Column:
    """Groups one after the other, trimmed, repeats dropped in any case."""
    empty = F.array().cast("array<string>")
    lines = F.concat(*[F.coalesce(g, empty) for g in groups])
    return first_seen(F.filter(F.transform(lines, squeeze), lambda x: x != ""))


def effective_profiles(manual: DataFrame, snapshots: DataFrame) -> DataFrame:
    """JOIN-23: manual profiles with their active snapshot laid over them.

    Snapshot values come first and manual lines after; a blank scalar falls back.
    """
    active = snapshots.where("status = 'active'").select("profile_id", "identity", "profile")
    rows = manual.join(active, "profile_id", "left")
    has = F.col("profile").isNotNull()
    entries = lambda name: F.transform(F.col(f"profile.{name}"), render_entry)
    one = F.when(F.trim(blank(F.col("profile.professional_summary"))) != "", split_lines(F.col("profile.professional_summary")))
    context = merge_lines(
        one, *[entries(n) for n in ("experience", "projects", "certifications", "leadership")],
        split_lines(F.col("additional_context")),
    )
    return rows.withColumns(
        {
            "full_name": F.when(has & (blank(F.col("identity.full_name")) != ""), F.col("identity.full_name")).otherwise(F.col("full_name")),
            "skills": F.when(has, merge_lines(F.col("profile.skills"), F.col("skills"))).otherwise(F.col("skills")),
            "education_summary": F.when(
                has, F.array_join(merge_lines(entries("education"), split_lines(F.col("education_summary"))), "\n")
            ).otherwise(F.col("education_summary")),
            "additional_context": F.when(has, F.array_join(context, "\n")).otherwise(F.col("additional_context")),
        }
    ).drop("identity", "profile")
