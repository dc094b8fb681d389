"""Feed payloads and their allow list (SRC-04, SRC-06, SRC-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import html_to_text
from ..functions.text import split_lines
from ..operators.ordered import top_k

NAMED = "array<struct<name:string>>"
TOKEN = "^[A-Za-z0-9_-]+$"


def approved_boards(config: DataFrame, limit: int | None = None) -> DataFrame:
    """SRC-06: enabled boards in their order, all or the first `limit`; a bad token or a repeated key or token is an error.

    config: position, key, label, token, industry, enabled. It is a hand-kept list.
    """
    on = config.where(F.coalesce("enabled", F.lit(True)))
    blankish = (F.trim("key") == "") | (F.trim("label") == "") | (F.trim("token") == "")
    again = lambda c: on.groupBy(c.alias("_id")).count().where("count > 1").select("_id")
    same_key = on.join(again(F.col("key")), F.col("key") == F.col("_id"), "left_semi")
    same_token = on.join(again(F.lower("token")), F.lower("token") == F.col("_id"), "left_semi")
    bad = on.where(blankish | ~F.col("token").rlike(TOKEN)).unionByName(same_key).unionByName(same_token).limit(1).collect()
    if bad:
        raise ValueError(f"board list is not usable at key {bad[0]['key']!r}")
    return on if limit is None else on.orderBy("position").limit(limit)


def flatten_feed(feed: DataFrame, boards: DataFrame, per_source: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-04: listings of each payload, all or the newest `per_source` a run and source; the full id set; and what was refused.

    feed: run_id, source_key, status, payload, ts; a run may have several payloads (pages) of a source. A payload is parsed
    once as a variant and its jobs are exploded from that, so that no typed array of all of them is built. The ids are taken
    before the cut, so a listing beyond it is not mistaken for one that disappeared. Refused: run_id, source_key, ts,
    position (null for a whole payload) and reason: failed, board_not_approved, not_json, no_jobs, incomplete.
    """
    named = boards.select(F.col("key").alias("source_key"), "label", "industry")
    parsed = feed.join(named, "source_key", "left").withColumn("_v", F.try_parse_json("payload"))
    parsed = parsed.withColumn("_jobs", F.try_variant_get("_v", "$.jobs", "variant"))
    reason = (
        F.when(F.col("status") != "success", "failed").when(F.col("label").isNull(), "board_not_approved")
        .when(F.col("_v").isNull(), "not_json").when(~F.coalesce(F.schema_of_variant("_jobs"), F.lit("")).startswith("ARRAY"), "no_jobs")
    )
    parsed = parsed.withColumn("reason", reason)
    whole = parsed.where(F.col("reason").isNotNull()).select("run_id", "source_key", "ts", F.lit(None).cast("int").alias("position"), "reason")
    tables = feed.sparkSession.tvf
    jobs = parsed.where(F.col("reason").isNull()).select("run_id", "source_key", "label", "industry", "ts", "_jobs").lateralJoin(
        tables.variant_explode(F.col("_jobs").outer())
    )
    at = lambda path, kind="string": F.try_variant_get("value", f"$.{path}", kind)
    trimmed = lambda path: F.trim(F.coalesce(at(path), F.lit("")))
    rows = jobs.select(
        "run_id", "source_key", "label", "industry", "ts", F.col("pos").alias("position"),
        F.concat_ws(":", "source_key", trimmed("id")).alias("external_id"), trimmed("title").alias("title_hint"), trimmed("absolute_url").alias("source_url"),
        F.coalesce(at("updated_at"), F.lit("")).alias("updated_at"), trimmed("location.name").alias("location_hint"),
        at("content").alias("content"), _names(at("departments", NAMED)).alias("departments"), _names(at("offices", NAMED)).alias("offices"),
    )
    complete = (F.col("title_hint") != "") & (F.col("source_url") != "") & ~F.col("external_id").endswith(":")
    refused = whole.unionByName(rows.where(~complete).select("run_id", "source_key", "ts", "position", F.lit("incomplete").alias("reason")))
    kept = rows.where(complete)
    if per_source is not None:
        kept = top_k(kept, ["run_id", "source_key"], [F.desc("updated_at"), F.desc("external_id")], per_source)
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    header = F.concat_ws(
        "\n", "title_hint", "label", F.when(F.col("location_hint") != "", F.col("location_hint")),
        listed("Departments: ", "departments"), listed("Offices: ", "offices"),
    )
    body = html_to_text(F.coalesce("content", F.lit("")))
    text = F.when(body != "", F.concat(header, F.lit("\n\n"), body)).otherwise(header)
    return (
        kept.withColumns({"company_hint": F.col("label"), "industry_hint": F.col("industry"), "raw_text": text}),
        rows.select("run_id", "source_key", "external_id", "ts"),
        refused,
    )


def _names(named: Column) -> Column:
    names = F.transform(F.coalesce(named, F.array().cast(NAMED)), lambda x: F.trim(x["name"]))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def search_query(profiles: DataFrame) -> DataFrame:
    """SRC-08: preferences as arrays from line lists."""
    lists = ("target_roles", "target_industries", "preferred_locations")
    return profiles.withColumns({c: split_lines(F.col(c)) for c in lists})
