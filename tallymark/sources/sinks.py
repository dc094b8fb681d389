"""Writers (SNK-01, SNK-03) and the guarded batch upsert (SRC-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_history(rows: DataFrame, path: str, run_date: str | None = None) -> None:
    """SNK-01: add the rows of a run, or of several with their own run_date, to an append-only history, one folder per run date."""
    rows = rows if run_date is None else rows.withColumn("run_date", F.lit(run_date))
    rows.write.mode("append").partitionBy("run_date").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """SNK-03."""
    rows.write.mode("overwrite").json(path)


def upsert_batch(
    target: DataFrame, batch: DataFrame, source: str, refresh: bool, key: str = "job_url"
) -> tuple[DataFrame, DataFrame]:
    """SRC-02: merge a curated batch by URL; rows of another source are left alone.

    Returns the new snapshot and one row per action (created, refreshed, unchanged,
    skipped) with its count. A key must occur once in the batch.
    """
    columns = [c for c in target.columns if c != key]
    t = target.select(key, F.struct(*columns).alias("t"))
    b = batch.withColumn("source", F.lit(source)).select(
        key, F.struct(*[c if c in batch.columns or c == "source" else F.lit(None).alias(c) for c in columns]).alias("b")
    )
    merged = t.join(b, key, "full_outer")
    action = (
        F.when(F.col("b").isNull(), "kept")
        .when(F.col("t").isNull(), "created")
        .when(F.col("t.source") != source, "skipped")
        .otherwise("refreshed" if refresh else "unchanged")
    )
    merged = merged.withColumn("action", action)
    take_batch = F.col("action").isin("created", "refreshed")
    snapshot = merged.select(
        key, *[F.when(take_batch, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns]
    )
    counts = merged.where("action <> 'kept'").groupBy("action").agg(F.count("*").alias("rows"))
    return snapshot, counts
