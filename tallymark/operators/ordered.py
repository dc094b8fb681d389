"""Per-key ordering that survives a hot key.

A plain window over a key puts every row of that key into one task. Here the key
is split by a second, order-preserving bucket (a day, an id range): the window
runs inside (key, bucket) and only one boundary row per bucket is looked at
across buckets. "Latest of a key" needs no window at all, an aggregate with
map-side combine does it. A rank over all rows is the place in a range partition
plus the rows of the partitions before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: A generated row id holds the partition above this bit and the place in the partition below it.
PLACE_BITS = 33


def _neighbour(df, keys, order, bucket, values, name, forward: bool) -> DataFrame:
    keys, order = list(keys), list(order)
    payload = F.struct(*[F.col(v) for v in values])
    rank = F.struct(*[F.col(o) for o in order])
    inner = W.partitionBy(*keys, "_bucket").orderBy(*order)
    outer = W.partitionBy(*keys).orderBy("_bucket")
    split = df.withColumn("_bucket", bucket)
    if forward:
        near, edge, far = F.lead(payload).over(inner), F.min_by(payload, rank), F.lead("_edge").over(outer)
    else:
        near, edge, far = F.lag(payload).over(inner), F.max_by(payload, rank), F.lag("_edge").over(outer)
    edges = (
        split.groupBy(*keys, "_bucket")
        .agg(edge.alias("_edge"))
        .select(*keys, "_bucket", far.alias("_far"))
    )
    return (
        split.withColumn("_near", near)
        .join(edges, [*keys, "_bucket"], "left")
        .withColumn(name, F.coalesce("_near", "_far"))
        .drop("_near", "_far", "_bucket")
    )


def previous_by_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, values: Sequence[str],
    name: str = "previous",
) -> DataFrame:
    """Struct of `values` of the row before, NULL for the first of a key.

    `bucket` must not decrease along `order`, and keys must not be NULL.
    """
    return _neighbour(df, keys, order, bucket, values, name, forward=False)


def next_by_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, values: Sequence[str],
    name: str = "following",
) -> DataFrame:
    """Struct of `values` of the row after, NULL for the last of a key."""
    return _neighbour(df, keys, order, bucket, values, name, forward=True)


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; combines before the shuffle."""
    return _edge_row(df, keys, order, F.max_by)


def earliest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; combines before the shuffle (WIN-06)."""
    return _edge_row(df, keys, order, F.min_by)


def _edge_row(df, keys, order, pick) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """WIN-10: best k rows per key. The rank filter is applied before the shuffle as well."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def global_rank(rows: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """The rows with their place 1, 2, 3... in `order` over all of them, without a task that sees them all.

    Rows are dealt out by ranges of `order`, sorted within each and written once to the shared folder; the partitions'
    counts (one number for each) then give what each place is moved by. Name columns in `order` until it leaves no ties
    that matter; rows equal in all of them share a range partition. A clashing column of the input is replaced.
    """
    spark = rows.sparkSession
    place = "_place"
    while place in {c.lower() for c in rows.columns}:
        place += "_"
    kept = [c for c in rows.columns if c.lower() != rank.lower()]
    path = f"{checkpoint_dir(spark).rstrip('/')}/rank-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias(place))
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    part = F.shiftright(F.col(place), PLACE_BITS)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row for each partition: the window below sees no more than that.
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    within = F.col(place).bitwiseAND((1 << PLACE_BITS) - 1)
    ranked = dealt.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return ranked.select(*[F.col(f"`{c}`") for c in kept], (within + F.col("_before") + 1).alias(rank))
