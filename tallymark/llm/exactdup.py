"""Exact duplicates (operator 8): two passes over a Bloom filter, only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, whole, written

#: Bits of one bitmap row, as the built-in bitmap functions lay them out.
ROW_BITS = 32_768
#: Bits for each row of the input, and the most bits of the filter (32 MB): the broadcast stays below that at any
#: size of the input. A fuller filter lets more rows through to the shuffle; the result is the same.
BITS_PER_ROW, MOST_BITS = 16, 1 << 28


def _slots(text: Column, bits: int) -> Column:
    """The two bit positions of a text."""
    return F.array(F.pmod(F.xxhash64(text), F.lit(bits)), F.pmod(F.xxhash64(F.lit(1), text), F.lit(bits)))


def _repeated_bits(rows: DataFrame, text: str, bits: int) -> DataFrame:
    """First pass: the filter of the bits that two rows or more have set, as (bucket, bitmap).

    A bit's rows are counted with a map-side combine, so that copies within a task leave it as one row of two numbers.
    """
    hit = rows.select(F.explode(_slots(whole(text), bits)).alias("slot")).groupBy("slot").count().where("count > 1")
    return hit.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    )


def _is_set(bitmap: Column, slot: Column) -> Column:
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))


def flag_repeats(rows: DataFrame, text: str, flag: str, bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """The rows with a boolean column: false means that no other row has this text.

    Rows go straight on: the filter is broadcast, its size has the fixed bound MOST_BITS.
    """
    count = max(1, rows.count())
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (count * bits_per_row - 1).bit_length()))
    bitmaps = _repeated_bits(rows, text, bits)
    first, second, a, b = fresh(rows, "slot_a", "slot_b", "map_a", "map_b")
    out = rows.withColumns({first: _slots(whole(text), bits)[0], second: _slots(whole(text), bits)[1]})
    for slot, bitmap in ((first, a), (second, b)):
        side = bitmaps.select(F.col("bucket").alias(f"{bitmap}_key"), F.col("bitmap").alias(bitmap))
        out = out.join(F.broadcast(side), F.bitmap_bucket_number(F.col(slot)) == F.col(f"{bitmap}_key"), "left")
        out = out.drop(f"{bitmap}_key")
    seen = _is_set(F.col(a), F.col(first)) & _is_set(F.col(b), F.col(second))
    return out.withColumn(flag, seen).drop(first, second, a, b)


def decide(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after no change; null counts as empty. Of equal texts the row with the largest key
    stays (a null key is the smallest); of repeated rows with that key one stays. Only key and digest of rows that the
    filter holds for possible repeats are shuffled; a hot digest is counted with a map-side combine, and its join back
    is an ordinary equi join that adaptive execution splits. No text is shuffled. An empty table gives no rows.
    """
    flag, = fresh(rows, "again")
    marked = flag_repeats(rows.select(key, text), text, flag).select(
        F.col(key).alias("doc_id"), F.sha2(whole(text), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"), F.col(flag).alias("again"),
    )
    marked = written(marked, "exact")
    single = marked.where("NOT again").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        "text_sha256",
    )
    again = marked.where("again")
    groups = again.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    # As a table of its own, so that the join below deals both sides out anew and adaptive execution can split a hot digest.
    groups = written(groups, "groups")
    found = again.join(groups, "text_sha256").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )
    return single.unionByName(found)


def keep_one(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The rows without later copies of a text: all columns, one row of each text, the one `decide` keeps.

    Rows whose text is not possibly repeated pass without a shuffle. Of the others the digest and key are ranked by an
    aggregate, and the winner is found again by an equi join on both; of fully repeated rows one stays.
    """
    flag, digest, best, order = fresh(rows, "again", "digest", "best", "row")
    marked = flag_repeats(rows, text, flag)
    single = marked.where(~F.col(flag)).drop(flag)
    again = marked.where(F.col(flag)).drop(flag).withColumn(digest, F.sha2(whole(text), 256))
    # The whole row stands for ties: two rows that differ in no column are one row for this choice.
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    again = again.withColumn(order, tie)
    winners = again.groupBy(digest).agg(F.max(F.struct(F.col(key), F.col(order))).alias(best))
    winners = written(winners, "winners")
    kept = again.join(winners, digest).where(
        F.col(f"`{key}`").eqNullSafe(F.col(f"{best}.{key}")) & (F.col(order) == F.col(f"{best}.{order}"))
    )
    return single.unionByName(kept.dropDuplicates([digest]).select(*rows.columns))
