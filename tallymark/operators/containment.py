"""Who contains whom, without comparing every text with every other (JOIN-03, JOIN-04, JOIN-21).

A contained text starts with a run of characters that also occurs in its
container, so that run is the join key. Every run of the container is emitted
once, which makes the block lossless; the real test follows on the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, size: int) -> Column:
    """All distinct overlapping runs of `size` characters, in one regex pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def contained_pairs(
    containers: DataFrame,
    contained: DataFrame,
    container_text: str,
    contained_text: str,
    sizes: tuple[int, ...] = (5,),
    on: tuple[str, ...] = (),
) -> DataFrame:
    """Pairs with contains(container_text, contained_text), one row per pair.

    `sizes` are the block lengths; a contained text is blocked on the longest
    one that fits, and one shorter than all of them is not looked for. Both
    inputs need one row per distinct text (and `on` key).
    """
    sizes = tuple(sorted(sizes))
    length = F.length(F.col(contained_text))
    key = F.when(F.lit(False), F.lit(""))
    for size in reversed(sizes):
        key = key.when(length >= size, F.substring(F.col(contained_text), 1, size))
    runs = F.concat(*[grams(F.col(container_text), size) for size in sizes])
    left = containers.withColumn("_gram", F.explode(runs))
    right = contained.withColumn("_gram", key).where(F.col("_gram").isNotNull())
    joined = left.join(right, [*on, "_gram"])
    return joined.where(F.contains(F.col(container_text), F.col(contained_text))).drop("_gram")


def piecewise_pairs(containers: DataFrame, contained: DataFrame, container_text: str, contained_text: str, piece: int) -> DataFrame:
    """Pairs with contains(container_text, contained_text), one row per pair of rows, for contained texts of 2 * piece - 1 or more.

    Containers are cut into pieces from their start; a contained text is looked up by each of its first `piece` runs. Of
    the places where a pair meets, only the first whole piece of the first occurrence counts.
    """
    pieces = F.regexp_extract_all(F.col(container_text), F.lit(f"(?s).{{{piece}}}"), F.lit(0))
    left = containers.select("*", F.posexplode(pieces).alias("_at", "_gram"))
    runs = F.transform(F.sequence(F.lit(0), F.lit(piece - 1)), lambda i: F.substring(F.col(contained_text), i + 1, F.lit(piece)))
    right = contained.select("*", F.posexplode(runs).alias("_off", "_gram"))
    first = F.instr(F.col(container_text), F.col(contained_text))
    joined = left.join(right, "_gram").where((first > 0) & (first - 1 + F.col("_off") == F.col("_at") * piece))
    return joined.drop("_gram", "_at", "_off")
