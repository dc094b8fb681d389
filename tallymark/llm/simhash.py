"""SimHash near-duplicates (operator 10): positional bytes in an inverted index, counted, then verified.

Two 64-bit fingerprints with at most two differing bits differ in at most two of their eight bytes, so they share at
least six positional bytes. A list for each single (position, byte) would hold 1/256 of all fingerprints at any size, and
the pairs that it makes would grow with the square. The index therefore posts four positional bytes at once: the eight
positions form four neighbours' pairs, and two differing bytes leave at least two of these pairs whole, so that one of
the six choices of two pairs is shared by every linked pair of fingerprints. Within a list the shared positional bytes
are tallied and pairs with six or more are verified by their bits.

A list with more than LONGEST fingerprints makes no pairs. There each fingerprint posts itself and its neighbours at one
flipped bit; two fingerprints are at most two bits apart exactly if they share such a point. That is linear in the list
and loses no link, so the limit only chooses between two exact ways.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .shared import fresh, whole, written

SEED, RADIUS, LEAST_SHARED, LONGEST = 42, 2, 6, 24


def fingerprint(text: str, words: int = 3) -> int:
    """The 64 majority bits of the shingles' XXH64 values, as an unsigned number."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly the six blanks
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(b" ".join(found), SEED)
    hashes = [digest(b" ".join(s), SEED) for s in zip(*(found[i:] for i in range(words)))]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """The fingerprints as signed 64-bit numbers."""
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64), pa.int64())


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes two fingerprints have in common."""
    other = a.bitwiseXOR(b)
    same = [(F.shiftright(other, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8)]
    return sum(same[1:], same[0])


def _near(a: Column, b: Column) -> Column:
    return (shared_bytes(a, b) >= LEAST_SHARED) & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)


def _masks() -> list[int]:
    """The positions of the six lists of a fingerprint, as signed 64-bit masks of four bytes."""
    pairs = [0xFFFF << (16 * i) for i in range(4)]
    return [m - (1 << 64) if (m := a | b) >> 63 else m for a, b in combinations(pairs, 2)]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a > b: links that connect every two of the distinct fingerprints `f` within the radius, directly or not.

    A short list gives its verified pairs, a long one a link from each fingerprint to the smallest at a common point.
    """
    masks = _masks()
    posts = distinct.select("f", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("list", "mask")).select(
        "f", "list", F.col("f").bitwiseAND(F.col("mask")).alias("bytes")
    )
    sizes = posts.groupBy("list", "bytes").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    posts = written(posts.join(sizes, ["list", "bytes"]), "posts")
    members = posts.where(F.col("size") <= LONGEST).groupBy("list", "bytes").agg(F.array_sort(F.collect_list("f")).alias("all"))
    pairs = F.flatten(
        F.transform(
            "all",
            lambda b, i: F.transform(
                F.filter(F.slice("all", i + 2, F.greatest(F.size("all") - i - 1, F.lit(0))), lambda a: _near(a, b)),
                lambda a: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )
    short = members.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    flips = F.array(F.lit(0), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)])
    points = posts.where(F.col("size") > LONGEST).select("f").distinct().select(
        "f", F.explode(flips).alias("flip")
    ).select("f", F.col("f").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("point").agg(F.min("f").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    long = points.join(least, "point").where("f > b").select(F.col("f").alias("a"), "b")
    return short.unionByName(long).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(f, root): the smallest member of the component of each fingerprint that has a link.

    Large and small stars in turn until nothing changes; every step is a map-side combined minimum and an equi join,
    written to the shared folder. Only two numbers per step reach the driver.
    """
    edges, before = written(edges, "edges"), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return edges.groupBy(F.col("a").alias("f")).agg(F.min("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("f"), F.col("b").alias("root")).distinct()
            )
        before = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")


def group(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero, which links like any other. Equal fingerprints are one node, so copies
    make no pairs; texts are read once and never shuffled. component_id is the smallest key of the component (null keys
    are passed over unless all are null). Repeated rows repeat in the result; an empty table gives none.
    """
    marked = written(rows.select(F.col(key).alias("doc_id"), fingerprints(whole(text)).alias("f")), "fingerprints")
    nodes = marked.groupBy("f").agg(F.min("doc_id").alias("first"))
    nodes = written(nodes, "nodes")
    roots = written(components(links(nodes.select("f"))), "roots")
    rooted = nodes.join(roots, "f", "left").select("f", "first", F.coalesce("root", "f").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("f", "component_id")
    return marked.join(named, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The rows with one document of each component: the one with the smallest key.

    All columns stay. Rows with a null key cannot be told apart by key and are kept.
    """
    named = group(rows.where(F.col(key).isNotNull()), key, text)
    drop = named.where("doc_id > component_id").select("doc_id").distinct()
    gone, = fresh(rows, "gone")
    return rows.join(drop.withColumnRenamed("doc_id", gone), F.col(key) == F.col(gone), "left_anti")
