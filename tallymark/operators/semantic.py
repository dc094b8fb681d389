"""Capped similarity for what is still missing (JOIN-07, JOIN-08, FN-12..14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import FAMILY_THRESHOLD, content_tokens, feature_terms, semantic_strength
from ..functions.text import normalize_text
from .spread import fence, settle, spread
from .vocabulary import Vocabulary


def text_vectors(texts: DataFrame, column: str, vocabulary: Vocabulary, scope=()) -> DataFrame:
    """Distinct texts with their sparse vector (map), norm and phrase families."""
    base = spread(texts.select(*scope, column).distinct(), *scope, column).withColumn("_n", normalize_text(F.col(column)))
    base = base.withColumn("families", vocabulary.family_tags(F.col("_n")))
    base = base.withColumn("_t", content_tokens(F.col("_n")))
    occurrences = base.withColumn("_f", feature_terms(F.col("_t"), F.col("families")))
    terms = F.array_distinct(F.transform("_f", lambda f: f["term"]))
    weights = F.transform(
        terms,
        lambda t: F.aggregate(
            F.filter("_f", lambda f: f["term"] == t), F.lit(0.0), lambda total, f: total + f["weight"]
        ),
    )
    vectors = occurrences.withColumn("vector", F.map_from_arrays(terms, weights))
    norm = F.sqrt(F.aggregate(F.map_values("vector"), F.lit(0.0), lambda total, w: total + w * w))
    return vectors.withColumn("norm", norm).select(*scope, column, "vector", "norm", "families")


def _indexed_terms(vectors: DataFrame, column: str, frequency: DataFrame, scope) -> DataFrame:
    """Terms of which a partner must share one to reach the lower threshold.

    Rare terms come first; once the rest of the vector cannot reach the threshold
    on its own, it need not be looked up. The windows are over one text's terms.
    """
    terms = vectors.select(*scope, column, "norm", F.explode("vector").alias("term", "weight"))
    terms = terms.join(frequency, [*scope, "term"])
    rest = (
        W.partitionBy(*scope, column)
        .orderBy("df", "term")
        .rowsBetween(W.currentRow, W.unboundedFollowing)
    )
    left_over = F.sum(F.col("weight") * F.col("weight")).over(rest)
    return (
        terms.withColumn("_rest", left_over)
        .where(F.col("_rest") >= F.lit(FAMILY_THRESHOLD**2 - 1e-9) * F.col("norm") * F.col("norm"))
        .select(*scope, column, "term")
    )


def similar_texts(
    needs: DataFrame, evidence: DataFrame, vocabulary: Vocabulary | None = None, scope: tuple[str, ...] = ("pool",)
) -> DataFrame:
    """Text pairs above the threshold: scope..., requirement, evidence, similarity, strength, families."""
    vocabulary = vocabulary or Vocabulary()
    scope = list(scope)
    left = settle(text_vectors(needs, "requirement", vocabulary, scope))
    right = settle(text_vectors(evidence, "evidence", vocabulary, scope))
    right_terms = right.select(*scope, "evidence", F.explode(F.map_keys("vector")).alias("term"))
    frequency = right_terms.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    candidates = (
        _indexed_terms(left, "requirement", frequency, scope)
        .join(right_terms, [*scope, "term"])
        .select(*scope, "requirement", "evidence")
        .distinct()
    )
    paired = candidates.join(left, [*scope, "requirement"]).join(
        right.select(
            *scope, "evidence", F.col("vector").alias("v2"), F.col("norm").alias("n2"), F.col("families").alias("f2")
        ),
        [*scope, "evidence"],
    )
    paired = spread(paired, *scope, "requirement", "evidence")
    dot = F.aggregate(
        F.map_entries("vector"),
        F.lit(0.0),
        lambda total, e: total + e["value"] * F.coalesce(F.try_element_at("v2", e["key"]), F.lit(0.0)),
    )
    shared = F.array_intersect("families", "f2")
    scored = paired.select(
        *scope, "requirement", "evidence", (dot / (F.col("norm") * F.col("n2"))).alias("similarity"),
        shared.alias("shared"),
    )
    labels = F.sort_array(F.transform("shared", vocabulary.family_label))
    return (
        fence(scored, "text_pairs_compared").withColumn("strength", semantic_strength(F.col("similarity"), F.size("shared") > 0))
        .where(F.col("strength").isNotNull())
        .select(*scope, "requirement", "evidence", "similarity", "strength", labels.alias("families"))
    )


def best_semantic(
    gaps: DataFrame, evidence: DataFrame, vocabulary: Vocabulary | None = None, scope: tuple[str, ...] = ("pool",)
) -> DataFrame:
    """JOIN-08: strongest evidence per (scope, requirement, profile_id) among `gaps`, first wins ties."""
    # Likeness does not depend on the scope, so each pair of distinct texts is compared once.
    pairs = similar_texts(gaps, evidence, vocabulary, ())
    first = evidence.groupBy(*scope, "profile_id", "evidence").agg(F.min("position").alias("position"))
    keys = [*scope, "requirement", "profile_id"]
    hits = gaps.select(*keys).distinct().join(pairs, "requirement").join(first, [*scope, "profile_id", "evidence"])
    best = F.min(
        F.struct(
            (-F.col("strength")).alias("weakness"), "position", "evidence", "similarity", "families", "strength"
        )
    )
    explanation = F.concat(
        F.lit("Controlled semantic similarity ("),
        F.format_string("%.2f", F.col("hit.similarity")),
        F.lit(")"),
        F.when(F.size("hit.families") > 0, F.concat(F.lit(" via "), F.array_join("hit.families", ", "))).otherwise(""),
    )
    return (
        hits.groupBy(*keys)
        .agg(best.alias("hit"))
        .select(*keys, "hit.evidence", explanation.alias("concept"), "hit.strength", "hit.similarity")
    )
