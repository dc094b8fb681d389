"""Best evidence per requirement (JOIN-03, SET-01).

The reference rule scans a profile's evidence in order: the first direct hit
ends the scan, otherwise a running best is replaced by strictly stronger related
hits. Here each kind of hit is its own equi join on a block key, the evidence is
brought down to one row per (profile, key) before it is joined, and the scan
order comes back as the position in the final aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, long_tokens, normalize_text
from .containment import contained_pairs
from .spread import settle, spread
from .vocabulary import Vocabulary, symmetric_relations, tag_with_table

CONTAINMENT_CHARS = 5
TOKEN_THRESHOLD = 0.60
TOKEN_CAP = 0.75
EXACT, SHARED_WORDS = "Exact vocabulary", "Shared technical vocabulary"
ROLE_POOL = "role"


class FixedTags:
    """Concepts from a `Vocabulary`; role concepts for the role pool, the others elsewhere."""

    def __init__(self, vocabulary: Vocabulary | None = None):
        self.vocabulary = vocabulary or Vocabulary()

    def tag(self, texts: DataFrame) -> DataFrame:
        v = self.vocabulary
        tags = v.concept_tags(F.col("norm"))
        if "pool" in texts.columns:
            tags = F.when(F.col("pool") == ROLE_POOL, v.concept_tags(F.col("norm"), role=True)).otherwise(tags)
        return texts.withColumn("concepts", tags)

    def relations(self, texts: DataFrame) -> DataFrame:
        spark = texts.sparkSession
        return self.vocabulary.relations_frame(spark, False).unionByName(
            self.vocabulary.relations_frame(spark, True)
        )

    def label(self, concept: Column) -> Column:
        return self.vocabulary.label(concept)


class TableTags:
    """Concepts and relations held as tables: aliases(concept, alias), relations(required, held, strength)."""

    def __init__(self, aliases: DataFrame, relations: DataFrame):
        self.aliases, self._relations = aliases, symmetric_relations(relations)

    def tag(self, texts: DataFrame) -> DataFrame:
        tags = tag_with_table(texts, "norm", self.aliases)
        # One row per distinct text; as many concepts as aliases fit into it.
        lists = tags.groupBy("norm").agg(F.sort_array(F.collect_set("concept")).alias("concepts"))
        return texts.join(lists, "norm", "left").withColumn(
            "concepts", F.coalesce("concepts", F.array().cast("array<string>"))
        )

    def relations(self, texts: DataFrame) -> DataFrame:
        return self._relations

    def label(self, concept: Column) -> Column:
        return concept


def _prefix(tokens: Column) -> Column:
    """Tokens two sets must share one of to reach the Jaccard threshold, long (rare) words first."""
    ordered = F.transform(
        F.array_sort(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))),
        lambda s: s["t"],
    )
    keep = F.size(tokens) - F.ceil(F.size(tokens) * TOKEN_THRESHOLD - F.lit(1e-9)).cast("int") + 1
    return F.slice(ordered, 1, F.greatest(keep, F.lit(1)))


def _similar_texts(needs: DataFrame, held: DataFrame, scope) -> DataFrame:
    """Text pairs with a token Jaccard of at least 0.60, by prefix filter."""
    left = needs.select(*scope, "norm", "tokens").distinct().where(F.size("tokens") > 0)
    right = held.select(*scope, F.col("norm").alias("held_norm"), F.col("tokens").alias("held_tokens"))
    right = right.distinct().where(F.size("held_tokens") > 0)
    pairs = left.withColumn("_t", F.explode(_prefix(F.col("tokens")))).join(
        right.withColumn("_t", F.explode(_prefix(F.col("held_tokens")))), [*scope, "_t"]
    )
    score = jaccard(F.col("tokens"), F.col("held_tokens"))
    return (
        pairs.select(*scope, "norm", "held_norm", score.alias("raw"))
        .where(F.col("raw") >= TOKEN_THRESHOLD)
        .distinct()
    )


def best_evidence(needs: DataFrame, evidence: DataFrame, tags=None, scope: tuple[str, ...] = ("pool",)) -> DataFrame:
    """Best match per (scope, requirement, profile_id); absent rows are missing matches.

    needs: scope..., requirement
    evidence: scope..., profile_id, position, evidence
    returns: scope..., requirement, profile_id, match_type, evidence, concept, strength
    """
    tags = tags or FixedTags()
    scope = list(scope)
    wanted = spread(needs.select(*scope, "requirement").distinct(), *scope, "requirement")
    wanted = tags.tag(wanted.withColumn("norm", normalize_text(F.col("requirement"))))
    wanted = settle(wanted.withColumn("tokens", long_tokens(F.col("norm"))))
    held = evidence.select(*scope, "profile_id", "position", "evidence")
    held = tags.tag(held.withColumn("norm", normalize_text(F.col("evidence"))))
    held = settle(held.withColumn("tokens", long_tokens(F.col("norm"))))

    pair = [*scope, "requirement", "profile_id"]
    first = F.min(F.struct("position", "evidence")).alias("first")
    by_text = held.groupBy(*scope, "profile_id", F.col("norm").alias("held_norm")).agg(first)
    held_concepts = held.withColumn("held", F.explode("concepts"))
    by_concept = held_concepts.groupBy(*scope, "profile_id", "held").agg(first)
    wanted_concepts = wanted.select(*scope, "requirement", F.explode("concepts").alias("concept"))

    # Direct: equal or contained text (kind 0), then a shared concept (kind 1).
    wanted_texts = wanted.select(*scope, "norm").distinct()
    held_texts = by_text.select(*scope, "held_norm").distinct()
    texts = (
        wanted_texts.where("norm != ''").join(
            held_texts.withColumn("norm", F.col("held_norm")), [*scope, "norm"]
        ).select(*scope, "norm", "held_norm")
        .unionByName(
            contained_pairs(wanted_texts, held_texts, "norm", "held_norm", (CONTAINMENT_CHARS,), tuple(scope))
            .select(*scope, "norm", "held_norm")
        )
        .unionByName(
            contained_pairs(held_texts, wanted_texts, "held_norm", "norm", (CONTAINMENT_CHARS,), tuple(scope))
            .select(*scope, "norm", "held_norm")
        )
        .distinct()
    )
    text_hits = (
        wanted.select(*scope, "requirement", "norm").join(texts, [*scope, "norm"])
        .join(by_text, [*scope, "held_norm"])
        .select(*pair, "first.position", F.lit(0).alias("kind"), F.lit("").alias("concept"), "first.evidence")
    )
    concept_hits = wanted_concepts.join(
        by_concept.withColumnRenamed("held", "concept"), [*scope, "concept"]
    ).select(*pair, "first.position", F.lit(1).alias("kind"), "concept", "first.evidence")
    direct = (
        text_hits.unionByName(concept_hits)
        .groupBy(*pair)
        .agg(F.min(F.struct("position", "kind", "concept", "evidence")).alias("hit"))
        .select(
            *pair,
            F.lit("direct").alias("match_type"),
            "hit.evidence",
            F.when(F.col("hit.kind") == 0, F.lit(EXACT)).otherwise(tags.label(F.col("hit.concept"))).alias("concept"),
            F.lit(1.0).alias("strength"),
        )
    )

    # Related: concept relations (kind 0) and common words (kind 1).
    related_concepts = wanted_concepts.join(
        tags.relations(needs).withColumnRenamed("required", "concept"), "concept"
    ).where("strength > 0")
    similar = wanted.select(*scope, "requirement", "norm").join(
        _similar_texts(wanted, held, scope), [*scope, "norm"]
    )

    def events(concept_rows: DataFrame, text_rows: DataFrame) -> DataFrame:
        relations = related_concepts.join(concept_rows, [*scope, "held"]).select(
            *pair, "position", F.lit(0).alias("kind"), "concept", "held",
            F.col("strength").alias("raw"), F.col("strength").alias("stored"), "evidence",
        )
        words = similar.join(text_rows, [*scope, "held_norm"]).select(
            *pair, "position", F.lit(1).alias("kind"), F.lit("").alias("concept"), F.lit("").alias("held"),
            "raw", F.least(F.lit(TOKEN_CAP), F.col("raw")).alias("stored"), "evidence",
        )
        return relations.unionByName(words).join(direct.select(*pair), pair, "left_anti")

    # With no word overlap above the cap the scan is a plain maximum, earliest first.
    opened = ["position", "evidence"]
    ranked = (
        events(
            by_concept.select(*scope, "profile_id", "held", *[f"first.{c}" for c in opened]),
            by_text.select(*scope, "profile_id", "held_norm", *[f"first.{c}" for c in opened]),
        )
        .groupBy(*pair)
        .agg(
            F.min(
                F.struct((-F.col("stored")).alias("weakness"), "position", "kind", "concept", "held", "evidence")
            ).alias("hit"),
            F.max(F.when(F.col("kind") == 1, F.col("raw"))).alias("words"),
        )
    )
    plain = ranked.where("words IS NULL OR words <= 0.75").select(
        *pair, (-F.col("hit.weakness")).alias("strength"), "hit.kind", "hit.concept", "hit.held", "hit.evidence"
    )

    # Above the cap a hit is stored lower than it was compared, so order matters: replay
    # the scan over that profile's own list.
    capped = ranked.where("words > 0.75").select(*pair)
    replay = (
        events(
            held_concepts.select(*scope, "profile_id", "held", "position", "evidence"),
            held.select(*scope, "profile_id", F.col("norm").alias("held_norm"), "position", "evidence"),
        )
        .join(capped, pair, "left_semi")
        .groupBy(*pair)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("position", "kind", "concept", "held", "raw", "stored", "evidence"))
            ).alias("scan")
        )
    )
    start = F.struct(
        F.lit(0.0).alias("strength"), F.lit(0).alias("kind"), F.lit("").alias("concept"),
        F.lit("").alias("held"), F.lit("").alias("evidence"),
    )
    final = F.aggregate(
        "scan",
        start,
        lambda best, x: F.when(
            x["raw"] > best["strength"],
            F.struct(x["stored"].alias("strength"), x["kind"], x["concept"], x["held"], x["evidence"]),
        ).otherwise(best),
    )
    replayed = replay.withColumn("hit", final).select(
        *pair, "hit.strength", "hit.kind", "hit.concept", "hit.held", "hit.evidence"
    )
    related = plain.unionByName(replayed).select(
        *pair,
        F.lit("related").alias("match_type"),
        "evidence",
        F.when(F.col("kind") == 1, F.lit(SHARED_WORDS))
        .otherwise(F.concat(tags.label(F.col("concept")), F.lit(" ↔ "), tags.label(F.col("held"))))
        .alias("concept"),
        "strength",
    )
    return direct.unionByName(related)


def pool(profiles: DataFrame, name: str, *lists: Column, scope: tuple[str, ...] = ()) -> DataFrame:
    """SET-01: one evidence pool from several lists of a profile, order kept."""
    parts = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])
    return profiles.select(
        *scope, F.lit(name).alias("pool"), "profile_id", F.posexplode(parts).alias("position", "evidence")
    )
