"""The ordered scan of JOIN-03 and JOIN-08 over one profile's own list, as expressions.

A profile's evidence is an array of its row, so a requirement text needs one join
with the profiles of its scope and no further shuffle: everything about a piece of
evidence is worked out once on the profile side, and the scan is a fold over the
array. `operators.evidence` is the join form for evidence held in large tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import content_tokens, feature_terms, semantic_strength
from ..functions.text import constant_map, jaccard, long_tokens, normalize_text
from .evidence import CONTAINMENT_CHARS, EXACT, SHARED_WORDS, TOKEN_CAP, TOKEN_THRESHOLD
from .vocabulary import Vocabulary


def _reach(concepts: Column, vocabulary: Vocabulary) -> Column:
    """What a set of held concepts is related to: array<struct<required, strength, held>>."""
    packed: dict[str, list[str]] = {}
    for required, held, strength in [*vocabulary.relation_rows(False), *vocabulary.relation_rows(True)]:
        packed.setdefault(held, []).append(f"{required}={strength}")
    table = constant_map({held: ",".join(rows) for held, rows in packed.items()} or {"": ""})
    related = F.transform(
        concepts,
        lambda held: F.transform(
            F.split(F.coalesce(F.try_element_at(table, held), F.lit("")), ","),
            lambda item: F.struct(
                F.split_part(item, F.lit("="), F.lit(1)).alias("required"),
                F.coalesce(F.split_part(item, F.lit("="), F.lit(2)).try_cast("double"), F.lit(0.0)).alias("strength"),
                held.alias("held"),
            ),
        ),
    )
    return F.filter(F.flatten(related), lambda x: x["strength"] > 0)


def text_features(texts: Column, vocabulary: Vocabulary, role: Column) -> Column:
    """array<struct<text, norm, concepts, tokens, reach>> of a list of texts."""
    norms = F.transform(texts, lambda t: F.struct(t.alias("text"), normalize_text(t).alias("norm")))
    tags = lambda norm: F.when(role, vocabulary.concept_tags(norm, True)).otherwise(vocabulary.concept_tags(norm))
    tagged = F.transform(norms, lambda x: F.struct(x["text"], x["norm"], tags(x["norm"]).alias("concepts")))
    return F.transform(
        tagged,
        lambda x: F.struct(
            x["text"], x["norm"], x["concepts"], long_tokens(x["norm"]).alias("tokens"),
            _reach(x["concepts"], vocabulary).alias("reach"),
        ),
    )


def vector_features(texts: Column, vocabulary: Vocabulary) -> Column:
    """array<struct<text, terms, families, norm>>: sparse vectors as arrays of (term, weight)."""

    def summed(terms: Column) -> Column:
        names = F.array_distinct(F.transform(terms, lambda f: f["term"]))
        return F.transform(
            names,
            lambda n: F.struct(
                n.alias("term"),
                F.aggregate(
                    F.filter(terms, lambda f: f["term"] == n), F.lit(0.0), lambda s, f: s + f["weight"]
                ).alias("weight"),
            ),
        )

    step = F.transform(texts, lambda t: F.struct(t.alias("text"), normalize_text(t).alias("norm")))
    step = F.transform(
        step,
        lambda x: F.struct(
            x["text"], content_tokens(x["norm"]).alias("tokens"), vocabulary.family_tags(x["norm"]).alias("families")
        ),
    )
    step = F.transform(
        step, lambda x: F.struct(x["text"], x["families"], feature_terms(x["tokens"], x["families"]).alias("all"))
    )
    step = F.transform(step, lambda x: F.struct(x["text"], x["families"], summed(x["all"]).alias("terms")))
    return F.transform(
        step,
        lambda x: F.struct(
            x["text"], x["families"], x["terms"],
            F.transform(x["terms"], lambda t: t["term"]).alias("names"),
            F.transform(x["terms"], lambda t: t["weight"]).alias("weights"),
            F.sqrt(F.aggregate(x["terms"], F.lit(0.0), lambda s, f: s + f["weight"] * f["weight"])).alias("norm"),
        ),
    )


def with_scan(rows: DataFrame, need: str, held: str, vocabulary: Vocabulary, out: str) -> DataFrame:
    """JOIN-03: add struct<match_type, evidence, concept, strength> of a need against a list, both featured.

    Built in steps, so that each costly part is worked out once per row.
    """
    n, norm = F.col(need), F.col(f"{need}.norm")
    length = F.length(norm)

    def same_text(e: Column) -> Column:
        return (norm != "") & (
            (norm == e["norm"])
            | ((length >= CONTAINMENT_CHARS) & F.contains(e["norm"], norm))
            | ((F.length(e["norm"]) >= CONTAINMENT_CHARS) & F.contains(norm, e["norm"]))
        )

    first = F.get(F.filter(held, lambda e: same_text(e) | F.arrays_overlap(n["concepts"], e["concepts"])), F.lit(0))
    rows = rows.withColumn("_hit", first)

    def event(e: Column) -> Column:
        relation = F.array_min(
            F.transform(
                F.filter(e["reach"], lambda r: F.array_contains(n["concepts"], r["required"])),
                lambda r: F.struct((-r["strength"]).alias("weakness"), r["required"], r["held"]),
            )
        )
        return F.struct(e["text"].alias("text"), relation.alias("relation"), jaccard(n["tokens"], e["tokens"]).alias("words"))

    open_row = F.col("_hit").isNull()
    none = F.slice(F.transform(held, event), 1, 0)
    rows = rows.withColumn("_events", F.when(open_row, F.transform(held, event)).otherwise(none))

    def step(best: Column, e: Column) -> Column:
        linked = F.coalesce(-e["relation"]["weakness"], F.lit(0.0))
        after = F.greatest(linked, best["strength"])
        return (
            F.when((e["words"] >= TOKEN_THRESHOLD) & (e["words"] > after), F.struct(
                e["text"].alias("evidence"), F.lit(SHARED_WORDS).alias("required"), F.lit("").alias("held"),
                F.least(F.lit(TOKEN_CAP), e["words"]).alias("strength"),
            ))
            .when(linked > best["strength"], F.struct(
                e["text"].alias("evidence"), e["relation"]["required"].alias("required"),
                e["relation"]["held"].alias("held"), linked.alias("strength"),
            ))
            .otherwise(best)
        )

    blank = F.lit("")
    start = F.struct(blank.alias("evidence"), blank.alias("required"), blank.alias("held"), F.lit(0.0).alias("strength"))
    rows = rows.withColumn("_best", F.aggregate("_events", start, step))
    hit, best, label = F.col("_hit"), F.col("_best"), vocabulary.label
    shared = F.array_min(F.array_intersect(n["concepts"], hit["concepts"]))
    direct = F.struct(
        F.lit("direct").alias("match_type"), hit["text"].alias("evidence"),
        F.when(same_text(hit), F.lit(EXACT)).otherwise(label(shared)).alias("concept"), F.lit(1.0).alias("strength"),
    )
    found = best["strength"] > 0
    related = F.struct(
        F.when(found, "related").otherwise("missing").alias("match_type"), best["evidence"].alias("evidence"),
        F.when(found & (best["held"] != ""), F.concat(label(best["required"]), F.lit(" ↔ "), label(best["held"])))
        .otherwise(best["required"]).alias("concept"),
        best["strength"].alias("strength"),
    )
    return rows.withColumn(out, F.when(hit.isNotNull(), direct).otherwise(related)).drop("_hit", "_events", "_best")


def with_semantic_scan(rows: DataFrame, need: str, held: str, vocabulary: Vocabulary, out: str) -> DataFrame:
    """JOIN-08: add struct<evidence, concept, strength> of the strongest similar text, NULL for none."""
    n = F.col(need)

    def compare(e: Column) -> Column:
        dot = F.aggregate(
            F.filter(e["terms"], lambda o: F.array_contains(n["names"], o["term"])),
            F.lit(0.0),
            lambda total, o: total + o["weight"] * F.element_at(n["weights"], F.array_position(n["names"], o["term"]).cast("int")),
        )
        similarity = F.when((n["norm"] > 0) & (e["norm"] > 0), dot / (n["norm"] * e["norm"])).otherwise(0.0)
        return F.struct(
            e["text"].alias("evidence"), similarity.alias("similarity"),
            F.array_intersect(n["families"], e["families"]).alias("families"),
        )

    scored = F.transform(
        F.transform(held, compare),
        lambda c, i: F.struct(
            semantic_strength(c["similarity"], F.size(c["families"]) > 0).alias("strength"), (-i).alias("place"),
            c["evidence"], c["similarity"], c["families"],
        ),
    )
    rows = rows.withColumn("_top", F.when(n.isNotNull(), F.array_max(F.filter(scored, lambda c: c["strength"].isNotNull()))))
    top = F.col("_top")
    labels = F.sort_array(F.transform(top["families"], vocabulary.family_label))
    explanation = F.concat(
        F.lit("Controlled semantic similarity ("), F.format_string("%.2f", top["similarity"]), F.lit(")"),
        F.when(F.size(labels) > 0, F.concat(F.lit(" via "), F.array_join(labels, ", "))).otherwise(""),
    )
    offer = F.struct(top["evidence"].alias("evidence"), explanation.alias("concept"), top["strength"].alias("strength"))
    return rows.withColumn(out, F.when(top.isNotNull(), offer)).drop("_top")
