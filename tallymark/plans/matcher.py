"""MAT-1..4: the explainable four-layer matcher.

Flow: requirement items are matched once per distinct text and profile and brought
back to the (posting, profile) pairs, one row per pair: the matches of texts that many
postings ask for are looked up by place in an array of the profile's row, those of
the rest are joined and gathered. From there all four layers are column expressions on
that row. A pair's arrays are as long as one posting's own requirement lists.

Scores, coverage and tracks are worked out from numbers (`_facts_by_place`, `_facts_of_items`), the lists of evidence
beside them, so that a query that asks for no evidence builds none. Evidence goes by labels: postings that ask for a
skill which reads like the label of another category are scored by their lists of evidence instead.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from ..functions.text import blank, constant_map, normalize_text, split_evidence
from ..operators.listing import choose, has_content
from ..operators.scoring import (
    ARRANGEMENT_LABELS, BASE_WEIGHTS, CATEGORIES, EMPLOYMENT_LABELS, MODEL_A, PROFILE_YEARS, arrangement_match, classify,
    denies_sponsorship, experience_match, needs_sponsorship, searchable_text, two_part,
    weighed_sums, score_of_sums,
)
from ..operators.ordered import top_k
from ..operators.rowmatch import text_features, vector_features, with_scan, with_semantic_scan
from ..operators.spread import fence, kept, spread
from ..operators.vocabulary import ENTRY_TERMS, SOFTWARE_TERMS, Vocabulary, mentions

MATCHER_VERSION = "tallymark-matcher-1"
# How many texts of a scope are looked up by place instead of joined, and how many postings must ask for each.
COMMON_TEXTS, COMMON_USES = 256, 20
# A map is searched from its first key to its last: the places of a scope's texts are dealt to so many maps by hash.
SLOTS = 64
TRANSFERABLE_ROLE, SOFTWARE_ROLE = 0.70, 0.80
DIRECT_INDUSTRY, RELATED_INDUSTRY, DIRECT_ROLE = 0.85, 0.55, 0.85
PRIORITY, ADJACENT, OUTSIDE = "PRIORITY ROLE", "ADJACENT OPPORTUNITY", "OUTSIDE PRIORITY"
# Beginnings of the labels of evidence that is no skill.
LABELS = ("Role:", "Required education:", "Preferred education:", "Experience:", "Industry:", "Location:", "Work arrangement:", "Employment type:")
# A match as a number: missing, missing with semantic credit to offer, related, direct.
GAP, OFFERED, NEAR, SAME = 0, 1, 2, 3

_ITEM = (
    "struct<category:string,ordinal:int,requirement:string,match_type:string,evidence:string,concept:string,"
    "strength:double,semantic:struct<evidence:string,concept:string,strength:double>>"
)
_RANKED = f"struct<s:double,o:int,x:{_ITEM}>"
EVIDENCE_TYPE = "struct<requirement:string,match_type:string,evidence:string,concept:string,strength:double>"
# Requirement categories, with the evidence pool each is matched against.
POOLS = {
    "role": "role", "required_skills": "skills", "preferred_skills": "skills",
    "required_education": "education", "preferred_education": "education",
    "industry": "industry", "location": "location",
}
# Categories of which the strongest item counts, and those of which all do.
SINGLE = {"role": "role", "school_required": "required_education", "school_preferred": "preferred_education", "industry": "industry", "location": "location"}
LISTS = {"required": "required_skills", "preferred": "preferred_skills"}


def _joined(*lists: Column) -> Column:
    """SET-01: lists of a profile one after the other."""
    return F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])


def evidence_pools(profiles: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """SET-01: the lists the direct and related phases read, by pool."""
    school, context = split_evidence(F.col("education_summary")), split_evidence(F.col("additional_context"))
    return profiles, {
        "role": _joined(F.col("target_roles")),
        "skills": _joined(F.col("skills"), school, context, F.col("priorities")),
        "education": _joined(school, F.col("skills")),
        "industry": _joined(F.col("target_industries")),
        "location": _joined(F.col("preferred_locations")),
    }


def semantic_pools(profiles: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The lists the semantic phase reads; industry looks further, location is not eligible."""
    profiles, pools = evidence_pools(profiles)
    school, context = split_evidence(F.col("education_summary")), split_evidence(F.col("additional_context"))
    pools = {name: pools[name] for name in ("role", "skills", "education")}
    return profiles, {**pools, "industry": _joined(F.col("target_industries"), school, context)}


def _requirements() -> dict[str, Column]:
    """The requirement texts of a posting row by category."""
    present = lambda *cs: F.filter(F.array(*[blank(c) for c in cs]), lambda x: x != "")
    lists = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in POOLS if c not in ("role", "industry", "location")}
    return {
        "role": present(F.col("role_family"), F.col("title")), **lists,
        "industry": present(F.col("industry")), "location": present(F.col("location")),
    }


def _items() -> Column:
    """Requirement items of a posting row as array<struct<category, ordinal, requirement>>."""

    def each(category: str, values: Column) -> Column:
        return F.transform(
            values,
            lambda x, i: F.struct(F.lit(category).alias("category"), i.alias("ordinal"), x.alias("requirement")),
        )

    return F.concat(*[each(category, values) for category, values in _requirements().items()])


def match(
    postings: DataFrame,
    requirements: DataFrame,
    profiles: DataFrame,
    scope: tuple[str, ...] = ("scope",),
    vocabulary: Vocabulary | None = None,
    manual_profiles: DataFrame | None = None,
    layers: int = 4,
    only: DataFrame | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Score every posting against the profiles of its scope.

    `scope` names the columns postings and profiles share (JOIN-02); a single
    candidate is one profile per scope. `manual_profiles` feeds the semantic layer
    where `profiles` carries a snapshot overlay. `only` (job_id, profile_id) names the
    pairs to match: no other posting is prepared and no other text is compared. `carry` names columns of the postings
    that go on to their results.
    """
    vocabulary = vocabulary or Vocabulary()
    scope = tuple(scope)
    if only is not None:
        postings = postings.join(only, "job_id", "left_semi")
        profiles = profiles.join(only, "profile_id", "left_semi")
    # Read by the two phases of matching and the pairs; by the texts, their uses and the pairs.
    profiles = kept(profiles, "profiles")
    jobs = kept(_prepare(postings, requirements, scope, carry).withColumn("asked", _items()), "jobs")
    items = _exploded(jobs, scope)
    if only is not None:
        items = items.join(only, "job_id")
    found = match_texts(items, profiles, manual_profiles, scope, vocabulary, semantic=layers >= 4)
    common = kept(_common_texts(_exploded(jobs, scope), scope), "common_texts")
    found = kept(found.join(common, [*scope, "pool", "requirement"], "left"), "texts_matched")

    # Common texts: their matches travel with the profile and are looked up by place, so no row per item is shuffled.
    places = common.select(*scope, "place", _text_key(F.col("pool"), F.col("requirement")).alias("key"))
    places = places.groupBy(*scope, _slot(F.col("key")).alias("slot")).agg(F.map_from_entries(F.collect_list(F.struct("key", "place"))).alias("keys"))
    places = places.groupBy(*scope).agg(F.map_from_entries(F.collect_list(F.struct("slot", "keys"))).alias("slots"))
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    places = kept(places.select(*scope, F.transform(slots, lambda i: F.try_element_at("slots", i)).alias("places")), "places")
    by_place = found.where("place IS NOT NULL").groupBy(*scope, "profile_id").agg(
        F.map_from_entries(F.collect_list(F.struct("place", _hit().alias("hit")))).alias("hits")
    )
    sides = _profile_side(profiles, scope).join(by_place, [*scope, "profile_id"], "left")
    at = F.sequence(F.lit(0), F.array_max(F.map_keys("hits")))
    sides = sides.withColumn("hits", F.transform(at, lambda i: F.try_element_at("hits", i)))
    sides = kept(sides.withColumns({
        "codes": F.transform("hits", _code), "strengths": F.transform("hits", lambda h: h["strength"]), "credits": F.transform("hits", _credit),
    }), "profile_sides")
    jobs = jobs.join(places, list(scope), "left")
    place_of = lambda x: _place(_text_key(_pool_of(x["category"]), x["requirement"]))
    placed = ~F.exists("asked", lambda x: x["requirement"].isNotNull() & place_of(x).isNull())
    spots = {f"{name}_at": _places_of(category) for name, category in {**SINGLE, **LISTS}.items()}

    def paired(some: DataFrame) -> DataFrame:
        asked = F.transform("asked", lambda x: F.struct(x["category"], x["ordinal"], x["requirement"], place_of(x).alias("place")))
        rows = some.withColumn("asked", asked).drop("places").join(sides, list(scope))
        if only is not None:
            rows = rows.join(only, ["job_id", "profile_id"], "left_semi")
        looked_up = F.transform("asked", lambda x: F.struct(x.alias("x"), F.get("hits", x["place"]).alias("hit")))
        return rows.withColumn("found", F.transform(
            F.filter(looked_up, lambda y: y["hit"].isNotNull()),
            lambda y: F.struct(
                *[y["x"][c].alias(c) for c in ("category", "ordinal", "requirement")],
                *[y["hit"][c].alias(c) for c in ("match_type", "evidence", "concept", "strength", "semantic")],
            ),
        ))

    # Texts that few postings ask for: one row per item and profile, gathered again.
    rare, gathered = found.where("place IS NULL").drop("place"), None
    if not rare.isEmpty():
        joined = items.join(rare, [*scope, "pool", "requirement", *(["profile_id"] if only is not None else [])])
        gathered = joined.groupBy("job_id", "profile_id").agg(
            F.collect_list(F.struct("category", "ordinal", "requirement", _hit().alias("hit"))).alias("rare")
        )
        gathered = gathered.withColumn("rare", F.transform("rare", lambda x: F.struct(
            x["category"], x["ordinal"], x["requirement"], *[x["hit"][c].alias(c) for c in ("match_type", "evidence", "concept", "strength", "semantic")],
        )))

    def completed(some: DataFrame) -> DataFrame:
        rows = paired(some)
        if gathered is None:
            return rows
        rows = rows.join(gathered, ["job_id", "profile_id"], "left")
        none = F.array().cast(f"array<{_ITEM}>")
        return rows.withColumn("found", F.concat(F.coalesce("found", none), F.coalesce("rare", none))).drop("rare")

    plain = jobs.where("NOT odd")
    common_only = plain if gathered is None else plain.where(placed)
    parts = [_score(_categories(_facts_by_place(paired(common_only.withColumns(spots)))), layers, carry)]
    if gathered is not None:
        parts.append(_score(_categories(_facts_of_items(completed(plain.where(~placed)))), layers, carry))
    odd = jobs.where("odd")
    if not odd.isEmpty():
        parts.append(_score(_categories(_facts_of_items(completed(odd))), layers, carry, by_label=True))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return fence(scored, "pairs_scored")


def _places_of(category: str) -> Column:
    """The places of a posting's texts of one category, in their order."""
    key = lambda x: F.concat(F.lit(f"{POOLS[category]}:"), x)
    return F.filter(F.transform(_requirements()[category], lambda x: _place(key(x))), lambda p: p.isNotNull())


def _exploded(jobs: DataFrame, scope) -> DataFrame:
    """One row per item that a posting asks for."""
    items = jobs.select(*scope, "job_id", F.explode("asked").alias("i"))
    return items.select(
        *scope, "job_id", "i.category", "i.ordinal", "i.requirement", _pool_of(F.col("i.category")).alias("pool")
    )


def _pool_of(category: Column) -> Column:
    return constant_map(POOLS)[category]


def _text_key(pool: Column, requirement: Column) -> Column:
    """A text and its pool as one string; no pool's name holds a colon."""
    return F.concat(pool, F.lit(":"), requirement)


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def _place(key: Column) -> Column:
    """The place of a text's key, NULL for none."""
    return F.try_element_at(F.get("places", _slot(key)), key)


def _common_texts(items: DataFrame, scope) -> DataFrame:
    """The texts of a scope that most postings ask for, at most COMMON_TEXTS, with their places from 0."""
    uses = items.where(F.col("requirement").isNotNull()).groupBy(*scope, "pool", "requirement").agg(F.count("*").alias("uses"))
    order = [F.desc("uses"), F.col("pool"), F.col("requirement")]
    best = top_k(uses.where(F.col("uses") >= COMMON_USES), list(scope), order, COMMON_TEXTS, "place")
    return best.select(*scope, "pool", "requirement", (F.col("place") - 1).alias("place"))


def _hit() -> Column:
    return F.struct(
        F.coalesce("match_type", F.lit("missing")).alias("match_type"), F.coalesce("evidence", F.lit("")).alias("evidence"),
        F.coalesce("concept", F.lit("")).alias("concept"), F.coalesce("strength", F.lit(0.0)).alias("strength"), F.col("semantic"),
    )


def _code(hit: Column) -> Column:
    """What a match is, as a number."""
    gap = F.when(hit["semantic"].isNotNull(), OFFERED).otherwise(GAP)
    return F.when(hit["match_type"] == "direct", SAME).when(hit["match_type"] == "related", NEAR).otherwise(gap).cast("byte")


def _credit(hit: Column) -> Column:
    """The strength of a match once semantic credit is given."""
    return F.when((hit["match_type"] == "missing") & hit["semantic"].isNotNull(), hit["semantic"]["strength"]).otherwise(hit["strength"])


def _facts_by_place(rows: DataFrame) -> DataFrame:
    """The numbers of a pair's matches, where all its texts have a place: the strongest of one category, sums of the lists."""
    strength = lambda p: F.get("strengths", p)
    best = lambda at: F.aggregate(
        at, F.lit(None).cast("int"), lambda b, p: F.when(b.isNull() | (strength(p) > strength(b)), p).otherwise(b)
    )
    total = lambda at, values: F.aggregate(at, F.lit(0.0), lambda t, p: t + F.get(values, p))
    rows = rows.withColumns({f"{k}_place": best(F.col(f"{k}_at")) for k in SINGLE})
    facts = {}
    for k in SINGLE:
        facts |= {f"{k}_{name}": F.get(values, F.col(f"{k}_place")) for name, values in (("code", "codes"), ("strength", "strengths"), ("credit", "credits"))}
    for k in LISTS:
        at = F.col(f"{k}_at")
        facts |= {
            f"{k}_n": F.size(at), f"{k}_sum": total(at, "strengths"), f"{k}_credit": total(at, "credits"),
            f"{k}_offer": F.exists(at, lambda p: F.get("codes", p) == OFFERED),
        }
    return rows.withColumns(facts)


def _facts_of_items(rows: DataFrame) -> DataFrame:
    """The same from the matches themselves."""
    first = {k: F.struct(_code(x).alias("code"), x["strength"].alias("strength"), _credit(x).alias("credit"))
             for k, x in ((k, F.col(f"_{k}")) for k in SINGLE)}
    rows = rows.withColumns({f"_{k}": _first_best(_of(c)) for k, c in SINGLE.items()} | {f"_{k}": _of(c) for k, c in LISTS.items()})
    facts = {}
    for k, x in first.items():
        facts |= {f"{k}_{name}": F.when(F.col(f"_{k}").isNotNull(), x[name]) for name in ("code", "strength", "credit")}
    for k in LISTS:
        x = F.col(f"_{k}")
        facts |= {
            f"{k}_n": F.size(x), f"{k}_sum": F.aggregate(x, F.lit(0.0), lambda t, y: t + y["strength"]),
            f"{k}_credit": F.aggregate(x, F.lit(0.0), lambda t, y: t + _credit(y)), f"{k}_offer": F.exists(x, lambda y: _code(y) == OFFERED),
        }
    return rows.withColumns(facts).drop(*[f"_{k}" for k in (*SINGLE, *LISTS)])


def _prepare(postings: DataFrame, requirements: DataFrame, scope, carry=()) -> DataFrame:
    """One row per posting with everything that does not depend on a profile."""
    facts = has_content(requirements)
    jobs = postings.join(facts, "job_id", "left")
    text = searchable_text(
        F.col("title"), F.col("description"), F.col("role_family"), F.col("industry"),
        F.array_join("required_skills", "\n"), F.array_join("preferred_skills", "\n"),
        F.array_join("hard_disqualifiers", "\n"), F.col("work_authorization"),
    )
    role_text = normalize_text(F.concat_ws("\n", blank(F.col("role_family")), F.col("title")))
    none = F.array().cast("array<string>")
    skills = F.concat(F.coalesce("required_skills", none), F.coalesce("preferred_skills", none))
    label = lambda x: F.coalesce(reduce(or_, [x.startswith(p) for p in LABELS]), F.lit(False))
    return jobs.select(
        *scope, "job_id", *[F.col(c).alias(f"_carry_{c}") for c in carry], F.exists(skills, label).alias("odd"), blank(F.col("title")).alias("title"), blank(F.col("location")).alias("location"),
        F.coalesce("employment_type", F.lit("unknown")).alias("employment_type"),
        F.coalesce("work_arrangement", F.lit("unknown")).alias("work_arrangement"),
        F.coalesce("has_content", F.lit(False)).alias("has_requirements"),
        F.coalesce("experience_range", F.lit("Not specified")).alias("experience_range"),
        blank(F.col("role_family")).alias("role_family"), blank(F.col("industry")).alias("industry"),
        F.coalesce("seniority_level", F.lit("unknown")).alias("seniority_level"), "min_years",
        # The fraction for a profile of each level, and of no known level.
        F.array(*[
            experience_match(F.col("min_years"), F.coalesce("seniority_level", F.lit("unknown")), F.lit(level))["fraction"] for level in (*PROFILE_YEARS, "")
        ]).alias("experience_fractions"),
        "required_skills", "preferred_skills", "required_education", "preferred_education", "hard_disqualifiers",
        blank(F.col("work_authorization")).alias("job_authorization"),
        denies_sponsorship(blank(F.col("work_authorization"))).alias("denies_sponsorship"),
        (normalize_text(blank(F.col("work_authorization"))) != "").alias("states_authorization"),
        F.contains(normalize_text(blank(F.col("location"))), F.lit("remote")).alias("remote_job"),
        text.alias("norm_text"),
        mentions(role_text, ENTRY_TERMS).alias("entry_role"),
        mentions(role_text, SOFTWARE_TERMS).alias("software_role"),
    )


def _profile_side(profiles: DataFrame, scope) -> DataFrame:
    texts = F.array().cast("array<string>")
    breakers = F.transform(F.coalesce("deal_breakers", texts), lambda b: F.struct(b.alias("text"), normalize_text(b).alias("norm")))
    return profiles.select(
        *scope, "profile_id", "experience_level",
        F.coalesce(F.array_position(F.array(*[F.lit(x) for x in (*PROFILE_YEARS, "")]), F.col("experience_level")), F.lit(0)).cast("int").alias("level_place"),
        "preferred_arrangement", "preferred_employment",
        F.filter(breakers, lambda b: b["norm"] != "").alias("breakers"),
        needs_sponsorship(blank(F.col("work_authorization"))).alias("needs_sponsorship"),
        F.get(
            F.filter(F.coalesce("preferred_locations", texts), lambda p: F.contains(normalize_text(p), F.lit("remote"))), F.lit(0)
        ).alias("remote_place"),
        (F.size(F.coalesce("target_roles", F.array())) > 0).alias("has_targets"),
        (F.size(F.coalesce("target_industries", F.array())) > 0).alias("has_industries"),
        (F.size(F.coalesce("preferred_locations", F.array())) > 0).alias("has_locations"),
    )


def match_texts(items, profiles, manual_profiles, scope, vocabulary, semantic=True) -> DataFrame:
    """Each distinct (scope, pool, requirement) text against the profiles of its scope, or the one its row names."""
    named = [c for c in ("profile_id",) if c in items.columns]
    needs = spread(items.select(*scope, "pool", "requirement", *named).distinct(), *scope, "pool", "requirement")
    one = F.array("requirement")
    features = lambda c: text_features(c, vocabulary, F.col("pool") == "role")
    needs = needs.withColumn("need", F.get(features(one), F.lit(0)))
    held = _listed(evidence_pools(profiles), scope).withColumn("held", features(F.col("items"))).drop("items")
    rows = with_scan(needs.join(held, [*scope, "pool", *named]), "need", "held", vocabulary, "hit")
    rows = rows.select(*scope, "pool", "requirement", "profile_id", "hit")
    if semantic:
        lists = semantic_pools(profiles if manual_profiles is None else manual_profiles)
        vectors = _listed(lists, scope).withColumn("vectors", vector_features(F.col("items"), vocabulary)).drop("items")
        rows = rows.join(vectors, [*scope, "pool", "profile_id"], "left")
        missing = (F.col("hit.match_type") == "missing") & F.col("vectors").isNotNull()
        rows = rows.withColumn("want", F.when(missing, F.get(vector_features(one, vocabulary), F.lit(0))))
        rows = with_semantic_scan(rows, "want", "vectors", vocabulary, "semantic")
    else:
        rows = rows.withColumn("semantic", F.lit(None).cast("struct<evidence:string,concept:string,strength:double>"))
    rows = rows.select(*scope, "pool", "requirement", "profile_id", "hit", "semantic")
    return fence(rows, "texts_matched").select("*", "hit.*").drop("hit")


def _listed(lists: tuple[DataFrame, dict[str, Column]], scope) -> DataFrame:
    """One row per (profile, pool) with its list."""
    profiles, pools = lists
    entries = F.array(*[F.struct(F.lit(key).alias("pool"), items.alias("items")) for key, items in pools.items()])
    return profiles.select(*scope, "profile_id", F.explode(entries).alias("p")).select(*scope, "profile_id", "p.*")


# ------------------------------------------------------------------ one row per pair
def _of(category: str) -> Column:
    found = F.filter(
        F.coalesce("found", F.array().cast(f"array<{_ITEM}>")),
        lambda x: x["category"] == category,
    )
    return F.array_sort(
        found, lambda a, b: F.when(a["ordinal"] < b["ordinal"], -1).when(a["ordinal"] > b["ordinal"], 1).otherwise(0)
    )


def _first_best(items: Column) -> Column:
    """Strongest item, the first of equals; NULL for none."""
    ranked = F.transform(items, lambda x: F.struct(x["strength"].alias("s"), (-x["ordinal"]).alias("o"), x.alias("x")))
    return F.reduce(
        ranked, F.lit(None).cast(_RANKED),
        lambda best, r: F.when(
            best.isNull() | (r["s"] > best["s"]) | ((r["s"] == best["s"]) & (r["o"] > best["o"])), r
        ).otherwise(best),
        lambda best: best["x"],
    )


def _entry(requirement, match_type, evidence, concept, strength) -> Column:
    return F.struct(
        requirement.alias("requirement"), match_type.alias("match_type"), evidence.alias("evidence"),
        concept.alias("concept"), strength.cast("double").alias("strength"),
    )


def _labelled(prefix: str, item: Column) -> Column:
    return _entry(
        F.concat(F.lit(prefix), item["requirement"]), item["match_type"], item["evidence"], item["concept"],
        item["strength"],
    )


def _categories(rows: DataFrame) -> DataFrame:
    """Layer 1: the eight category fractions, the evidence list and the blockers."""
    rows = rows.withColumns(
        {
            "role_item": _first_best(_of("role")),
            "required_items": _of("required_skills"),
            "preferred_items": _of("preferred_skills"),
            "school_required": _first_best(_of("required_education")),
            "school_preferred": _first_best(_of("preferred_education")),
            "industry_item": _first_best(_of("industry")),
            "location_item": _first_best(_of("location")),
        }
    )
    mean = lambda k: F.when(F.col(f"{k}_n") > 0, F.col(f"{k}_sum") / F.col(f"{k}_n")).otherwise(0.0)
    remote_place = F.col("remote_place")
    remote = (F.col("location_code") <= OFFERED) & F.col("remote_job") & remote_place.isNotNull()
    years = experience_match(F.col("min_years"), F.col("seniority_level"), F.col("experience_level"))
    desk = arrangement_match(F.col("work_arrangement"), F.col("preferred_arrangement"))
    rows = rows.withColumns(
        {
            "role_on": F.col("has_targets") & F.col("role_code").isNotNull(),
            "role_shown": F.col("has_targets") & F.col("role_code").isNotNull(),
            "industry_on": F.col("has_industries") & (F.col("industry") != ""),
            "location_on": F.col("has_locations") & (F.col("location") != ""),
            "place_strength": F.when(remote, 1.0).otherwise(F.coalesce("location_strength", F.lit(0.0))),
            "location_match": F.when(
                remote,
                _entry(F.concat(F.lit("Location: "), F.col("location")), F.lit("direct"), remote_place,
                       F.lit("Remote location"), F.lit(1.0)),
            ).otherwise(_labelled("Location: ", F.col("location_item"))),
            "arrangement_on": desk["available"],
            "arrangement_strength": desk["strength"],
            "experience_on": years["available"],
            "experience_fraction": F.element_at("experience_fractions", F.when(F.col("level_place") > 0, F.col("level_place")).otherwise(len(PROFILE_YEARS) + 1)),
            "employment_on": F.col("employment_type") != "unknown",
            "employment_strength": F.when(
                F.col("preferred_employment") == F.col("employment_type"), 1.0
            ).otherwise(0.0),
        }
    )
    education, education_on = two_part(
        F.coalesce("school_required_strength", F.lit(0.0)), F.col("school_required_code").isNotNull(),
        F.coalesce("school_preferred_strength", F.lit(0.0)), F.col("school_preferred_code").isNotNull(), (0.8, 0.2),
    )
    place, place_on = two_part(
        F.col("place_strength"), F.col("location_on"), F.col("arrangement_strength"), F.col("arrangement_on"),
        (0.4, 0.6),
    )
    rows = rows.withColumns(
        {
            "role_fraction": F.when(F.col("role_on"), F.col("role_strength")).otherwise(0.0),
            "required_fraction": mean("required"),
            "preferred_fraction": mean("preferred"),
            "education_fraction": education,
            "education_on": education_on,
            "industry_fraction": F.when(F.col("industry_on"), F.col("industry_strength")).otherwise(0.0),
            "place_fraction": place,
            "place_on": place_on,
        }
    )
    hired = F.col("employment_strength") == 1.0
    plain = lambda c: F.transform(c, lambda x: _labelled("", x))
    one = lambda on, entry: F.when(on, F.array(entry)).otherwise(F.array().cast(f"array<{EVIDENCE_TYPE}>"))
    evidence = F.concat(
        one(F.col("role_on"), _labelled("Role: ", F.col("role_item"))),
        plain("required_items"),
        plain("preferred_items"),
        one(F.col("school_required").isNotNull(), _labelled("Required education: ", F.col("school_required"))),
        one(F.col("school_preferred").isNotNull(), _labelled("Preferred education: ", F.col("school_preferred"))),
        one(
            F.col("experience_on"),
            _entry(F.concat(F.lit("Experience: "), F.col("experience_range")), years["match_type"],
                   years["evidence"], years["concept"], years["fraction"]),
        ),
        one(F.col("industry_on"), _labelled("Industry: ", F.col("industry_item"))),
        one(F.col("location_on"), F.col("location_match")),
        one(
            F.col("arrangement_on"),
            _entry(
                F.concat(F.lit("Work arrangement: "), choose(F.col("work_arrangement"), ARRANGEMENT_LABELS, "")),
                desk["match_type"], desk["evidence"], desk["concept"], desk["strength"],
            ),
        ),
        one(
            F.col("employment_on"),
            _entry(
                F.concat(F.lit("Employment type: "), choose(F.col("employment_type"), EMPLOYMENT_LABELS, "")),
                F.when(hired, "direct").otherwise("missing"),
                F.when(hired, choose(F.col("preferred_employment"), EMPLOYMENT_LABELS, "")).otherwise(""),
                F.when(hired, "Employment type").otherwise(""), F.col("employment_strength"),
            ),
        ),
    )
    conflict = F.col("needs_sponsorship") & F.col("denies_sponsorship")
    breaks = lambda b: F.contains(F.col("norm_text"), b["norm"])
    texts = F.array().cast("array<string>")
    confirmed = F.concat(
        F.when(
            conflict,
            F.array(F.lit("The profile indicates sponsorship is required, but the posting states sponsorship is unavailable.")),
        ).otherwise(texts),
        F.transform(
            F.filter("breakers", breaks), lambda b: F.concat(F.lit("Profile deal-breaker found in posting: "), b["text"])
        ),
    )
    review = F.concat(
        F.transform(
            F.coalesce("hard_disqualifiers", texts), lambda b: F.concat(F.lit("Posting blocker to verify: "), b)
        ),
        F.when(
            ~conflict & F.col("states_authorization"),
            F.array(F.concat(F.lit("Work authorization requirement to verify: "), F.trim("job_authorization"))),
        ).otherwise(texts),
    )
    blocked = conflict | F.exists("breakers", breaks)
    return rows.withColumns({"evidence": evidence, "confirmed_blockers": confirmed, "review_blockers": review, "blocked": blocked})


def _parts(role: Column, role_on: Column) -> dict[str, tuple[Column, Column]]:
    return {
        "role": (role, role_on),
        "required_skills": (F.col("required_fraction"), F.col("required_n") > 0),
        "preferred_skills": (F.col("preferred_fraction"), F.col("preferred_n") > 0),
        "education": (F.col("education_fraction"), F.col("education_on")),
        "experience": (F.col("experience_fraction"), F.col("experience_on")),
        "industry": (F.col("industry_fraction"), F.col("industry_on")),
        "location_arrangement": (F.col("place_fraction"), F.col("place_on")),
        "employment_type": (F.col("employment_strength"), F.col("employment_on")),
    }


def _weighed(rows: DataFrame, weights: dict[str, int]) -> DataFrame:
    """AGG-02: score and coverage, in two steps so that each sum is worked out once."""
    total, earned = weighed_sums(_parts(F.col("role_fraction"), F.col("role_on")), weights)
    score, coverage = score_of_sums(F.col("_total"), F.col("_earned"))
    return rows.withColumns({"_total": total, "_earned": earned}).withColumns({"score": score, "coverage": coverage}).drop("_total", "_earned")


def _score(rows: DataFrame, layers: int, carry=(), by_label: bool = False) -> DataFrame:
    track = (
        F.when(F.col("role_on") & (F.col("role_code") == SAME), PRIORITY)
        .when(F.col("role_on") & (F.col("role_code") == NEAR), ADJACENT)
        .otherwise(OUTSIDE)
    )
    rows = _weighed(rows, BASE_WEIGHTS)
    rows = rows.withColumn(
        "track", F.when((track == OUTSIDE) & (F.col("score") >= 65), ADJACENT).otherwise(track)
    )
    weights = BASE_WEIGHTS
    if layers >= 2:
        weights = MODEL_A
        rows = _industry_first(rows)
    if layers >= 3:
        rows = _software_path(rows)
    if layers >= 4:
        rows = _semantic_credit(rows, by_label)
    parts = _parts(F.col("role_fraction"), F.col("role_on"))
    rows = _weighed(rows, weights)
    rows = rows.withColumn("classification", classify(F.col("score"), F.col("coverage"), F.col("blocked")))

    ready = F.col("has_requirements")
    split = lambda kind: F.filter("evidence", lambda e: e["match_type"] == kind)
    categories = F.array(
        *[
            F.struct(
                F.lit(key).alias("key"), F.lit(weights[key]).alias("weight"),
                (weights[key] * parts[key][0]).alias("earned"), parts[key][1].alias("available"),
            )
            for key in CATEGORIES
        ]
    )
    none = f"array<{EVIDENCE_TYPE}>"
    return rows.select(
        "job_id",
        "profile_id",
        F.when(ready, F.col("score")).otherwise(F.lit(0)).alias("score"),
        F.when(ready, F.col("coverage")).otherwise(F.lit(0)).alias("coverage"),
        F.when(ready, F.col("classification")).otherwise("NEEDS REQUIREMENTS").alias("classification"),
        F.when(ready, F.col("track")).otherwise(OUTSIDE).alias("track"),
        ready.alias("has_requirements"),
        F.when(ready, categories).otherwise(F.slice(categories, 1, 0)).alias("categories"),
        *[
            F.when(ready, split(kind)).otherwise(F.array().cast(none)).alias(name)
            for kind, name in (
                ("direct", "direct"), ("related", "related"), ("semantic", "semantic"), ("missing", "gaps"),
            )
        ],
        *[
            F.when(ready, F.col(c)).otherwise(F.array().cast("array<string>")).alias(c)
            for c in ("confirmed_blockers", "review_blockers")
        ],
        F.lit(MATCHER_VERSION).alias("matcher_version"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )


def _role_label() -> Column:
    return F.when(F.col("role_family") != "", F.col("role_family")).otherwise(F.col("title"))


def _swap_role_gap(evidence: Column, entry: Column, unless: Column) -> Column:
    """Drop a missing role and add a transferable one behind the related evidence."""
    kept = F.filter(
        evidence, lambda e: ~(e["requirement"].startswith("Role:") & (e["match_type"] == "missing"))
    )
    return F.when(unless, kept).otherwise(F.concat(kept, F.array(entry)))


def _industry_first(rows: DataFrame) -> DataFrame:
    """Layer 2: industry-first weights, the transferable role and the track."""
    path = (
        (F.col("industry_fraction") >= RELATED_INDUSTRY)
        & F.col("entry_role")
        & (F.col("role_fraction") < TRANSFERABLE_ROLE)
    )
    entry = _entry(
        F.concat(F.lit("Role: "), _role_label()), F.lit("related"), F.lit("Medical-device industry entry strategy"),
        F.lit("Transferable technical MedTech function"), F.lit(TRANSFERABLE_ROLE),
    )
    has_related = F.exists(
        "evidence", lambda e: e["requirement"].startswith("Role:") & (e["match_type"] == "related")
    )
    rows = rows.withColumn("transferable", path).withColumn(
        "evidence",
        F.when(F.col("transferable"), _swap_role_gap(F.col("evidence"), entry, has_related)).otherwise(F.col("evidence")),
    )
    rows = rows.withColumns(
        {
            "role_fraction": F.when(F.col("transferable"), TRANSFERABLE_ROLE).otherwise(F.col("role_fraction")),
            "role_on": F.col("role_on") | F.col("transferable"),
        }
    )
    return rows.withColumn("track", F.when(F.col("industry_on"), _industry_track()).otherwise(F.col("track")))


def _industry_track() -> Column:
    return (
        F.when(F.col("industry_fraction") < RELATED_INDUSTRY, OUTSIDE)
        .when((F.col("industry_fraction") >= DIRECT_INDUSTRY) & (F.col("role_fraction") >= DIRECT_ROLE), PRIORITY)
        .when(F.col("role_fraction") > 0, ADJACENT)
        .otherwise(OUTSIDE)
    )


def _software_path(rows: DataFrame) -> DataFrame:
    """Layer 3: software work as a path into the target industry."""
    qualifies = F.col("software_role") & (F.col("industry_fraction") >= RELATED_INDUSTRY)
    lifted = qualifies & (F.col("role_fraction") < SOFTWARE_ROLE)
    entry = _entry(
        F.concat(F.lit("Role: "), _role_label()), F.lit("related"),
        F.lit("Software is an accepted technical pathway into MedTech"),
        F.lit("Software pathway into MedTech"), F.lit(SOFTWARE_ROLE),
    )
    rows = rows.withColumns({"_qualifies": qualifies, "_lifted": lifted})
    rows = rows.withColumns(
        {
            "evidence": F.when(
                F.col("_lifted"), _swap_role_gap(F.col("evidence"), entry, F.lit(False))
            ).otherwise(F.col("evidence")),
            "role_fraction": F.when(F.col("_lifted"), SOFTWARE_ROLE).otherwise(F.col("role_fraction")),
            "role_on": F.col("role_on") | F.col("_lifted"),
        }
    )
    track = (
        F.when(F.col("industry_fraction") < RELATED_INDUSTRY, OUTSIDE)
        .when((F.col("industry_fraction") >= DIRECT_INDUSTRY) & (F.col("role_fraction") >= DIRECT_ROLE), PRIORITY)
        .when(F.col("_qualifies"), ADJACENT)
        .otherwise(F.col("track"))
    )
    return rows.withColumn("track", F.when(F.col("industry_on"), track).otherwise(F.col("track")))


def _semantic_credit(rows: DataFrame, by_label: bool = False) -> DataFrame:
    """Layer 4: capped credit for eligible gaps, then average, score and track again.

    Evidence is found again by its label. Where no skill reads like another category's label that comes to the numbers of
    the matches; with `by_label` the lists of evidence are asked.
    """
    none = F.array().cast("array<struct<requirement:string,semantic:struct<evidence:string,concept:string,strength:double>>>")

    def offers(prefix: str, items: Column) -> Column:
        return F.transform(
            items, lambda x: F.struct(F.concat(F.lit(prefix), x["requirement"]).alias("requirement"), x["semantic"].alias("semantic"))
        )

    one = lambda prefix, c: F.when(F.col(c).isNotNull(), offers(prefix, F.array(F.col(c)))).otherwise(none)
    known = F.filter(
        F.concat(
            one("Role: ", "role_item"), offers("", F.col("required_items")), offers("", F.col("preferred_items")),
            one("Required education: ", "school_required"), one("Preferred education: ", "school_preferred"),
            one("Industry: ", "industry_item"),
        ),
        lambda x: x["semantic"].isNotNull(),
    )
    rows = rows.withColumn("_offers", known)

    def upgrade(e: Column) -> Column:
        offer = F.get(F.filter("_offers", lambda o: o["requirement"] == e["requirement"]), F.lit(0))
        return F.when(
            (e["match_type"] == "missing") & offer.isNotNull(),
            _entry(e["requirement"], F.lit("semantic"), offer["semantic"]["evidence"], offer["semantic"]["concept"],
                   offer["semantic"]["strength"]),
        ).otherwise(e)

    rows = rows.withColumn("evidence", F.transform("evidence", upgrade))
    again = _labelled_strengths() if by_label else _credited_strengths()
    rows = rows.withColumn("_used", again.pop("used"))
    education, _ = two_part(
        again.pop("school_required"), F.col("school_required_code").isNotNull(),
        again.pop("school_preferred"), F.col("school_preferred_code").isNotNull(), (0.8, 0.2),
    )
    on = {
        "required": F.col("required_n") > 0, "preferred": F.col("preferred_n") > 0, "role": F.col("role_on"),
        "industry": F.col("industry_on"), "education": F.col("education_on"),
    }
    redone = {**again, "education": education}
    rows = rows.withColumns(
        {f"{k}_fraction": F.when(F.col("_used") & on[k], redone[k]).otherwise(F.col(f"{k}_fraction")) for k in on}
    )
    return rows.withColumn(
        "track", F.when(F.col("_used") & F.col("industry_on"), _industry_track()).otherwise(F.col("track"))
    )


def _labelled_strengths() -> dict[str, Column]:
    """What layer 4 averages again, by the labels of the evidence."""
    strength = lambda label: F.coalesce(
        F.array_max(F.transform(F.filter("evidence", lambda e: e["requirement"] == label), lambda e: e["strength"])),
        F.lit(0.0),
    )
    mean = lambda c: F.aggregate(
        c, F.lit(0.0), lambda t, x: t + strength(x["requirement"])
    ) / F.size(c)
    top = lambda prefix: F.array_max(
        F.transform(F.filter("evidence", lambda e: e["requirement"].startswith(prefix)), lambda e: e["strength"])
    )
    return {
        "used": F.exists("evidence", lambda e: e["match_type"] == "semantic"),
        "school_required": F.coalesce(top("Required education:"), F.lit(0.0)),
        "school_preferred": F.coalesce(top("Preferred education:"), F.lit(0.0)),
        "required": mean("required_items"), "preferred": mean("preferred_items"),
        "role": F.coalesce(top("Role:"), F.col("role_fraction")),
        "industry": strength(F.concat(F.lit("Industry: "), F.col("industry"))),
    }


def _credited_strengths() -> dict[str, Column]:
    """The same from the numbers of the matches."""
    code = lambda k: F.coalesce(F.col(f"{k}_code"), F.lit(-1))
    credit = lambda k: F.coalesce(F.col(f"{k}_credit"), F.lit(0.0))
    swapped = F.col("transferable") | F.col("_lifted")
    # The role's own entry, unless it was a gap that a transferable role took the place of.
    own = F.col("role_shown") & ~((code("role") <= OFFERED) & swapped)
    added = F.col("transferable") & ~(F.col("role_shown") & (code("role") == NEAR))
    top = F.greatest(F.when(own, F.col("role_credit")), F.when(added, TRANSFERABLE_ROLE), F.when(F.col("_lifted"), SOFTWARE_ROLE))
    return {
        "used": (own & (code("role") == OFFERED)) | F.col("required_offer") | F.col("preferred_offer") | (code("school_required") == OFFERED)
        | (code("school_preferred") == OFFERED) | (F.col("industry_on") & (code("industry") == OFFERED)),
        "school_required": credit("school_required"), "school_preferred": credit("school_preferred"),
        "required": F.col("required_credit") / F.col("required_n"), "preferred": F.col("preferred_credit") / F.col("preferred_n"),
        "role": F.coalesce(top, F.col("role_fraction")), "industry": credit("industry"),
    }


def evidence_rows(results: DataFrame) -> DataFrame:
    """Long form of match results: one row per evidence entry."""
    lists = F.concat("direct", "related", "semantic", "gaps")
    return results.select("job_id", "profile_id", F.explode(lists).alias("e")).select("job_id", "profile_id", "e.*")


def coverage_percent(earned: Column, weight: Column) -> Column:
    """Whole percent of a category's weight, half-even."""
    return F.when(weight > 0, half_even(100 * earned / weight)).otherwise(F.lit(0))
