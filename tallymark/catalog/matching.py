"""The matcher over orders as postings and (nation, segment) groups of customers as profiles.

A posting asks for the phrases of its parts; a profile holds the phrases its group
spent most on. Postings meet the five profiles of their customer's nation, so the
number of pairs grows with the postings only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import BIGRAM_WEIGHT, FAMILY_WEIGHT
from ..functions.text import normalize_text, phrase_present
from ..operators import discovery as D
from ..operators import listing as L
from ..operators import scoring as P
from ..operators.evidence import FixedTags, TableTags, best_evidence, pool
from ..operators.ordered import top_k
from ..operators.rowmatch import text_features, with_scan
from ..operators.semantic import best_semantic, similar_texts
from ..operators.spread import fence, kept, spread
from ..operators.vocabulary import Vocabulary, symmetric_relations, tag_with_table
from ..plans.matcher import evidence_rows, match
from ..sources.tables import table
from .registry import query
from .texts import NORM, PHRASES, STEM, STOPS, _tag_sql

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SKILLS_HELD = 12
TITLES = (
    "Systems Test Engineer", "Firmware Developer", "Quality Engineer", "Biomedical Engineer II", "Field Service Engineer",
    "Data Analyst", "Clinical Applications Specialist", "Verification Engineer", "Software Engineer", "Retail Manager",
)
FAMILIES_OF = ("", "Test engineering", "Software development", "Quality engineering", "Sales")
INDUSTRIES = ("MedTech", "Healthcare", "Regulated industry", "Retail", "Medical devices", "")
ARRANGEMENTS = ("onsite", "hybrid", "remote", "unknown")
EMPLOYMENTS = ("full_time", "part_time", "contract", "internship", "temporary", "unknown")
SENIORITIES = ("unknown", "internship", "entry_level", "early_career", "mid_level", "senior", "lead_manager")
AUTHORIZATIONS = ("", "No sponsorship available", "Must be authorized to work", "We are unable to sponsor visas")
SCHOOLS = ("", "Electrical engineering degree", "BSc in Computer Science", "Biomedical engineering degree")
ROLES = (
    ("Systems Engineer", "Test Engineer"), ("Software Engineer",), ("Quality Engineer", "Reliability Engineer"),
    ("Biomedical Engineer", "Clinical Engineer"), ("Applications Engineer",),
)
WANTED_INDUSTRIES = (("Medical devices",), ("Healthcare", "Finance"), ("Regulated industry",), ("Retail",), ("MedTech",))


def pick(values, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def pick_list(values, n: Column) -> Column:
    rows = F.array(*[F.array(*[F.lit(v) for v in row]) for row in values])
    return F.element_at(rows, (n % len(values) + 1).cast("int"))


def phrase_of(part_key: Column) -> Column:
    return pick(PHRASES, part_key)


def jobs(spark, sf):
    lines = table(spark, sf, "lineitem")
    items = lines.select(
        F.col("l_orderkey").alias("job_id"), phrase_of(F.col("l_partkey")).alias("phrase"), F.col("l_linenumber").alias("n"),
        (F.col("l_returnflag") == "N").alias("required"),
    )
    # As many items as an order has lines.
    listed = lambda keep: F.transform(
        F.array_sort(F.collect_list(F.when(keep, F.struct("n", "phrase")))), lambda x: x["phrase"]
    )
    asked = items.groupBy("job_id").agg(
        listed(F.col("required")).alias("required_skills"), listed(~F.col("required")).alias("preferred_skills")
    )
    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    rows = (
        table(spark, sf, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
        .join(asked, key == F.col("job_id"), "left")
        .select(
            key.alias("job_id"), F.col("c_nationkey").alias("scope"), pick(TITLES, key).alias("title"), F.col("c_name").alias("company"),
            F.when(key % 9 == 0, "Remote").otherwise(F.col("n_name")).alias("location"), F.col("o_orderpriority").alias("description"),
            pick(EMPLOYMENTS, key).alias("employment_type"), pick(ARRANGEMENTS, key).alias("work_arrangement"), F.col("o_orderdate").alias("created_at"),
            pick(FAMILIES_OF, key).alias("role_family"), pick(SENIORITIES, key).alias("seniority_level"), pick(INDUSTRIES, key).alias("industry"),
            F.coalesce("required_skills", F.array().cast("array<string>")).alias("required_skills"),
            F.coalesce("preferred_skills", F.array().cast("array<string>")).alias("preferred_skills"),
            F.filter(F.array(pick(SCHOOLS, key)), lambda x: x != "").alias("required_education"),
            F.filter(F.array(pick(SCHOOLS, key + 2)), lambda x: x != "").alias("preferred_education"),
            F.when(key % 3 != 0, (F.col("o_custkey") % 7).cast("int")).alias("min_years"), F.lit(None).cast("int").alias("max_years"),
            F.array().cast("array<string>").alias("responsibilities"), F.array().cast("array<string>").alias("certifications"),
            pick(AUTHORIZATIONS, key).alias("work_authorization"),
            F.when(key % 10 == 0, F.array(F.lit("Active clearance"))).otherwise(F.array().cast("array<string>")).alias("hard_disqualifiers"), F.lit("").alias("notes"),
        )
    )
    posting = rows.select("job_id", "scope", "title", "company", "location", "description", "employment_type", "work_arrangement", "created_at")
    requirement = rows.drop("scope", "title", "company", "location", "description", "employment_type", "work_arrangement", "created_at")
    return posting, requirement


def held_phrases(spark, sf):
    """The phrases each (nation, segment) spent most on, best first."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    spent = (
        lines.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("scope"), "c_mktsegment", phrase_of(F.col("l_partkey")).alias("evidence"))
        .agg(F.round(F.sum("l_quantity"), 2).alias("spent"))
    )
    ranked = top_k(spent, ["scope", "c_mktsegment"], [F.desc("spent"), F.col("evidence")], SKILLS_HELD, "position")
    segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")) - 1
    return ranked.select("scope", (F.col("scope") * 5 + segment).cast("long").alias("profile_id"), "position", "evidence")


def profiles(spark, sf):
    """25 nations x 5 segments: 125 rows at any scale."""
    skills = held_phrases(spark, sf).groupBy("scope", "profile_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "evidence"))), lambda x: x["evidence"]).alias("skills")
    )
    n, s = F.col("profile_id"), F.col("profile_id") % 5
    nation = table(spark, sf, "nation")
    none = F.array().cast("array<string>")
    return skills.join(nation, F.col("scope") == F.col("n_nationkey")).select(
        "scope", "profile_id", "skills", F.lit("").alias("full_name"), pick(SCHOOLS, n).alias("education_summary"),
        pick_list(ROLES, s).alias("target_roles"), pick_list(WANTED_INDUSTRIES, s).alias("target_industries"),
        pick(("entry_level", "early_career", "mid_level", "senior"), n).alias("experience_level"),
        F.when(n % 2 == 0, F.array("n_name", F.lit("Remote - anywhere"))).otherwise(F.array("n_name")).alias("preferred_locations"),
        pick(("flexible", "onsite", "hybrid", "remote"), n).alias("preferred_arrangement"), pick(EMPLOYMENTS, n).alias("preferred_employment"),
        F.when(n % 3 == 0, "Requires sponsorship").otherwise("").alias("work_authorization"), none.alias("priorities"),
        F.when(n % 5 == 0, F.array(F.lit("retail"))).otherwise(none).alias("deal_breakers"), F.lit("Built a Django web application").alias("additional_context"),
    )


def matched(spark, sf, layers=4, carry=()):
    posting, requirement = jobs(spark, sf)
    return match(posting, requirement, profiles(spark, sf), layers=layers, carry=carry)


@query("mat_ranked_dashboard")
def ranked(spark, sf):
    """All postings of all orders scored by all four layers, every pair with its rank (SRT-01)."""
    rows = matched(spark, sf, carry=("created_at",))
    rows = rows.select("job_id", "profile_id", "score", "coverage", "classification", "track", "has_requirements", "created_at", F.lit(False).alias("blind"))
    # Ranges are sampled before rows are dealt out: the pairs are scored once for both.
    rows = kept(rows, "scored")
    ranked_pairs = L.ranked_rows(rows, "match_high", False)
    return ranked_pairs.select("rank", "job_id", "profile_id", "score", "coverage", "classification", "track")


def _summary(rows):
    return rows.groupBy("profile_id", "classification", "track").agg(
        F.count("*").alias("pairs"), F.sum("score").cast("long").alias("score_sum"), F.sum("coverage").cast("long").alias("coverage_sum"),
        F.sum(F.size("direct")).cast("long").alias("direct"), F.sum(F.size("related")).cast("long").alias("related"),
        F.sum(F.size("semantic")).cast("long").alias("semantic"), F.sum(F.size("gaps")).cast("long").alias("gaps"),
        F.sum(F.size("confirmed_blockers")).cast("long").alias("blockers"),
    )


@query("mat_1_base_matcher")
def mat_1(spark, sf):
    return _summary(matched(spark, sf, 1))


@query("mat_2_industry_first")
def mat_2(spark, sf):
    return _summary(matched(spark, sf, 2))


@query("mat_3_software_path")
def mat_3(spark, sf):
    return _summary(matched(spark, sf, 3))


@query("mat_4_semantic_credit")
def mat_4(spark, sf):
    return _summary(matched(spark, sf, 4))


# ---------------------------------------------------------------- JOIN-03 against brute force SQL
_V = Vocabulary()
_PH = "ph(l) AS (SELECT [" + ", ".join(f"'{p}'" for p in PHRASES) + "])"
_SIZE = len(PHRASES)
_REL = ", ".join(f"('{a}', '{b}', {s}::DOUBLE)" for a, b, s in _V.relation_rows(False))
_LABELS = ", ".join(f"('{n}', '{_V.concepts[n][0]}')" for n in _V.names(False))
HELD = f"""{_PH}, spent AS (SELECT c_nationkey AS scope, c_mktsegment, l[l_partkey % {_SIZE} + 1] AS evidence, round(sum(l_quantity), 2) AS spent
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey, ph GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scope, c_mktsegment ORDER BY spent DESC, evidence) AS position FROM spent),
held AS (SELECT scope, scope * 5 + list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) - 1 AS profile_id, position, evidence FROM ranked WHERE position <= {SKILLS_HELD}),
needs AS (SELECT DISTINCT c_nationkey AS scope, l[l_partkey % {_SIZE} + 1] || CASE WHEN l_linenumber % 3 = 0 THEN ' for ' || lower(c_mktsegment) ELSE '' END AS requirement
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey, ph)"""
SCAN = f"""{HELD}, texts AS (SELECT requirement AS x FROM needs UNION SELECT evidence FROM held), normed AS (SELECT x, {NORM.format(c='x')} AS t FROM texts),
feat AS (SELECT x, t, list_filter(string_split({_tag_sql({n: _V.concepts[n][1] for n in _V.names(False)}, False)}, ','), lambda c: c <> '') AS cs,
  list_distinct(list_filter(string_split(t, ' '), lambda w: len(w) > 2)) AS ts FROM normed),
rel(a, b, s) AS (VALUES {_REL}), lab(c, label) AS (VALUES {_LABELS}),
p AS (SELECT n.scope, n.requirement, h.profile_id, h.position, h.evidence, f.t AS rt, f.cs AS rc, f.ts AS rts, g.t AS et, g.cs AS ec, g.ts AS ets
  FROM needs n JOIN held h ON n.scope = h.scope JOIN feat f ON f.x = n.requirement JOIN feat g ON g.x = h.evidence),
dir AS (SELECT scope, requirement, profile_id, min_by(struct_pack(evidence := evidence, exact := exact, c := shared), position) AS hit FROM (
  SELECT *, (rt = et OR (len(rt) >= 5 AND contains(et, rt)) OR (len(et) >= 5 AND contains(rt, et))) AS exact, list_sort(list_intersect(rc, ec))[1] AS shared FROM p)
  WHERE exact OR shared IS NOT NULL GROUP BY 1, 2, 3),
ev AS (
  SELECT scope, requirement, profile_id, position, 0 AS kind, a, b, s AS raw, s AS stored, evidence FROM (SELECT *, unnest(rc) AS a FROM p) q JOIN rel USING (a) WHERE list_contains(ec, b)
  UNION ALL SELECT scope, requirement, profile_id, position, 1, '', '', j, least(0.75, j), evidence FROM (
    SELECT *, len(list_intersect(rts, ets))::DOUBLE / nullif(len(list_distinct(list_concat(rts, ets))), 0) AS j FROM p) WHERE j >= 0.6 AND len(rts) > 0 AND len(ets) > 0),
fold AS (SELECT scope, requirement, profile_id, list_reduce(list_prepend(struct_pack(raw := 0.0::DOUBLE, stored := 0.0::DOUBLE, kind := 0, a := '', b := '', evidence := ''),
  list(struct_pack(raw := raw, stored := stored, kind := kind, a := a, b := b, evidence := evidence) ORDER BY position, kind, a, b)),
  lambda acc, y: CASE WHEN y.raw > acc.stored THEN y ELSE acc END) AS hit FROM ev GROUP BY 1, 2, 3)
SELECT d.scope, d.requirement, d.profile_id, 'direct' AS match_type, hit.evidence AS evidence, CASE WHEN hit.exact THEN 'Exact vocabulary' ELSE (SELECT label FROM lab WHERE lab.c = hit.c) END AS concept, 1.0::DOUBLE AS strength FROM dir d
UNION ALL SELECT f.scope, f.requirement, f.profile_id, 'related', hit.evidence, CASE WHEN hit.kind = 1 THEN 'Shared technical vocabulary' ELSE
  (SELECT label FROM lab WHERE lab.c = hit.a) || ' ↔ ' || (SELECT label FROM lab WHERE lab.c = hit.b) END, hit.stored FROM fold f ANTI JOIN dir d ON f.scope = d.scope AND f.requirement = d.requirement AND f.profile_id = d.profile_id"""


def needs(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    tail = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" for "), F.lower("c_mktsegment"))).otherwise("")
    return rows.select(F.col("c_nationkey").alias("scope"), F.concat(phrase_of(F.col("l_partkey")), tail).alias("requirement")).distinct()


@query("join_03_best_evidence", "WITH " + SCAN)
def join_03(spark, sf):
    """Row-local scan: each distinct text against the lists of its scope's profiles."""
    role = F.lit(False)
    lists = held_phrases(spark, sf).groupBy("scope", "profile_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "evidence"))), lambda x: x["evidence"]).alias("items")
    )
    held = lists.select("scope", "profile_id", text_features(F.col("items"), _V, role).alias("held"))
    asked = spread(needs(spark, sf), "scope", "requirement").withColumn("need", F.get(text_features(F.array("requirement"), _V, role), F.lit(0)))
    rows = fence(with_scan(asked.join(held, "scope"), "need", "held", _V, "hit"), "texts_scanned")
    return rows.select("scope", "requirement", "profile_id", "hit.*").where("match_type <> 'missing'")


@query("join_03_best_evidence_by_joins", "WITH " + SCAN)
def join_03_joins(spark, sf):
    """The same by block-key joins, for evidence in large tables."""
    return best_evidence(needs(spark, sf), held_phrases(spark, sf), FixedTags(_V), ("scope",))


@query("join_03_table_vocabulary", f"""WITH sales AS (
  SELECT c_nationkey AS scope, c_mktsegment, p_name, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
top AS (SELECT *, row_number() OVER (PARTITION BY scope, p_name ORDER BY q DESC, c_mktsegment) AS rn FROM sales),
held AS (SELECT scope, c_mktsegment AS profile_id, p_name AS evidence, row_number() OVER (PARTITION BY scope, c_mktsegment ORDER BY q DESC, p_name) AS position FROM top WHERE rn = 1),
needs AS (SELECT DISTINCT c_nationkey AS scope, p_brand || ' ' || p_name AS requirement, p_name AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
names AS (SELECT DISTINCT p_name AS c FROM part), rc AS (SELECT scope, requirement, c FROM needs JOIN names ON contains(requirement, c)),
hc AS (SELECT held.*, c FROM held JOIN names ON contains(evidence, c)),
p AS (SELECT n.scope, n.requirement, h.profile_id, h.evidence, h.position, CASE WHEN n.c = h.c THEN 1.0 WHEN split_part(h.c, ' ', 2) = split_part(n.c, ' ', 2) THEN 0.65
  WHEN split_part(h.c, ' ', 1) = split_part(n.c, ' ', 1) THEN 0.55 END AS s FROM rc n JOIN hc h ON n.scope = h.scope)
SELECT scope, requirement, profile_id, CASE WHEN max(s) = 1.0 THEN 'direct' ELSE 'related' END AS match_type, min_by(evidence, struct_pack(a := -s, b := position)) AS evidence, max(s)::DOUBLE AS strength
FROM p WHERE s IS NOT NULL GROUP BY 1, 2, 3""")
def join_03_table(spark, sf):
    """Concepts and relations taken from the parts: same name direct, same noun 0.65, same first word 0.55."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sales = rows.groupBy(F.col("c_nationkey").alias("scope"), "c_mktsegment", "p_name").agg(F.sum("l_quantity").alias("q"))
    best = top_k(sales, ["scope", "p_name"], [F.desc("q"), F.col("c_mktsegment")], 1)
    # At most one row per (scope, name), so a group is as long as there are names.
    turn = F.row_number().over(W.partitionBy("scope", "c_mktsegment").orderBy(F.desc("q"), "p_name"))
    held = best.select("scope", F.col("c_mktsegment").alias("profile_id"), F.col("p_name").alias("evidence"), turn.alias("position"))
    asked = rows.select(F.col("c_nationkey").alias("scope"), F.concat_ws(" ", "p_brand", "p_name").alias("requirement")).distinct()
    names = table(spark, sf, "part").select(F.col("p_name").alias("concept")).distinct()
    words = names.select("concept", F.split_part(F.col("concept"), F.lit(" "), F.lit(1)).alias("first"), F.split_part(F.col("concept"), F.lit(" "), F.lit(2)).alias("noun"))
    other = words.select(F.col("concept").alias("held"), "first", "noun")
    pairs = lambda by, s: words.join(other, by).where("concept <> held").select(F.col("concept").alias("required"), "held", F.lit(s).alias("strength"))
    related = pairs("noun", 0.65).unionByName(pairs("first", 0.55))
    tags = TableTags(names.select("concept", F.col("concept").alias("alias")), related)
    return best_evidence(asked, held, tags, ("scope",)).drop("concept")


@query("join_05_symmetric_relations", """WITH w AS (SELECT DISTINCT p_brand AS a, p_type AS b, min(p_size) AS s FROM part GROUP BY 1, 2), u AS (SELECT a, b, s FROM w UNION ALL SELECT b, a, s FROM w)
SELECT a AS required, b AS held, CAST(max(s) AS DOUBLE) AS strength FROM u GROUP BY 1, 2""")
def join_05(spark, sf):
    rows = table(spark, sf, "part").groupBy(F.col("p_brand").alias("required"), F.col("p_type").alias("held")).agg(F.min("p_size").cast("double").alias("strength"))
    return symmetric_relations(rows)


@query("join_04_table_tags", """WITH t AS (SELECT DISTINCT lower(p_brand || ' ' || p_name || ' ' || p_type) AS norm FROM part), a AS (SELECT DISTINCT p_name AS alias FROM part UNION SELECT DISTINCT lower(p_type) FROM part)
SELECT norm, alias AS concept FROM t JOIN a ON contains(norm, alias)""")
def join_04_table(spark, sf):
    part = table(spark, sf, "part")
    texts = part.select(normalize_text(F.concat_ws(" ", "p_brand", "p_name", "p_type")).alias("norm")).distinct()
    names = part.select(F.col("p_name").alias("alias")).union(part.select(F.lower("p_type"))).distinct()
    return tag_with_table(texts, "norm", names.select(F.col("alias").alias("concept"), "alias"))


# ---------------------------------------------------------------- JOIN-08 against SQL
SIMILAR = f"""{HELD}, texts AS (SELECT requirement AS x FROM needs UNION SELECT evidence FROM held), normed AS (SELECT x, {NORM.format(c='x')} AS t FROM texts),
base AS (SELECT x, list_filter(string_split({_tag_sql({n: _V.families[n][1] for n in _V.families}, True)}, ','), lambda c: c <> '') AS fs,
  list_transform(list_filter(string_split(t, ' '), lambda w: len(w) > 2 AND w NOT IN ({STOPS})), lambda w: {STEM}) AS ts FROM normed),
occ AS (SELECT x, 'token:' || unnest(ts) AS term, 1.0::DOUBLE AS w FROM base
  UNION ALL SELECT x, 'bigram:' || unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || '_' || ts[i + 1])), {BIGRAM_WEIGHT}::DOUBLE FROM base
  UNION ALL SELECT x, 'family:' || unnest(fs), {FAMILY_WEIGHT}::DOUBLE FROM base),
vec AS (SELECT x, term, sum(w) AS w FROM occ GROUP BY 1, 2), nrm AS (SELECT x, sqrt(sum(w * w)) AS n FROM vec GROUP BY 1),
dots AS (SELECT a.x AS r, b.x AS e, sum(a.w * b.w) AS dot FROM vec a JOIN vec b ON a.term = b.term GROUP BY 1, 2),
sims AS (SELECT r, e, dot / (m.n * k.n) AS sim, len(list_intersect(br.fs, be.fs)) > 0 AS fam FROM dots JOIN nrm m ON m.x = r JOIN nrm k ON k.x = e JOIN base br ON br.x = r JOIN base be ON be.x = e),
good AS (SELECT r, e, sim, least(0.65, 0.34 + 0.42 * sim) AS strength FROM sims WHERE sim >= CASE WHEN fam THEN 0.48 ELSE 0.62 END)"""


@query("fn_13_similar_texts", f"WITH {SIMILAR} SELECT DISTINCT g.r AS requirement, g.e AS evidence, round(g.sim, 6) AS similarity, round(g.strength, 6) AS strength FROM good g JOIN needs n ON n.requirement = g.r JOIN held h ON h.evidence = g.e")
def fn_13(spark, sf):
    rows = similar_texts(needs(spark, sf), held_phrases(spark, sf), _V, ())
    return rows.select("requirement", "evidence", F.round("similarity", 6).alias("similarity"), F.round("strength", 6).alias("strength"))


@query("join_08_best_semantic", f"""WITH {SIMILAR}, c AS (SELECT n.scope, n.requirement, h.profile_id, h.position, h.evidence, round(strength, 9) AS strength FROM needs n JOIN held h ON n.scope = h.scope JOIN good g ON g.r = n.requirement AND g.e = h.evidence)
SELECT scope, requirement, profile_id, min_by(evidence, struct_pack(a := -strength, b := position)) AS evidence, round(max(strength), 6) AS strength FROM c GROUP BY 1, 2, 3""")
def join_08(spark, sf):
    held = held_phrases(spark, sf)
    gaps = needs(spark, sf).join(held.select("scope", "profile_id").distinct(), "scope")
    return best_semantic(gaps, held, _V, ("scope",)).select("scope", "requirement", "profile_id", "evidence", F.round("strength", 6).alias("strength"))


# ---------------------------------------------------------------- parts of the score
@query("set_01_evidence_pool", f"""WITH {HELD} SELECT profile_id, CAST(position - 1 AS INTEGER) AS position, evidence FROM held
UNION ALL SELECT profile_id, CAST(count(*) AS INTEGER), 'last wish' FROM held GROUP BY 1""")
def set_01(spark, sf):
    rows = profiles(spark, sf).withColumn("priorities", F.array(F.lit("last wish")))
    return pool(rows, "skills", F.col("skills"), F.col("priorities")).select("profile_id", "position", "evidence")


@query("join_02_profile_pairs", """WITH p AS (SELECT DISTINCT c_nationkey AS scope, list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) - 1 AS s
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey AS job_id, CAST(scope * 5 + s AS BIGINT) AS profile_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN p ON c_nationkey = scope""")
def join_02(spark, sf):
    posting, _ = jobs(spark, sf)
    return posting.select("job_id", "scope").join(profiles(spark, sf).select("scope", "profile_id"), "scope").select("job_id", "profile_id")


LINES = """items AS (SELECT l_orderkey AS job_id, l_returnflag AS category, CASE WHEN l_quantity >= 40 THEN 'direct' WHEN l_quantity >= 25 THEN 'related' WHEN l_quantity >= 20 THEN 'semantic' ELSE 'missing' END AS match_type,
  CASE WHEN l_quantity >= 40 THEN 1.0 WHEN l_quantity >= 25 THEN 0.5 WHEN l_quantity >= 20 THEN 0.25 ELSE 0.0 END::DOUBLE AS strength FROM lineitem)"""


@query("agg_01_requirement_coverage", f"""WITH {LINES} SELECT job_id, category, avg(strength) AS fraction, count(*) FILTER (match_type = 'direct') AS direct, count(*) FILTER (match_type = 'related') AS related,
  count(*) FILTER (match_type = 'semantic') AS semantic, count(*) FILTER (match_type = 'missing') AS missing FROM items GROUP BY 1, 2""")
def agg_01(spark, sf):
    q = F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("category"),
        F.when(q >= 40, "direct").when(q >= 25, "related").when(q >= 20, "semantic").otherwise("missing").alias("match_type"),
        F.when(q >= 40, 1.0).when(q >= 25, 0.5).when(q >= 20, 0.25).otherwise(0.0).alias("strength"),
    )
    return P.requirement_coverage(rows, ["job_id", "category"])


@query("agg_02_weighted_score_rows", """SELECT l_orderkey AS job_id, CASE WHEN sum(CASE WHEN l_tax > 0.02 THEN l_quantity ELSE 0 END) > 0 THEN
  CAST(round_even(100 * sum(CASE WHEN l_tax > 0.02 THEN l_quantity * l_discount ELSE 0 END) / sum(CASE WHEN l_tax > 0.02 THEN l_quantity ELSE 0 END), 0) AS INTEGER) ELSE 0 END AS score,
  CAST(round_even(sum(CASE WHEN l_tax > 0.02 THEN l_quantity ELSE 0 END), 0) AS INTEGER) AS coverage FROM lineitem GROUP BY 1""")
def agg_02(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_quantity").alias("weight"), (F.col("l_quantity") * F.col("l_discount")).alias("earned"), (F.col("l_tax") > 0.02).alias("available")
    )
    return P.weighted_score_rows(rows, ["job_id"])


@query("agg_03_education_parts", """SELECT o_orderkey AS job_id, CASE WHEN a OR b THEN round((CASE WHEN a THEN 0.8 * x ELSE 0 END + CASE WHEN b THEN 0.2 * y ELSE 0 END) / (CASE WHEN a THEN 0.8 ELSE 0 END + CASE WHEN b THEN 0.2 ELSE 0 END), 6) ELSE 0.0 END AS fraction, a OR b AS available
FROM (SELECT o_orderkey, o_orderkey % 3 <> 0 AS a, o_orderkey % 4 <> 0 AS b, (o_orderkey % 11) / 10.0::DOUBLE AS x, (o_orderkey % 7) / 6.0::DOUBLE AS y FROM orders)""")
def agg_03(spark, sf):
    k = F.col("o_orderkey")
    fraction, on = P.two_part((k % 11) / 10, k % 3 != 0, (k % 7) / 6, k % 4 != 0, (0.8, 0.2))
    return table(spark, sf, "orders").select(k.alias("job_id"), F.round(fraction, 6).alias("fraction"), on.alias("available"))


@query("agg_04_location_arrangement", """WITH r AS (SELECT o_orderkey AS job_id, (['onsite','hybrid','remote','unknown'])[o_orderkey % 4 + 1] AS a, (['flexible','onsite','hybrid','remote'])[o_custkey % 4 + 1] AS p, o_orderkey % 5 <> 0 AS loc, (o_orderkey % 3) / 2.0::DOUBLE AS ls FROM orders),
s AS (SELECT *, CASE WHEN p = 'flexible' OR p = a THEN 1.0 WHEN (p = 'hybrid' AND a = 'onsite') OR (p = 'onsite' AND a = 'hybrid') THEN 0.6 ELSE 0.0 END AS st, a <> 'unknown' AS on2 FROM r)
SELECT job_id, CASE WHEN loc OR on2 THEN round((CASE WHEN loc THEN 0.4 * ls ELSE 0 END + CASE WHEN on2 THEN 0.6 * st ELSE 0 END) / (CASE WHEN loc THEN 0.4 ELSE 0 END + CASE WHEN on2 THEN 0.6 ELSE 0 END), 6) ELSE 0.0 END AS fraction, loc OR on2 AS available FROM s""")
def agg_04(spark, sf):
    k = F.col("o_orderkey")
    desk = P.arrangement_match(pick(ARRANGEMENTS, k), pick(("flexible", "onsite", "hybrid", "remote"), F.col("o_custkey")))
    fraction, on = P.two_part((k % 3) / 2, k % 5 != 0, desk["strength"], desk["available"], (0.4, 0.6))
    return table(spark, sf, "orders").select(k.alias("job_id"), F.round(fraction, 6).alias("fraction"), on.alias("available"))


@query("fn_29_experience", """WITH r AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 7 END AS y, (['unknown','internship','entry_level','early_career','mid_level','senior','lead_manager'])[o_orderkey % 7 + 1] AS s,
  (['entry_level','early_career','mid_level','senior'])[o_custkey % 4 + 1] AS l, ([1, 3, 6, 12])[o_custkey % 4 + 1] AS have, o_custkey % 4 + 1 AS li FROM orders)
SELECT job_id, CASE WHEN y IS NOT NULL THEN CASE WHEN y <= have THEN 1.0 WHEN y = have + 1 THEN 0.6 ELSE 0.0 END ELSE
  CASE s WHEN 'internship' THEN 1.0 WHEN 'entry_level' THEN 1.0 WHEN 'early_career' THEN ([0.7, 1.0, 1.0, 1.0])[li] WHEN 'mid_level' THEN ([0.2, 0.5, 1.0, 1.0])[li]
    WHEN 'senior' THEN ([0.0, 0.2, 0.6, 1.0])[li] WHEN 'lead_manager' THEN ([0.0, 0.1, 0.5, 0.85])[li] ELSE 0.0 END END::DOUBLE AS fraction, y IS NOT NULL OR s <> 'unknown' AS available FROM r""")
def fn_29(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    e = P.experience_match(F.when(k % 3 != 0, c % 7), pick(SENIORITIES, k), pick(("entry_level", "early_career", "mid_level", "senior"), c))
    return table(spark, sf, "orders").select(k.alias("job_id"), e["fraction"].alias("fraction"), e["available"].alias("available"))


@query("fn_31_classification", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0.08 THEN 'DISQUALIFIED' WHEN l_quantity < 10 THEN 'LOW CONFIDENCE' WHEN l_discount * 1000 >= 80 THEN 'STRONG MATCH'
  WHEN l_discount * 1000 >= 65 THEN 'GOOD MATCH' WHEN l_discount * 1000 >= 50 THEN 'POSSIBLE MATCH' ELSE 'WEAK MATCH' END AS classification FROM lineitem""")
def fn_31(spark, sf):
    lines = table(spark, sf, "lineitem")
    coverage = F.when(F.col("l_quantity") < 10, 10).otherwise(90)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", P.classify(F.col("l_discount") * 1000, coverage, F.col("l_tax") == 0.08).alias("classification"))


@query("join_14_blockers", """SELECT o_orderkey AS job_id, CAST(contains(lower(o_orderpriority || ' ' || c_mktsegment), 'low building') AS INTEGER) + CAST(contains(lower(o_orderpriority || ' ' || c_mktsegment), 'urgent') AS INTEGER) AS deal_breakers,
  o_custkey % 3 = 0 AND o_orderkey % 4 IN (1, 3) AS sponsorship_conflict FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_14(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = P.searchable_text(F.concat_ws(" ", "o_orderpriority", "c_mktsegment"))
    breakers = F.array(F.lit("Low / Building"), F.lit("URGENT!"), F.lit("--"))
    wants = P.needs_sponsorship(F.when(F.col("o_custkey") % 3 == 0, "Requires sponsorship").otherwise(""))
    return rows.select(
        F.col("o_orderkey").alias("job_id"), F.size(P.deal_breaker_hits(breakers, text)).alias("deal_breakers"),
        (wants & P.denies_sponsorship(pick(AUTHORIZATIONS, F.col("o_orderkey")))).alias("sponsorship_conflict"),
    )


@query("join_11_broad_relevance", """WITH r AS (SELECT o_orderkey AS opp_id, c_nationkey % 5 AS s, lower(c_mktsegment) AS title, lower(n_name) AS place, (['onsite','hybrid','remote','unknown'])[o_orderkey % 4 + 1] AS desk, (['full time','part time','contract'])[o_orderkey % 3 + 1] AS hours
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT *, (s = 0 AND title = 'building') OR (s = 1 AND contains('machinery and tools', title)) AS role, s = 2 AND contains(title, 'house') AS ind FROM r)
SELECT opp_id, CASE WHEN role OR ind THEN 'broad_match' WHEN s = 4 THEN 'unknown' WHEN s = 3 AND desk = 'remote' AND hours = 'full time' THEN 'broad_match' ELSE 'outside' END AS relevance FROM p""")
def join_11(spark, sf):
    rows = (
        table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    opportunities = rows.select(
        F.col("o_orderkey").alias("opp_id"), F.col("c_nationkey").alias("searcher"), F.col("c_mktsegment").alias("title_hint"), F.col("c_mktsegment").alias("industry_hint"),
        F.col("n_name").alias("location_hint"), pick(ARRANGEMENTS, F.col("o_orderkey")).alias("arrangement_hint"), pick(("full_time", "part_time", "contract"), F.col("o_orderkey")).alias("employment_hint"),
    )
    n = F.col("n_nationkey") % 5
    none = F.array().cast("array<string>")
    wanted = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("searcher"), F.when(n == 0, F.array(F.lit("Building!"))).when(n == 1, F.array(F.lit("Machinery and tools"))).otherwise(none).alias("target_roles"),
        F.when(n == 2, F.array(F.lit("house"))).otherwise(none).alias("target_industries"), none.alias("preferred_locations"),
        F.when(n == 3, "remote").otherwise("flexible").alias("preferred_arrangement"), F.when(n == 3, "full_time").otherwise("").alias("preferred_employment"),
    )
    return D.relevance(opportunities, wanted, ("searcher",)).select("opp_id", "relevance")


@query("flt_11_gap_eligibility", """SELECT l_orderkey, l_linenumber, l_partkey, kind FROM (SELECT *, (['role','required_skill','experience','industry','location','preferred_skill'])[l_linenumber % 6 + 1] AS kind FROM lineitem)
WHERE kind IN ('role','required_skill','preferred_skill','required_education','preferred_education','industry')""")
def flt_11(spark, sf):
    label = pick(("Role: x", "Need", "Experience: 3 years", "Industry: x", "Location: x", "Nice"), F.col("l_linenumber"))
    rows = table(spark, sf, "lineitem").withColumn("requirement", label)
    kind = gap_kind(F.col("requirement"), F.array(F.lit("Need")), F.array(F.lit("Nice")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind")).where(F.col("kind").isin(*ELIGIBLE))


ELIGIBLE = ("role", "required_skill", "preferred_skill", "required_education", "preferred_education", "industry")


def gap_kind(label: Column, required: Column, preferred: Column) -> Column:
    """FLT-11: what a gap is about, from its label or the list it is in."""
    prefixes = {"Role:": "role", "Industry:": "industry", "Required education:": "required_education", "Preferred education:": "preferred_education"}
    kind = F.when(F.lit(False), "")
    for prefix, name in prefixes.items():
        kind = kind.when(label.startswith(prefix), name)
    for prefix in ("Experience:", "Location:", "Work arrangement:", "Employment type:"):
        kind = kind.when(label.startswith(prefix), "excluded")
    return kind.when(F.array_contains(required, label), "required_skill").when(F.array_contains(preferred, label), "preferred_skill").otherwise("excluded")
