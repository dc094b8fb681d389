import random
import re

from people import POSTINGS, PROFILES, REQUIREMENTS, posting, profile, requirement
from pyspark.sql import functions as F

from tallymark.functions.text import fold_literal
from tallymark.operators.evidence import FixedTags, best_evidence
from tallymark.operators.rowmatch import text_features, with_scan
from tallymark.operators.vocabulary import Vocabulary
from tallymark.plans import matcher
from tallymark.plans.matcher import evidence_rows, match

TOY = Vocabulary(
    concepts={"ax": ("Ax", ("axe", "hatchet")), "saw": ("Saw", ("saw", "sawing")), "oak": ("Oak", ("oak",))},
    relations={"ax": {"saw": 0.80, "oak": 0.40}, "oak": {"saw": 0.85}},
    families={},
)


def brute(requirement, evidence):
    """The scan rule in plain Python, for small lists."""
    tags = lambda t: {c for c, (_, al) in TOY.concepts.items() if any(
        (f" {a} " in f" {t} ") if len(a) <= 3 else a in t for a in al)}
    strong = {(a, b): s for a, b, s in TOY.relation_rows(False)}
    need, best = fold_literal(requirement), ("missing", "", 0.0)
    for text in evidence:
        have = fold_literal(text)
        if need and (need == have or (len(need) > 4 and need in have) or (len(have) > 4 and have in need)):
            return ("direct", text, 1.0)
        if tags(need) & tags(have):
            return ("direct", text, 1.0)
        for pair in sorted((a, b) for a in tags(need) for b in tags(have)):
            if strong.get(pair, 0) > best[2]:
                best = ("related", text, strong[pair])
        a, b = ({w for w in t.split() if len(w) > 2} for t in (need, have))
        share = len(a & b) / len(a | b) if a and b else 0.0
        if share >= 0.6 and share > best[2]:
            best = ("related", text, min(0.75, share))
    return best


def random_lists(seed):
    pick = random.Random(seed)
    words = ["axe", "sawing", "oak", "blue", "green", "river", "stone", "cloud", "paper", "grass"]
    text = lambda: " ".join(pick.sample(words, pick.choice((2, 3, 4, 5, 6))))
    return [text() for _ in range(25)], [text() for _ in range(14)]


def test_scan_equals_brute_force_in_both_forms(spark):
    for seed in (1, 2, 3):
        needs, held = random_lists(seed)
        want = {n: brute(n, held) for n in needs}
        left = spark.createDataFrame([("p", n) for n in needs], "pool string, requirement string")
        right = spark.createDataFrame([("p", 1, i, h) for i, h in enumerate(held)], "pool string, profile_id int, position int, evidence string")
        by_join = {r["requirement"]: (r["match_type"], r["evidence"], r["strength"]) for r in best_evidence(left, right, FixedTags(TOY)).collect()}
        rows = left.distinct().withColumn("need", F.get(text_features(F.array("requirement"), TOY, F.lit(False)), F.lit(0)))
        rows = rows.withColumn("held", text_features(F.array(*[F.lit(h) for h in held]), TOY, F.lit(False)))
        scanned = {r["requirement"]: (r["h"]["match_type"], r["h"]["evidence"], r["h"]["strength"]) for r in with_scan(rows, "need", "held", TOY, "h").collect()}
        for n in needs:
            assert scanned[n] == want[n], (seed, n)
            assert by_join.get(n, ("missing", "", 0.0)) == want[n], (seed, n)


def run(spark, reqs, layers=4, posts=None, **given):
    posts = posts or [posting(r[0], "Systems Test Engineer", "Boston, MA") for r in reqs]
    rows = match(
        spark.createDataFrame(posts, POSTINGS), spark.createDataFrame(reqs, REQUIREMENTS),
        spark.createDataFrame([profile(1, **given)], PROFILES), layers=layers,
    )
    return rows


def test_matcher_behaviour(spark):
    reqs = [
        requirement(1, industry="MedTech", required_skills=["V&V", "Python"], min_years=1),
        requirement(2, industry="Healthcare", required_skills=["latte art"], work_authorization="We cannot sponsor"),
        requirement(3, required_skills=["RTOS"], min_years=9),
        requirement(4),
    ]
    rows = run(spark, reqs, work_authorization="I require sponsorship").cache()
    got = {r["job_id"]: r for r in rows.collect()}
    assert got[4]["classification"] == "NEEDS REQUIREMENTS" and got[4]["score"] == 0
    assert got[2]["classification"] == "DISQUALIFIED"
    assert got[1]["track"] == "PRIORITY ROLE" and got[1]["classification"] in ("GOOD MATCH", "STRONG MATCH")
    kinds = {(r["job_id"], r["requirement"]): r for r in evidence_rows(rows).collect()}
    assert kinds[(1, "V&V")]["match_type"] == "related" and kinds[(1, "V&V")]["strength"] == 0.8
    assert kinds[(3, "RTOS")]["match_type"] == "semantic" and kinds[(3, "RTOS")]["strength"] <= 0.65
    # Semantic credit never reaches experience.
    assert kinds[(3, "Experience: 9+ years")]["match_type"] == "missing"


def test_matcher_does_not_depend_on_partitioning(spark):
    reqs = [requirement(i, industry="MedTech", required_skills=["CAD", "Python", "testing"][: i % 3 + 1]) for i in range(1, 7)]
    keep = lambda rows: sorted((r["job_id"], r["score"], r["track"]) for r in rows.collect())
    once = keep(run(spark, reqs))
    assert once == keep(run(spark, list(reversed(reqs))))


def test_common_texts_are_looked_up_and_rare_ones_joined_with_the_same_result(spark, monkeypatch):
    from tallymark.plans import matcher

    lists = (["CAD", "Python"], ["testing", None, "V&V"], ["CAD", "latte art", "CAD"], [])
    reqs = [requirement(i, industry="MedTech", required_skills=lists[i % 4], preferred_skills=lists[i % 3]) for i in range(1, 9)]
    rows = []
    for texts, uses in ((matcher.COMMON_TEXTS, 1), (2, 1), (matcher.COMMON_TEXTS, 10**6)):
        monkeypatch.setattr(matcher, "COMMON_TEXTS", texts)
        monkeypatch.setattr(matcher, "COMMON_USES", uses)
        rows.append(sorted(run(spark, reqs).toJSON().collect()))
    assert len(rows[0]) == 8 and rows[0] == rows[1] == rows[2]


def test_no_row_per_item_and_pair_is_shuffled_for_common_texts(spark, monkeypatch):
    from tallymark.plans import matcher

    monkeypatch.setattr(matcher, "COMMON_USES", 1, raising=False)
    rows = run(spark, [requirement(i, industry="MedTech", required_skills=["CAD", "Python"]) for i in range(1, 5)])
    # Before, items and pairs were both dealt out by posting and profile.
    assert not re.search(r"hashpartitioning\(job_id#\d+L?, profile_id#", rows._jdf.queryExecution().executedPlan().toString())


def mixed(spark):
    """Postings and profiles of many kinds, one of which asks for a skill that reads like another category's label."""
    pick = random.Random(11)
    skills = ["Python", "ISO 13485", "welding", "circuit design", "test fixtures", "validation of devices", "Java services", "data analysis", "", "technical documentation", "RTOS", "regression testing of scripts in labs"]
    schools = ["Electrical engineering degree", "BSc in Computer Science", "Biomedical engineering degree", "Nursing diploma"]
    some = lambda values, n: [pick.choice(values) for _ in range(pick.randrange(n))]
    titles = ["Systems Test Engineer", "Software Engineer", "Retail Manager", "Field Service Engineer", "Biomedical Engineer II", "Quality Analyst"]
    jobs, asks = [], []
    for i in range(60):
        jobs.append(posting(i, pick.choice(titles), location=pick.choice(["Boston", "Remote", ""]), description="A retail shop" if i % 7 == 0 else "", employment=pick.choice(["full_time", "contract", "unknown"]), arrangement=pick.choice(["hybrid", "onsite", "unknown"])))
        asks.append(requirement(
            i, role_family=pick.choice(["", "Test engineering", "Software development"]), seniority_level=pick.choice(["unknown", "entry_level", "senior"]),
            industry=pick.choice(["", "MedTech", "Healthcare", "Retail"]), required_skills=some(skills, 5) + ["Role: tester", "Industry: MedTech"] * (i % 10 == 3), preferred_skills=some(skills, 4),
            required_education=some(schools, 3), preferred_education=some(schools, 3), min_years=pick.choice([None, 1, 2, 9]), work_authorization=pick.choice(["", "No sponsorship available"]),
        ))
    people = [profile(
        k, skills=some(skills, 6) + ["Built test fixtures", "embedded firmware on microcontrollers", "scripts for labs regression"], target_roles=some(titles, 3), target_industries=some(["Medical devices", "Healthcare", "Retail"], 3), education_summary=pick.choice(["", *schools]),
        experience_level=pick.choice(["entry_level", "mid_level", "senior"]), preferred_locations=["Boston", "Remote - anywhere"][: k % 3], deal_breakers=["retail"] * (k % 2), work_authorization=pick.choice(["", "Requires sponsorship"]),
    ) for k in range(6)]
    return spark.createDataFrame(jobs, POSTINGS), spark.createDataFrame(asks, REQUIREMENTS), spark.createDataFrame(people, PROFILES)


def test_numbers_places_and_labels_score_alike(spark, monkeypatch):
    tables = mixed(spark)
    rows = lambda: sorted(map(str, matcher.match(*tables).collect()))
    monkeypatch.setattr(matcher, "COMMON_USES", 10)
    part = rows()
    monkeypatch.setattr(matcher, "COMMON_USES", 1)
    placed = rows()
    monkeypatch.setattr(matcher, "LABELS", ("",))
    assert len(part) == 360 and part == placed == rows()
    assert sum("match_type='semantic'" in r for r in part) > 20


def test_scores_alone_build_no_evidence(spark, monkeypatch):
    """The dashboard asks for scores: lists of evidence were built for every pair of it."""
    monkeypatch.setattr(matcher, "COMMON_USES", 1)
    spark.conf.set("spark.sql.debug.maxToStringFields", 2000)
    jobs, asks, people = mixed(spark)
    rows = match(jobs.where("job_id % 10 <> 3"), asks, people)
    plan = lambda *columns: rows.select(*columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "Software pathway into MedTech" in plan("job_id", "score", "related")
    assert "Software pathway into MedTech" not in plan("job_id", "score", "coverage", "classification", "track")
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_postings_columns_go_on_to_the_results(spark):
    tables = mixed(spark)
    rows = match(*tables, layers=1, carry=("title",)).select("job_id", "title").distinct()
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in tables[0].select("job_id", "title").collect()}
