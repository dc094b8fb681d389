"""Re-evaluation: only what changed is matched, and the current runs equal a match of everything."""

import os
import uuid

from people import POSTINGS, PROFILES, REQUIREMENTS, posting, profile, requirement
from pyspark.sql import functions as F

from tallymark.plans import reevaluate as R
from tallymark.plans.matcher import match
from tallymark.session import checkpoint_dir


def state(spark, title="Systems Engineer", skill="Python", extra=False, wish="Firmware Developer"):
    jobs = [posting(1, "Test Engineer"), posting(2, title), posting(3, "Quality Engineer")] + [posting(4, "Data Analyst")] * extra
    asks = [requirement(1, required_skills=["Python"]), requirement(2, required_skills=["ISO 13485", "welding"])]
    people = [profile(1, skills=[skill, "ISO 13485 basics"]), profile(2, target_roles=[wish])]
    return spark.createDataFrame(jobs, POSTINGS), spark.createDataFrame(asks, REQUIREMENTS), spark.createDataFrame(people, PROFILES)


def scored(tables, pairs):
    """A small stand-in for the matcher: the share of asked skills that the profile lists."""
    jobs, asks, people = tables
    rows = pairs.join(jobs, "job_id").join(asks, "job_id", "left").join(people.drop("scope"), "profile_id")
    asked = F.coalesce("required_skills", F.array().cast("array<string>"))
    hit = lambda x: F.array_contains("skills", x)
    entry = F.transform(asked, lambda x: F.struct(x.alias("requirement"), F.when(hit(x), x).otherwise("").alias("evidence"), F.when(hit(x), "direct").otherwise("missing").alias("match_type")))
    share = (100 * F.size(F.filter(asked, hit)) / F.greatest(F.size(asked), F.lit(1))).cast("int")
    return rows.select(*R.PAIR, (F.size(asked) > 0).alias("has_requirements"), share.alias("score"), F.size(asked).alias("coverage"), F.col("title").alias("classification"), F.array_join("target_roles", ",").alias("track"), entry.alias("evidence"))


def matcher(tables, asked):
    def evaluate(pairs):
        asked.append({tuple(r) for r in pairs.collect()})
        return scored(tables, pairs)

    return evaluate


def run(path, tables, version="v1", **more):
    asked = []
    R.reevaluate(path, R.fingerprinted_pairs(*tables), matcher(tables, asked), version, F.lit("2026-01-01").cast("timestamp"), buckets=4, **more)
    return asked[0] if asked else set()


def check(spark, path, tables):
    """One current run a pair, with the score that evaluating everything gives; earlier runs linked and closed."""
    rows = R.read_history(spark, path).collect()
    current = {(r["job_id"], r["profile_id"]): (r["score"], r["coverage"], r["classification"], r["track"]) for r in rows if r["is_current"]}
    whole = {(r["job_id"], r["profile_id"]): (r["score"], r["coverage"], r["classification"], r["track"]) for r in scored(tables, R.fingerprinted_pairs(*tables).select(*R.PAIR)).collect()}
    assert current == whole and len([r for r in rows if r["is_current"]]) == len(whole)
    for r in rows:
        assert r["previous_run"] == (r["run_no"] - 1 or None) and bool(r["stale_reasons"]) != r["is_current"]
    return {(r["job_id"], r["profile_id"], r["run_no"]): r for r in rows}


def test_only_changed_pairs_are_matched(spark):
    path = f"{checkpoint_dir(spark)}/test-evaluations-{uuid.uuid4().hex}"
    first = state(spark)
    everything = {(j, p) for j in (1, 2, 3) for p in (1, 2)}
    assert run(path, first) == everything
    check(spark, path, first)
    assert run(path, first) == set()

    changed = state(spark, title="Senior Systems Engineer", extra=True)
    assert run(path, changed) == {(2, 1), (2, 2), (4, 1), (4, 2)}
    rows = check(spark, path, changed)
    assert rows[2, 1, 1]["stale_reasons"] == ["Job details or structured requirements changed"]
    assert rows[4, 1, 1]["previous_run"] is None and (1, 1, 2) not in rows

    learned = state(spark, title="Senior Systems Engineer", extra=True, skill="Welding of pipes")
    assert run(path, learned) == {(j, 1) for j in (1, 2, 3, 4)}
    rows = check(spark, path, learned)
    assert rows[1, 1, 1]["stale_reasons"] == ["Candidate profile or manual preferences changed"]
    assert rows[1, 1, 2]["changes"]["removed_direct"] == ["python"] and rows[1, 1, 2]["changes"]["new_gap"] == ["python"]

    R.mark_stale(path, spark, spark.createDataFrame([(1, 2), (1, 2), (99, 9)], "job_id long, profile_id long"), "Asked by hand", buckets=4)
    rows = {(r["job_id"], r["profile_id"], r["run_no"]): r for r in R.read_history(spark, path).collect()}
    assert not rows[1, 2, 1]["is_current"] and rows[1, 2, 1]["stale_reasons"] == ["Asked by hand"]
    assert run(path, learned) == {(1, 2)}

    assert run(path, learned, version="v2") == {(j, p) for j in (1, 2, 3, 4) for p in (1, 2)}
    rows = check(spark, path, learned)
    assert rows[3, 2, 1]["stale_reasons"] == ["Matcher version changed"]
    run(path, learned, version="v2", everything=True)
    rows = check(spark, path, learned)
    assert rows[3, 2, 2]["stale_reasons"] == ["Superseded by a newer evaluation run"]


def test_the_matcher_takes_named_pairs_only(spark):
    tables = state(spark, extra=True)
    wanted = {(1, 1), (2, 2), (3, 1), (3, 2)}
    only = spark.createDataFrame(sorted(wanted), "job_id long, profile_id long")
    plain = lambda rows: {(r["job_id"], r["profile_id"]): (r["score"], r["coverage"], r["classification"], r["track"], sorted(map(str, r["direct"]))) for r in rows.collect()}
    everything = plain(match(*tables, layers=2))
    assert plain(match(*tables, layers=2, only=only)) == {k: v for k, v in everything.items() if k in wanted}


def test_runs_are_not_left_on_disk_twice(spark):
    """Each run's rows stayed in a folder beside the history."""
    path = f"{checkpoint_dir(spark)}/test-evaluations-{uuid.uuid4().hex}"
    folders = lambda: {d for d in os.listdir(checkpoint_dir(spark).removeprefix("file://")) if d.startswith("runs-")}
    before = folders()
    run(path, state(spark))
    run(path, state(spark, skill="Welding of pipes"))
    check(spark, path, state(spark, skill="Welding of pipes"))
    assert folders() == before
