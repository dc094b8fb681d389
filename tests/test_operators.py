import datetime as dt

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.operators import calibration as C
from tallymark.operators import claims as K
from tallymark.operators import discovery as D
from tallymark.operators import listing as L
from tallymark.operators import quality as Q
from tallymark.operators.ordered import latest_by_key, next_by_key, previous_by_key
from tallymark.plans.pages import interpret_pages
from tallymark.plans.resume import extract_documents
from tallymark.sources import cases, feeds, sinks


def test_neighbours_equal_the_plain_window_under_a_hot_key(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(F.lit(99)).alias("k"), (F.col("id") * 7919 % 4001).alias("t"), "id"
    )
    w = W.partitionBy("k").orderBy("t", "id")
    want = rows.select("id", F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("n"))
    got = previous_by_key(rows, ["k"], ["t", "id"], F.floor(F.col("t") / 100), ["id"], "a")
    got = next_by_key(got, ["k"], ["t", "id"], F.floor(F.col("t") / 100), ["id"], "b")
    assert got.select("id", F.col("a.id").alias("p"), F.col("b.id").alias("n")).exceptAll(want).isEmpty()
    last = latest_by_key(rows, ["k"], ["t", "id"])
    assert last.count() == rows.select("k").distinct().count()


def test_freshness_rules(spark):
    day = dt.date(2026, 1, 10)
    rows = spark.createDataFrame(
        [(1, "open", "confirmed", day - dt.timedelta(1), day), (2, "open", "rolling", None, day - dt.timedelta(8)),
         (3, "open", "rolling", None, day - dt.timedelta(7)), (4, "unverified", "confirmed", day + dt.timedelta(1), None)],
        "job_id int, listing_status string, deadline_status string, application_deadline date, listing_last_verified date",
    )
    got = {r["job_id"]: r for r in L.listing_state(rows, "2026-01-10").collect()}
    assert got[1]["effective_status"] == "expired" and got[1]["deadline_label"] == "Expired 1 day ago"
    assert got[2]["needs_verification"] and not got[3]["needs_verification"]
    assert got[4]["due_soon"] and got[4]["deadline_label"] == "Deadline tomorrow"


def test_reconcile_seen_again_gone_and_failed_source(spark):
    seen = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("s", "a", 3), ("f", "c", 1)], "source_key string, external_id string, run_at int")
    fetch = spark.createDataFrame([("s", 1, "success"), ("s", 2, "success"), ("s", 3, "success"), ("f", 1, "success"), ("f", 2, "failed")], "source_key string, run_at int, status string")
    got = {r["external_id"]: r for r in D.reconcile(seen, fetch).collect()}
    assert got["a"]["is_active"] and got["b"]["closed_at"] == 2 and got["c"]["is_active"]


def test_reconcile_step(spark):
    t = dt.datetime(2026, 1, 1)
    prior = spark.createDataFrame([("s", "a", True, t, None), ("s", "b", True, t, None), ("f", "c", True, t, None)], "source_key string, external_id string, is_active boolean, last_seen_at timestamp, closed_at timestamp")
    current = spark.createDataFrame([("s", "a")], "source_key string, external_id string")
    ok = spark.createDataFrame([("s",)], "source_key string")
    rows = D.reconcile_step(prior, current, ok, "2026-01-02").collect()
    state = {(r["external_id"], r["is_active"]): r for r in rows}
    assert ("a", False) in state and ("a", True) in state and state[("b", False)]["closed_at"] is not None
    assert state[("c", True)]["closed_at"] is None


PAGE = "page_id int, title string, company string, final_url string, status_code int, content_type string, body string"
LD = (
    '<html><head><meta charset="utf-8"><title>Test Engineer - Helix</title><script type="application/ld+json">'
    '{"@graph":[{"@type":"JobPosting","title":"Test Engineer","hiringOrganization":{"name":"Helix Inc"},'
    '"validThrough":"%s","directApply":true}]}</script></head><body><h1>Test Engineer</h1>%s</body></html>'
)


def test_page_states(spark):
    url = "https://helix.example/jobs/17"
    rows = [
        (1, "Test Engineer", "Helix", url, 200, "text/html", LD % ("2030-01-01", "<a href='/apply/1'>Apply now</a>")),
        (2, "Test Engineer", "Helix", url, 200, "text/html", LD % ("2020-01-01", "")),
        (3, "Test Engineer", "Helix", url, 200, "text/html", LD % ("", "This position has been filled")),
        (4, "Test Engineer", "Helix", url, 404, "text/html", "<p>gone</p>"),
        (5, "Test Engineer", "Helix", "https://helix.example/careers", 200, "text/html", "<title>Careers</title><p>Search all jobs</p>"),
        (6, "Test Engineer", "Helix", url, 200, "text/html", "<h1>Test Engineer</h1><p>Helix</p>"),
    ]
    got = {r["page_id"]: r for r in interpret_pages(spark.createDataFrame(rows, PAGE), "2026-01-01").collect()}
    assert [got[i]["listing_status"] for i in range(1, 7)] == ["open", "expired", "closed", "link_broken", "wrong_page", "unverified"]
    assert got[1]["confidence"] == "high" and got[1]["deadline_status"] == "confirmed"


def test_one_item_cannot_match_twice(spark):
    rows = spark.createDataFrame([("Python\nSQL", "Python\npython!\nHaskell")], "expected string, actual string")
    got = Q.compare_lists(rows).collect()[0]
    assert got["status"] == "partial" and len(got["matches"]) == 1 and got["missing_items"] == ["SQL"]
    same = Q.compare_lists(spark.createDataFrame([("b\na", "A\nB")], "expected string, actual string")).collect()[0]
    assert same["status"] == "exact" and same["score"] == 1.0


def test_incomplete_holdout_recommends_nothing(spark):
    rows = spark.createDataFrame([(1, m, "STRONG MATCH", "PRIORITY ROLE", "strong", "priority") for m in ("a", "b")], "job_id int, model string, classification string, track string, human_rating string, opportunity_type string")
    assert C.compare_models(rows, "a", "b", 10).collect()[0]["recommendation"] == "HOLDOUT INCOMPLETE"
    assert C.compare_models(rows, "a", "b", 1).collect()[0]["recommendation"] == "NO MEASURED ADVANTAGE"
    for pair in (("a", "absent"), ("absent", "b")):
        assert C.compare_models(rows, *pair, 1).collect()[0]["recommendation"] == "HOLDOUT INCOMPLETE"


def test_newest_scalar_claim_wins_and_snapshots_are_reused(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    row = lambda i, path, key, text, day: (1, i, key, path, path.split(".")[0], text.lower(), t(day), text, "", "", "", [])
    schema = "profile_id int, claim_id int, claim_key string, field_path string, section string, semantic_key string, approved_at timestamp, text string, heading string, subheading string, dates string, details array<string>"
    claims = [row(1, "identity.full_name", "n", "Old Name", 1), row(2, "identity.full_name", "n", "New Name", 2), row(3, "profile.skills", "s.0", "SQL", 1), row(4, "identity.email", "e", "a@x.io | b@x.io", 1)]
    made = K.compose_profiles(spark.createDataFrame(claims, schema)).cache()
    got = made.collect()[0]
    assert got["identity"]["full_name"] == "New Name" and got["identity"]["emails"] == ["a@x.io", "b@x.io"]
    assert "older_claims_collapsed" in got["warnings"]
    known = made.select("profile_id", "fingerprint", F.lit(3).alias("version"))
    assert K.next_versions(made, known).isEmpty()
    other = known.withColumn("fingerprint", F.lit("x"))
    assert K.next_versions(made, other).collect()[0]["version"] == 4


def test_resume_profile(spark):
    text = "Ana Maria Silva\nana@mail.example | (555) 123-4567 | Boston, MA\n\nEDUCATION\nState University | BSc, May 2020\n- honours\n\nSKILLS\nTools: Python, SQL; python\n"
    got = extract_documents(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()[0]
    assert got["identity"]["full_name"] == "Ana Maria Silva" and got["identity"]["location"] == "Boston, MA"
    school = got["profile"]["education"][0]
    assert (school["heading"], school["subheading"], school["dates"]) == ("State University", "BSc", "May 2020")
    assert got["profile"]["skills"] == ["Python", "SQL"] and "no_projects" in got["warnings"]


def test_sources(spark, tmp_path):
    folder = tmp_path / "case-1"
    folder.mkdir()
    (folder / "ground-truth.json").write_text('{"case_id": "case-1", "title": "T"}')
    (folder / "listing.txt").write_text("Some listing")
    found = cases.case_folder(spark, str(tmp_path), "case_id string, title string", "listing.txt")
    assert [r["text"] for r in found.collect()] == ["Some listing"]
    with pytest.raises(ValueError):
        cases.select_cases(found, ["case-9"])
    config = "position int, key string, label string, token string, industry string, enabled boolean"
    with pytest.raises(ValueError):
        feeds.approved_boards(spark.createDataFrame([(1, "a", "A", "tok", "", True), (2, "b", "B", "TOK", "", True)], config), 5)
    sinks.append_history(spark.range(2), str(tmp_path / "h"), "2026-01-01")
    sinks.append_history(spark.range(3), str(tmp_path / "h"), "2026-01-02")
    assert spark.read.parquet(str(tmp_path / "h")).count() == 5
