"""Ranks, duplicate classes, linked groups, excerpts, feeds and first arrivals against plain Python."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tallymark.operators import duplicates as D
from tallymark.operators import grounding as G
from tallymark.operators.ordered import global_rank
from tallymark.session import checkpoint_dir
from tallymark.sources import cases, feeds, providers
from tallymark.streaming import lifecycle as S


def test_global_rank(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice([None, *range(40)]), "x") for i in range(3000)] + [(7, 3, "x")] * 50
    frame = spark.createDataFrame(rows, "id long, score long, rank string").repartition(7)
    got = global_rank(frame, [F.desc("score"), F.asc("id")], "rank").collect()
    brute = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [r[:2] for r in brute]
    assert sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))
    assert global_rank(frame.limit(0), [F.asc("id")]).collect() == []


def test_duplicate_classes_and_groups(spark):
    draw = random.Random(3)
    some = lambda n: draw.choice([None, "", *map(str, range(n))])
    rows = [(i, draw.choice("ab"), draw.choice("xy"), some(60), some(80), some(90)) for i in range(150)]
    frame = spark.createDataFrame(rows, "job_id long, title string, company string, url_key string, text_key string, role_key string")
    mine = frame.withColumnRenamed("job_id", "candidate_id").select("candidate_id", "url_key", "text_key", "role_key")
    found = D.tracked_classes(mine, D.key_classes(frame, frame), same=True).collect()
    for got in found:
        me = rows[got["candidate_id"]]
        like = {k: sorted((r[2], r[1], r[0]) for r in rows if r[0] != me[0] and me[c] and r[c] == me[c]) for k, c in (("url", 3), ("text", 4), ("role", 5))}
        assert [got[f"{k}_links"] for k in like] == [len(v) for v in like.values()]
        best = next((k for k in like if like[k]), None)
        assert got["reason"] == {"url": "exact_url", "text": "exact_text", "role": "same_role", None: None}[best]
        assert got["blocking"] == (best in ("url", "text")) and got["first_job_id"] == (like[best][0][2] if best else None)
    groups = {r[0]: r[1] for r in D.linked_groups(mine, "candidate_id", ("url_key", "text_key", "role_key")).collect()}
    parent = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if any(a[c] and a[c] == b[c] for c in (3, 4, 5)) and parent[a[0]] > parent[b[0]]:
                    parent[a[0]], changed = parent[b[0]], True
    assert groups == parent
    chain = spark.createDataFrame([(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(64)], "id long, a string, b string")
    assert {r[1] for r in D.linked_groups(chain, "id", ("a", "b")).collect()} == {0}


def compact(text):
    return re.sub(r"[^\w]+", "", text.lower())


def best_window(text, claims):
    blocks, current = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            current.append(line.strip())
        elif current:
            blocks.append(current)
            current = []
    best = (None, "")
    for block in blocks:
        for a in range(len(block)):
            for b in range(a + 1, min(len(block), a + 8) + 1):
                body = "\n".join(block[a:b])
                n = sum(c in compact(body) for c in claims)
                score = (n == len(claims), n, a - b, -len(body))
                if n and (best[0] is None or score > best[0]):
                    best = (score, body)
    return best[1]


def verdict(text, excerpt, claims):
    text, excerpt = text or "", excerpt or ""
    wanted = list(dict.fromkeys(c for c in (compact(c or "") for c in claims or []) if c))
    squeeze = lambda t: " ".join(t.lower().split())
    supports = any(c in compact(excerpt) for c in wanted)
    if not wanted:
        return "rejected", "no_claims", ""
    if supports and squeeze(excerpt) in squeeze(text):
        return "kept", "", excerpt
    if excerpt.strip() and not supports:
        return "rejected", "unsupported", ""
    found = best_window(text, wanted)
    if not found:
        return "rejected", "not_anchored", ""
    return "re_anchored", "not_verbatim" if excerpt.strip() else "no_support", found


def test_excerpts_kept_anchored_or_rejected(spark):
    draw = random.Random(9)
    word = lambda: draw.choice(["red", "Fox", "blue-ish", "owl", "ab", "abab", "x."])
    rows = []
    for i in range(250):
        lines = [" ".join(word() for _ in range(draw.randrange(1, 4))) if draw.random() > 0.25 else draw.choice(["", "  "]) for _ in range(draw.randrange(1, 16))]
        claims = [" ".join(word() for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(3))] + draw.choice([[], ["--"], ["zebra"]])
        rows.append((i, "\n".join(lines), draw.choice([lines[0], lines[0] + " indeed", lines[-1], "", "FOX  red"]), claims))
    rows += [(900, None, None, ["a"]), (901, "a b", "a", None), (902, "Ｒｅｄ fox\nowl", "", ["red FOX", "owl"])]
    frame = spark.createDataFrame(rows, "id long, text string, excerpt string, claims array<string>")
    got = {r["id"]: (r["verdict"], r["reason"], r["anchored"]) for r in G.judge_excerpts(frame, "text", "excerpt", "claims").collect()}
    for i, text, excerpt, claims in rows[:-1]:
        assert got[i] == verdict(text, excerpt, claims), (i, text, excerpt, claims)
    assert got[902] == ("re_anchored", "no_support", "Ｒｅｄ fox\nowl")
    assert {v[:2] for v in got.values()} >= {("kept", ""), ("rejected", "no_claims"), ("rejected", "unsupported"), ("rejected", "not_anchored"), ("re_anchored", "not_verbatim"), ("re_anchored", "no_support")}


def test_feeds_refuse_with_a_reason(spark):
    jobs = '{"jobs": [{"id": 1, "title": " T ", "absolute_url": "u", "departments": [{"name": "D"}]}, {"id": 2, "title": ""}, "odd", null]}'
    rows = [(1, "a", "success", jobs), (1, "a", "success", '{"jobs": ['), (1, "a", "success", "{}"), (2, "a", "error", jobs), (3, "b", "success", jobs), (4, "a", "success", '{"jobs": []}'), (5, "a", "success", None)]
    feed = spark.createDataFrame(rows, "run_id int, source_key string, status string, payload string").withColumn("ts", F.current_timestamp())
    boards = spark.createDataFrame([(1, "a", "A", "tok", "", True)], "position int, key string, label string, token string, industry string, enabled boolean")
    kept, ids, refused = feeds.flatten_feed(feed, feeds.approved_boards(boards))
    assert [(r["external_id"], r["title_hint"], r["raw_text"]) for r in kept.collect()] == [("a:1", "T", "T\nA\nDepartments: D")]
    assert sorted((r["run_id"], r["reason"]) for r in refused.collect()) == [(1, "incomplete")] * 3 + [(1, "no_jobs"), (1, "not_json"), (2, "failed"), (3, "board_not_approved"), (5, "not_json")]
    assert ids.count() == 4


def test_first_arrivals_are_kept_and_replays_change_nothing(spark):
    path = f"{checkpoint_dir(spark)}/test-first-{uuid.uuid4().hex}"
    batch = lambda *rows: spark.createDataFrame(rows, "k string, at long")
    schema = "k string, first_at long, bucket int, batch long"
    held = lambda: sorted(((r["k"], r["first_at"]) for r in S.first_seen_table(spark, path, schema).collect()), key=repr)
    assert held() == []
    first, second = batch(("a", 5), ("a", 3), ("b", 4)), batch(("a", 1), ("c", 9), (None, 2))
    S.first_seen_batch(first, 0, path, ["k"], "at", 4)
    S.first_seen_batch(second, 1, path, ["k"], "at", 4)
    S.first_seen_batch(second, 1, path, ["k"], "at", 4)
    assert [x for x in held() if x[0]] == [("a", 3), ("b", 4), ("c", 9)]


def test_files_with_broken_bytes(spark, tmp_path):
    folder = tmp_path / "case-1"
    folder.mkdir()
    (folder / "ground-truth.json").write_text('{"case_id": "case-1", "title": "T"}')
    (folder / "listing.txt").write_bytes(b"\xef\xbb\xbfgood \xff bad\n")
    found = cases.case_folder(spark, str(tmp_path), "case_id string, title string", "listing.txt")
    assert [r["text"] for r in found.collect()] == ["good � bad"]
    with pytest.raises(ValueError, match="case-9"):
        cases.select_cases(found, spark.createDataFrame([("case-9",), ("case-1",)], "case_id string"))


def test_providers_and_verifiers(spark):
    offers = spark.createDataFrame([(" 1 ", "https://a.example/x", "A listing text that is long enough to be valid."), ("", "", "x")], "external_id string, source_url string, raw_text string")
    providers.register_provider("toy", "Toy", "v1", lambda search: offers)
    got = sorted((r["external_id"], r["title_hint"], r["reject_reason"]) for r in providers.discover_with("toy", offers).fillna("", ["reject_reason"]).collect())
    assert got == [("", "", "no_identifier"), ("1", "", "")]
    providers.register_verifier("toy", lambda jobs: jobs.where("job_id = 1").select("job_id", F.lit(200).alias("http_status_code")))
    jobs = spark.createDataFrame([(1, "https://a.example", "t", "c"), (2, "https://b.example", "t", "c"), (3, "ftp://x", "t", "c"), (4, None, "t", "c")], "job_id long, job_url string, title string, company string")
    got = {r["job_id"]: (r["error_category"], r["status"], r["http_status_code"]) for r in providers.verify_with("toy", jobs).collect()}
    assert got == {1: (None, "needs_review", 200), 2: ("no_observation", "failed", None), 3: ("input", "failed", None), 4: ("input", "failed", None)}
    with pytest.raises(KeyError):
        providers.discover_with("absent", offers)
