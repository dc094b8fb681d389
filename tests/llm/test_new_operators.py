"""Resampling, conversation repair and quality against brute force, with nulls, ties, empty tables, clashing columns."""

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallymark.llm import dialogue, preference, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, rank string, Score string, row int, _place int, n_words int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "r", "s", 1, 2, 3) for i, t in rows], DOCS)


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_checksums_of_spans():
    draw = random.Random(5)
    data = np.frombuffer(draw.randbytes(9000), np.uint8)
    starts = np.array([draw.randrange(8000) for _ in range(800)] + [0, 0, 1, 100])
    ends = np.array([min(9000, s + 1 + int(draw.paretovariate(0.7))) for s in starts[:-4]] + [9000, 64, 66, 101])
    assert resample.span_checksums(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


@pytest.mark.parametrize(("cut", "piece"), [(1 << 17, 1 << 20), (50, 40), (1000, 1), (7, 9)])
def test_features_of_a_batch(monkeypatch, cut, piece):
    monkeypatch.setattr(resample, "SLICE", cut)
    monkeypatch.setattr(resample, "PIECE", piece)
    texts = [None, "", "a", "Hello, WORLD é x", "...", "b b b " * 5, "x" * 1000 + " " + "y" * 70, "ab", "cd", "~É中 '9'"]
    found = [[] for _ in texts]
    for bucket, place in resample.buckets_of(pa.array(texts)):
        for b, i in zip(bucket.tolist(), place.tolist()):
            found[i].append(b)
    assert [sorted(f) for f in found] == [sorted(features(t)) for t in texts]
    assert resample.words_of(pa.array(texts)).tolist() == [len(words(t)) for t in texts]


def test_resampling(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_001, None), (10_002, ""), (None, "one two " * 20), (10_003, rows[0][1]), (10_003, rows[0][1]), (10_004, "W" * 50_000 + " b" * 9)]
    target = [(1, "one two three"), (2, None), (3, rows[3][1])]
    raw, want = [features(t) for _, t in rows], [features(t) for _, t in target]
    s, t = np.bincount(sum(raw, []), minlength=10000), np.bincount(sum(want, []), minlength=10000)
    gain = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + 10000) / ((a + 1) * (int(t.sum()) + 10000)))) for a, b in zip(s.tolist(), t.tolist())]
    brute = []
    for (key, text), found in zip(rows, raw):
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        brute.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in brute if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for place, row in enumerate(fit[: 5 * len(fit) // 100]):
        row[4] = place + 1
    docs = documents(spark, rows).repartition(5)
    got = resample.resample(docs, documents(spark, target), "doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((tuple(r[:5]) for r in brute), key=repr)
    assert resample.resample(documents(spark, []), documents(spark, target), "doc_id", "text").collect() == []
    assert len(resample.resample(docs, documents(spark, []), "doc_id", "text").collect()) == len(rows)


def cheapest(codes):
    """Least cost, then least letters, by a search over all edits that knows only the pattern of roles."""
    fits = lambda last, r: last + r in ("s", "u", "su", "ua", "au")
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(codes) and last in ("", "a"):
            return cost, audit
        edits = [("I", 2, i, r) for r in "ua" if fits(last, r)]
        if i < len(codes):
            role, fault = "?sua"[codes[i] % 4], codes[i] // 4
            edits.append(("D", 3, i + 1, last))
            if fault not in (1, 2):
                edits += [("K", fault // 3, i + 1, role)] if fits(last, role) else []
                edits += [("R", 2 + fault // 3, i + 1, r) for r in "ua" if fits(last, r)]
        for letter, price, j, to in edits:
            heapq.heappush(heap, (cost + price, audit + letter, j, to))


@pytest.mark.parametrize("block", [4096, 3])
def test_auction_finds_the_least_edits(monkeypatch, block):
    monkeypatch.setattr(dialogue, "BLOCK", block)
    draw = random.Random(block)
    for _ in range(1500):
        codes = bytes(draw.choices([0, 1, 2, 3, 4, 6, 10, 11, 13, 14, 15], [1, 3, 9, 9, 1, 1, 1, 1, 1, 3, 3], k=draw.randrange(13)))
        assert dialogue.cheapest(codes) == cheapest(codes)


def brute_report(rows):
    """rows of one conversation, damaged, in order -> the report's values and the repaired lines."""
    seen, faults = set(), []
    for _, role, text in rows:
        plain = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append(1 if not plain else 2 if (role, text) in seen else 3 if plain[-1] not in ".!?" else 0)
        seen.add((role, text))
    heads = [r[1][:1] for r in rows]
    cost, audit = cheapest([{"s": 1, "u": 2, "a": 3}.get(h, 0) + 4 * f for h, f in zip(heads, faults)])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    made, i = [], 0
    free = lambda: "user" if not made or made[-1][0][:1] in ("s", "a") else "assistant"
    for letter in audit:
        if letter == "I":
            made.append((free(), "", "I"))
            continue
        if letter != "D":
            made.append((rows[i][1] if letter == "K" else free(), rows[i][2], letter))
        i += 1
    lines = "\n".join(f"{r}:{t}" for r, t, _ in made)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()), made


def test_conversations(spark, sf):
    schema = "conv_id long, turn long, role string, text string, cost string, is_line int, digest string, copy int"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    draw = random.Random(2)
    rows += [(c, draw.choice([None, *range(9)]), draw.choice(["user", "assistant", "system", "", "tool", None]), draw.choice(["Yes.", "no", None, " \n", "ok!\t"]))
             for c in (None, *range(9000, 9060)) for _ in range(draw.randrange(1, 9))]
    rows += [(9999, None, "user", "hi")] * 3 + [(9998, t, ("user", "assistant")[t % 2], "w " * 100 + f"{t}.") for t in range(600)]
    damaged = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        new = (turn, "user" if kind == 4 else role, text)
        damaged.setdefault(conv, []).extend([] if kind == 0 else [new, new] if kind == 3 else [new])
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    brute = {c: brute_report(sorted(v, key=order)) for c, v in damaged.items()}
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], schema).repartition(6)
    got = dialogue.repair_damaged(frame).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {c: b for c, (b, _) in brute.items()} and len(got) == len(brute)
    lines = {}
    for conv, place, role, text, edit in dialogue.repaired(dialogue.damage(frame)).orderBy("conv_id", "place").collect():
        lines.setdefault(conv, []).append((role, text, edit))
        assert place == len(lines[conv]) - 1
    assert lines == {c: m for c, (_, m) in brute.items() if m}
    none = spark.createDataFrame([], schema)
    assert dialogue.repair_damaged(none).collect() == [] and dialogue.repaired(none).collect() == []


def test_quality(spark, sf):
    big = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = preference.score_all(docs, labels, "doc_id", "text").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) > 0.97 * len(held) > 100
    odd = documents(spark, [(1, None), (1, None), (2, ""), (None, "x"), (4, "** " * 100_000), (5, "A!! " * 1000)])
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0), (5, 1)], "doc_id long, quality int")
    assert len(preference.score_all(odd, marks, "doc_id", "text").collect()) == 6
    assert {round(r["score"], 9) for r in preference.score_all(odd, marks.where("quality = 1"), "doc_id", "text").collect()} == {0.3}
    assert preference.score_all(documents(spark, []), marks, "doc_id", "text").collect() == []


def test_pairs_order_planted_strengths():
    draw = np.random.default_rng(1)
    points = draw.normal(size=(800, 3))
    good = points @ [2.0, -1.0, 0.0] + draw.logistic(size=800) > 0
    found = preference.bradley_terry(points, good, preference.Settings())
    assert found[0] > 0.8 and found[1] < -0.4 and abs(found[2]) < 0.3
    assert not preference.bradley_terry(points, np.ones(800, bool), preference.Settings()).any()


def test_quality_learns_from_every_labelled_row(spark):
    rng = np.random.default_rng(7)
    n = 400
    points = rng.normal(size=(n, len(preference.MEASURES)))
    good = points[:, 0] + rng.normal(size=n) > -0.8
    keys = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 5][:n]
    table = spark.createDataFrame([(k, x.tolist()) for k, x in zip(keys, points)], "k long, x array<double>")
    marks = spark.createDataFrame([(k, int(g)) for k, g in zip(keys, good)], "doc_id long, quality int")
    settings = preference.Settings(pairs=50)
    model = preference.fit(table, marks, settings)
    # All 400 rows, in pairs, give the weights; before, pairs and rows were both bounded.
    assert preference.pair_count(int(good.sum()), int(n - good.sum()), settings) >= good.sum()
    assert np.allclose(model.middle, points.mean(axis=0)) and np.allclose(model.spread, points.std(axis=0))
    hashes = {r["k"]: r["h"] for r in table.selectExpr("k", "xxhash64(k) AS h").collect()}
    order = sorted(range(n), key=lambda i: (hashes[keys[i]], keys[i]))
    plain = ((points - points.mean(axis=0)) / points.std(axis=0))[order]
    weights = preference.bradley_terry(plain, good[order], settings)
    assert np.allclose(model.weights, weights)
    assert np.isclose(model.bar, np.quantile(plain @ weights, (~good).mean()))
