"""Scans, texts and records at sizes where one task, one text or one rule did all the work."""

import re
import unicodedata
from hashlib import sha256

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallymark.functions import text as X
from tallymark.operators.spread import fill_slots
from tallymark.operators.vocabulary import ENTRY_TERMS, Vocabulary, mentions


def test_one_row_group_is_spread_however_many_splits_its_file_has(spark, tmp_path):
    path = str(tmp_path / "wide.parquet")
    pq.write_table(pa.table({"i": range(20000), "text": [sha256(str(i).encode()).hexdigest() for i in range(20000)]}), path)
    rows = spark.read.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        assert rows.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        sizes = [n for n in fill_slots(rows).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == 20000 and max(sizes) < 20000 / 8


def test_even_scans_and_empty_ones_are_left_alone(spark, tmp_path):
    path = str(tmp_path / "even")
    spark.range(16000).repartition(16).write.parquet(path)
    plan = fill_slots(spark.read.schema("id long").parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan
    assert fill_slots(spark.read.schema("id long").parquet(path).where("id < 0")).count() == 0


def test_normalized_text_is_the_python_form(spark):
    texts = ["", "plain Text", "a\tb\n c & D&&e", "½ cup ﬁsh № 5…", "é́ü ß ÆØ x", "漢字 and 𝔘nicode 😀!", "\x00x\x7fy", "C++ / C# ＆ ..", "™" * 3 + "a" * 50]

    def want(t):
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower().replace("&", " and ")
        return " ".join(re.findall("[a-z0-9+#]+", plain))

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.normalize_text(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [want(r["t"]) for r in rows]


def test_tags_are_those_of_the_patterns(spark):
    vocabulary = Vocabulary()
    phrases = [p for part in (vocabulary.families, vocabulary.concepts) for _, ps in part.values() for p in map(X.fold_literal, ps)]
    texts = [t for p in phrases for t in (p, f"x{p}", f"{p}y z", f"a +{p}# b", f"xx{p} {p}")] + ["", "nothing"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = rows.select("t", vocabulary.family_tags(t).alias("f"), vocabulary.concept_tags(t).alias("c"), mentions(t, ENTRY_TERMS).alias("m")).collect()

    def tags(text, part, whole):
        return sorted(n for n, (_, ps) in part.items() if re.search(X.phrase_pattern([X.fold_literal(p) for p in ps], whole), text))

    for row in got:
        assert row["f"] == tags(row["t"], vocabulary.families, True)
        assert row["c"] == tags(row["t"], {n: vocabulary.concepts[n] for n in vocabulary.names(False)}, False)
        assert row["m"] == any(X.fold_literal(x) in row["t"] for x in ENTRY_TERMS)


def test_family_patterns_are_tried_on_texts_that_hold_a_phrase_only(spark):
    rows = spark.createDataFrame([("",)], "t string").select(Vocabulary().family_tags(F.col("t")).alias("f"))
    assert "Contains" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_named_fields_and_extractions_only_are_compared(spark, sf):
    from tallymark.catalog import fieldcases as C
    from tallymark.operators import quality as Q

    def rows(frame):
        return sorted(map(repr, frame.select("case_id", "run", "path", "status", "score", "matches").collect()))

    some = {p: Q.FIELD_KINDS[p] for p in ("job.title", "requirements.required_skills", "job.deadline_status")}
    whole = C.compared(spark, sf)
    assert rows(C.compared(spark, sf, ("a",), some)) == rows(whole.where("run = 'a'").where(F.col("path").isin(*some)))
    plan = C.flt_15(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "requirement_notes AS path" not in plan and "path,requirements.requirement_notes" not in plan


def test_records_of_one_row_group_are_compared_by_many_tasks(spark, sf):
    from tallymark.catalog import fieldcases as C

    assert C.cases(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


class CountedState:
    """A map state that counts what it is asked."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def containsKey(self, key):
        self.asked += 1
        return key in self.held

    def getValue(self, key):
        self.asked += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.asked += 1
        self.held[key] = value

    def iterator(self):
        self.asked += 1 + len(self.held)
        return iter(list(self.held.items()))


def test_listing_state_is_asked_once_for_each_listing_however_many_days_a_batch_has():
    import pandas as pd

    from tallymark.streaming.lifecycle import END, ListingLives

    lives = ListingLives()
    lives.lives = state = CountedState()
    days, names = 60, [f"n{i}" for i in range(30)]
    seen = {(d, n) for d in range(days) for i, n in enumerate(names) if (d * 7 + i * 5) % 11 < 6 or i == 0}
    ends = {d for d in range(days) if d % 5}
    for low, high in ((0, 40), (40, 60)):
        rows = [(d, "seen", n) for d, n in sorted(seen) if low <= d < high] + [(d, END, None) for d in sorted(ends) if low <= d < high]
        list(lives.handleInputRows(("s", 0), iter([pd.DataFrame(rows, columns=["at", "kind", "external_id"])]), None))
    want = {}
    for name in names:
        last = max(d for d, n in seen if n == name)
        want[(name,)] = (min(d for d, n in seen if n == name), last, min((d for d in ends if d > last), default=-1))
    assert state.held == want
    assert state.asked <= 2 * (1 + 2 * len(names))


def test_a_text_has_a_key_for_every_piece_and_pairs_equal_brute_force(spark):
    """Passages of every length, over few letters, in texts that repeat and overlap them, rows and passages repeated."""
    import random

    from tallymark.operators.containment import piecewise_pairs
    from tallymark.operators.grounding import shared_passages

    roll = random.Random(5)
    texts = ["".join(roll.choice("abß漢") for _ in range(roll.randrange(120))) for _ in range(40)] + ["ab" * 60, "ab" * 60, "", None]
    passages = [t[i : i + roll.randrange(1, 60)] for t in texts[:20] for i in (0, 7, 30)] + ["ab" * 20, "ab" * 20, "漢", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    fold = lambda t: (t or "").replace("ß", "ss")
    want = sorted((d, i) for d, t in enumerate(texts) for i, p in enumerate(passages) if p and fold(p) in fold(t))
    assert sorted(tuple(r) for r in shared_passages(docs, items).collect()) == want and len(want) > 200
    # A text of 120 characters has a key for each of its seven whole pieces, not one for each place.
    plan = piecewise_pairs(docs.withColumnRenamed("text", "t"), items.withColumnRenamed("text", "p"), "t", "p", 16)
    assert "(?s).{16}" in plan._jdf.queryExecution().optimizedPlan().toString()
