"""Costly parts of a row are worked out once, however often their values are used."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions import text as X
from tallymark.functions import urls as U


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_an_address_are_read_once(spark):
    urls = ["https://a.example/b", "HTTP://User@A.example:80//x//y/?b=2&utm_x=1&a=1#f", " https://h:8443 ", "", None, "//h/p/", "x?q=é"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(U.normalize_url(F.col("u")).alias("key"))
    assert plan_of(rows).count("regexp_extract") <= 15
    assert [r["key"] for r in rows.collect()] == [
        "https://a.example/b", "http://a.example/x/y?a=1&b=2", "https://h:8443/", "", "", "//h/p", "x?q=%C3%A9"
    ]


def test_strip_takes_the_white_space_of_the_pattern(spark):
    texts = [f"{w}a{w}b{w}" for w in map(chr, range(1, 0x3100)) if not 0xD800 <= ord(w) <= 0xDFFF] + ["", " \n　"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    by_pattern = F.regexp_replace("t", f"^[{X.WHITE}]+|[{X.WHITE}]+$", "")
    stripped = rows.select(X.strip(F.col("t")).alias("s"), by_pattern.alias("p"), X.squeeze(F.col("t")).alias("q"))
    assert stripped.where("s <> p").count() == 0
    assert stripped.where(F.col("q") != F.trim(F.regexp_replace("p", f"[{X.WHITE}]+", " "))).count() == 0
    assert "regexp" not in plan_of(rows.select(X.strip(F.col("t"))))


def test_an_entry_reads_its_lines_for_a_date_only_where_its_head_has_none(spark):
    from tallymark.plans.resume import read_entry

    blocks = [
        ["Analyst | Works, May 2020", "Boston | Fall 2019", "June 2018 did this", "May 2020"], ["Analyst", "Works | 2019 - present", "did that"],
        ["Analyst", "went on in lower case", "since May 2021"], ["Only"], ["2019", "X"],
    ]
    rows = spark.createDataFrame([(b,) for b in blocks], "b array<string>").select(read_entry(F.col("b")).alias("e"))
    assert plan_of(rows).count("(?:19|20)") <= 8
    got = [(r["e"]["heading"], r["e"]["subheading"], r["e"]["dates"], r["e"]["details"]) for r in rows.collect()]
    assert got == [
        ("Analyst", "Works", "May 2020", ["Boston | Fall 2019", "June 2018 did this"]), ("Analyst", "Works", "2019 - present", ["did that"]),
        ("Analyst", "", "May 2021", ["went on in lower case", "since May 2021"]), ("Only", "", "", []), ("2019", "X", "2019", []),
    ]


def test_headings_are_found_behind_marks_and_long_lines_are_none(spark):
    from tallymark.plans.resume import HEADINGS, numbered_lines

    lines = [m.format(h) for h in HEADINGS for m in ("{}", "• {}:", "  {} ____", "({})", "{}" + "." * 90)] + ["Licenses & Certifications", "x" * 50, "skills " * 9]
    text = spark.createDataFrame([("\n".join(lines),)], "t string").select(numbered_lines(F.col("t")).alias("l")).first()["l"]
    assert sum(x["section"] is not None for x in text) == 5 * len(HEADINGS) + 1


def test_both_orders_of_the_postings_are_ranked_from_one_written_join(spark, sf, monkeypatch):
    from tallymark.catalog import listings
    from tallymark.operators import listing as L

    plans, rank = [], L.global_rank
    monkeypatch.setattr(L, "global_rank", lambda rows, *rest: plans.append(plan_of(rows)) or rank(rows, *rest))
    listings.srt_05(spark, sf)
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_lists_of_a_day_are_gathered_before_they_are_compared_and_matched(spark, sf, monkeypatch):
    from tallymark.catalog import reevaluation

    plans = []

    def stop(postings, asked, profiles):
        plans.extend([plan_of(asked), plan_of(profiles)])
        raise StopIteration

    monkeypatch.setattr(reevaluation.R, "fingerprinted_pairs", stop)
    with pytest.raises(StopIteration):
        reevaluation.two_runs(spark, sf)
    assert plans and not any("Aggregate" in p for p in plans)
