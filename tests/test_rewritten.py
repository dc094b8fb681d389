"""Page reading, line joining, list matching, excerpts and entries on small cases."""

import html

import pytest
from pyspark.sql import functions as F

from tallymark.functions.html import parse_page, postings_in, unescape
from tallymark.functions.text import normalize_document
from tallymark.operators import grounding as G
from tallymark.operators import quality as Q
from tallymark.plans.resume import read_entry

PAGE = """<html><head><title>T &amp; x</title><meta property="og:title" content="A &quot;b&quot; name='z'">
<meta name=description content=q><script type="application/ld+json">[{"@type":["JobPosting"],"title":"Eng",
"hiringOrganization":{"name":"Acme"},"directApply":true,"x":{"@type":"jobposting","title":"in"}}]</script></head>
<body><!-- <a href=1>no</a> --><a class=k href='/apply?x=1&amp;y=2'> Apply <b>now</b></a><button>Go</button>
<input type=submit value="Send"><input type=text value=no><button>go</button>text
<noscript><p>hid</p></noscript></body></html>"""


def values(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()


def test_references_decode_as_in_the_standard(spark):
    texts = ["a &amp;lt; b &lt; &copy2020 &notit; &#8364; &#x41; &#128; &#0; &#xD800; &foo; & x &amp &Aacute;", "", "plain"]
    got = values(spark, [(t,) for t in texts], "t string", v=unescape(F.col("t")))
    assert [r.v for r in got] == [html.unescape(t) for t in texts]


def test_page_evidence(spark):
    rows = [(PAGE, "text/html"), (None, "text/html"), (" a\n <b> ", "text/plain")]
    page, empty, plain = (r.p for r in values(spark, rows, "c string, t string", p=parse_page("c", "t")))
    assert page.document_title == "T & x" and page.meta_titles == ["A \"b\" name='z'"]
    assert page.visible_text == "T & x Apply now Go go text"
    assert page.links == [("Apply now", "/apply?x=1&y=2")] and page.buttons == ["Go", "Send"]
    assert [(p.title, p.company, p.direct_apply) for p in page.postings] == [("Eng", "Acme", True), ("in", "", False)]
    assert empty.visible_text == "" and empty.links == [] and empty.postings == []
    assert plain.visible_text == "a <b>"
    assert postings_in(["no json", "[]"]) == []


def test_wrapped_lines(spark):
    text = "intro-\nduction\n▪ one\n      two\n      three\n• four\n\n      five\n\n\n      six\nlast-\nOne"
    got = values(spark, [(text,), (None,), ("",)], "t string", v=normalize_document(F.col("t")))
    assert [r.v for r in got] == ["intro-duction\n• one two three\n• four\n\nfive\n\nsix\nlast-\nOne", "", ""]


def test_lists_fold_wide_letters_and_drop_repeats(spark):
    rows = spark.createDataFrame([("ＡＢＣ\nx y", "abc\nABC\nx  y"), (None, ""), (None, "a")], "expected string, actual string")
    got = [(r.status, r.score) for r in Q.compare_lists(rows).collect()]
    assert got == [("exact", 1.0), ("exact", 1.0), ("unexpected", 0.0)]


def test_sequential_match_takes_unused_partners(spark):
    rows = [(["alpha beta", "alpha beta gamma"], ["alpha beta", "zzz"]), ([], [])]
    keyed = lambda c: Q.keyed_items(F.col(c))
    first, empty = (r.m for r in values(spark, rows, "e array<string>, a array<string>", m=Q.sequential_match(keyed("e"), keyed("a"))))
    assert (first.score, first.missing, first.unexpected) == (0.5, ["alpha beta gamma"], ["zzz"])
    assert (empty.score, empty.missing, empty.unexpected) == (1.0, [], [])


def test_excerpts_cover_all_claims_or_none(spark):
    rows = [("Red fox.\nblue\n\ngreen owl", ["red fox", "GREEN", "red-fox"]), ("red", ["red", "absent"]), ("red", [])]
    cover = G.cover_excerpts(G.document_blocks(F.col("t")), F.col("c"))
    assert [r.v for r in values(spark, rows, "t string, c array<string>", v=cover)] == [["Red fox.", "green owl"], [], []]


def test_entry_blocks(spark):
    rows = [
        (["Engineer | Acme | 2019 - 2021", "built things"],),
        (["Analyst, May 2020 – Present", "Beta Corp | Boston", "did it"],),
        (["Helper", "went on", "2018"],),
    ]
    got = [r.e for r in values(spark, rows, "b array<string>", e=read_entry(F.col("b")))]
    assert [(e.heading, e.subheading, e.dates, e.details) for e in got] == [
        ("Engineer", "Acme", "2019 - 2021", ["built things"]),
        ("Analyst", "Beta Corp", "May 2020 – Present", ["did it"]),
        ("Helper", "", "2018", ["went on"]),
    ]


def test_a_critical_claim_without_comparison_stops(spark):
    claims = spark.createDataFrame([(1, "a"), (1, "b")], "case_id long, path string")
    compared = spark.createDataFrame([(1, "a", 0.9)], "case_id long, path string, score double")
    assert Q.critical_claims(claims.where("path = 'a'"), compared).collect()[0].passed
    with pytest.raises(Exception, match="critical field b"):
        Q.critical_claims(claims, compared).collect()
