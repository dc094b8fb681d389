import unicodedata

from pyspark.sql import functions as F

from tallymark.functions import listing as L
from tallymark.functions import similarity as S
from tallymark.functions import text as X
from tallymark.functions import urls as U
from tallymark.functions.fingerprint import listing_text_sha256, role_sha256
from tallymark.functions.html import html_to_text

WORDS = ["Straße ﬁne & C++", "naïve ½ ⑩ Ⅳ", "  a b c ", "éclair", "ＡＢＣ １２", "ﬀ Σας Ωmega", "", "plain text"]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def each(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_text_is_nfkd_ascii(spark):
    import re

    def slow(v):
        v = unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().casefold().replace("&", " and ")
        return " ".join(re.sub("[^a-z0-9+#]+", " ", v).split())

    assert each(spark, WORDS, X.normalize_text) == [slow(w) for w in WORDS]


def test_folded_text_is_nfkc_casefold(spark):
    slow = [" ".join(unicodedata.normalize("NFKC", w).casefold().split()) for w in WORDS]
    assert each(spark, WORDS, X.folded_text) == slow


def test_text_hash_ignores_case_and_space(spark):
    a, b = each(spark, ["One  Role\nHere", "one role HERE "], listing_text_sha256)
    assert a == b


def test_role_hash_needs_title_and_company(spark):
    assert one(spark, role_sha256(F.lit(" "), F.lit("x"), F.lit("y"))) == ""


def test_url_key(spark):
    urls = [
        "https://User@Example.com:443//a//b/?utm_source=x&id=2&A=1#top",
        "https://example.com/a/b?A=1&id=2",
        "https://example.com/a/b?A=1&id=3",
        "http://example.com:8080",
    ]
    a, b, c, d = each(spark, urls, U.normalize_url)
    assert a == b == "https://example.com/a/b?A=1&id=2" and c != a and d == "http://example.com:8080/"


def test_first_seen_keeps_order(spark):
    assert one(spark, X.first_seen(F.array(*[F.lit(x) for x in ("b", "A", "B", "a", "c")]))) == ["b", "A", "c"]


def test_short_phrases_need_boundaries(spark):
    check = lambda t, p: one(spark, X.phrase_present(F.lit(t), F.lit(p)))
    assert check("use c++ daily", "c++") and not check("adsp board", "dsp") and check("embedded board", "board")


def test_document_normalize_joins_wrapped_lines(spark):
    text = "▪ first item\n      goes on\n\n\n\nhyphen-\nated  ____\nplain"
    assert one(spark, X.normalize_document(F.lit(text))) == "• first item goes on\n\nhyphen-ated\nplain"


def test_stems_and_similarity(spark):
    assert one(spark, S.stem(F.lit("validation"))) == "valid" and one(spark, S.stem(F.lit("user"))) == "user"
    assert one(spark, S.title_similarity(F.lit("Lead Analyst"), F.lit("lead analyst | Acme"))) == 0.82


def test_deadlines(spark):
    found = one(spark, L.deadline(F.lit("Apply by: 2026-05-04")))
    assert found["status"] == "confirmed" and str(found["date"]) == "2026-05-04"
    assert one(spark, L.deadline(F.lit("Apply by: whenever it suits")))["status"] == "unknown"
    assert one(spark, L.deadline(F.lit("Open until filled. Apply by 2026-01-01")))["status"] == "rolling"


def test_html_to_text(spark):
    assert one(spark, html_to_text(F.lit("<p>a <b>b</b></p><ul><li>x<li>y</ul>"))) == "a b\n\n- x\n- y"
