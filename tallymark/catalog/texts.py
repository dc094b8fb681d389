"""Text forms, URLs, fingerprints, extraction and grounding over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import listing as T
from ..functions import similarity as S
from ..functions import text as X
from ..functions import urls as U
from ..functions.fingerprint import listing_text_sha256, record_sha256, role_sha256
from ..functions.html import html_to_text, parse_page
from ..functions.numbers import half_even
from ..operators import duplicates as D
from ..operators import grounding as G
from ..operators.discovery import validity
from ..operators.spread import fill_slots, settle
from ..operators.vocabulary import ENTRY_TERMS, Vocabulary, mentions
from ..plans.intake import extract_listings
from ..plans.pages import crawl, interpret_pages
from ..plans.resume import blocks, extract_documents, numbered_lines, section_lines
from ..sources.tables import table
from .registry import query

# Combined forms of the accented letters the oracle strips; NFKD keeps their base letter.
PLAIN = "strip_accents(text)"
NORM = "trim(regexp_replace(replace(lower(regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g')), '&', ' and '), '[^a-z0-9+#]+', ' ', 'g'))"
FOLD = "trim(regexp_replace(replace(lower(nfc_normalize({c})), 'ß', 'ss'), '\\s+', ' ', 'g'))"
COMPACT = "regexp_replace(replace(lower(nfc_normalize({c})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


def documents(spark, sf):
    return fill_slots(table(spark, sf, "documents"))


def digest(c):
    """Long results are compared by their hash."""
    return F.sha2(c, 256)


@query("fn_01_normalize_text", f"SELECT doc_id, sha256({NORM.format(c='text')}) AS norm FROM documents")
def fn_01(spark, sf):
    return documents(spark, sf).select("doc_id", digest(X.normalize_text(F.col("text"))).alias("norm"))


@query("fn_02_folded_text", f"SELECT doc_id, sha256({FOLD.format(c='text')}) AS folded FROM documents")
def fn_02(spark, sf):
    return documents(spark, sf).select("doc_id", digest(X.folded_text(F.col("text"))).alias("folded"))


@query("fn_03_words_only", "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS words FROM documents")
def fn_03(spark, sf):
    return documents(spark, sf).select("doc_id", digest(X.words_only(F.col("text"))).alias("words"))


@query("fn_04_grounding_compact", f"SELECT doc_id, sha256({COMPACT.format(c='text')}) AS compact FROM documents")
def fn_04(spark, sf):
    return documents(spark, sf).select("doc_id", digest(X.grounding_compact(F.col("text"))).alias("compact"))


@query("fn_05_company_and_title_tokens", """SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name || ' Co. of ' || c_mktsegment || ' Inc.'), '\\b(?:incorporated|inc|corporation|corp|company|co|limited|ltd|llc|plc)\\b\\.?', ' ', 'g'), '\\s+', ' ', 'g')) AS company,
  len(list_filter(list_distinct(regexp_extract_all(lower('The ' || c_mktsegment || ' role for ' || c_name), '[a-z0-9+#.]+')), lambda x: NOT list_contains(['the','role','for'], x))) AS tokens FROM customer""")
def fn_05(spark, sf):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        "c_custkey", X.company_text(F.concat(name, F.lit(" Co. of "), segment, F.lit(" Inc."))).alias("company"),
        F.size(X.title_tokens(F.concat(F.lit("The "), segment, F.lit(" role for "), name))).cast("long").alias("tokens"),
    )


@query("fn_06_document_normalize")
def fn_06(spark, sf):
    text, warnings = X.bounded_document(F.col("text"))
    return documents(spark, sf).select("doc_id", digest(text).alias("normal"), F.size(warnings).alias("warnings"))


@query("fn_07_split_evidence", """SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '[\\n.;|]+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), lambda x: x <> '')) AS pieces,
  len(list_filter(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: trim(x) <> '')) AS lines FROM documents""")
def fn_07(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.size(X.split_evidence(F.col("text"))).cast("long").alias("pieces"), F.size(X.split_lines(F.col("text"))).cast("long").alias("lines")
    )


@query("fn_08_phrase_present", f"""WITH n AS (SELECT doc_id, {NORM.format(c='text')} AS t FROM documents)
SELECT doc_id, regexp_matches(' ' || t || ' ', '[^a-z0-9]the[^a-z0-9]') AS short_phrase, contains(t, 'tion') AS long_phrase FROM n""")
def fn_08(spark, sf):
    t = X.normalize_text(F.col("text"))
    return documents(spark, sf).withColumn("t", t).select(
        "doc_id", X.phrase_present(F.col("t"), F.lit("the")).alias("short_phrase"), X.phrase_present(F.col("t"), F.lit("tion")).alias("long_phrase")
    )


def turns(spark, sf):
    """Each turn beside the next one of its conversation; conversations are short."""
    rows = table(spark, sf, "conversations")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return rows.join(after, ["conv_id", "turn"])


@query("fn_09_token_jaccard", f"""WITH p AS (SELECT a.conv_id, a.turn, list_distinct(list_filter(string_split({NORM.format(c='a.text')}, ' '), lambda x: len(x) > 2)) AS l,
  list_distinct(list_filter(string_split({NORM.format(c='b.text')}, ' '), lambda x: len(x) > 2)) AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0.0 ELSE round(len(list_intersect(l, r))::DOUBLE / len(list_distinct(list_concat(l, r))), 6) END AS jaccard FROM p""")
def fn_09(spark, sf):
    tokens = lambda c: X.long_tokens(X.normalize_text(F.col(c)))
    rows = turns(spark, sf).withColumns({"l": tokens("text"), "r": tokens("reply")})
    return rows.select("conv_id", "turn", F.round(X.jaccard(F.col("l"), F.col("r")), 6).alias("jaccard"))


@query("fn_11_title_similarity", """WITH n AS (SELECT DISTINCT p_name AS a, p_name || ' for ' || lower(p_type) AS b FROM part UNION SELECT DISTINCT p_name, 'the ' || split_part(p_name, ' ', 2) || ' ' || p_type FROM part),
t AS (SELECT a, b, lower(a) AS x, lower(b) AS y, list_distinct(regexp_extract_all(lower(a), '[a-z0-9+#.]+')) AS ta,
  list_filter(list_distinct(regexp_extract_all(lower(b), '[a-z0-9+#.]+')), lambda w: NOT list_contains(['for','the'], w)) AS tb FROM n)
SELECT a, b, round(CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN greatest(0.82, least(len(x), len(y))::DOUBLE / greatest(len(x), len(y)))
  ELSE round_even(0.7 * len(list_intersect(ta, tb)) / len(ta) + 0.3 * len(list_intersect(ta, tb)) / len(tb), 4) END, 4) AS similarity FROM t""")
def fn_11(spark, sf):
    part = table(spark, sf, "part")
    a = part.select(F.col("p_name").alias("a"), F.concat(F.col("p_name"), F.lit(" for "), F.lower("p_type")).alias("b"))
    b = part.select("p_name", F.concat(F.lit("the "), F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)), F.lit(" "), F.col("p_type")))
    return a.union(b).distinct().select("a", "b", F.round(S.title_similarity(F.col("a"), F.col("b")), 4).alias("similarity"))


STEM = "CASE " + " ".join(
    f"WHEN w LIKE '%{e}' AND len(w) - {len(e)} >= 4 THEN substr(w, 1, len(w) - {len(e)})" for e in S.STEM_ENDINGS
) + " ELSE w END"
STOPS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


@query("fn_12_stem_counts", f"""WITH w AS (SELECT unnest(string_split({NORM.format(c='text')}, ' ')) AS w FROM documents)
SELECT {STEM} AS stem, count(*) AS n FROM w WHERE len(w) > 2 AND w NOT IN ({STOPS}) GROUP BY 1""")
def fn_12(spark, sf):
    stems = S.content_tokens(X.normalize_text(F.col("text")))
    return documents(spark, sf).select(F.explode(stems).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query("fn_15_normalize_url", """WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)', 1)) AS s, lower(regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)', 2)) AS h,
  regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p, list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS q FROM pages)
SELECT page_id, s || '://' || h || CASE WHEN p = '' OR p = '/' THEN '/' ELSE regexp_replace(regexp_replace(p, '/{2,}', '/', 'g'), '/+$', '') END
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM u""")
def fn_15(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalize_url(F.col("url")).alias("url_key"))


@query("fn_16_generic_careers_url", """WITH p AS (SELECT page_id, lower(trim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/')) AS path FROM pages)
SELECT page_id, path = '' OR path IN ('career','careers','job-search','jobs','search','search-jobs') OR regexp_extract(path, '([^/]*)$', 1) IN ('careers','jobs','search') AS generic FROM p""")
def fn_16(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.generic_careers_url(F.col("url")).alias("generic"))


@query("fn_17_fingerprints", f"""SELECT c_custkey, sha256({FOLD.format(c="c_name || '  ' || c_mktsegment")}) AS text_key,
  sha256({FOLD.format(c='c_mktsegment')} || chr(31) || {FOLD.format(c='c_name')} || chr(31) || {FOLD.format(c='n_name')}) AS role_key,
  sha256('{{"a_segment":"' || c_mktsegment || '","b_nation":' || c_nationkey || '}}') AS record_key FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def fn_17(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        "c_custkey", listing_text_sha256(F.concat_ws("  ", "c_name", "c_mktsegment")).alias("text_key"),
        role_sha256(F.col("c_mktsegment"), F.col("c_name"), F.col("n_name")).alias("role_key"),
        record_sha256(b_nation=F.col("c_nationkey"), a_segment=F.col("c_mktsegment")).alias("record_key"),
    )


CHAIN = lambda patterns, c: "CASE " + " ".join(
    f"WHEN regexp_matches({c}, '{p}') THEN '{v}'" for p, v in patterns
) + " ELSE 'unknown' END"


def adverts(spark, sf):
    """Documents with a line of listing facts, so that every rule meets data: facts follow from the id."""
    fact = F.element_at(F.array(*[F.lit(x) for x in FACTS]), (F.col("doc_id") % len(FACTS) + 1).cast("int"))
    return documents(spark, sf).select("doc_id", F.concat_ws("\n", "text", fact).alias("raw_text"))


FACTS = (
    "Full-time hybrid role. Application deadline: March 3, 2026",
    "Part time, remote. Open until filled",
    "Contractor, on-site, apply by 04/05/2026",
    "Senior staff internship in office. No deadline",
    "Position: Lead Analyst\nCompany: Example Works\nLocation: Springfield",
    "Requirements:\n- Bachelor degree in science\n- must be a U.S. citizen\nBenefits:\n- lunch",
    "Nice to have\n* French\nHow to apply\nWe cannot sponsor visas",
)
ADVERTS = "adverts AS (SELECT doc_id, text || chr(10) || ([" + ", ".join(
    "'" + f.replace("\n", "' || chr(10) || '") + "'" for f in FACTS
) + f"])[doc_id % {len(FACTS)} + 1] AS raw_text FROM documents)"


#: Lines of an advert without bullets and runs of spaces, and their heading keys, in SQL.
LINES = """lines AS (SELECT doc_id, list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '^[\\s\\-–—•*▪◦]+', ''), '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM adverts),
keyed AS (SELECT *, list_transform(l, lambda x: trim(regexp_replace(regexp_replace(lower(x), ':+$', ''), '[^a-z0-9'' -]+', '', 'g'))) AS k FROM lines)"""


def _labelled(labels) -> str:
    pattern = f"(?i)^(?:{'|'.join(labels)})\\s*[:\\-]\\s*(.+)$"
    return f"coalesce(trim(regexp_extract(list_filter(l, lambda x: regexp_matches(x, '{pattern}'))[1], '{pattern}', 1)), '')"


@query("fn_18_labelled_values", f"""WITH {ADVERTS}, {LINES}
SELECT doc_id, {_labelled(T.TITLE_LABELS)} AS title, {_labelled(T.COMPANY_LABELS)} AS company, {_labelled(T.LOCATION_LABELS)} AS location FROM lines""")
def fn_18(spark, sf):
    rows = adverts(spark, sf).withColumn("lines", T.clean_lines(F.col("raw_text")))
    value = lambda labels: T.labeled_value(F.col("lines"), labels)
    return rows.select("doc_id", value(T.TITLE_LABELS).alias("title"), value(T.COMPANY_LABELS).alias("company"), value(T.LOCATION_LABELS).alias("location"))


@query("fn_19_employment_arrangement_seniority", f"""WITH {ADVERTS} SELECT doc_id, {CHAIN(T.EMPLOYMENT_PATTERNS, 'lower(raw_text)')} AS employment_type,
  {CHAIN(T.ARRANGEMENT_PATTERNS, 'lower(raw_text)')} AS work_arrangement, {CHAIN(T.SENIORITY_PATTERNS, "lower(' ' || substr(raw_text, 1, 1200))")} AS seniority FROM adverts""")
def fn_19(spark, sf):
    text = F.col("raw_text")
    return adverts(spark, sf).select(
        "doc_id", T.employment_type(text).alias("employment_type"), T.work_arrangement(text).alias("work_arrangement"), T.seniority(F.lit(""), text).alias("seniority")
    )


@query("fn_20_deadlines", f"""WITH {ADVERTS}, d AS (SELECT doc_id, raw_text, trim(regexp_extract(raw_text, '{T.LABELED_DEADLINE}', 1)) AS stated FROM adverts),
p AS (SELECT *, CAST(try_strptime(stated, ['%Y-%m-%d', '%m/%d/%Y', '%m-%d-%Y', '%B %d, %Y', '%b %d, %Y', '%B %d %Y', '%b %d %Y']) AS DATE) AS day FROM d),
s AS (SELECT *, CASE WHEN regexp_matches(raw_text, '{T.ROLLING}') THEN 'rolling' WHEN regexp_matches(raw_text, '{T.LABELED_DEADLINE}') THEN CASE WHEN day IS NOT NULL THEN 'confirmed' ELSE 'unknown' END
  WHEN regexp_matches(raw_text, '{T.NO_DEADLINE}') THEN 'not_stated' ELSE 'unknown' END AS status FROM p)
SELECT doc_id, status, CASE WHEN status = 'confirmed' THEN CAST(day AS VARCHAR) END AS deadline FROM s""")
def fn_20(spark, sf):
    rows = adverts(spark, sf).withColumn("d", T.deadline(F.col("raw_text")))
    return rows.select("doc_id", "d.status", F.col("d.date").cast("string").alias("deadline"))


@query("fn_21_cued_dates", f"""WITH {ADVERTS} SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '2026-03-03' WHEN 2 THEN '2026-04-05' END AS deadline FROM adverts""")
def fn_21(spark, sf):
    return adverts(spark, sf).select("doc_id", T.cued_date(X.squeeze(F.col("raw_text"))).cast("string").alias("deadline"))


@query("fn_22_education_and_authorization", f"""WITH {ADVERTS}, l AS (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS line FROM adverts)
SELECT doc_id, least(8, count(*) FILTER (regexp_matches(lower(line), 'sponsor|work authorization|authorized to work|visa|citizen|permanent resident'))) AS authorization_lines,
  count(*) FILTER (regexp_matches(lower(line), '\\b(bachelor|master|ph\\.?d|degree|b\\.?s\\.?|m\\.?s\\.?)\\b')) AS education_lines FROM l GROUP BY 1""")
def fn_22(spark, sf):
    rows = adverts(spark, sf).withColumn("lines", T.clean_lines(F.col("raw_text")))
    return rows.select(
        "doc_id", F.size(T.authorization_lines(F.col("lines"))).cast("long").alias("authorization_lines"),
        F.size(T.education_lines(F.col("lines"))).cast("long").alias("education_lines"),
    )


@query("fn_25_html_to_text")
def fn_25(spark, sf):
    return fill_slots(table(spark, sf, "pages")).select("page_id", digest(html_to_text("html")).alias("text_hash"))


@query("fn_26_page_evidence")
def fn_26(spark, sf):
    rows = fill_slots(table(spark, sf, "pages")).select("page_id", parse_page("html", F.lit("text/html")).alias("p"))
    return rows.select(
        "page_id", "p.document_title", digest(F.col("p.visible_text")).alias("visible_hash"), F.size("p.links").alias("links"),
        F.size("p.buttons").alias("buttons"), F.size("p.postings").alias("postings"),
    )


@query("fn_32_half_even", "SELECT p_partkey, CAST(round_even(p_size / 2.0, 0) AS INTEGER) AS half, CAST(round_even(p_size * 2.5, 0) AS INTEGER) AS more FROM part")
def fn_32(spark, sf):
    return table(spark, sf, "part").select("p_partkey", half_even(F.col("p_size") / 2).alias("half"), half_even(F.col("p_size") * 2.5).alias("more"))


# ---------------------------------------------------------------- crawl and pages
@query("src_05_crawl_records", "SELECT page_id, sha256(html) AS body_sha256, octet_length(encode(html)) AS bytes FROM pages")
def src_05(spark, sf):
    return crawled(spark, sf).select("page_id", "body_sha256", F.octet_length("body").cast("long").alias("bytes"))


def crawled(spark, sf):
    return crawl(pages_of(spark, sf))


def pages_of(spark, sf):
    """Pages as a crawl of listings: the expected title is the page's own for two of three."""
    rows = fill_slots(table(spark, sf, "pages"))
    title = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    host = U.host_of(F.col("url"))
    n = F.col("page_id")
    return rows.select(
        "page_id", F.when(n % 3 == 0, "Senior zymurgist of orbital works").otherwise(title).alias("title"), host.alias("company"),
        F.when(n % 11 == 0, F.concat(F.lit("http://user:pw@"), host, F.lit("/x"))).when(n % 13 == 0, F.concat(F.lit("https://"), host, F.lit(":8443/x"))).otherwise(F.col("url")).alias("final_url"),
        F.when(n % 17 == 0, 404).otherwise(200).alias("status_code"), F.when(n % 19 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type_raw"),
        F.when(n % 19 == 0, "application/pdf").otherwise("text/html").alias("content_type"), F.when(n % 23 == 0, "gzip").otherwise("").alias("content_encoding"), F.col("html").alias("body"),
    )


@query("flt_13_crawl_gate", """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'embedded_credentials' WHEN page_id % 13 = 0 THEN 'non_standard_port'
  WHEN page_id % 19 = 0 THEN 'unsupported_content_type' WHEN page_id % 23 = 0 THEN 'unsupported_encoding' WHEN octet_length(encode(html)) > 750000 THEN 'too_large' END AS reject_reason FROM pages""")
def flt_13(spark, sf):
    return crawled(spark, sf).select("page_id", "reject_reason")


@query("page_interpretation")
def page(spark, sf):
    rows = interpret_pages(pages_of(spark, sf), "2026-01-01")
    return rows.select(
        "page_id", "listing_status", "confidence", F.round("title_score", 4).alias("title_score"), F.round("company_score", 4).alias("company_score"),
        "apply_action_found", "deadline_status", F.array_join("wrong_page_signals", ",").alias("wrong_page_signals"),
    )


# ---------------------------------------------------------------- extraction
@query("intake_listing_records")
def intake(spark, sf):
    rows = extract_listings(adverts(spark, sf))
    return rows.select(
        "doc_id", "title", "company", "location", "employment_type", "work_arrangement", "seniority_level", "deadline_status",
        F.array_join("required_skills", "|").alias("required_skills"), F.array_join("preferred_skills", "|").alias("preferred_skills"),
        F.array_join("required_education", "|").alias("required_education"), F.size("hard_disqualifiers").alias("hard_disqualifiers"), F.array_join("warnings", ",").alias("warnings"),
    )


def _section(name: str) -> str:
    """Lines after the first heading of a group up to the next heading of any, 20 at most."""
    quoted = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
    at = lambda group, after: f"list_min(list_filter(range(1, len(k) + 1), lambda i: i > {after} AND list_contains({quoted(group)}, k[i])))"
    start = at(T.SECTION_HEADINGS[name], 0)
    return f"coalesce(array_to_string(l[{start} + 1:least(coalesce({at(T.ALL_HEADINGS, start)}, len(k) + 1) - 1, {start} + {T.SECTION_LINES})], '|'), '')"


@query("win_11_intake_sections", f"""WITH {ADVERTS}, {LINES} SELECT doc_id, {_section('required_skills')} AS required_skills, {_section('preferred_skills')} AS preferred_skills FROM keyed""")
def win_11(spark, sf):
    rows = adverts(spark, sf).withColumn("lines", T.clean_lines(F.col("raw_text")))
    rows = rows.withColumn("keys", F.transform("lines", T.heading_key))
    part = lambda name: F.array_join(T.section(F.col("lines"), F.col("keys"), T.SECTION_HEADINGS[name]), "|")
    return rows.select("doc_id", part("required_skills").alias("required_skills"), part("preferred_skills").alias("preferred_skills"))


def resumes(spark, sf):
    """A document as a resume: facts from its id above, its text as the experience."""
    n = F.col("doc_id")
    head = F.concat(F.lit("Jane Q. Doe\njane"), n.cast("string"), F.lit("@mail.example.com | (555) 123-4567 | Boston, MA\nhttps://example.com/jane"))
    school = F.lit("\n\nEDUCATION\nState University | BSc Physics, May 2020\n- honours\n\nNight School\nFall 2021\n\nTechnical Skills:\nLanguages: Python, SQL; python | C++\n\nExperience\n")
    return documents(spark, sf).select("doc_id", F.concat(F.when(n % 4 != 0, head).otherwise("about this person 7"), school, "text").alias("text"))


@query("resume_profiles")
def resume(spark, sf):
    rows = extract_documents(resumes(spark, sf))
    return rows.select(
        "doc_id", "identity.full_name", "identity.email", "identity.phone", "identity.location", F.array_join("identity.links", "|").alias("links"),
        F.array_join("profile.skills", "|").alias("skills"), F.to_json("profile.education").alias("education"), F.size("profile.experience").alias("experience"),
        F.array_join("warnings", ",").alias("warnings"),
    )


@query("fn_23_identity_patterns", r"""SELECT doc_id, regexp_extract(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b') AS email,
  len(regexp_extract_all(text, '(?i)(https?://[^\s|]+|(?:linkedin\.com|github\.com)/[^\s|]+)')) AS links FROM documents""")
def fn_23(spark, sf):
    from ..plans.resume import EMAIL, LINK

    return documents(spark, sf).select(
        "doc_id", F.regexp_extract("text", EMAIL, 0).alias("email"), F.size(F.regexp_extract_all("text", F.lit(LINK), F.lit(1))).cast("long").alias("links")
    )


@query("win_12_blocks", "SELECT doc_id, CAST(2 AS BIGINT) AS education_blocks, CAST(1 AS BIGINT) AS header_blocks FROM documents")
def win_12(spark, sf):
    rows = resumes(spark, sf).withColumn("lines", numbered_lines(F.col("text")))
    count = lambda s: F.size(blocks(section_lines(F.col("lines"), s))).cast("long")
    return rows.select("doc_id", count("education").alias("education_blocks"), count("header").alias("header_blocks"))


# ---------------------------------------------------------------- dedup
def library(spark, sf):
    """Documents as listings: role from source and language, address from pages of the same number."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return D.with_keys(documents(spark, sf).join(pages, "doc_id", "left"), url="url", text="text", title="source", company="lang", location="lang")


ADDRESS = """SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)', 1)) || '://' || lower(regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)', 2))
    || CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/' ELSE regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/+$', '') END
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&'), ''), '') AS u FROM pages"""


@query("join_09_tracked_duplicates", f"""WITH RECURSIVE k AS (SELECT doc_id, source, lang, sha256({FOLD.format(c='text')}) AS t, source || '|' || lang AS r, u FROM documents LEFT JOIN ({ADDRESS}) ON page_id = doc_id),
n AS (SELECT *, CASE WHEN u IS NULL THEN 0 ELSE count(*) OVER a - 1 END AS url_links, count(*) OVER b - 1 AS text_links, count(*) OVER c - 1 AS role_links,
    CASE WHEN first_value(doc_id) OVER a = doc_id THEN nth_value(doc_id, 2) OVER a ELSE first_value(doc_id) OVER a END AS pu,
    CASE WHEN first_value(doc_id) OVER b = doc_id THEN nth_value(doc_id, 2) OVER b ELSE first_value(doc_id) OVER b END AS pt,
    CASE WHEN first_value(doc_id) OVER c = doc_id THEN nth_value(doc_id, 2) OVER c ELSE first_value(doc_id) OVER c END AS pr
  FROM k WINDOW a AS (PARTITION BY u ORDER BY lang, source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
    b AS (PARTITION BY t ORDER BY lang, source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), c AS (PARTITION BY r ORDER BY lang, source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
-- Every document has a role, so that documents hang together as the roles do that share a text or an address.
e AS (SELECT DISTINCT r AS x, min(r) OVER (PARTITION BY t) AS y FROM k UNION SELECT DISTINCT r, min(r) OVER (PARTITION BY u) FROM k WHERE u IS NOT NULL),
reach(x, y) AS (SELECT x, x FROM e UNION SELECT reach.x, b FROM reach JOIN (SELECT x AS a, y AS b FROM e UNION SELECT y, x FROM e) ON reach.y = a),
least_of AS (SELECT reach.x AS r, min(doc_id) AS component_id FROM reach JOIN k ON k.r = reach.y GROUP BY 1)
SELECT doc_id AS candidate_id, url_links, text_links, role_links, CASE WHEN url_links > 0 THEN 'exact_url' WHEN text_links > 0 THEN 'exact_text' WHEN role_links > 0 THEN 'same_role' END AS reason,
  url_links > 0 OR text_links > 0 AS blocking, CASE WHEN url_links > 0 THEN pu WHEN text_links > 0 THEN pt WHEN role_links > 0 THEN pr END AS first_job_id, component_id FROM n JOIN least_of USING (r)""")
def join_09(spark, sf):
    """Every document against all others by address, text and role: links by key, the strongest reason, the first of its class."""
    rows = settle(library(spark, sf).select("doc_id", "source", "lang", "url_key", "text_key", "role_key"))
    mine = rows.select(F.col("doc_id").alias("candidate_id"), "url_key", "text_key", "role_key")
    tracked = rows.select(F.col("doc_id").alias("job_id"), F.col("source").alias("title"), F.col("lang").alias("company"), "url_key", "role_key")
    history = rows.select(F.col("doc_id").alias("job_id"), "url_key", "text_key")
    found = D.tracked_classes(mine, D.key_classes(tracked, history), same=True)
    groups = D.linked_groups(mine, "candidate_id", ("url_key", "text_key", "role_key"))
    return found.join(groups, "candidate_id")


@query("join_09_copy_groups", f"""SELECT sha256({FOLD.format(c='text')}) AS text_key, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1""")
def copy_groups(spark, sf):
    """Exact-text duplicates at any scale: one row per text, never the pairs."""
    return documents(spark, sf).groupBy(listing_text_sha256(F.col("text")).alias("text_key")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


@query("flt_12_validity", """SELECT doc_id, CASE WHEN doc_id % 9 = 0 AND doc_id % 5 = 0 THEN 'no_identifier' WHEN doc_id % 5 <> 0 AND doc_id % 8 = 0 THEN 'invalid_url'
  WHEN len(trim(text)) < 40 THEN 'text_too_short' END AS reject_reason FROM documents""")
def flt_12(spark, sf):
    n = F.col("doc_id")
    rows = documents(spark, sf).select(
        "doc_id", F.when(n % 9 == 0, " ").otherwise(n.cast("string")).alias("external_id"),
        F.when(n % 5 == 0, "").when(n % 8 == 0, "ftp://x/y").otherwise(F.concat(F.lit("https://x.example/"), n.cast("string"))).alias("source_url"), F.col("text").alias("raw_text"),
    )
    return validity(rows).select("doc_id", "reject_reason")


# ---------------------------------------------------------------- grounding
@query("join_21_shared_passages", f"""SELECT doc_id, item_id FROM (SELECT doc_id, {COMPACT.format(c='text')} AS t FROM documents) JOIN (SELECT item_id, {COMPACT.format(c='text')} AS p FROM benchmark) ON contains(t, p)""")
def join_21(spark, sf):
    return G.shared_passages(documents(spark, sf), table(spark, sf, "benchmark"))


@query("join_21_grounded_claims", f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(coalesce(string_split(text, '.')[2], '')) ELSE 'invented ' || doc_id END AS claim, text FROM documents)
SELECT doc_id, ({FOLD.format(c='claim')} <> '' AND contains({FOLD.format(c='text')}, {FOLD.format(c='claim')})) OR ({COMPACT.format(c='claim')} <> '' AND contains({COMPACT.format(c='text')}, {COMPACT.format(c='claim')})) AS grounded FROM c""")
def grounded(spark, sf):
    docs = documents(spark, sf)
    second = F.coalesce(F.get(F.split("text", "\\."), F.lit(1)), F.lit(""))
    claims = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper(second)).otherwise(F.concat(F.lit("invented "), F.col("doc_id").cast("string"))).alias("claim"))
    return G.grounded(claims, docs, "claim", "text").select("doc_id", "grounded")


@query("join_22_anchored_excerpts")
def join_22(spark, sf):
    """Sentences of a shared passage anchored in each document that holds it."""
    pairs = G.shared_passages(documents(spark, sf), table(spark, sf, "benchmark"))
    rows = pairs.join(documents(spark, sf).select("doc_id", "text"), "doc_id").join(table(spark, sf, "benchmark").withColumnRenamed("text", "passage"), "item_id")
    claims = F.filter(F.transform(F.split("passage", "\\."), G.compact_lower), lambda c: c != "")
    excerpt = G.anchor(F.col("text"), F.array_distinct(claims))
    return rows.select("doc_id", "item_id", F.length(excerpt).alias("excerpt_chars"), digest(excerpt).alias("excerpt"))


VERDICTS = f"""WITH d AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l, len(text) AS n FROM documents),
  w AS (SELECT *, string_split(l[1], ' ') AS f, string_split(l[(len(l) + 1) // 2], ' ') AS m FROM d),
  q AS (SELECT doc_id, text, CASE n % 4 WHEN 0 THEN l[1] WHEN 1 THEN l[1] || ' indeed' WHEN 2 THEN l[len(l)] ELSE '' END AS excerpt,
    list_concat([array_to_string(f[2:4], ' '), array_to_string(m[2:4], ' ')], CASE WHEN n % 5 = 0 THEN ['zz not there'] ELSE [] END) AS claims FROM w),
  c AS (SELECT doc_id, text, excerpt, list_distinct(list_filter(list_transform(claims, lambda x: {COMPACT.format(c='x')}), lambda x: x <> '')) AS cs,
    {COMPACT.format(c='excerpt')} AS e, {FOLD.format(c='excerpt')} <> '' AND contains({FOLD.format(c='text')}, {FOLD.format(c='excerpt')}) AS verbatim FROM q),
  s AS (SELECT *, len(list_filter(cs, lambda x: contains(e, x))) > 0 AS supports, trim(excerpt) <> '' AS cited FROM c),
  o AS (SELECT *, len(cs) > 0 AND NOT (verbatim AND supports) AND (supports OR NOT cited) AS open FROM s),
  lines AS (SELECT doc_id, cs, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM o WHERE open),
  marked AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM lines),
  blocks AS (SELECT doc_id, block, any_value(cs) AS cs, list(line ORDER BY i) AS ls, list({COMPACT.format(c='line')} ORDER BY i) AS co FROM marked WHERE line <> '' GROUP BY 1, 2),
  spans AS (SELECT *, unnest(range(a, least(a + 8, len(ls) + 1))) AS b FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS a FROM blocks)),
  tried AS (SELECT doc_id, block, a, b, array_to_string(ls[a:b], chr(10)) AS body, len(cs) AS total, len(list_filter(cs, lambda x: contains(array_to_string(co[a:b], ''), x))) AS n FROM spans),
  best AS (SELECT doc_id, body FROM tried WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n = total DESC, n DESC, b - a, len(body), block, a) = 1)
SELECT doc_id, CASE WHEN len(cs) = 0 THEN 'rejected' WHEN verbatim AND supports THEN 'kept' WHEN open AND body IS NOT NULL THEN 're_anchored' ELSE 'rejected' END AS verdict,
  CASE WHEN len(cs) = 0 THEN 'no_claims' WHEN verbatim AND supports THEN '' WHEN NOT open THEN 'unsupported' WHEN body IS NULL THEN 'not_anchored' WHEN cited THEN 'not_verbatim' ELSE 'no_support' END AS reason,
  sha256(CASE WHEN len(cs) > 0 AND verbatim AND supports THEN excerpt WHEN open THEN coalesce(body, '') ELSE '' END) AS anchored FROM o LEFT JOIN best USING (doc_id)"""


@query("join_22_excerpt_verdicts", VERDICTS)
def join_22_verdicts(spark, sf):
    """Two claims of each document, from its first and its middle line, and an excerpt that holds them, is altered, is another line or missing."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = documents(spark, sf).select("doc_id", "text", F.length("text").alias("n"), lines.alias("l"))
    at = lambda i: F.get(F.col("l"), i)
    three = lambda line: F.array_join(F.slice(F.split(line, " "), 2, 3), " ")
    first, middle, n = at(F.lit(0)), at(F.floor((F.size("l") + 1) / 2).cast("int") - 1), F.col("n")
    excerpt = F.when(n % 4 == 0, first).when(n % 4 == 1, F.concat(first, F.lit(" indeed"))).when(n % 4 == 2, at(F.size("l") - 1)).otherwise("")
    claims = F.array_compact(F.array(three(first), three(middle), F.when(n % 5 == 0, "zz not there")))
    judged = G.judge_excerpts(rows.select("doc_id", "text", excerpt.alias("excerpt"), claims.alias("claims")), "text", "excerpt", "claims")
    return judged.select("doc_id", "verdict", "reason", digest(F.col("anchored")).alias("anchored"))


@query("join_22_cover_excerpts")
def join_22_cover(spark, sf):
    pairs = G.shared_passages(documents(spark, sf), table(spark, sf, "benchmark"))
    rows = pairs.join(documents(spark, sf).select("doc_id", "text"), "doc_id").join(table(spark, sf, "benchmark").withColumnRenamed("text", "passage"), "item_id")
    rows = rows.select("doc_id", "item_id", G.document_blocks(F.col("text")).alias("b"), F.filter(F.transform(F.split("passage", "\\."), X.strip), lambda c: c != "").alias("c"))
    return rows.select("doc_id", "item_id", F.size(G.cover_excerpts(F.col("b"), F.col("c"))).alias("excerpts"))


@query("join_26_verbatim_quotes", """SELECT doc_id, contains(text, CASE WHEN doc_id % 3 = 0 THEN upper(substr(text, 11, 30)) ELSE substr(text, 11, 30) END) AS verbatim FROM documents""")
def join_26(spark, sf):
    docs = documents(spark, sf)
    part = F.substring("text", 11, 30)
    quotes = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.upper(part)).otherwise(part).alias("quote"))
    return G.verbatim_quotes(quotes, docs, "quote", "text").select("doc_id", "verbatim")


@query("join_06_entry_terms", f"""WITH n AS (SELECT doc_id, {NORM.format(c='raw_text')} AS t FROM (SELECT doc_id, text || ' ' || (['Quality Engineer','Barista','R&D Engineer','V&V lead'])[doc_id % 4 + 1] AS raw_text FROM documents))
SELECT doc_id, {' OR '.join("contains(t, '" + X.fold_literal(x) + "')" for x in ENTRY_TERMS)} AS entry FROM n""")
def join_06(spark, sf):
    word = F.element_at(F.array(*[F.lit(x) for x in ("Quality Engineer", "Barista", "R&D Engineer", "V&V lead")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return documents(spark, sf).select("doc_id", mentions(X.normalize_text(F.concat_ws(" ", "text", word)), ENTRY_TERMS).alias("entry"))


def _tag_sql(phrases, whole):
    cases = []
    for name in sorted(phrases):
        tests = []
        for p in phrases[name]:
            body = X.fold_literal(p).replace("+", "\\+")
            tests.append(f"regexp_matches(' ' || t || ' ', '[^a-z0-9]{body}[^a-z0-9]')" if whole or len(X.fold_literal(p)) <= 3 else f"contains(t, '{X.fold_literal(p)}')")
        cases.append(f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END")
    return "concat_ws(',', " + ", ".join(cases) + ")"


_V = Vocabulary()
PHRASES = tuple(X.fold_literal(p) for _, ps in list(_V.concepts.values()) + list(_V.families.values()) for p in ps)


def phrased(spark, sf):
    """The whole document with two vocabulary phrases around it, picked by its id."""
    pick = lambda k: F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("doc_id") * k) % len(PHRASES) + 1).cast("int"))
    return documents(spark, sf).select("doc_id", F.concat_ws(" ", pick(1), "text", pick(7)).alias("text"))


PHRASED = "ph(l) AS (SELECT [" + ", ".join(f"'{p}'" for p in PHRASES) + f"]), d AS (SELECT doc_id, l[doc_id % {len(PHRASES)} + 1] || ' ' || text || ' ' || l[(doc_id * 7) % {len(PHRASES)} + 1] AS text FROM documents, ph), n AS (SELECT doc_id, {NORM.format(c='text')} AS t FROM d)"


@query("join_04_concept_tags", f"WITH {PHRASED} SELECT doc_id, {_tag_sql({n: _V.concepts[n][1] for n in _V.names(False)}, False)} AS concepts, {_tag_sql({n: _V.concepts[n][1] for n in _V.names(True)}, False)} AS roles FROM n")
def join_04(spark, sf):
    rows = phrased(spark, sf).withColumn("t", X.normalize_text(F.col("text")))
    return rows.select(
        "doc_id", F.array_join(_V.concept_tags(F.col("t")), ",").alias("concepts"), F.array_join(_V.concept_tags(F.col("t"), True), ",").alias("roles")
    )


@query("join_07_family_tags", f"WITH {PHRASED} SELECT doc_id, {_tag_sql({n: _V.families[n][1] for n in _V.families}, True)} AS families FROM n")
def join_07(spark, sf):
    rows = phrased(spark, sf).withColumn("t", X.normalize_text(F.col("text")))
    return rows.select("doc_id", F.array_join(_V.family_tags(F.col("t")), ",").alias("families"))
