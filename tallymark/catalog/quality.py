"""Extractions compared, payloads checked, profiles overlaid, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import listing as T
from ..functions import text as X
from ..operators import claims as K
from ..operators import extractors as E
from ..operators import listing as L
from ..operators import quality as Q
from ..operators.duplicates import with_keys
from ..operators.spread import fill_slots
from ..plans.discovery import duplicates_and_relevance
from ..plans.resume import extract_documents
from ..session import checkpoint_dir
from ..sources import cases, feeds, providers, sinks
from ..sources.tables import TABLES, table
from ..streaming import lifecycle as S
from .histories import claims, fetches, sightings
from .registry import query
from .views import postings
from .texts import ADVERTS, CHAIN, FOLD, adverts, documents, resumes

KINDS = {"job.title": "text", "job.employment_type": "typed", "job.work_arrangement": "typed"}


def expected_fields(spark, sf):
    """What an advert should yield, from the fact line its id picks."""
    n = F.col("doc_id") % 7
    title = F.when(n == 4, "Lead Analyst").when(n == 5, "lead  analyst!").otherwise("")
    employment = F.when(n == 0, "full_time").when(n == 1, "part_time").when(n == 2, "contract").when(n == 3, "internship").otherwise("unknown")
    desk = F.when(n == 0, "hybrid").when(n == 1, "remote").when(n == 2, "onsite").otherwise("")
    rows = adverts(spark, sf).select(F.col("doc_id").alias("case_id"), title.alias("t"), employment.alias("e"), desk.alias("d"))
    return Q.field_rows(rows, "case_id", {"job.title": F.col("t"), "job.employment_type": F.col("e"), "job.work_arrangement": F.col("d")}, "expected")


def actual_fields(spark, sf):
    rows = adverts(spark, sf).withColumn("lines", T.clean_lines(F.col("raw_text")))
    labelled = T.labeled_value(F.col("lines"), T.TITLE_LABELS)
    rows = rows.select(
        F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 7 == 5, "Lead Analyst").otherwise(labelled).alias("t"),
        T.employment_type(F.col("raw_text")).alias("e"), T.work_arrangement(F.col("raw_text")).alias("d"),
    )
    return Q.field_rows(rows, "case_id", {"job.title": F.col("t"), "job.employment_type": F.col("e"), "job.work_arrangement": F.col("d")}, "actual")


def comparisons(spark, sf):
    return Q.compare_scalars(expected_fields(spark, sf), actual_fields(spark, sf), KINDS)


COMPARED = f"""WITH {ADVERTS}, v AS (SELECT doc_id AS case_id, doc_id % 7 AS n, {CHAIN(T.EMPLOYMENT_PATTERNS, 'lower(raw_text)')} AS e, {CHAIN(T.ARRANGEMENT_PATTERNS, 'lower(raw_text)')} AS d FROM adverts),
f AS (SELECT case_id, 'job.title' AS path, 'exact' AS status FROM v
  UNION ALL SELECT case_id, 'job.employment_type', CASE WHEN e = CASE n WHEN 0 THEN 'full_time' WHEN 1 THEN 'part_time' WHEN 2 THEN 'contract' WHEN 3 THEN 'internship' ELSE 'unknown' END THEN 'exact' ELSE 'incorrect' END FROM v
  UNION ALL SELECT case_id, 'job.work_arrangement', CASE WHEN n > 2 THEN 'unexpected' WHEN d = CASE n WHEN 0 THEN 'hybrid' WHEN 1 THEN 'remote' ELSE 'onsite' END THEN 'exact' ELSE 'incorrect' END FROM v)"""


def line_pairs(spark, sf):
    """Each turn's sentences as expected lines, the same without every third letter pair as found lines."""
    rows = fill_slots(table(spark, sf, "conversations"))
    lines = F.array_join(F.transform(F.split("text", "[.\n]+"), lambda x: F.trim(x)), "\n")
    changed = F.when(F.col("turn") % 2 == 0, lines).otherwise(F.regexp_replace(lines, "th", "d"))
    return rows.select("conv_id", "turn", lines.alias("expected"), changed.alias("actual"))


@query("join_16_list_matching")
def join_16(spark, sf):
    rows = Q.compare_lists(line_pairs(spark, sf))
    return rows.select(
        "conv_id", "turn", "status", F.round("score", 4).alias("score"), F.size("matches").alias("matched"),
        F.size("missing_items").alias("missing"), F.size("unexpected_items").alias("unexpected"),
    )


@query("join_16_sequential_matching")
def join_16_sequential(spark, sf):
    rows = line_pairs(spark, sf).withColumns({c: Q.keyed_items(F.filter(F.split(c, "\n"), lambda x: x != "")) for c in ("expected", "actual")})
    rows = rows.withColumn("m", Q.sequential_match(F.col("expected"), F.col("actual")))
    return rows.select("conv_id", "turn", F.round("m.score", 4).alias("score"), F.size("m.missing").alias("missing"), F.size("m.unexpected").alias("unexpected"))


@query("set_04_line_set_equality", """WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(list_transform(string_split_regex(text, '[.\\n]+'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '')) AS a,
  list_distinct(list_filter(list_transform(string_split_regex(CASE WHEN turn % 2 = 0 THEN text ELSE replace(text, 'th', 'd') END, '[.\\n]+'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '')) AS b FROM conversations)
SELECT conv_id, turn, list_sort(a) = list_sort(b) AS same FROM t""")
def set_04(spark, sf):
    rows = line_pairs(spark, sf)
    keys = lambda c: F.array_distinct(F.filter(F.transform(F.split(c, "\n"), Q.compare_text_plain), lambda x: x != ""))
    rows = rows.withColumns({"a": keys("expected"), "b": keys("actual")})
    return rows.select("conv_id", "turn", ((F.size(F.array_except("a", "b")) == 0) & (F.size(F.array_except("b", "a")) == 0)).alias("same"))


# ---------------------------------------------------------------- evidence, criticals, gates
def resume_rows(spark, sf):
    return extract_documents(resumes(spark, sf))


@query("join_20_critical_and_forbidden", f"""{COMPARED}, j AS (SELECT case_id, bool_and(status = 'exact') AS ok FROM f WHERE path <> 'job.title' GROUP BY 1)
SELECT j.case_id, ok AS passed, CAST(contains(lower(text), 'worthless') AS INTEGER) AS forbidden FROM j JOIN documents ON j.case_id = doc_id""")
def join_20(spark, sf):
    wanted = documents(spark, sf).select(F.col("doc_id").alias("case_id"), F.explode(F.array(F.lit("job.employment_type"), F.lit("job.work_arrangement"))).alias("path"))
    passed = Q.critical_claims(wanted, comparisons(spark, sf)).groupBy("case_id").agg(F.bool_and("passed").alias("passed"))
    cases = documents(spark, sf).select(F.col("doc_id").alias("case_id"), F.array(F.lit("WORTHLESS")).alias("forbidden"))
    hits = Q.forbidden_hits(cases, documents(spark, sf).select(F.col("doc_id").alias("case_id"), F.to_json(F.struct("text")).alias("serialised")))
    return passed.join(hits, "case_id").select("case_id", "passed", F.size("hits").alias("forbidden"))


@query("join_25_fallback_merge", """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'primary_success' WHEN doc_id % 5 <> 0 THEN 'fallback_success' ELSE 'all_extractors_failed' END AS status,
  CASE WHEN doc_id % 3 <> 0 THEN 'first' WHEN doc_id % 5 <> 0 THEN 'second' END AS result, CAST(CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 2 END AS INTEGER) AS attempts,
  CAST(CASE WHEN doc_id % 3 <> 0 THEN 0 WHEN doc_id % 5 <> 0 THEN 2 ELSE 3 END AS INTEGER) AS warnings FROM documents""")
def join_25(spark, sf):
    def side(name, gap, category):
        ok = F.col("doc_id") % gap != 0
        return documents(spark, sf).select(
            "doc_id", F.when(ok, F.struct(F.lit(name).alias("by"))).alias("result"), F.array().cast("array<string>").alias("warnings"),
            F.when(~ok, category).alias("error_category"), F.when(~ok, "no answer").alias("error_message"), F.lit(name).alias("provider"),
        )

    rows = E.merge_fallback(side("first", 3, "timeout"), side("second", 5, "unavailable"), "doc_id")
    return rows.select("doc_id", "status", F.col("result.by").alias("result"), F.size("attempts").alias("attempts"), F.size("warnings").alias("warnings"))


def _word_count(text):
    if len(text) < 40:
        raise E.ExtractionFailure("invalid_response", "too short")
    return {"words": len(text.split(" ")), "first": text.split(" ")[0]}


@query("udf_01_registered_extractor", """SELECT doc_id, CASE WHEN len(text) >= 40 THEN len(string_split(text, ' ')) END AS words, CASE WHEN len(text) < 40 THEN 'invalid_response' ELSE '' END AS error_category FROM documents""")
def udf_01(spark, sf):
    """UDF-01, UDF-04: a row that fails carries its category, the job goes on."""
    E.register_extractor("word_count", "v1", "words long, first string", _word_count)
    rows = E.run_extractor(documents(spark, sf), "word_count", "doc_id", "text")
    return rows.select("doc_id", "result.words", F.coalesce("error_category", F.lit("")).alias("error_category"))


def _events_provider(search):
    """Opportunities of the events of the asked sources; those of errors bring neither id nor text."""
    spark, sf = search.sparkSession, search.first()["folder"]
    asked = search.select(F.explode("sources").alias("event_type")).distinct()
    broken, event = F.col("event_type") == "error", F.col("event_id").cast("string")
    return table(spark, sf, "events").join(asked, "event_type").select(
        F.when(broken, "").otherwise(event).alias("external_id"), F.when(F.col("value") > 90, "no address").when(broken, "").otherwise(F.concat(F.lit(" https://b.example/"), event)).alias("source_url"),
        F.concat(F.lit("Role "), F.col("user_id").cast("string")).alias("title_hint"), F.concat_ws(" ", F.lit("A listing text of a fair length for number"), event).alias("raw_text"),
    )


@query("udf_02_registered_provider", """SELECT 'events' AS provider, 'v1' AS provider_version, coalesce(reason, '') AS reject_reason, count(*) AS n, count(DISTINCT title) AS titles FROM (
  SELECT CASE WHEN value > 90 THEN 'invalid_url' WHEN event_type = 'error' THEN 'no_identifier' END AS reason, 'Role ' || user_id AS title FROM events WHERE event_type IN ('view', 'click', 'error')) GROUP BY 3""")
def udf_02(spark, sf):
    """UDF-02: a provider run by its key; rows that break the contract keep their place with a reason."""
    providers.register_provider("events", "Events", "v1", _events_provider)
    search = spark.createDataFrame([(sf, ["view", "click", "error"])], "folder string, sources array<string>")
    rows = providers.discover_with("events", search)
    return rows.groupBy("provider", "provider_version", F.coalesce("reject_reason", F.lit("")).alias("reject_reason")).agg(F.count("*").alias("n"), F.count_distinct("title_hint").alias("titles"))


@query("udf_03_registered_verifier", """SELECT o_orderkey AS job_id, CASE WHEN o_totalprice <= 1000 THEN 'input' ELSE '' END AS error_category, CASE WHEN o_totalprice <= 1000 THEN 'failed' ELSE 'needs_review' END AS status,
  CASE WHEN o_totalprice <= 1000 THEN 'unknown' ELSE 'low' END AS confidence, CASE WHEN o_totalprice <= 1000 THEN '' ELSE 'https://jobs.example.com/' || o_orderkey END AS final_url, 'unverified' AS detected_listing_status FROM orders JOIN customer ON o_custkey = c_custkey""")
def udf_03(spark, sf):
    """UDF-03: a verifier run by its version over all postings."""
    providers.register_verifier("url-readiness-1", providers.url_readiness)
    rows = providers.verify_with("url-readiness-1", postings(spark, sf).select("job_id", "job_url", "title", "company"))
    return rows.select("job_id", F.coalesce("error_category", F.lit("")).alias("error_category"), "status", "confidence", "final_url", "detected_listing_status")


@query("prj_10_default_merge", """SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) AS k, 'unknown' AS status FROM events""")
def prj_10(spark, sf):
    rows = table(spark, sf, "events").withColumn("p", F.from_json("props", "k int, status string"))
    merged = E.with_defaults(F.col("p"), {"k": F.lit(0), "status": F.lit("unknown")})
    return rows.select("event_id", merged.alias("m")).select("event_id", "m.*")


@query("prj_09_line_list_cleanup", """SELECT conv_id, turn, len(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(trim(x))), lambda x: x <> ''))) AS lines FROM conversations""")
def prj_09(spark, sf):
    clean = X.clean_line_list(F.concat_ws("\n", F.lit(" "), "text", F.concat(F.lit(" "), "text")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(F.split(clean, "\n")).cast("long").alias("lines"))


# ---------------------------------------------------------------- payloads
def payloads(spark, sf):
    """Orders as extraction payloads, some of them wrong in one way."""
    n = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    job = F.struct(
        F.col("o_orderpriority").alias("title"), F.lit("c").alias("company"), F.lit("").alias("location"), F.when(n % 3 == 0, "gig").otherwise("full_time").alias("employment_type"),
        F.lit("remote").alias("work_arrangement"), F.lit("").alias("salary_text"), F.lit("").alias("date_posted"), F.when(n % 5 == 0, "confirmed").otherwise("unknown").alias("deadline_status"),
        F.when(n % 10 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("application_deadline"),
    )
    lists = ("required_skills", "preferred_skills", "required_education", "preferred_education", "responsibilities", "certifications", "work_authorization_requirements", "hard_disqualifiers")
    req = F.struct(
        F.lit("r").alias("role_family"), F.lit("senior").alias("seniority_level"), F.lit("i").alias("industry"), *[none.alias(c) for c in lists],
        (n % 70).alias("minimum_years_experience"), F.lit(65).alias("maximum_years_experience"), F.lit("").alias("requirement_notes"),
    )
    whole = F.struct(job.alias("job"), req.alias("requirements"), none.alias("evidence"), none.alias("warnings"))
    extra = F.regexp_replace(F.to_json(whole), "\"warnings\":\\[\\]", "\"notes\":1")
    return table(spark, sf, "orders").select(n.alias("job_id"), F.when(n % 7 == 0, extra).otherwise(F.to_json(whole)).alias("payload"))


@query("fn_28_payload_violations", """SELECT o_orderkey AS job_id, concat_ws('; ', CASE WHEN o_orderkey % 7 = 0 THEN '$ missing warnings; $ extra notes' END, CASE WHEN o_orderkey % 3 = 0 THEN 'job.employment_type not_allowed' END,
  CASE WHEN o_orderkey % 70 > 60 THEN 'requirements.minimum_years_experience out_of_range' END, 'requirements.maximum_years_experience out_of_range', CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN 'confirmed_without_date' END,
  CASE WHEN o_orderkey % 70 > 65 THEN 'max_years_below_min' END) AS violations FROM orders""")
def fn_28(spark, sf):
    rows = payloads(spark, sf).withColumn("parsed", F.try_parse_json("payload"))
    return rows.select("job_id", F.array_join(Q.payload_violations(F.col("payload"), F.col("parsed")), "; ").alias("violations"))


@query("set_06_key_conformity", """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 7 = 0 THEN '$ missing warnings; $ extra notes' ELSE '' END AS problems FROM orders""")
def set_06(spark, sf):
    return payloads(spark, sf).select("job_id", F.array_join(Q.key_problems(F.col("payload"), "$", Q.KEYS["$"]), "; ").alias("problems"))


# ---------------------------------------------------------------- overlay
@query("join_23_effective_profiles")
def join_23(spark, sf):
    """Customers as manual profiles under the snapshot composed from their events."""
    snapshots = K.compose_profiles(claims(spark, sf)).withColumn("status", F.when(F.col("profile_id") % 3 != 0, "active").otherwise("archived"))
    manual = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("profile_id"), F.col("c_name").alias("full_name"), F.array(F.lit("v 1"), F.col("c_mktsegment")).alias("skills"),
        F.lit("Manual school").alias("education_summary"), F.lit("").alias("additional_context"),
    )
    rows = K.effective_profiles(manual, snapshots)
    return rows.select("profile_id", "full_name", F.array_join("skills", "|").alias("skills"), "education_summary", "additional_context")


@query("udtf_01_extraction_claims")
def udtf_01(spark, sf):
    rows = resume_rows(spark, sf).withColumnRenamed("doc_id", "review_id")
    return K.extraction_claims(rows).select("review_id", "claim_key", "field_path", "section", "claim_type", "position", F.sha2("fallback", 256).alias("value"))


# ---------------------------------------------------------------- sources
@query("src_02_batch_upsert", """SELECT CASE WHEN c_custkey IS NULL THEN 'created' WHEN c_mktsegment <> 'BUILDING' THEN 'skipped' ELSE 'refreshed' END AS action, count(*) AS rows
FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 30 GROUP BY 1""")
def src_02(spark, sf):
    target = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("job_url"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("source"))
    batch = table(spark, sf, "supplier").select((F.col("s_suppkey") * 30).cast("string").alias("job_url"), F.col("s_name").alias("title"))
    return sinks.upsert_batch(target, batch, "BUILDING", True)[1]


def feed(spark, sf):
    """Payloads as boards would send them: one page an hour and event type. Some listings have no title, some pages are cut short."""
    rows = table(spark, sf, "events")
    title = F.when(F.col("user_id") % 50 == 7, "").otherwise(F.concat(F.lit("Role "), F.col("user_id").cast("string")))
    listing = F.struct(
        F.col("user_id").cast("string").alias("id"), title.alias("title"),
        F.concat(F.lit("https://b.example/"), F.col("event_id").cast("string")).alias("absolute_url"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"),
        F.lit("<p>About <b>us</b></p><ul><li>one<li>two</ul>").alias("content"), F.struct(F.lit("Boston").alias("name")).alias("location"),
        F.array(F.struct(F.col("event_type").alias("name"))).alias("departments"), F.array().cast("array<struct<name:string>>").alias("offices"),
    )
    # A page holds one source's listings of one hour.
    pages = rows.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("page"), F.col("event_type").alias("source_key")).agg(F.collect_list(listing).alias("jobs"), F.min("ts").alias("ts"))
    payload = F.to_json(F.struct("jobs"))
    cut = (F.col("source_key") == "view") & (F.col("page") == 23)
    return pages.select(
        F.datediff("day", F.lit("2024-01-01").cast("date")).alias("run_id"), "source_key", F.lit("success").alias("status"),
        F.when(cut, F.substring(payload, F.lit(1), F.length(payload) - 3)).otherwise(payload).alias("payload"), "ts",
    )


def boards(spark, sf):
    names = table(spark, sf, "events").select(F.col("event_type").alias("key")).distinct()
    config = names.select(
        F.ascii("key").alias("position"), "key", F.upper("key").alias("label"), F.concat(F.lit("t-"), "key").alias("token"), F.lit("Web").alias("industry"), (F.col("key") != "error").alias("enabled"),
    )
    return feeds.approved_boards(config)


@query("src_04_feed_flatten", """WITH e AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS run_id, hour(ts) AS page, CASE WHEN event_type = 'error' THEN 'board_not_approved' WHEN event_type = 'view' AND hour(ts) = 23 THEN 'not_json' END AS whole FROM events),
r AS (SELECT run_id, event_type, whole AS reason, count(DISTINCT page) AS n FROM e WHERE whole IS NOT NULL GROUP BY ALL UNION ALL SELECT run_id, event_type, 'incomplete', count(*) FROM e WHERE whole IS NULL AND user_id % 50 = 7 GROUP BY ALL)
SELECT run_id, event_type AS source_key, 'listed' AS outcome, count(*) AS n, min(sha256('Role ' || user_id || chr(10) || upper(event_type) || chr(10) || 'Boston' || chr(10) || 'Departments: ' || event_type || chr(10) || chr(10) || 'About us' || chr(10) || chr(10) || '- one' || chr(10) || '- two')) AS text_hash
FROM e WHERE whole IS NULL AND user_id % 50 <> 7 GROUP BY 1, 2 UNION ALL SELECT run_id, event_type, reason, n, '' FROM r""")
def src_04(spark, sf):
    """All listings of all pages, and every page and listing that is refused with its reason."""
    rows, _, refused = feeds.flatten_feed(feed(spark, sf), boards(spark, sf))
    run = F.col("run_id").cast("long").alias("run_id")
    listed = rows.groupBy(run, "source_key").agg(F.lit("listed").alias("outcome"), F.count("*").alias("n"), F.min(F.sha2("raw_text", 256)).alias("text_hash"))
    return listed.unionByName(refused.groupBy(run, "source_key", F.col("reason").alias("outcome")).agg(F.count("*").alias("n"), F.lit("").alias("text_hash")))


@query("src_06_approved_boards", "SELECT DISTINCT event_type AS key, 't-' || event_type AS token FROM events WHERE event_type <> 'error'")
def src_06(spark, sf):
    return boards(spark, sf).select("key", "token")


def case_folders(spark, sf):
    """The benchmark's items as case folders: the text in one file, its record in another."""
    folder = workspace(spark, "cases")
    rows = table(spark, sf, "benchmark").select(F.concat(F.lit("case-"), F.col("item_id").cast("string")).alias("case_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("folder", F.col("case_id"))
    rows.select("folder", "text").write.partitionBy("folder").text(folder)
    rows.select("folder", "case_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("title")).write.mode("append").partitionBy("folder").json(folder)
    return folder


def read_cases(spark, folder):
    return cases.case_folder(spark, folder, "case_id string, title string", "*.txt", "*.json")


@query("src_03_case_folders", "SELECT 'case-' || item_id AS case_id, split_part(text, ' ', 1) AS title, sha256(trim(text)) AS text_sha256 FROM benchmark")
def src_03(spark, sf):
    return read_cases(spark, case_folders(spark, sf)).select("case_id", "title", F.sha2("text", 256).alias("text_sha256"))


@query("flt_14_selected_cases", "SELECT 'case-' || item_id AS case_id, split_part(text, ' ', 1) AS title FROM benchmark WHERE len(text) > (SELECT avg(len(text)) FROM benchmark)")
def flt_14(spark, sf):
    """The cases with texts above the mean, asked for by a table of ids."""
    found = read_cases(spark, case_folders(spark, sf))
    mean = table(spark, sf, "benchmark").agg(F.avg(F.length("text")).alias("mean"))
    asked = table(spark, sf, "benchmark").join(F.broadcast(mean), F.length("text") > F.col("mean"))  # one row
    asked = asked.select(F.concat(F.lit("case-"), F.col("item_id").cast("string")).alias("case_id"))
    return cases.select_cases(found, asked).select("case_id", "title")


@query("src_07_text_files", "SELECT 'case-' || item_id AS case_id, sha256(trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), chr(10)))) AS text_sha256, CAST(0 AS INTEGER) AS warnings FROM benchmark")
def src_07(spark, sf):
    rows = cases.text_documents(spark, case_folders(spark, sf))
    return rows.select(F.col("folder").alias("case_id"), F.sha2("text", 256).alias("text_sha256"), F.size("warnings").alias("warnings"))


@query("src_08_search_query", "SELECT c_custkey, c_name || '|' || c_mktsegment AS target_roles FROM customer")
def src_08(spark, sf):
    lines = F.concat_ws("\n", F.lit(""), F.concat(F.lit("  "), "c_name"), F.lit(" "), "c_mktsegment")
    rows = table(spark, sf, "customer").select("c_custkey", lines.alias("target_roles"), F.lit("").alias("target_industries"), F.lit("").alias("preferred_locations"))
    return feeds.search_query(rows).select("c_custkey", F.array_join("target_roles", "|").alias("target_roles"))


@query("discover_inbox_rows", """WITH e AS (SELECT *, 'https://b.example/' || CASE WHEN event_id % 2 = 0 THEN 'r' || user_id ELSE 'e' || event_id END AS u FROM events WHERE event_type <> 'error'),
d AS (SELECT *, lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS a, lag(event_id) OVER (PARTITION BY u ORDER BY ts, event_id) AS b FROM e),
j AS (SELECT d.*, c_custkey IS NOT NULL AND event_id % 2 = 0 AS same_url, c_custkey IS NOT NULL AS same_role FROM d LEFT JOIN customer ON c_custkey = user_id AND c_mktsegment = 'BUILDING')
SELECT event_type AS source_key, CASE WHEN a IS NOT NULL OR b IS NOT NULL OR same_url THEN 'duplicate' ELSE 'new' END AS status, CASE WHEN event_type = 'click' THEN 'broad_match' ELSE 'outside' END AS relevance,
  CASE WHEN a IS NOT NULL THEN 'provider_external_id' WHEN b IS NOT NULL THEN 'exact_url' ELSE '' END AS discovery_reason, CASE WHEN same_url THEN 'exact_url' WHEN same_role THEN 'same_role' ELSE '' END AS tracked_reason, count(*) AS n FROM j GROUP BY ALL
UNION ALL SELECT event_type, 'rejected', 'text_too_short', '', '', count(*) FROM events WHERE event_type = 'error' GROUP BY 1""")
def discover(spark, sf):
    """SNK-02: validity, duplicates of earlier discoveries and of tracked customers, and relevance of all arrivals; errors bring no text."""
    event, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    broken = F.col("event_type") == "error"
    rows = fill_slots(table(spark, sf, "events")).select(
        F.col("event_id").alias("opp_id"), F.col("ts").alias("discovered_at"), F.col("event_type").alias("provider"), user.alias("external_id"),
        F.concat(F.lit("https://b.example/"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("r"), user)).otherwise(F.concat(F.lit("e"), event))).alias("source_url"),
        F.concat(F.lit("Role "), user).alias("title_hint"), F.lit("Works").alias("company_hint"),
        F.col("event_type").alias("industry_hint"), F.lit("").alias("location_hint"), F.lit("").alias("arrangement_hint"), F.lit("").alias("employment_hint"),
        F.when(broken, "").otherwise(F.concat_ws(" ", F.lit("A listing text of a fair length for number"), event)).alias("raw_text"),
    )
    none = F.array().cast("array<string>")
    wanted = rows.select("provider").distinct().select(
        "provider", none.alias("target_roles"), F.array(F.lit("Click")).alias("target_industries"), none.alias("preferred_locations"), F.lit("flexible").alias("preferred_arrangement"), F.lit("").alias("preferred_employment"),
    )
    number = F.col("c_custkey").cast("string")
    jobs = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("job_id"), F.concat(F.lit("Role "), number).alias("title"), F.lit("Works").alias("company"), F.lit("").alias("location"),
        F.concat(F.lit("https://b.example/r"), number).alias("job_url"), F.lit("").alias("raw_text"),
    )
    tracked = with_keys(jobs)
    history = tracked.select("job_id", "url_key", F.lit(None).cast("string").alias("text_key"))
    kept, refused = duplicates_and_relevance(rows, wanted, ("provider",), ("discovered_at", "opp_id"), F.to_date("discovered_at"), tracked, history)
    kept = kept.select("provider", "status", "relevance", F.coalesce("duplicate_reason", F.lit("")).alias("discovery_reason"), F.coalesce("tracked_reason", F.lit("")).alias("tracked_reason"))
    refused = refused.select("provider", F.lit("rejected").alias("status"), F.col("reject_reason").alias("relevance"), F.lit("").alias("discovery_reason"), F.lit("").alias("tracked_reason"))
    return kept.unionByName(refused).groupBy(F.col("provider").alias("source_key"), "status", "relevance", "discovery_reason", "tracked_reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- streams
def workspace(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


DELIVERIES = 4


def deliveries(rows, at, folder, step):
    """The rows arrive in DELIVERIES parts by time, each a write of its own; after each `step` runs the stream again where it stopped.

    The stream then goes over as many batches at least, and over restarts from its checkpoint.
    """
    low, high = rows.agg(F.min(at), F.max(at)).first()  # two numbers
    part = F.least(F.floor((at - F.lit(low)) * DELIVERIES / F.lit(max(1, high - low + 1))), F.lit(DELIVERIES - 1))
    for i in range(DELIVERIES):
        rows.where(part == i).write.mode("append").parquet(folder)
        result = step()
    return result


def day_number():
    return F.unix_date(F.to_date("ts")).cast("long")


def delivered_events(spark, sf, folder, sink):
    """The event table as a stream of several deliveries; `sink(stream)` drains what has arrived."""
    def step():
        return sink(spark.readStream.schema(TABLES["events"]).parquet(f"{folder}/in"))

    return deliveries(table(spark, sf, "events"), day_number(), f"{folder}/in", step)


def drained(stream, folder, write):
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


@query("str_01_stale_marks", "SELECT user_id AS job_id, event_type AS reason, CAST(epoch_us(min(ts)) AS BIGINT) AS since FROM events GROUP BY 1, 2")
def str_01(spark, sf):
    folder = workspace(spark, "stale")

    def sink(stream):
        changes = stream.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("reason"), F.col("ts").alias("at"))
        drained(changes, folder, lambda rows, batch: S.mark_stale_batch(rows, batch, f"{folder}/out"))
        return S.stale_jobs(spark.read.parquet(f"{folder}/out")).withColumn("since", F.unix_micros("since"))

    return delivered_events(spark, sf, folder, sink)


@query("str_02_listing_lifecycle", """WITH s AS (SELECT DISTINCT event_type AS source_key, CAST(user_id AS VARCHAR) AS external_id, CAST(ts AS DATE) AS run_at FROM events),
f AS (SELECT DISTINCT source_key, run_at FROM s WHERE NOT (source_key = 'view' AND day(run_at) % 7 = 0)), t AS (SELECT source_key, run_at, lead(run_at) OVER (PARTITION BY source_key ORDER BY run_at) AS next_at FROM f),
life AS (SELECT source_key, external_id, min(run_at) AS first_at, max(run_at) AS last_at FROM s JOIN f USING (source_key, run_at) GROUP BY 1, 2)
SELECT life.source_key, external_id, date_diff('day', DATE '1970-01-01', first_at) AS first_at, date_diff('day', DATE '1970-01-01', last_at) AS last_at, coalesce(date_diff('day', DATE '1970-01-01', next_at), -1) AS closed_at
FROM life JOIN t ON life.source_key = t.source_key AND last_at = t.run_at""")
def str_02(spark, sf):
    """Snapshots over several batches, failed fetches among them; the stream must end where the batch reconcile ends."""
    folder = workspace(spark, "life")
    day = F.unix_date("run_at").cast("long").alias("at")
    rows = S.snapshots(sightings(spark, sf).select("source_key", "external_id", day), fetches(spark, sf).select("source_key", day, "status"), buckets=4)

    def step():
        feed_rows = spark.readStream.schema("source_key string, bucket int, external_id string, at long, kind string").parquet(f"{folder}/feed")
        return S.latest_states(S.run_available(S.lifecycle_stream(feed_rows), folder, "update"))

    return deliveries(rows, F.col("at"), f"{folder}/feed", step)


@query("str_03_first_seen", "SELECT event_type, user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS first_at FROM events GROUP BY 1, 2")
def str_03(spark, sf):
    folder, keys = workspace(spark, "first"), ["event_type", "user_id"]

    def sink(stream):
        drained(stream, folder, lambda rows, batch: S.first_seen_batch(rows, batch, f"{folder}/out", keys, "ts", buckets=8))
        schema = "event_type string, user_id long, first_at timestamp, bucket int, batch long"
        return S.first_seen_table(spark, f"{folder}/out", schema).select(*keys, F.unix_micros("first_at").alias("first_at"))

    return delivered_events(spark, sf, folder, sink)


@query("str_04_period_counters", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS period, event_type, count(*) AS n FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def str_04(spark, sf):
    folder = workspace(spark, "count")

    def sink(stream):
        return S.run_available(S.counters_stream(stream, "ts", "1 hour", "1 day", "event_type"), folder, "append")

    return delivered_events(spark, sf, folder, sink).select(F.to_date("period").cast("string").alias("period"), "event_type", "n")


@query("snk_01_append_history", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_date, count(*) AS runs FROM events GROUP BY 1")
def snk_01(spark, sf):
    """Every day's runs appended to a history, all days in one partitioned write, and read back."""
    folder = workspace(spark, "history")
    sinks.append_history(table(spark, sf, "events").withColumn("run_date", F.to_date("ts").cast("string")), folder)
    return spark.read.parquet(folder).groupBy(F.col("run_date").cast("string").alias("run_date")).agg(F.count("*").alias("runs"))


@query("snk_03_json_report", "SELECT lang, count(*) AS documents FROM documents GROUP BY 1")
def snk_03(spark, sf):
    folder = workspace(spark, "report")
    sinks.write_report(documents(spark, sf).groupBy("lang").agg(F.count("*").alias("documents")), folder)
    return spark.read.schema("lang string, documents long").json(folder)
