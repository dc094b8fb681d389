"""PRJ, FLT, SRT and counters over postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators import listing as L
from ..operators.scoring import classify
from ..operators.spread import kept
from ..sources.tables import table
from .registry import query
from .views import AS_OF, CALIBRATION, POSTINGS, PREDICTIONS, VALIDATION, postings, predictions


def states(spark, sf):
    return L.listing_state(postings(spark, sf), AS_OF)


def classed(spark, sf):
    rows = L.listing_state(predictions(spark, sf), AS_OF)
    track = (
        F.when(F.col("job_id") % 4 == 0, "PRIORITY ROLE")
        .when(F.col("job_id") % 4 == 1, "ADJACENT OPPORTUNITY")
        .otherwise("OUTSIDE PRIORITY")
    )
    blocked = F.col("effective_status") == "wrong_page"
    return rows.withColumns({"classification": classify(F.col("score"), F.col("coverage"), blocked), "track": track})


def human(spark, sf):
    rows = classed(spark, sf).where(F.col("title").contains("HIGH") | F.col("title").contains("URGENT"))
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("job_id") % n + 1).cast("int"))
    third = F.col("job_id") % 3 == 0
    return rows.select(
        "job_id",
        pick(("strong", "good", "possible", "weak", "not_eligible"), 5).alias("human_rating"),
        pick(("priority", "adjacent", "outside", "unsure"), 4).alias("opportunity_type"),
        (F.col("score") - F.when(third, 10).otherwise(0)).alias("predicted_score"),
        F.when(third, "WEAK MATCH").otherwise(F.col("classification")).alias("predicted_class"),
        F.when(F.col("job_id") % 6 == 0, "OUTSIDE PRIORITY").otherwise(F.col("track")).alias("predicted_track"),
    )


def shown(spark, sf):
    """FLT-09 marks; scores stay visible to the counters, which leave blind rows out themselves."""
    labels = human(spark, sf).select("job_id", F.lit(True).alias("reviewed"))
    rows = classed(spark, sf).join(labels, "job_id", "left").na.fill(False, ["reviewed"])
    return rows.withColumn("blind", (F.col("source") == VALIDATION) & ~F.col("reviewed"))


DAY = "CAST(application_deadline AS VARCHAR)"


@query("prj_01_deadline_state", f"""WITH {POSTINGS}
SELECT job_id, days_remaining, is_overdue, due_soon,
  CASE WHEN days_remaining < 0 THEN 'Expired ' || -days_remaining || CASE WHEN days_remaining = -1 THEN ' day' ELSE ' days' END || ' ago'
    WHEN days_remaining = 0 THEN 'Deadline today' WHEN days_remaining = 1 THEN 'Deadline tomorrow'
    WHEN days_remaining > 1 THEN 'Deadline in ' || days_remaining || ' days'
    ELSE CASE deadline_status WHEN 'unknown' THEN 'Unknown' WHEN 'confirmed' THEN 'Confirmed date'
      WHEN 'rolling' THEN 'Rolling / open until filled' ELSE 'No deadline stated' END END AS deadline_label
FROM flagged""")
def prj_01(spark, sf):
    return L.with_deadline_state(postings(spark, sf), AS_OF).select(
        "job_id", "days_remaining", "is_overdue", "due_soon", "deadline_label"
    )


@query("prj_02_listing_state", f"""WITH {POSTINGS}
SELECT job_id, effective_status, is_available, has_link_problem, is_unavailable,
  CASE effective_status WHEN 'unverified' THEN 'Unverified' WHEN 'open' THEN 'Open' WHEN 'closed' THEN 'Closed by employer'
    WHEN 'expired' THEN 'Expired' WHEN 'link_broken' THEN 'Broken link' ELSE 'Wrong company page' END AS effective_label
FROM states""")
def prj_02(spark, sf):
    return states(spark, sf).select(
        "job_id", "effective_status", "is_available", "has_link_problem", "is_unavailable", "effective_label"
    )


@query("prj_03_needs_verification", f"WITH {POSTINGS} SELECT job_id, needs_verification FROM states")
def prj_03(spark, sf):
    return states(spark, sf).select("job_id", "needs_verification")


@query("prj_04_constraint_violations", f"""WITH {POSTINGS}, checked AS (
  SELECT job_id, CASE WHEN application_deadline IS NOT NULL THEN 'confirmed' ELSE deadline_status END AS deadline_status,
    application_deadline, date_posted, min_years, max_years, listing_status, job_url FROM postings)
SELECT job_id, deadline_status, concat_ws(',',
  CASE WHEN deadline_status = 'confirmed' AND application_deadline IS NULL THEN 'confirmed_without_date' END,
  CASE WHEN application_deadline < date_posted THEN 'deadline_before_posting' END,
  CASE WHEN max_years < min_years THEN 'max_years_below_min' END,
  CASE WHEN listing_status = 'open' AND job_url = '' THEN 'open_without_url' END) AS violations FROM checked""")
def prj_04(spark, sf):
    return L.posting_violations(postings(spark, sf)).select(
        "job_id", "deadline_status", F.array_join("violations", ",").alias("violations")
    )


@query("prj_04_quarantine_counts", f"""WITH {POSTINGS}, checked AS (
  SELECT (CASE WHEN application_deadline < date_posted THEN 1 ELSE 0 END) + (CASE WHEN max_years < min_years THEN 1 ELSE 0 END)
    + (CASE WHEN listing_status = 'open' AND job_url = '' THEN 1 ELSE 0 END)
    + (CASE WHEN application_deadline IS NULL AND deadline_status = 'confirmed' THEN 1 ELSE 0 END) AS n, source FROM postings)
SELECT source, count(*) FILTER (n = 0) AS accepted, count(*) FILTER (n > 0) AS quarantined FROM checked GROUP BY source""")
def prj_04_counts(spark, sf):
    good, bad = L.split_quarantine(L.posting_violations(postings(spark, sf)))
    marked = good.select("source", F.lit(1).alias("ok")).unionByName(bad.select("source", F.lit(0).alias("ok")))
    return marked.groupBy("source").agg(
        F.count_if(F.col("ok") == 1).alias("accepted"), F.count_if(F.col("ok") == 0).alias("quarantined")
    )


def requirement_view(spark, sf):
    part = table(spark, sf, "part")
    some = lambda n: F.col("p_partkey") % n == 0
    return part.select(
        F.col("p_partkey").alias("job_id"),
        F.when(some(3), "").otherwise(F.col("p_name")).alias("role_family"),
        F.when(some(2), "").otherwise(F.col("p_brand")).alias("industry"),
        F.when(some(6), F.array().cast("array<string>")).otherwise(F.array("p_type", "p_name")).alias("required_skills"),
        F.when(some(2), "unknown").otherwise("senior").alias("seniority_level"),
        F.when(some(4), F.lit(None)).otherwise((F.col("p_size") % 9).cast("int")).alias("min_years"),
        F.when(some(5), F.lit(None)).otherwise((F.col("p_size") % 11).cast("int")).alias("max_years"),
    )


@query("prj_05_content_and_experience", """WITH r AS (
  SELECT p_partkey AS job_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS role_family,
    CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS industry, p_partkey % 6 <> 0 AS skills,
    CASE WHEN p_partkey % 2 = 0 THEN 'unknown' ELSE 'senior' END AS level,
    CASE WHEN p_partkey % 4 <> 0 THEN p_size % 9 END AS lo, CASE WHEN p_partkey % 5 <> 0 THEN p_size % 11 END AS hi FROM part)
SELECT job_id, role_family <> '' OR industry <> '' OR skills OR level <> 'unknown' OR lo IS NOT NULL OR hi IS NOT NULL AS has_content,
  CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo || '–' || hi || ' years' WHEN lo IS NOT NULL THEN lo || '+ years'
    WHEN hi IS NOT NULL THEN 'Up to ' || hi || ' years' ELSE 'Not specified' END AS experience_range FROM r""")
def prj_05(spark, sf):
    return L.has_content(requirement_view(spark, sf)).select("job_id", "has_content", "experience_range")


RATING = """CASE {c} WHEN 'STRONG MATCH' THEN 'strong' WHEN 'GOOD MATCH' THEN 'good' WHEN 'POSSIBLE MATCH' THEN 'possible'
 WHEN 'WEAK MATCH' THEN 'weak' WHEN 'DISQUALIFIED' THEN 'not_eligible' END"""


def agreement_sql(c):
    rating = RATING.format(c=c)
    return f"CASE WHEN ({rating}) IS NULL THEN 'NEEDS EVIDENCE' WHEN ({rating}) = human_rating THEN 'ALIGNED' ELSE 'REVIEW' END"


@query("prj_06_agreement_status", f"""WITH {POSTINGS}, {PREDICTIONS}
SELECT job_id, human_rating, predicted_class, {agreement_sql('predicted_class')} AS agreement FROM human""")
def prj_06(spark, sf):
    return human(spark, sf).select(
        "job_id", "human_rating", "predicted_class",
        L.agreement_status(F.col("predicted_class"), F.col("human_rating")).alias("agreement"),
    )


@query("prj_07_run_state", """WITH r AS (
  SELECT o_orderkey AS run_id, o_orderdate AS started_at, last_ship AS completed_at,
    CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'needs_review' ELSE 'completed' END AS status,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'pending' ELSE 'accepted' END AS review_status
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) ON o_orderkey = l_orderkey)
SELECT run_id, CASE WHEN completed_at IS NOT NULL THEN greatest(0.0, CAST(epoch(completed_at) - epoch(started_at) AS DOUBLE)) END AS duration_seconds,
  status IN ('completed','needs_review','failed') AS is_finished, status = 'needs_review' OR review_status = 'pending' AS needs_manual_review FROM r""")
def prj_07(spark, sf):
    last = table(spark, sf, "lineitem").where("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("completed_at"))
    runs = table(spark, sf, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), "completed_at",
        F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "needs_review").otherwise("completed").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "pending").otherwise("accepted").alias("review_status"),
    )
    return L.run_state(runs).select("run_id", "duration_seconds", "is_finished", "needs_manual_review")


@query("prj_11_review_prefill_and_decisions", f"""WITH {POSTINGS}, runs AS (
  SELECT l_orderkey AS job_id, l_linenumber AS n, l_shipdate AS decided_at, l_partkey AS decision_id,
    CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'closed' END AS listing_status, CAST(l_shipdate AS DATE) AS application_deadline
  FROM lineitem WHERE l_returnflag = 'A'),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY decided_at DESC, decision_id DESC, n DESC) AS rn FROM runs) WHERE rn = 1)
SELECT p.job_id, coalesce(l.listing_status, p.listing_status) AS listing_status,
  CAST(CASE WHEN l.job_id IS NULL THEN p.application_deadline ELSE l.application_deadline END AS VARCHAR) AS application_deadline,
  CAST(CASE WHEN l.job_id IS NULL THEN p.listing_last_verified ELSE DATE '1998-01-01' END AS VARCHAR) AS listing_last_verified
FROM postings p LEFT JOIN latest l ON p.job_id = l.job_id""")
def prj_11(spark, sf):
    decisions = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").alias("decided_at"),
        F.struct("l_partkey", "l_linenumber").alias("decision_id"), F.lit("").alias("job_url"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("listing_status"),
        F.lit("confirmed").alias("deadline_status"), F.to_date("l_shipdate").alias("application_deadline"),
    )
    return L.apply_decisions(postings(spark, sf), decisions, AS_OF).select(
        "job_id", "listing_status", F.col("application_deadline").cast("string").alias("application_deadline"),
        F.col("listing_last_verified").cast("string").alias("listing_last_verified"),
    )


# ---------------------------------------------------------------- filters
@query("flt_01_search", """WITH hits AS (
  SELECT DISTINCT p_partkey AS job_id, p_name, p_brand, p_type FROM part
  LEFT JOIN (SELECT l_partkey, min(s_name) AS s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) ON p_partkey = l_partkey
  WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red') OR contains(lower(coalesce(s_name, '')), 'red'))
SELECT job_id, p_name, p_brand, p_type FROM hits""")
def flt_01(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), "p_name", "p_brand", "p_type")
    lines, suppliers = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    named = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("job_id")).agg(F.min("s_name").alias("s_name"))
    return L.search(part, named, " RED ", ("p_name", "p_brand", "p_type"), ("s_name",))


@query("flt_02_status", f"WITH {POSTINGS} SELECT job_id, status FROM postings WHERE status = 'applied'")
def flt_02(spark, sf):
    # An unknown status filters nothing, so this is one filter.
    return L.by_status(L.by_status(postings(spark, sf), "no such status"), "applied").select("job_id", "status")


@query("flt_03_source_bucket", f"WITH {POSTINGS} SELECT job_id, source FROM postings WHERE source NOT IN ('BUILDING','MACHINERY')")
def flt_03(spark, sf):
    return L.by_source(postings(spark, sf), "other", CALIBRATION, VALIDATION).select("job_id", "source")


BUCKETS = ("open", "needs_verification", "deadline_soon", "unavailable", "link_problem")


@query("flt_04_listing_buckets", f"""WITH {POSTINGS}
SELECT 'open' AS bucket, job_id FROM states WHERE is_available AND NOT needs_verification
UNION ALL SELECT 'needs_verification', job_id FROM states WHERE needs_verification
UNION ALL SELECT 'deadline_soon', job_id FROM states WHERE due_soon
UNION ALL SELECT 'unavailable', job_id FROM states WHERE is_unavailable AND NOT has_link_problem
UNION ALL SELECT 'link_problem', job_id FROM states WHERE has_link_problem""")
def flt_04(spark, sf):
    rows = states(spark, sf)
    result = None
    for bucket in BUCKETS:
        part = L.by_listing(rows, bucket).select(F.lit(bucket).alias("bucket"), "job_id")
        result = part if result is None else result.unionByName(part)
    return result


@query("flt_05_fit_bucket", f"WITH {POSTINGS}, {PREDICTIONS} SELECT job_id, classification, blind FROM shown WHERE blind OR classification IN ('STRONG MATCH','GOOD MATCH')")
def flt_05(spark, sf):
    return L.by_fit(shown(spark, sf), "strong").select("job_id", "classification", "blind")


@query("flt_06_track_bucket", f"WITH {POSTINGS}, {PREDICTIONS} SELECT job_id, track, blind FROM shown WHERE blind OR track = 'ADJACENT OPPORTUNITY'")
def flt_06(spark, sf):
    return L.by_track(shown(spark, sf), "adjacent").select("job_id", "track", "blind")


@query("flt_07_review_state", f"""WITH {POSTINGS}, {PREDICTIONS}, agreed AS (SELECT job_id, {agreement_sql('predicted_class')} AS a FROM human)
SELECT 'reviewed' AS bucket, job_id FROM human UNION ALL SELECT 'unreviewed', job_id FROM shown WHERE NOT reviewed
UNION ALL SELECT 'aligned', job_id FROM agreed WHERE a = 'ALIGNED' UNION ALL SELECT 'disagree', job_id FROM agreed WHERE a = 'REVIEW'""")
def flt_07(spark, sf):
    rows, labels = classed(spark, sf), human(spark, sf)
    parts = [
        L.by_review(rows, labels, b).select(F.lit(b).alias("bucket"), "job_id")
        for b in ("reviewed", "unreviewed", "aligned", "disagree")
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("flt_09_blind_mask", f"""WITH {POSTINGS}, {PREDICTIONS}
SELECT job_id, blind, CASE WHEN NOT blind THEN score END AS score, CASE WHEN NOT blind THEN classification END AS classification,
  CASE WHEN NOT blind THEN track END AS track FROM shown""")
def flt_09(spark, sf):
    return L.mask_blind(classed(spark, sf), human(spark, sf), VALIDATION).select(
        "job_id", "blind", "score", "classification", "track"
    )


# ---------------------------------------------------------------- sorts: every row with its rank
@query("srt_01_match_high", f"""WITH {POSTINGS}, {PREDICTIONS}
SELECT job_id, score, coverage, classification,
  row_number() OVER (ORDER BY classification <> 'DISQUALIFIED' DESC, has_requirements DESC, score DESC, coverage DESC, created_at DESC, job_id) AS rank FROM shown WHERE NOT blind""")
def srt_01(spark, sf):
    rows = shown(spark, sf).where(~F.col("blind"))
    return L.ranked_rows(rows, "match_high", False).select("job_id", "score", "coverage", "classification", "rank")


@query("srt_02_match_low", f"""WITH {POSTINGS}, {PREDICTIONS}
SELECT job_id, score, company, row_number() OVER (ORDER BY blind, NOT has_requirements, score, lower(company), job_id) AS rank FROM shown""")
def srt_02(spark, sf):
    return L.ranked_rows(shown(spark, sf), "match_low", False).select("job_id", "score", "company", "rank")


@query("srt_03_nearest_deadline", f"""WITH {POSTINGS}
SELECT job_id, company, CAST(application_deadline AS VARCHAR) AS application_deadline, row_number() OVER (ORDER BY postings.application_deadline ASC NULLS LAST, lower(company), job_id) AS rank FROM postings""")
def srt_03(spark, sf):
    rows = L.ranked_rows(postings(spark, sf), "deadline")
    return rows.select("job_id", "company", F.col("application_deadline").cast("string").alias("application_deadline"), "rank")


@query("srt_04_company", f"WITH {POSTINGS} SELECT job_id, company, title, row_number() OVER (ORDER BY lower(company), lower(title), job_id) AS rank FROM postings")
def srt_04(spark, sf):
    return L.ranked_rows(postings(spark, sf), "company").select("job_id", "company", "title", "rank")


@query("srt_05_newest_with_blind_reset", f"""WITH {POSTINGS}, {PREDICTIONS}
SELECT 'newest' AS sorted_by, job_id, row_number() OVER (ORDER BY created_at DESC, job_id) AS rank FROM shown
UNION ALL SELECT 'reset', job_id, row_number() OVER (ORDER BY lower(company), lower(title), job_id) FROM shown""")
def srt_05(spark, sf):
    # Both orders, and whether a row is blind, are read from what was joined once.
    rows = kept(shown(spark, sf).select("job_id", "created_at", "company", "title", "blind", "classification", "has_requirements", "score", "coverage"), "shown")
    newest = L.ranked_rows(rows.select("job_id", "created_at"), "newest").select(F.lit("newest").alias("sorted_by"), "job_id", "rank")
    # Blind rows are present, so the score order falls back to company order.
    reset = L.ranked_rows(rows, "match_high").select(F.lit("reset").alias("sorted_by"), "job_id", "rank")
    return newest.unionByName(reset)


# ---------------------------------------------------------------- counters
@query("agg_05_dashboard_counters", f"""WITH {POSTINGS}, {PREDICTIONS}
SELECT count(*) AS total, count(*) FILTER (is_available AND NOT needs_verification) AS verified_open,
  count(*) FILTER (needs_verification) AS need_verification, count(*) FILTER (due_soon) AS due_soon,
  count(*) FILTER (status = 'applied' AND NOT blind AND has_requirements) AS analysed,
  count(*) FILTER (status = 'applied' AND NOT blind AND classification = 'STRONG MATCH') AS strong,
  count(*) FILTER (status = 'applied' AND NOT blind AND classification = 'GOOD MATCH') AS good,
  count(*) FILTER (status = 'applied' AND reviewed) AS reviewed, count(*) FILTER (status = 'applied' AND blind) AS blind FROM shown""")
def agg_05(spark, sf):
    return C.dashboard_counters(states(spark, sf), L.by_status(shown(spark, sf), "applied"))


@query("agg_09_status_counts", f"WITH {POSTINGS} SELECT status, count(*) AS n FROM postings GROUP BY status")
def agg_09(spark, sf):
    return postings(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("join_01_posting_requirement_label", f"""WITH {POSTINGS}, {PREDICTIONS}, lines AS (SELECT l_orderkey, count(*) AS items, count(DISTINCT l_partkey) AS distinct_items FROM lineitem GROUP BY 1)
SELECT c.job_id, c.company, coalesce(items, 0) AS items, coalesce(distinct_items, 0) AS distinct_items, coalesce(human_rating, '') AS human_rating
FROM classed c LEFT JOIN lines ON c.job_id = l_orderkey LEFT JOIN human h ON c.job_id = h.job_id""")
def join_01(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.count("*").alias("items"), F.count_distinct("l_partkey").alias("distinct_items")
    )
    rows = classed(spark, sf).join(lines, "job_id", "left").join(human(spark, sf), "job_id", "left")
    return rows.select("job_id", "company", "items", "distinct_items", "human_rating").na.fill(0, ["items", "distinct_items"]).na.fill("", ["human_rating"])


# ---------------------------------------------------------------- calibration
CAL = f"""{POSTINGS}, {PREDICTIONS}, cal AS (
  SELECT h.*, c.company, c.title, c.score, c.classification, c.track, c.has_requirements,
    {agreement_sql('classification')} AS rating_status, {agreement_sql('predicted_class')} AS saved_status,
    CASE c.track WHEN 'PRIORITY ROLE' THEN 'priority' WHEN 'ADJACENT OPPORTUNITY' THEN 'adjacent' WHEN 'OUTSIDE PRIORITY' THEN 'outside' END AS lane,
    CASE WHEN has_requirements THEN score - predicted_score END AS score_delta
  FROM human h JOIN classed c ON h.job_id = c.job_id
), cal2 AS (
  SELECT *, CASE WHEN opportunity_type = 'unsure' THEN 'NOT SCORED' WHEN lane IS NULL THEN 'NEEDS EVIDENCE'
      WHEN lane = opportunity_type THEN 'ALIGNED' ELSE 'REVIEW' END AS lane_status,
    CASE WHEN rating_status = 'NEEDS EVIDENCE' THEN 'NEEDS EVIDENCE' WHEN rating_status = 'ALIGNED' AND saved_status <> 'ALIGNED' THEN 'IMPROVED'
      WHEN rating_status <> 'ALIGNED' AND saved_status = 'ALIGNED' THEN 'REGRESSED' WHEN rating_status = 'ALIGNED' THEN 'STABLE ALIGNED'
      ELSE 'STILL REVIEW' END AS change_status,
    coalesce(score_delta <> 0, FALSE) OR classification <> predicted_class OR track <> predicted_track AS strategy_changed
  FROM cal
), cal3 AS (SELECT *, rating_status = 'REVIEW' OR lane_status = 'REVIEW' AS needs_attention FROM cal2)"""


def calibrated(spark, sf):
    return C.calibration_rows(human(spark, sf), classed(spark, sf))


@query("join_27_calibration_rows", f"WITH {CAL} SELECT job_id, rating_status, lane_status, change_status, score_delta, strategy_changed, needs_attention FROM cal3")
def join_27(spark, sf):
    return calibrated(spark, sf).select(
        "job_id", "rating_status", "lane_status", "change_status", "score_delta", "strategy_changed", "needs_attention"
    )


@query("flt_08_report_filters", f"""WITH {CAL}
SELECT 'attention' AS f, job_id FROM cal3 WHERE needs_attention
UNION ALL SELECT 'aligned', job_id FROM cal3 WHERE rating_status = 'ALIGNED' AND lane_status IN ('ALIGNED','NOT SCORED')
UNION ALL SELECT 'changed', job_id FROM cal3 WHERE strategy_changed
UNION ALL SELECT 'improved', job_id FROM cal3 WHERE change_status = 'IMPROVED'
UNION ALL SELECT 'regressed', job_id FROM cal3 WHERE change_status = 'REGRESSED'""")
def flt_08(spark, sf):
    rows, result = calibrated(spark, sf), None
    for name in ("attention", "aligned", "changed", "improved", "regressed"):
        part = C.report_filter(rows, name).select(F.lit(name).alias("f"), "job_id")
        result = part if result is None else result.unionByName(part)
    return result


@query("srt_06_report_order", f"""WITH {CAL} SELECT job_id, company, change_status,
  row_number() OVER (ORDER BY NOT needs_attention, change_status <> 'REGRESSED', lower(company), lower(title), job_id) AS rank FROM cal3""")
def srt_06(spark, sf):
    return C.report_order(calibrated(spark, sf)).select("job_id", "company", "change_status", "rank")


@query("agg_06_calibration_summary", f"""WITH {CAL}, s AS (
  SELECT count(*) AS reviewed, count(*) FILTER (rating_status <> 'NEEDS EVIDENCE') AS rating_comparable,
    count(*) FILTER (rating_status = 'ALIGNED') AS rating_aligned,
    count(*) FILTER (lane_status NOT IN ('NOT SCORED','NEEDS EVIDENCE')) AS lane_comparable,
    count(*) FILTER (lane_status = 'ALIGNED') AS lane_aligned, count(*) FILTER (strategy_changed) AS changed,
    count(*) FILTER (change_status = 'IMPROVED') AS improved, count(*) FILTER (change_status = 'REGRESSED') AS regressed,
    count(*) FILTER (needs_attention) AS attention FROM cal3)
SELECT *, CAST(round_even(100.0 * rating_aligned / rating_comparable, 0) AS INTEGER) AS rating_percent,
  CAST(round_even(100.0 * lane_aligned / lane_comparable, 0) AS INTEGER) AS lane_percent FROM s""")
def agg_06(spark, sf):
    return C.calibration_summary(calibrated(spark, sf))


def model_inputs(spark, sf):
    """Long category rows of each labelled posting, with unknown parts left out."""
    rows = human(spark, sf).join(classed(spark, sf).drop("source"), "job_id")
    part = lambda name, n, gap: F.struct(
        F.lit(name).alias("category"), ((F.col("job_id") * n) % 101 / F.lit(100.0)).alias("fraction"),
        (F.col("job_id") % gap != 0).alias("available"),
    )
    names = ("role", "required_skills", "preferred_skills", "education", "experience", "industry", "location_arrangement", "employment_type")
    parts = F.array(*[part(name, 7 * i + 3, i + 4) for i, name in enumerate(names)])
    return rows.select("job_id", "human_rating", "opportunity_type", "track", (F.col("classification") == "DISQUALIFIED").alias("blocked"), F.explode(parts).alias("c")).select("*", "c.*").drop("c")


_NAMES = ("role", "required_skills", "preferred_skills", "education", "experience", "industry", "location_arrangement", "employment_type")
_A = dict(zip(_NAMES, (10, 20, 10, 15, 15, 20, 5, 5)))
_B = {**_A, "required_skills": 25, "industry": 15}
_WEIGHTS = ", ".join(
    f"('{m}', '{c}', {w[c]}, {7 * i + 3}, {i + 4})" for m, w in (("industry_balanced", _A), ("skills_priority", _B)) for i, c in enumerate(_NAMES)
)
WEIGHED = f"""{CAL}, w(model, category, weight, mul, gap) AS (VALUES {_WEIGHTS}), sums AS (
  SELECT job_id, model, any_value(human_rating) AS human_rating, any_value(opportunity_type) AS opportunity_type, any_value(track) AS track,
    any_value(classification) = 'DISQUALIFIED' AS blocked,
    sum(CASE WHEN job_id % gap <> 0 THEN CAST(weight AS DOUBLE) ELSE 0.0 END) AS won,
    sum(CASE WHEN job_id % gap <> 0 THEN weight * ((job_id * mul) % 101 / 100.0::DOUBLE) ELSE 0.0 END) AS got
  FROM cal3, w GROUP BY job_id, model
), scored AS (SELECT *, CAST(round_even(100 * got / won, 0) AS INTEGER) AS mscore, CAST(round_even(won, 0) AS INTEGER) AS mcov FROM sums),
pred AS (SELECT job_id, model, human_rating, opportunity_type, track, mscore AS score, mcov AS coverage,
  CASE WHEN blocked THEN 'DISQUALIFIED' WHEN mcov < 35 THEN 'LOW CONFIDENCE' WHEN mscore >= 80 THEN 'STRONG MATCH' WHEN mscore >= 65 THEN 'GOOD MATCH'
    WHEN mscore >= 50 THEN 'POSSIBLE MATCH' ELSE 'WEAK MATCH' END AS classification FROM scored)"""


def model_predictions(spark, sf):
    rows = model_inputs(spark, sf)
    labels = human(spark, sf).select("job_id", "human_rating", "opportunity_type")
    tracks = classed(spark, sf).select("job_id", "track")
    return C.reweigh(rows).join(labels, "job_id").join(tracks, "job_id")


@query("agg_02_weighted_score_by_model", f"WITH {WEIGHED} SELECT job_id, model, score, coverage, classification FROM pred")
def agg_02(spark, sf):
    return C.reweigh(model_inputs(spark, sf))


_RANK = "CASE {c} WHEN 'not_eligible' THEN 0 WHEN 'weak' THEN 1 WHEN 'possible' THEN 2 WHEN 'good' THEN 3 WHEN 'strong' THEN 4 END"
MODEL = f"""{WEIGHED}, rated AS (SELECT *, {RATING.format(c='classification')} AS rating,
  CASE track WHEN 'PRIORITY ROLE' THEN 'priority' WHEN 'ADJACENT OPPORTUNITY' THEN 'adjacent' WHEN 'OUTSIDE PRIORITY' THEN 'outside' END AS lane FROM pred),
far AS (SELECT *, abs({_RANK.format(c='rating')} - {_RANK.format(c='human_rating')}) AS distance FROM rated)"""


@query("agg_07_model_metrics", f"""WITH {MODEL}, m AS (
  SELECT model, count(*) AS reviewed, count(rating) AS comparable, count(*) FILTER (rating = human_rating) AS agreement,
    count(*) FILTER (opportunity_type <> 'unsure' AND lane IS NOT NULL) AS lane_comparable,
    count(*) FILTER (opportunity_type <> 'unsure' AND lane = opportunity_type) AS lane_agreement,
    count(*) FILTER (rating = 'strong' AND human_rating <> 'strong') AS false_strong,
    count(*) FILTER (rating = 'weak' AND human_rating IN ('strong','good','possible')) AS false_weak,
    count(*) FILTER (rating = 'not_eligible' AND human_rating <> 'not_eligible') AS false_disqualification,
    coalesce(round_even(avg(distance), 2), 0.0) AS mean_distance FROM far GROUP BY model)
SELECT *, CAST(round_even(100.0 * agreement / comparable, 0) AS INTEGER) AS agreement_percent,
  CAST(round_even(100.0 * lane_agreement / lane_comparable, 0) AS INTEGER) AS lane_percent FROM m""")
def agg_07(spark, sf):
    return C.model_metrics(model_predictions(spark, sf))


@query("agg_08_model_comparison", f"""WITH {MODEL}, pairs AS (
  SELECT job_id, max(distance) FILTER (model = 'industry_balanced') AS da, max(distance) FILTER (model = 'skills_priority') AS db,
    count(DISTINCT classification) AS classes FROM far GROUP BY job_id),
m AS (SELECT model, count(*) AS reviewed, count(*) FILTER (rating = human_rating) AS agreement, count(*) FILTER (rating = 'strong' AND human_rating <> 'strong') AS fs,
  count(*) FILTER (rating = 'not_eligible' AND human_rating <> 'not_eligible') AS fd,
  count(*) FILTER (rating = 'weak' AND human_rating IN ('strong','good','possible')) AS fw, round_even(avg(distance), 2) AS md FROM far GROUP BY model),
k AS (SELECT model, reviewed, row(agreement, -fs, -fd, -fw, -md) AS perf FROM m)
SELECT (SELECT reviewed FROM k WHERE model = 'industry_balanced') AS reviewed, count(*) FILTER (da < db) AS a_wins, count(*) FILTER (db < da) AS b_wins,
  count(*) FILTER (da = db) AS ties, count(*) FILTER (classes > 1) AS changed_classes,
  CASE WHEN (SELECT reviewed FROM k WHERE model = 'industry_balanced') < 10 THEN 'HOLDOUT INCOMPLETE'
    WHEN (SELECT perf FROM k WHERE model = 'skills_priority') > (SELECT perf FROM k WHERE model = 'industry_balanced') THEN 'MODEL B PERFORMED BETTER'
    WHEN (SELECT perf FROM k WHERE model = 'industry_balanced') > (SELECT perf FROM k WHERE model = 'skills_priority') THEN 'MODEL A PERFORMED BETTER'
    ELSE 'NO MEASURED ADVANTAGE' END AS recommendation FROM pairs""")
def agg_08(spark, sf):
    return C.compare_models(model_predictions(spark, sf), "industry_balanced", "skills_priority", 10)
