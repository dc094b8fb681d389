"""Runs, feeds and claims read from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as K
from ..operators import discovery as D
from ..operators import duplicates as U
from ..operators import history as H
from ..operators import listing as L
from ..operators.ordered import earliest_by_key
from ..sources.tables import table
from .registry import query
from .views import EVENTS, events


def day():
    return F.to_date("ts")


def runs(spark, sf):
    return events(spark, sf).select(
        F.col("user_id").alias("job_id"), F.col("ts").alias("evaluated_at"), F.col("event_id").alias("run_id"),
        F.col("value").alias("score"), F.col("event_type").alias("classification"), "k",
    )


HISTORY = """WITH h AS (SELECT event_id AS run_id, user_id AS job_id, value,
  lag(event_id) OVER w AS previous_run, lag(value) OVER w AS previous_value, lead(event_id) OVER w IS NULL AS is_current
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def history(spark, sf):
    return H.run_history(runs(spark, sf), "job_id", ("evaluated_at", "run_id"), F.to_date("evaluated_at"))


@query("win_01_previous_run", HISTORY + " SELECT run_id, job_id, previous_run FROM h")
def win_01(spark, sf):
    return history(spark, sf).select("run_id", "job_id", "previous_run")


@query("win_02_current_run", HISTORY + """ SELECT run_id, job_id, is_current,
  CASE WHEN is_current THEN '' ELSE 'Superseded by a newer evaluation run' END AS stale_reason FROM h""")
def win_02(spark, sf):
    return history(spark, sf).select("run_id", "job_id", "is_current", "stale_reason")


@query("win_03_score_delta", HISTORY + " SELECT run_id, job_id, round(value - previous_value, 4) AS score_delta FROM h")
def win_03(spark, sf):
    return history(spark, sf).select("run_id", "job_id", F.round("score_delta", 4).alias("score_delta"))


@query("win_09_active_run_guard", """SELECT user_id AS job_id, count(*) FILTER (event_type = 'purchase') AS active_runs
FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase') > 1""")
def win_09(spark, sf):
    return H.active_run_violations(runs(spark, sf), "job_id", F.col("classification") == "purchase")


def judged(spark, sf):
    latest = H.latest_runs(runs(spark, sf), "job_id", ("evaluated_at", "run_id")).select(
        "job_id", F.when(F.col("k") % 5 == 0, "v1").otherwise("v2").alias("matcher_version"),
        F.sha2("classification", 256).alias("profile_fp"), F.sha2((F.col("k") % 3).cast("string"), 256).alias("job_fp"),
    )
    now = H.latest_runs(runs(spark, sf).where("k % 2 = 0"), "job_id", ("evaluated_at", "run_id")).select(
        "job_id", F.sha2("classification", 256).alias("profile_fp_now"),
        F.sha2((F.col("k") % 3).cast("string"), 256).alias("job_fp_now"),
    )
    return H.stale_reasons(latest, now, "v2"), now


STALE = f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev WHERE k % 2 = 0),
j AS (SELECT r.user_id AS job_id, r.k % 5 = 0 AS v, sha256(r.event_type) <> sha256(e.event_type) AS p, sha256(CAST(r.k % 3 AS VARCHAR)) <> sha256(CAST(e.k % 3 AS VARCHAR)) AS q
  FROM r JOIN e ON r.user_id = e.user_id WHERE r.rn = 1 AND e.rn = 1)"""


@query("stale_reasons", STALE + """ SELECT job_id, concat_ws('; ', CASE WHEN v THEN 'Matcher version changed' END,
  CASE WHEN p THEN 'Candidate profile or manual preferences changed' END, CASE WHEN q THEN 'Job details or structured requirements changed' END) AS reasons FROM j""")
def stale(spark, sf):
    rows, _ = judged(spark, sf)
    return rows.select("job_id", F.array_join("stale_reasons", "; ").alias("reasons"))


@query("stale_work_list", STALE + " SELECT job_id FROM j WHERE v OR p OR q")
def stale_work(spark, sf):
    rows, now = judged(spark, sf)
    return H.work_list(now, rows).select("job_id")


@query("agg_16_freshness", STALE + """ SELECT count(*) FILTER (NOT (v OR p OR q)) AS current, count(*) FILTER (v OR p OR q) AS stale,
  count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (v OR p OR q) + count(*) FILTER (v IS NULL) AS needs_reevaluation
  FROM customer LEFT JOIN j ON c_custkey = job_id""")
def agg_16(spark, sf):
    rows, _ = judged(spark, sf)
    return H.freshness(table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id")), rows)


def halves(spark, sf):
    rows = events(spark, sf).select(
        F.col("user_id").alias("job_id"), F.lit(1).alias("profile_id"), "ts",
        F.concat(F.lit(" Need "), (F.col("k") % 10).cast("string")).alias("requirement"),
        F.concat(F.lit("Has "), (F.col("k") % 3).cast("string")).alias("evidence"),
        F.element_at(F.array(*[F.lit(x) for x in ("direct", "related", "semantic", "missing")]), F.col("k") % 4 + 1).alias("match_type"),
    )
    cut = F.lit("2024-01-16").cast("timestamp")
    return rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)


@query("join_13_evidence_changes", f"""WITH {EVENTS}, e AS (
  SELECT DISTINCT user_id AS job_id, ts < TIMESTAMP '2024-01-16' AS before, CASE k % 4 WHEN 0 THEN 'direct' WHEN 3 THEN 'gap' ELSE 'related' END AS kind,
    'need ' || k % 10 AS requirement, CASE WHEN k % 4 = 3 THEN '' ELSE 'has ' || k % 3 END AS evidence FROM ev),
a AS (SELECT job_id, kind, requirement, evidence FROM e WHERE before), b AS (SELECT job_id, kind, requirement, evidence FROM e WHERE NOT before)
SELECT job_id, CASE WHEN kind = 'gap' THEN 'resolved_gap' ELSE 'removed_' || kind END AS change, requirement, evidence FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT job_id, CASE WHEN kind = 'gap' THEN 'new_gap' ELSE 'added_' || kind END, requirement, evidence FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def join_13(spark, sf):
    before, after = halves(spark, sf)
    return H.evidence_changes(before, after).drop("profile_id")


# ---------------------------------------------------------------- feeds
def sightings(spark, sf):
    return events(spark, sf).select(
        F.col("event_type").alias("source_key"), F.col("user_id").cast("string").alias("external_id"), day().alias("run_at")
    )


def fetches(spark, sf):
    seen = events(spark, sf).select(F.col("event_type").alias("source_key"), day().alias("run_at")).distinct()
    failed = (F.col("source_key") == "view") & (F.dayofmonth("run_at") % 7 == 0)
    return seen.withColumn("status", F.when(failed, "failed").otherwise("success"))


LIFE = """WITH s AS (SELECT DISTINCT event_type AS source_key, CAST(user_id AS VARCHAR) AS external_id, CAST(ts AS DATE) AS run_at FROM events),
f AS (SELECT DISTINCT source_key, run_at FROM s WHERE NOT (source_key = 'view' AND day(run_at) % 7 = 0)),
t AS (SELECT source_key, run_at, lead(run_at) OVER (PARTITION BY source_key ORDER BY run_at) AS next_at FROM f),
life AS (SELECT source_key, external_id, min(run_at) AS first_at, max(run_at) AS last_at FROM s JOIN f USING (source_key, run_at) GROUP BY 1, 2),
state AS (SELECT life.*, next_at FROM life JOIN t ON life.source_key = t.source_key AND last_at = t.run_at)"""


@query("join_12_source_reconcile", LIFE + """ SELECT source_key, external_id, CAST(first_at AS VARCHAR) AS first_seen_at,
  CAST(last_at AS VARCHAR) AS last_seen_at, CAST(next_at AS VARCHAR) AS closed_at, next_at IS NULL AS is_active FROM state""")
def join_12(spark, sf):
    rows = D.reconcile(sightings(spark, sf), fetches(spark, sf))
    return rows.withColumns({c: F.col(c).cast("string") for c in ("first_seen_at", "last_seen_at", "closed_at")})


@query("win_10_newest_per_source", """SELECT event_type AS source_key, user_id AS external_id, event_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, user_id DESC) AS rank FROM events) WHERE rank <= 100""")
def win_10(spark, sf):
    feed = events(spark, sf).select(
        F.col("event_type").alias("source_key"), F.col("user_id").alias("external_id"), F.col("ts").alias("updated_at"), "event_id"
    )
    return D.newest_per_source(feed, 100).select("source_key", "external_id", "event_id", F.col("rank").cast("long").alias("rank"))


def arrivals(spark, sf):
    return events(spark, sf).select(
        F.col("event_id").alias("opp_id"), F.col("ts").alias("discovered_at"), F.col("event_type").alias("provider"),
        F.when(F.col("k") % 2 == 0, F.col("user_id").cast("string")).otherwise("").alias("external_id"),
        F.when(F.col("k") % 3 != 0, F.concat(F.lit("u"), ((F.col("user_id") * 100 + F.col("k"))).cast("string"))).alias("url_key"),
        F.sha2(F.col("value").cast("string"), 256).alias("text_key"),
    )


EARLIER = f"""WITH {EVENTS}, o AS (
  SELECT event_id AS opp_id, ts, event_type AS provider, CASE WHEN k % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS external_id,
    CASE WHEN k % 3 <> 0 THEN 'u' || (user_id * 100 + k) END AS url_key, value AS text_key FROM ev),
p AS (SELECT *, CASE WHEN external_id <> '' THEN lag(opp_id) OVER (PARTITION BY provider, external_id ORDER BY ts, opp_id) END AS a,
  CASE WHEN url_key IS NOT NULL THEN lag(opp_id) OVER (PARTITION BY url_key ORDER BY ts, opp_id) END AS b,
  lag(opp_id) OVER (PARTITION BY text_key ORDER BY ts, opp_id) AS c FROM o),
d AS (SELECT *, coalesce(a, b, c) AS duplicate_of, CASE WHEN a IS NOT NULL THEN 'provider_external_id' WHEN b IS NOT NULL THEN 'exact_url'
  WHEN c IS NOT NULL THEN 'exact_text' ELSE '' END AS duplicate_reason FROM p)"""


def linked(spark, sf):
    return U.earlier_discovery(arrivals(spark, sf), ("discovered_at", "opp_id"), F.to_date("discovered_at"))


@query("join_10_earlier_discovery", EARLIER + " SELECT opp_id, duplicate_of, duplicate_reason FROM d")
def join_10(spark, sf):
    return linked(spark, sf).select("opp_id", "duplicate_of", "duplicate_reason")


@query("prj_08_can_send", EARLIER + """ SELECT opp_id, opp_id % 13 <> 0 AND opp_id % 5 < 3 AND (duplicate_of IS NULL OR opp_id % 7 = 0) AS can_send FROM d""")
def prj_08(spark, sf):
    state = F.element_at(
        F.array(*[F.lit(s) for s in ("new", "ready", "processing_failed", "ignored", "processed")]), (F.col("opp_id") % 5 + 1).cast("int")
    )
    rows = linked(spark, sf).withColumns(
        {
            "duplicate_details": F.array(F.struct(F.col("duplicate_of").isNotNull().alias("blocking"))),
            "source_is_active": F.col("opp_id") % 13 != 0, "source_closed_at": F.lit(None).cast("timestamp"),
            "status": state, "duplicate_override": F.col("opp_id") % 7 == 0,
        }
    )
    return rows.select("opp_id", L.can_send_to_processing().alias("can_send"))


@query("agg_10_run_counters", EARLIER + """ SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, count(*) AS results, count(*) FILTER (duplicate_of IS NULL) AS new,
  count(*) FILTER (duplicate_of IS NOT NULL) AS duplicates, count(*) FILTER (provider = 'error') AS outside FROM d GROUP BY 1""")
def agg_10(spark, sf):
    rows = linked(spark, sf).select(
        F.to_date("discovered_at").cast("string").alias("run_id"),
        F.when(F.col("duplicate_of").isNull(), "new").otherwise("duplicate").alias("status"),
        F.when(F.col("provider") == "error", "outside").otherwise("broad_match").alias("relevance"),
    )
    return D.run_counters(rows)


@query("agg_11_run_status", f"""WITH {EVENTS}, a AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_type AS source_key, max(k) AS m FROM ev GROUP BY 1, 2)
SELECT run_id, CASE WHEN bool_or(m < 98) AND bool_or(m >= 98) THEN 'partial' WHEN bool_or(m >= 98) THEN 'failed' ELSE 'completed' END AS status,
  coalesce(string_agg(source_key || ': ' || 'code ' || m, '; ' ORDER BY source_key || ': ' || 'code ' || m) FILTER (m >= 98), '') AS errors FROM a GROUP BY 1""")
def agg_11(spark, sf):
    attempts = events(spark, sf).groupBy(day().cast("string").alias("run_id"), F.col("event_type").alias("source_key")).agg(F.max("k").alias("m"))
    attempts = attempts.select(
        "run_id", "source_key", F.when(F.col("m") >= 98, "failed").otherwise("success").alias("status"),
        F.concat(F.lit("code "), F.col("m").cast("string")).alias("error"),
    )
    return D.run_status(attempts)


@query("flt_10_inbox", f"""WITH {EVENTS} SELECT event_id AS opp_id, status FROM (
  SELECT event_id, ts, (['new','ready','processing_failed','ignored','processed'])[event_id % 5 + 1] AS status FROM ev)
WHERE status IN ('new','ready','processing_failed') ORDER BY ts DESC, event_id DESC LIMIT 100""")
def flt_10(spark, sf):
    state = F.element_at(
        F.array(*[F.lit(s) for s in ("new", "ready", "processing_failed", "ignored", "processed")]), (F.col("event_id") % 5 + 1).cast("int")
    )
    rows = events(spark, sf).select(F.col("event_id").alias("opp_id"), F.col("ts").alias("discovered_at"), state.alias("status"))
    return D.inbox(rows, "needs_action").select("opp_id", "status")


@query("srt_08_recent_runs", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, count(*) AS results FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 8""")
def srt_08(spark, sf):
    return events(spark, sf).groupBy(day().cast("string").alias("run_id")).agg(F.count("*").alias("results")).orderBy(F.desc("run_id")).limit(8)


@query("prj_12_state_transitions", """WITH RECURSIVE a AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, user_id % 3 = 0 AS blocking,
    CASE event_type WHEN 'click' THEN 'send' WHEN 'view' THEN 'ignore' WHEN 'signup' THEN 'restore' WHEN 'purchase' THEN 'retain' ELSE 'release' END AS action FROM events),
s AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CASE WHEN user_id % 3 = 0 THEN 'duplicate' ELSE 'new' END AS status, FALSE AS override, CAST(0 AS BIGINT) AS refused FROM events
  UNION ALL
  SELECT user_id, n, coalesce(t, status), override OR (action = 'retain' AND t IS NOT NULL), refused + CASE WHEN t IS NULL THEN 1 ELSE 0 END FROM (
    SELECT s.user_id, a.n, s.status, s.override, s.refused, a.action, CASE
      WHEN action = 'retain' AND status = 'duplicate' THEN 'ready'
      WHEN action = 'ignore' AND status NOT IN ('processed','sent') THEN 'ignored'
      WHEN action = 'restore' AND status = 'ignored' THEN CASE WHEN blocking AND NOT override THEN 'duplicate' ELSE 'ready' END
      WHEN action = 'send' AND status IN ('new','ready','processing_failed') AND (NOT blocking OR override) THEN 'sent'
      WHEN action = 'release' AND status = 'sent' THEN CASE WHEN override THEN 'ready' ELSE 'new' END END AS t
    FROM s JOIN a ON a.user_id = s.user_id AND a.n = s.n + 1)),
last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS rn FROM s)
SELECT user_id AS opp_id, status, override, refused FROM last WHERE rn = 1""")
def prj_12(spark, sf):
    rows = events(spark, sf)
    known = rows.select(F.col("user_id").alias("opp_id")).distinct().select(
        "opp_id", (F.col("opp_id") % 3 == 0).alias("blocking"),
        F.when(F.col("opp_id") % 3 == 0, "duplicate").otherwise("new").alias("status"),
    )
    action = L.choose(F.col("event_type"), {"click": "send", "view": "ignore", "signup": "restore", "purchase": "retain"}, "release")
    actions = rows.select(F.col("user_id").alias("opp_id"), day().alias("bucket"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), action.alias("action"))
    return D.fold_actions(known, actions)


# ---------------------------------------------------------------- claims
def claims(spark, sf):
    path = L.choose(
        F.col("event_type"),
        {"signup": "identity.full_name", "view": "profile.skills", "click": "profile.education", "purchase": "identity.email"},
        "profile.experience",
    )
    text = F.when(
        F.col("event_type") == "purchase", F.concat(F.lit("a"), (F.col("k") % 4).cast("string"), F.lit(" | b"), (F.col("k") % 3).cast("string"))
    ).otherwise(F.concat(F.lit("V "), (F.col("k") % 10).cast("string")))
    return events(spark, sf).select(
        F.col("user_id").alias("profile_id"), F.col("event_id").alias("claim_id"), path.alias("field_path"),
        F.concat_ws(".", path, (F.col("k") % 5).cast("string")).alias("claim_key"), F.split_part(path, F.lit("."), F.lit(1)).alias("section"),
        F.concat_ws("|", "event_type", (F.col("k") % 10).cast("string")).alias("semantic_key"), F.col("ts").alias("approved_at"),
        text.alias("text"), F.concat(F.lit("H"), (F.col("k") % 3).cast("string")).alias("heading"), F.lit("").alias("subheading"),
        F.lit("").alias("dates"), F.array().cast("array<string>").alias("details"),
    )


CLAIMS = f"""{EVENTS}, c0 AS (SELECT *, CASE event_type WHEN 'signup' THEN 'identity.full_name' WHEN 'view' THEN 'profile.skills' WHEN 'click' THEN 'profile.education'
  WHEN 'purchase' THEN 'identity.email' ELSE 'profile.experience' END AS field_path FROM ev),
claims AS (SELECT user_id AS profile_id, event_id AS claim_id, field_path, field_path || '.' || k % 5 AS claim_key, split_part(field_path, '.', 1) AS section,
  event_type || '|' || k % 10 AS semantic_key, ts AS approved_at, k,
  CASE event_type WHEN 'purchase' THEN 'a' || k % 4 || ' | b' || k % 3 ELSE 'V ' || k % 10 END AS text FROM c0),
keyed AS (SELECT *, CASE WHEN field_path IN ('identity.full_name','identity.email') THEN 'scalar|' || field_path
  WHEN field_path IN ('profile.education','profile.experience') THEN 'entry|' || claim_key ELSE 'list|' || semantic_key END AS ident FROM claims),
lastc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, ident ORDER BY approved_at DESC, claim_id DESC) AS rn FROM keyed) WHERE rn = 1)"""


@query("win_04_claim_supersede", f"""WITH {CLAIMS} SELECT claim_id, lead(claim_id) OVER w IS NULL AS is_active,
  CAST(epoch_us(lead(approved_at) OVER w) AS BIGINT) AS superseded_us FROM claims WINDOW w AS (PARTITION BY profile_id, semantic_key ORDER BY approved_at, claim_id)""")
def win_04(spark, sf):
    rows = K.supersede(claims(spark, sf), ("profile_id", "semantic_key"), ("approved_at", "claim_id"), F.to_date("approved_at"), "approved_at")
    return rows.select("claim_id", "is_active", F.unix_micros("superseded_at").alias("superseded_us"))


@query("win_05_last_claims", f"""WITH {CLAIMS} SELECT profile_id, ident, claim_id FROM lastc""")
def win_05(spark, sf):
    rows = claims(spark, sf).withColumn("ident", K.identity_key(F.col("field_path"), F.col("claim_key"), F.col("semantic_key")))
    last, _ = K.last_claims(rows, ("profile_id", "ident"), ("approved_at", "claim_id"))
    return last.select("profile_id", "ident", "claim_id")


@query("win_05_collapsed_count", f"WITH {CLAIMS} SELECT profile_id, count(*) - count(DISTINCT ident) AS collapsed FROM keyed GROUP BY 1")
def win_05_count(spark, sf):
    rows = claims(spark, sf).withColumn("ident", K.identity_key(F.col("field_path"), F.col("claim_key"), F.col("semantic_key")))
    return K.last_claims(rows, ("profile_id", "ident"), ("approved_at", "claim_id"))[1]


@query("win_06_first_seen_values", f"""WITH {CLAIMS} SELECT profile_id, claim_id, text FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_id, lower(text) ORDER BY approved_at, claim_id) AS rn FROM claims) WHERE rn = 1""")
def win_06(spark, sf):
    return K.distinct_values(claims(spark, sf), ("profile_id",), "text", ("approved_at", "claim_id")).select("profile_id", "claim_id", "text")


@query("agg_19_compose_profiles", f"""WITH {CLAIMS}, pieces AS (
  SELECT profile_id, claim_id, field_path, approved_at, k, trim(unnest(CASE field_path WHEN 'identity.email' THEN string_split(text, '|') ELSE [text] END)) AS v FROM lastc),
firsts AS (SELECT *, row_number() OVER (PARTITION BY profile_id, field_path, CASE WHEN field_path IN ('profile.education','profile.experience') THEN 'h' || k % 3 ELSE lower(v) END
  ORDER BY approved_at, claim_id) AS rn FROM pieces)
SELECT profile_id, max(v) FILTER (field_path = 'identity.full_name') AS full_name,
  coalesce(string_agg(v, ',' ORDER BY approved_at, claim_id, lower(v)) FILTER (field_path = 'identity.email'), '') AS emails,
  coalesce(string_agg(v, ',' ORDER BY approved_at, claim_id) FILTER (field_path = 'profile.skills'), '') AS skills,
  coalesce(string_agg('H' || k % 3, ',' ORDER BY approved_at, claim_id) FILTER (field_path = 'profile.education'), '') AS education,
  count(DISTINCT claim_id) AS source_claims FROM firsts WHERE rn = 1 GROUP BY 1""")
def agg_19(spark, sf):
    rows = K.compose_profiles(claims(spark, sf))
    return rows.select(
        "profile_id", F.expr("nullif(identity.full_name, '')").alias("full_name"), F.array_join("identity.emails", ",").alias("emails"),
        F.array_join("profile.skills", ",").alias("skills"),
        F.array_join(F.transform("profile.education", lambda e: e["heading"]), ",").alias("education"), "source_claims",
    )


@query("agg_18_next_versions")
def agg_18(spark, sf):
    """Profiles composed now against those of mid-month: unchanged ones are reused, the rest get a version."""
    rows = claims(spark, sf)
    before = K.compose_profiles(rows.where(F.col("approved_at") < F.lit("2024-01-20").cast("timestamp"))).withColumn("version", F.lit(1))
    fresh = K.next_versions(K.compose_profiles(rows), before.select("profile_id", "fingerprint", "version"))
    return fresh.select("profile_id", "version", "status", "source_claims")


@query("agg_17_decision_counts", """SELECT user_id AS review_id, count(*) FILTER (event_type = 'click') AS pending, count(*) FILTER (event_type = 'view') AS approved,
  count(*) FILTER (event_type NOT IN ('click','view')) AS rejected FROM events GROUP BY 1""")
def agg_17(spark, sf):
    decision = L.choose(F.col("event_type"), {"click": "pending", "view": "approved"}, "rejected")
    return K.decision_counts(events(spark, sf).select(F.col("user_id").alias("review_id"), decision.alias("decision")))


@query("join_24_snapshot_lineage", f"""WITH {CLAIMS} SELECT profile_id, 1 AS version, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY section, field_path, approved_at, claim_id) - 1 AS INTEGER) AS position,
  claim_id, field_path FROM lastc""")
def join_24(spark, sf):
    rows = claims(spark, sf).withColumn("ident", K.identity_key(F.col("field_path"), F.col("claim_key"), F.col("semantic_key")))
    last, _ = K.last_claims(rows, ("profile_id", "ident"), ("approved_at", "claim_id"))
    # One claim per identity: the list is as long as a profile has distinct identities.
    used = last.groupBy("profile_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("section", "field_path", "approved_at", "claim_id"))),
            lambda c: F.struct(c["claim_id"], c["field_path"]),
        ).alias("claims")
    )
    return K.snapshot_lineage(used.withColumn("version", F.lit(1)))


SNAP = """WITH e AS (SELECT user_id AS profile_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS version, event_type, ts FROM events),
s AS (SELECT DISTINCT profile_id, version FROM e), a AS (SELECT profile_id, version, max(ts) AS act FROM e WHERE event_type = 'purchase' GROUP BY 1, 2),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY act DESC, version DESC) AS rn FROM a) WHERE rn = 1)"""


@query("win_07_active_snapshot", SNAP + """ SELECT s.profile_id, s.version, CASE WHEN l.version = s.version THEN 'active' WHEN a.act IS NOT NULL THEN 'archived' ELSE 'draft' END AS status
FROM s LEFT JOIN a ON s.profile_id = a.profile_id AND s.version = a.version LEFT JOIN l ON s.profile_id = l.profile_id""")
def win_07(spark, sf):
    rows = events(spark, sf).select(
        F.col("user_id").alias("profile_id"), F.datediff(day(), F.lit("2024-01-01").cast("date")).alias("version"), "event_type", F.col("ts").alias("activated_at")
    )
    snapshots = rows.select("profile_id", "version").distinct()
    acts = rows.where("event_type = 'purchase'").select("profile_id", "version", "activated_at")
    return K.snapshot_status(snapshots, acts).select("profile_id", "version", "status")


@query("win_08_stale_reviews", f"""WITH {EVENTS}, r AS (SELECT user_id, event_id AS review_id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'in_review' ELSE 'completed' END AS status,
  k % 4 AS sha, last_value(k % 4) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sha_now,
  lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM ev)
SELECT review_id, CASE WHEN status IN ('pending','in_review') AND (nxt IS NOT NULL OR sha <> sha_now) THEN 'stale' ELSE status END AS status FROM r""")
def win_08(spark, sf):
    status = L.choose(F.col("event_type"), {"click": "pending", "view": "in_review"}, "completed")
    rows = events(spark, sf).select(
        F.col("user_id").alias("profile_id"), F.col("event_id").alias("review_id"), F.col("ts").alias("created_at"), status.alias("status"),
        (F.col("k") % 4).alias("source_sha"),
    )
    now = rows.groupBy("profile_id").agg(F.max_by("source_sha", F.struct("created_at", "review_id")).alias("source_sha_now"))
    return K.stale_reviews(rows.join(now, "profile_id"), ("created_at", "review_id"), F.to_date("created_at")).select("review_id", "status")


@query("win_13_active_document", f"""WITH {EVENTS}, d AS (SELECT user_id % 50 AS profile_id, event_id AS document_id, k AS sha, ts, CASE WHEN event_type = 'purchase' AND k > 60 THEN ts END AS act FROM ev),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, sha ORDER BY ts, document_id) AS rn FROM d) WHERE rn = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY act DESC NULLS LAST, CASE WHEN act IS NULL THEN ts END ASC, document_id DESC) AS pick FROM u)
SELECT profile_id, document_id, pick = 1 AS is_active FROM p""")
def win_13(spark, sf):
    rows = events(spark, sf).select(
        (F.col("user_id") % 50).alias("profile_id"), F.col("event_id").alias("document_id"), F.col("k").alias("sha"), F.col("ts").alias("uploaded_at"),
        F.when((F.col("event_type") == "purchase") & (F.col("k") > 60), F.col("ts")).alias("activated_at"),
    )
    return K.active_documents(rows).select("profile_id", "document_id", "is_active")


@query("join_18_claim_evidence_pairing", """WITH t AS (SELECT conv_id AS review_id, turn AS position, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations),
c AS (SELECT *, CASE WHEN review_id % 2 = 0 THEN n ELSE 1 END AS want FROM t WHERE role = 'user'), e AS (SELECT * FROM t WHERE role = 'assistant')
SELECT c.review_id, c.position, sha256(CASE WHEN e.text IS NOT NULL AND e.text <> '' THEN e.text ELSE c.text END) AS source FROM c LEFT JOIN e ON c.review_id = e.review_id AND e.n = c.want""")
def join_18(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("review_id"), F.col("turn").alias("position"), "role", "text", F.lit("profile.skills").alias("field_path"))
    asked = turns.where("role = 'user'").select(
        "review_id", "field_path", "position", F.col("text").alias("fallback"),
        F.when(F.col("review_id") % 2 == 0, "scalar").otherwise("list_item").alias("claim_type"),
    )
    told = turns.where("role = 'assistant'").select("review_id", "field_path", "position", F.col("text").alias("source_text"), F.lit("").alias("note"))
    return K.pair_evidence(asked, told).select("review_id", "position", F.sha2("source_text", 256).alias("source"))


@query("agg_21_distinct_pairs", "SELECT event_type, user_id, min(event_id) AS first_event FROM events GROUP BY 1, 2")
def agg_21(spark, sf):
    first = earliest_by_key(events(spark, sf).select("event_type", "user_id", "event_id"), ["event_type", "user_id"], ["event_id"])
    return first.select("event_type", "user_id", F.col("event_id").alias("first_event"))
