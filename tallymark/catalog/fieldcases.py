"""Two extractions of each document compared with an expected record, over all fields.

The expected record takes its values from the words of the whole text. The two extractions read the text without its
words of two letters, or of one, so that their values are the same, close, missing, new or wrong, as the text has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import quality as Q
from ..operators.spread import fill_slots, settle
from ..sources.tables import table
from .registry import query

#: Where the words of a text or list field begin, and how many they are.
PLACES = {
    "job.title": (1, 4), "job.company": (5, 2), "job.location": (7, 1), "job.salary_text": (8, 2),
    "requirements.role_family": (10, 2), "requirements.requirement_notes": (12, 4), "requirements.industry_tags": (16, 1),
    "requirements.required_skills": (17, 3), "requirements.preferred_skills": (20, 2), "requirements.required_education": (22, 1),
    "requirements.preferred_education": (23, 1), "requirements.responsibilities": (24, 2), "requirements.certifications": (26, 1),
    "requirements.work_authorization_requirements": (27, 1), "requirements.hard_disqualifiers": (28, 2),
}
HOURS, DESKS, LEVELS = ("full_time", "part_time", "contract"), ("onsite", "hybrid", "remote"), ("entry_level", "mid_level", "senior")
CRITICAL = ("job.title", "requirements.required_skills")
FORBIDDEN = ("worthless", "stupid")
RUNS = {"a": 2, "b": 1}
#: Scores as decimals add up to the same mean in any order.
EXACT_SCORE = "decimal(9,6)"


def record(words: Column) -> Column:
    """A record in JSON from the words of a text; absent words give absent values."""
    size = lambda i: F.length(F.get(words, F.lit(i - 1)))
    # Named cases instead of an element of a list: that takes an absent place for -1 once code is generated.
    one_of = lambda values, n: F.coalesce(*[F.when(n % len(values) == i, v) for i, v in enumerate(values)])
    day = lambda start, n: F.date_format(F.date_add(F.lit(start).cast("date"), n), "yyyy-MM-dd")
    fields: dict[str, Column] = {}
    for path, (start, n) in PLACES.items():
        part = F.slice(words, start, n)
        fields[path] = part if Q.FIELD_KINDS[path] == "list" else F.array_join(part, " ")
    fields["job.employment_type"] = one_of(HOURS, size(1))
    fields["job.work_arrangement"] = one_of(DESKS, size(5))
    fields["job.date_posted"] = day("2024-01-01", size(7))
    fields["job.deadline_status"] = one_of(("rolling", "confirmed"), size(8))
    fields["job.application_deadline"] = F.when(size(8) % 2 == 1, day("2024-02-01", size(9)))
    fields["requirements.seniority_level"] = one_of(LEVELS, size(10))
    fields["requirements.minimum_years_experience"] = size(1)
    fields["requirements.maximum_years_experience"] = F.when(size(2) > 3, size(1) + size(2))
    part = lambda of: F.struct(*[c.alias(p.split(".")[1]) for p, c in fields.items() if p.startswith(of)])
    return F.to_json(F.struct(part("job").alias("job"), part("requirements").alias("requirements")))


def cases(spark, sf, only: tuple[str, ...] = tuple(RUNS)) -> DataFrame:
    """case_id, run, n_chars, expected and actual records, for each document and the asked-for extractions."""
    words = F.filter(F.split(F.lower(X.blank(F.col("text"))), "[^a-z]+"), lambda x: x != "")
    rows = fill_slots(table(spark, sf, "documents")).select(F.col("doc_id").alias("case_id"), "n_chars", words.alias("w"))
    runs = F.array(*[F.struct(F.lit(run).alias("run"), F.lit(RUNS[run]).alias("without")) for run in only])
    rows = rows.select("case_id", "n_chars", "w", F.explode(runs).alias("r"))
    kept = F.filter("w", lambda x: F.length(x) != F.col("r.without"))
    actual = F.replace(record(kept), F.lit('"industry_tags"'), F.lit('"industry"'))
    return rows.select("case_id", "r.run", "n_chars", record(F.col("w")).alias("expected"), actual.alias("actual"))


def compared(spark, sf, only: tuple[str, ...] = tuple(RUNS), kinds: dict[str, str] = Q.FIELD_KINDS) -> DataFrame:
    """The compared fields. A query that gives out one extraction or some fields names them: no others are read or compared."""
    keyed = cases(spark, sf, only).select(F.struct("case_id", "run", "n_chars").alias("k"), "expected", "actual")
    return Q.compare_records(Q.record_fields(keyed, "k", "expected", "actual", kinds)).select("k.*", *[c for c in _COLUMNS])


_COLUMNS = ("path", "kind", "status", "score", "matches", "missing_items", "unexpected_items", "expected_blank", "actual_blank", "actual_text")


# ---------------------------------------------------------------- the same in SQL
def ratio_sql(pairs: str) -> str:
    """CTEs `seg` and `ratio(x, y, ratio)`: longest common run first, then left and right of it, over the pairs (x, y)."""
    return f"""seg(x, y, alo, ahi, blo, bhi, got) AS (
    SELECT x, y, 1::BIGINT, len(x) + 1, 1::BIGINT, len(y) + 1, 0::BIGINT FROM {pairs}
    UNION ALL
    SELECT x, y, CASE side WHEN 0 THEN alo ELSE m.k - m.i END, CASE side WHEN 0 THEN -m.i ELSE ahi END, CASE side WHEN 0 THEN blo ELSE m.k - m.j END,
      CASE side WHEN 0 THEN -m.j ELSE bhi END, CASE side WHEN 0 THEN m.k ELSE 0 END
    FROM (
      SELECT x, y, alo, ahi, blo, bhi, max({{'k': list_max(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda k: substr(x, i, k) = substr(y, j, k))), 'i': -i, 'j': -j}}) AS m
      FROM (SELECT *, unnest(range(blo, bhi)) AS j FROM (SELECT *, unnest(range(alo, ahi)) AS i FROM seg WHERE ahi > alo AND bhi > blo))
      WHERE substr(x, i, 1) = substr(y, j, 1) GROUP BY ALL), (VALUES (0), (1)) s(side)),
  ratio AS (SELECT x, y, 2.0 * sum(got) / (len(x) + len(y)) AS ratio FROM seg GROUP BY x, y),
  likeness AS (
    SELECT x, y, greatest(ratio, CASE WHEN common = 0 THEN 0 ELSE 2.0 * (common / ny) * (common / nx) / (common / ny + common / nx) END,
      CASE WHEN contains(x, y) OR contains(y, x) THEN least(len(x), len(y))::DOUBLE / greatest(len(x), len(y)) ELSE 0 END)::DOUBLE AS s
    FROM (SELECT *, len(list_intersect(string_split(x, ' '), string_split(y, ' ')))::DOUBLE AS common, len(list_distinct(string_split(x, ' ')))::DOUBLE AS nx,
      len(list_distinct(string_split(y, ' ')))::DOUBLE AS ny FROM ratio))"""


def _listing(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_TYPED = {
    "job.employment_type": f"({_listing(HOURS)})[len(w[1]) % 3 + 1]",
    "job.work_arrangement": f"({_listing(DESKS)})[len(w[5]) % 3 + 1]",
    "job.date_posted": "strftime(DATE '2024-01-01' + len(w[7])::INTEGER, '%Y-%m-%d')",
    "job.deadline_status": "(['rolling', 'confirmed'])[len(w[8]) % 2 + 1]",
    "job.application_deadline": "CASE WHEN len(w[8]) % 2 = 1 THEN strftime(DATE '2024-02-01' + len(w[9])::INTEGER, '%Y-%m-%d') END",
    "requirements.seniority_level": f"({_listing(LEVELS)})[len(w[10]) % 3 + 1]",
    "requirements.minimum_years_experience": "len(w[1])::VARCHAR",
    "requirements.maximum_years_experience": "CASE WHEN len(w[2]) > 3 THEN (len(w[1]) + len(w[2]))::VARCHAR END",
}
_PLACED = ", ".join(f"('{p}', '{Q.FIELD_KINDS[p]}', {a}, {n})" for p, (a, n) in PLACES.items())
_UNTYPED = " UNION ALL ".join(f"SELECT case_id, run, side, '{p}' AS path, {c} AS v FROM sides" for p, c in _TYPED.items())
COMPARED = f"""WITH RECURSIVE base AS (SELECT doc_id AS case_id, n_chars, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents),
  runs(run, without) AS (VALUES ('a', 2), ('b', 1)),
  sides AS (SELECT case_id, run, 'e' AS side, w FROM base, runs UNION ALL SELECT case_id, run, 'a', list_filter(w, lambda x: len(x) <> without) FROM base, runs),
  spec(path, kind, a, n) AS (VALUES {_PLACED}),
  lists AS (SELECT case_id, run, path, kind, side, w[a:a + n - 1] AS l FROM sides, spec),
  paired AS (SELECT case_id, run, path, kind, max(l) FILTER (side = 'e') AS e, max(l) FILTER (side = 'a') AS a FROM lists GROUP BY ALL),
  texts AS (SELECT case_id, run, path, array_to_string(e, ' ') AS x, array_to_string(a, ' ') AS y FROM paired WHERE kind = 'text'),
  items AS (SELECT case_id, run, path, list_filter(e, lambda x, i: list_position(e, x) = i) AS e, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM paired WHERE kind = 'list'),
  met AS (SELECT case_id, run, path, i, j, e[i] AS x, a[j] AS y FROM (SELECT *, unnest(range(1, len(a) + 1)) AS j FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM items))),
  pairs AS (SELECT x, y FROM texts WHERE x <> y AND x <> '' AND y <> '' UNION SELECT x, y FROM met WHERE x <> y),
  {ratio_sql('pairs')},
  cand AS (SELECT case_id, run, path, i, j, s FROM (SELECT met.*, CASE WHEN met.x = met.y THEN 1.0 ELSE coalesce(s, 0) END AS s FROM met LEFT JOIN likeness USING (x, y)) WHERE s >= 0.55),
  greedy(case_id, run, path, ui, uj, n, total) AS (
    SELECT case_id, run, path, []::BIGINT[], []::BIGINT[], 0, 0.0::DOUBLE FROM items
    UNION ALL
    SELECT case_id, run, path, list_append(ui, m.i), list_append(uj, m.j), n + 1, total + round_even(m.s, 4)
    FROM (SELECT case_id, run, path, ui, uj, n, total, max({{'s': s, 'i': i, 'j': j}}) AS m FROM greedy JOIN cand USING (case_id, run, path)
      WHERE NOT list_contains(ui, i) AND NOT list_contains(uj, j) GROUP BY ALL)),
  matched AS (SELECT case_id, run, path, max(n) AS n, max_by(total, n) AS total FROM greedy GROUP BY ALL),
  typed AS (SELECT case_id, run, path, max(v) FILTER (side = 'e') AS e, max(v) FILTER (side = 'a') AS a FROM ({_UNTYPED}) GROUP BY ALL),
  cmp AS (
    SELECT case_id, run, path, 'typed' AS kind, CASE WHEN e IS NULL AND a IS NULL THEN 'exact' WHEN a IS NULL THEN 'missing' WHEN e IS NULL THEN 'unexpected' WHEN e = a THEN 'exact' ELSE 'incorrect' END AS status,
      CASE WHEN e IS NOT DISTINCT FROM a THEN 1.0 ELSE 0.0 END AS score, e IS NULL AS no_e, a IS NULL AS no_a, 0 AS matched, 0 AS missing, 0 AS unexpected FROM typed
    UNION ALL SELECT case_id, run, path, 'text', CASE WHEN x = '' AND y = '' THEN 'exact' WHEN y = '' THEN 'missing' WHEN x = '' THEN 'unexpected' WHEN s >= 0.98 THEN 'exact' WHEN s >= 0.55 THEN 'partial' ELSE 'incorrect' END,
      s, x = '', y = '', 0, 0, 0 FROM (SELECT t.*, CASE WHEN t.x = t.y THEN 1.0 ELSE coalesce(s, 0) END AS s FROM texts t LEFT JOIN likeness USING (x, y))
    UNION ALL SELECT case_id, run, path, 'list', CASE WHEN len(e) = 0 AND len(a) = 0 THEN 'exact' WHEN len(a) = 0 THEN 'missing' WHEN len(e) = 0 THEN 'unexpected'
      WHEN list_sort(e) = list_sort(a) THEN 'exact' WHEN n > 0 THEN 'partial' ELSE 'incorrect' END,
      CASE WHEN list_sort(e) = list_sort(a) THEN 1.0 WHEN total = 0 THEN 0.0 ELSE 2 * (total / len(a)) * (total / len(e)) / (total / len(a) + total / len(e)) END,
      len(e) = 0, len(a) = 0, n, len(e) - n, len(a) - n FROM items JOIN matched USING (case_id, run, path))"""
_SENSITIVE = ", ".join(f"'{p}'" for p in Q.SENSITIVE_FIELDS)
#: Mean score in percent, half to even, from whole millionths, so that no order of adding shows.
_MEAN = "round_even(sum(CAST(round(score * 1000000) AS BIGINT)) FILTER ({where}) / (10000.0 * nullif(count(*) FILTER ({where}), 0)), 2)::DOUBLE"
_CRITICAL = ", ".join(f"'{p}'" for p in CRITICAL)


@query("join_15_field_comparison", COMPARED + " SELECT case_id, run, path, kind, status, round(score, 6)::DOUBLE AS score FROM cmp")
def join_15(spark, sf):
    """JOIN-15 and FN-30: every field of every document and run."""
    return compared(spark, sf).select("case_id", "run", "path", "kind", "status", F.round("score", 6).alias("score"))


@query("join_16_field_lists", COMPARED + " SELECT case_id, run, path, status, round(score, 6)::DOUBLE AS score, CAST(matched AS INTEGER) AS matched, CAST(missing AS INTEGER) AS missing, CAST(unexpected AS INTEGER) AS unexpected FROM cmp WHERE kind = 'list'")
def join_16_fields(spark, sf):
    """JOIN-16 on the list fields: pairs matched one to one, and what is left on either side."""
    return compared(spark, sf, kinds={p: k for p, k in Q.FIELD_KINDS.items() if k == "list"}).select(
        "case_id", "run", "path", "status", F.round("score", 6).alias("score"), F.size("matches").alias("matched"),
        F.size("missing_items").alias("missing"), F.size("unexpected_items").alias("unexpected"),
    )


@query("agg_12_status_histogram", COMPARED + " SELECT run, path, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in Q.STATUSES) + " FROM cmp GROUP BY 1, 2")
def agg_12(spark, sf):
    return Q.status_histogram(compared(spark, sf), ("run", "path"))


@query("agg_13_agreement_sets", COMPARED + f""" SELECT case_id, path, CASE WHEN grouping(case_id) = 0 THEN 'case' WHEN grouping(path) = 0 THEN 'field' ELSE 'overall' END AS level,
  {_MEAN.format(where='TRUE')} AS agreement, {_MEAN.format(where=f'path IN ({_SENSITIVE})')} AS sensitive_agreement, count(*) AS fields
  FROM cmp WHERE run = 'a' GROUP BY GROUPING SETS ((case_id), (path), ())""")
def agg_13(spark, sf):
    rows = Q.agreement(compared(spark, sf, ("a",)).withColumn("score", F.round("score", 6).cast(EXACT_SCORE)))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("agreement", "sensitive_agreement")})


@query("flt_15_sensitive_fields", COMPARED + f" SELECT case_id, run, path, status FROM cmp WHERE path IN ({_SENSITIVE})")
def flt_15(spark, sf):
    return compared(spark, sf, kinds={p: Q.FIELD_KINDS[p] for p in Q.SENSITIVE_FIELDS}).select("case_id", "run", "path", "status")


@query("join_19_evidence_coverage", COMPARED + """ SELECT case_id, count(*) AS required, count(*) FILTER (NOT no_a) AS covered, coalesce(string_agg(path, ',' ORDER BY path) FILTER (no_a), '') AS missing_fields,
  round(100.0 * count(*) FILTER (NOT no_a) / count(*), 2) AS coverage_percent FROM cmp WHERE run = 'a' AND NOT no_e GROUP BY 1""")
def join_19(spark, sf):
    """Fields with an expected value, and those of them that the extraction can cite a text for."""
    rows = compared(spark, sf, ("a",))
    expected = rows.select("case_id", F.col("path").alias("field"), F.when(~F.col("expected_blank"), "x").alias("value"))
    cited = rows.select("case_id", F.col("path").alias("field"), F.col("actual_text").alias("source_text"))
    return Q.evidence_coverage(expected, cited)


def summaries(spark, sf, only: tuple[str, ...] = tuple(RUNS)) -> DataFrame:
    """A line per case and run with what the gate and the comparison of runs read."""
    rows = settle(compared(spark, sf, only).select("case_id", "run", "n_chars", "path", F.round("score", 6).cast(EXACT_SCORE).alias("score"), "status", "expected_blank", "actual_blank"))
    per_case = Q.case_summary(rows, ("case_id", "run", "n_chars"))
    wanted = rows.where(F.col("path").isin(*CRITICAL)).select("case_id", "run", "path")
    keyed = rows.select(F.struct("case_id", "run").alias("k"), "path", "score")
    passed = Q.critical_claims(wanted.select(F.struct("case_id", "run").alias("k"), "path"), keyed, "k").groupBy("k.case_id", "k.run").agg(
        F.count_if("passed").alias("critical_passed"), F.count("*").alias("critical_total")
    )
    records = cases(spark, sf, only).select(F.struct("case_id", "run").alias("k"), F.array(*[F.lit(f) for f in FORBIDDEN]).alias("forbidden"), F.col("actual").alias("serialised"))
    hits = Q.forbidden_hits(records.select("k", "forbidden"), records.select("k", "serialised"), "k").select("k.*", F.size("hits").cast("long").alias("forbidden"))
    return per_case.join(passed, ["case_id", "run"]).join(hits, ["case_id", "run"])


SUMMARIES = COMPARED + f""", said AS (SELECT case_id, run, string_agg(array_to_string(a, ' '), ' ') AS t FROM paired GROUP BY ALL),
  c AS (SELECT case_id, run, {_MEAN.format(where='TRUE')} AS agreement, count(*) FILTER (NOT no_e) AS required, count(*) FILTER (NOT no_e AND NOT no_a) AS covered,
    CASE WHEN count(*) FILTER (NOT no_e) = 0 THEN 100.0 ELSE round(100.0 * count(*) FILTER (NOT no_e AND NOT no_a) / count(*) FILTER (NOT no_e), 2) END AS coverage,
    count(*) FILTER (status = 'missing') AS under, count(*) FILTER (status = 'unexpected') AS over, count(*) FILTER (path IN ({_CRITICAL}) AND round(score, 6) >= 0.55) AS critical_passed,
    count(*) FILTER (path IN ({_CRITICAL})) AS critical_total FROM cmp GROUP BY ALL),
  f AS (SELECT c.*, n_chars, {' + '.join(f"contains(t, '{w}')::INTEGER" for w in FORBIDDEN)} AS forbidden FROM c JOIN said USING (case_id, run) JOIN base USING (case_id))"""


@query("agg_14_run_totals_and_gate", SUMMARIES + """ SELECT count(*) AS cases, round_even(sum(CAST(round(agreement * 100) AS BIGINT)) / (100.0 * count(*)), 2)::DOUBLE AS agreement, round_even(100.0 * sum(covered) / sum(required), 2)::DOUBLE AS evidence_coverage, CAST(sum(under) AS BIGINT) AS under_extraction,
  CAST(sum(over) AS BIGINT) AS over_extraction, CAST(sum(critical_passed) AS BIGINT) AS critical_passed, CAST(sum(critical_total) AS BIGINT) AS critical_total, CAST(sum(forbidden) AS BIGINT) AS forbidden_hits, round_even(avg(n_chars), 2)::DOUBLE AS average_latency_ms,
  concat_ws(',', CASE WHEN sum(forbidden) > 0 THEN 'forbidden_claims' END, CASE WHEN sum(critical_passed) <> sum(critical_total) THEN 'critical_claims_missed' END, CASE WHEN round(avg(agreement), 2) < 60 THEN 'agreement_below_minimum' END) AS failures FROM f WHERE run = 'a'""")
def agg_14(spark, sf):
    """AGG-14 and AGG-15 over the first run; a case's size stands for its time."""
    rows = summaries(spark, sf, ("a",)).withColumn("latency_ms", F.col("n_chars").cast("double"))
    totals = Q.run_totals(rows).withColumn("agreement", F.col("agreement").cast("double"))
    return Q.quality_gate(totals, 60.0).withColumn("failures", F.array_join("failures", ","))


@query("join_17_run_comparison", SUMMARIES + """, d AS (SELECT a.case_id, round(b.agreement - a.agreement, 2)::DOUBLE AS agreement_delta, round(b.coverage - a.coverage, 2)::DOUBLE AS coverage_delta, b.under - a.under AS under_delta, b.over - a.over AS over_delta,
  b.critical_passed - a.critical_passed AS critical_passed_delta, CAST(b.forbidden - a.forbidden AS BIGINT) AS forbidden_delta FROM f a JOIN f b ON a.case_id = b.case_id AND a.run = 'a' AND b.run = 'b'),
r AS (SELECT *, concat_ws(',', CASE WHEN agreement_delta < 0 THEN 'agreement_decreased' END, CASE WHEN coverage_delta < 0 THEN 'evidence_coverage_decreased' END, CASE WHEN under_delta > 0 THEN 'under_extraction_increased' END,
  CASE WHEN over_delta > 0 THEN 'over_extraction_increased' END, CASE WHEN critical_passed_delta < 0 THEN 'critical_claims_decreased' END, CASE WHEN forbidden_delta > 0 THEN 'forbidden_claims_increased' END) AS reasons FROM d)
SELECT *, reasons = '' AND (agreement_delta > 0 OR coverage_delta > 0 OR under_delta < 0 OR over_delta < 0) AS improved FROM r""")
def join_17(spark, sf):
    """JOIN-17 and AGG-20: the second extraction against the first."""
    rows = settle(summaries(spark, sf))
    side = lambda run: rows.where(F.col("run") == run).drop("run")
    found = Q.compare_runs(side("a"), side("b")).withColumn("reasons", F.array_join("reasons", ","))
    return found.withColumn("agreement_delta", F.col("agreement_delta").cast("double"))


@query("fn_10_text_similarity", f"""WITH RECURSIVE n AS (SELECT DISTINCT a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size),
  pairs AS (SELECT x, y FROM n WHERE x <> y), {ratio_sql('pairs')}
  SELECT x AS p_name, y AS other, round(CASE WHEN x = y THEN 1.0 ELSE s END, 6)::DOUBLE AS similarity FROM n LEFT JOIN likeness USING (x, y)""")
def fn_10(spark, sf):
    """Names of parts against the names of parts of the same brand and size."""
    part = table(spark, sf, "part").select("p_brand", "p_size", "p_name").distinct()
    names = part.join(part.withColumnRenamed("p_name", "other"), ["p_brand", "p_size"]).select("p_name", "other").distinct()
    similarity = S.text_similarity(X.compare_text(F.col("p_name")), X.compare_text(F.col("other")))
    return names.select("p_name", "other", F.round(similarity, 6).alias("similarity"))
