"""The given tables seen as postings, profiles, feeds, runs and claims.

Every view exists twice, as a DataFrame and as a CTE, so that a query and its SQL
twin read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.listing import STATUSES, choose
from ..sources.tables import table

AS_OF = "1998-01-01"
CALIBRATION, VALIDATION = "BUILDING", "MACHINERY"

DEADLINE_OF = {
    "1-URGENT": "confirmed", "2-HIGH": "confirmed", "3-MEDIUM": "rolling", "4-NOT SPECIFIED": "not_stated",
    "5-LOW": "unknown",
}


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """An order as a posting: posted when ordered, due when its last line ships."""
    ships = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")
    )
    orders = table(spark, sf, "orders")
    people = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    listing = (
        F.when(status == "O", "open")
        .when(status == "P", "unverified")
        .when(priority == "4-NOT SPECIFIED", "link_broken")
        .when(priority == "5-LOW", "wrong_page")
        .otherwise("closed")
    )
    stage = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return (
        orders.join(ships, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("job_id"),
            F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
            F.col("c_name").alias("company"),
            F.col("n_name").alias("location"),
            F.col("c_mktsegment").alias("source"),
            stage.alias("status"),
            listing.alias("listing_status"),
            choose(priority, DEADLINE_OF).alias("deadline_status"),
            F.to_date("o_orderdate").alias("date_posted"),
            F.to_date("last_ship").alias("application_deadline"),
            F.to_date("first_ship").alias("listing_last_verified"),
            F.when(F.col("o_totalprice") > 1000, F.concat(F.lit("https://jobs.example.com/"), F.col("o_orderkey").cast("string"))).otherwise("").alias("job_url"),
            (F.col("o_custkey") % 7).cast("int").alias("min_years"),
            (F.col("o_orderkey") % 9).cast("int").alias("max_years"),
            F.col("o_orderdate").alias("created_at"),
            "o_totalprice",
        )
    )


POSTINGS = """ships AS (
  SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey
), postings AS (
  SELECT o_orderkey AS job_id, o_orderpriority || ' ' || c_mktsegment AS title, c_name AS company,
    n_name AS location, c_mktsegment AS source,
    (['discovered','saved','preparing','applied','interview','offer','rejected','withdrawn','closed'])[o_orderkey % 9 + 1] AS status,
    CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'P' THEN 'unverified'
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'link_broken' WHEN o_orderpriority = '5-LOW' THEN 'wrong_page'
      ELSE 'closed' END AS listing_status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'confirmed' WHEN '2-HIGH' THEN 'confirmed' WHEN '3-MEDIUM' THEN 'rolling'
      WHEN '4-NOT SPECIFIED' THEN 'not_stated' ELSE 'unknown' END AS deadline_status,
    CAST(o_orderdate AS DATE) AS date_posted, CAST(last_ship AS DATE) AS application_deadline,
    CAST(first_ship AS DATE) AS listing_last_verified,
    CASE WHEN o_totalprice > 1000 THEN 'https://jobs.example.com/' || o_orderkey ELSE '' END AS job_url,
    CAST(o_custkey % 7 AS INTEGER) AS min_years, CAST(o_orderkey % 9 AS INTEGER) AS max_years,
    o_orderdate AS created_at, o_totalprice
  FROM orders LEFT JOIN ships ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), dated AS (
  SELECT *, CASE WHEN deadline_status = 'confirmed' THEN CAST(application_deadline - DATE '1998-01-01' AS INTEGER) END AS days_remaining
  FROM postings
), flagged AS (
  SELECT *, coalesce(days_remaining < 0, FALSE) AS is_overdue, coalesce(days_remaining BETWEEN 0 AND 7, FALSE) AS due_soon
  FROM dated
), effective AS (
  SELECT *, CASE WHEN is_overdue AND listing_status IN ('open','unverified') THEN 'expired' ELSE listing_status END AS effective_status
  FROM flagged
), states AS (
  SELECT *, effective_status = 'open' AS is_available, effective_status IN ('link_broken','wrong_page') AS has_link_problem,
    effective_status IN ('closed','expired','link_broken','wrong_page') AS is_unavailable,
    CASE WHEN effective_status = 'unverified' THEN TRUE WHEN effective_status <> 'open' THEN FALSE
      WHEN deadline_status = 'unknown' THEN TRUE WHEN listing_last_verified IS NULL THEN TRUE
      ELSE listing_last_verified < DATE '1997-12-25' END AS needs_verification
  FROM effective
)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A posting's score from its value, with class and track; the saved one lags ten points behind for every third."""
    rows = postings(spark, sf)
    score = F.floor(F.col("o_totalprice") / 5000).cast("int")
    return rows.withColumns(
        {
            "score": score,
            "coverage": (F.col("job_id") % 10 * 10 + 5).cast("int"),
            "has_requirements": F.col("job_id") % 11 != 0,
        }
    )


PREDICTIONS = """predicted AS (
  SELECT *, CAST(floor(o_totalprice / 5000) AS INTEGER) AS score, CAST(job_id % 10 * 10 + 5 AS INTEGER) AS coverage,
    job_id % 11 <> 0 AS has_requirements
  FROM states
), classed AS (
  SELECT *, CASE WHEN effective_status = 'wrong_page' THEN 'DISQUALIFIED' WHEN coverage < 35 THEN 'LOW CONFIDENCE'
      WHEN score >= 80 THEN 'STRONG MATCH' WHEN score >= 65 THEN 'GOOD MATCH' WHEN score >= 50 THEN 'POSSIBLE MATCH'
      ELSE 'WEAK MATCH' END AS classification,
    CASE job_id % 4 WHEN 0 THEN 'PRIORITY ROLE' WHEN 1 THEN 'ADJACENT OPPORTUNITY' ELSE 'OUTSIDE PRIORITY' END AS track
  FROM predicted
), human AS (
  SELECT job_id, (['strong','good','possible','weak','not_eligible'])[job_id % 5 + 1] AS human_rating,
    (['priority','adjacent','outside','unsure'])[job_id % 4 + 1] AS opportunity_type,
    score - CASE WHEN job_id % 3 = 0 THEN 10 ELSE 0 END AS predicted_score,
    CASE WHEN job_id % 3 = 0 THEN 'WEAK MATCH' ELSE classification END AS predicted_class,
    CASE WHEN job_id % 6 = 0 THEN 'OUTSIDE PRIORITY' ELSE track END AS predicted_track
  FROM classed WHERE title LIKE '%HIGH%' OR title LIKE '%URGENT%'
), shown AS (
  SELECT classed.*, human.human_rating IS NOT NULL AS reviewed, source = 'MACHINERY' AND human.human_rating IS NULL AS blind
  FROM classed LEFT JOIN human USING (job_id)
)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


EVENTS = """ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""
