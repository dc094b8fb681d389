"""Predictions against human labels (JOIN-27, AGG-05..08, FLT-08, SRT-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_even, percent
from .listing import PREDICTED_RATING, agreement_status, choose
from .ordered import global_rank
from .scoring import MODELS, classify

RATING_ORDER = {"not_eligible": 0, "weak": 1, "possible": 2, "good": 3, "strong": 4}
TRACK_LANE = {"PRIORITY ROLE": "priority", "ADJACENT OPPORTUNITY": "adjacent", "OUTSIDE PRIORITY": "outside"}


def calibration_rows(labels: DataFrame, current: DataFrame) -> DataFrame:
    """JOIN-27: saved against current prediction against the label.

    labels: job_id, human_rating, opportunity_type, predicted_score, predicted_class, predicted_track
    current: job_id, score, classification, track, has_requirements
    """
    rows = labels.join(current, "job_id")
    rating = agreement_status(F.col("classification"), F.col("human_rating"))
    saved = agreement_status(F.col("predicted_class"), F.col("human_rating"))
    lane = choose(F.col("track"), TRACK_LANE)
    delta = F.when(F.col("has_requirements"), F.col("score")) - F.col("predicted_score")
    return rows.withColumns(
        {
            "rating_status": rating,
            "lane_status": F.when(F.col("opportunity_type") == "unsure", "NOT SCORED")
            .when(lane.isNull(), "NEEDS EVIDENCE")
            .when(lane == F.col("opportunity_type"), "ALIGNED")
            .otherwise("REVIEW"),
            "change_status": F.when(rating == "NEEDS EVIDENCE", "NEEDS EVIDENCE")
            .when((rating == "ALIGNED") & (saved != "ALIGNED"), "IMPROVED")
            .when((rating != "ALIGNED") & (saved == "ALIGNED"), "REGRESSED")
            .when(rating == "ALIGNED", "STABLE ALIGNED")
            .otherwise("STILL REVIEW"),
            "score_delta": delta,
            "strategy_changed": F.coalesce(delta != 0, F.lit(False))
            | (F.col("classification") != F.col("predicted_class"))
            | (F.col("track") != F.col("predicted_track")),
        }
    ).withColumn("needs_attention", (F.col("rating_status") == "REVIEW") | (F.col("lane_status") == "REVIEW"))


def report_filter(rows: DataFrame, name: str) -> DataFrame:
    """FLT-08."""
    rules = {
        "attention": F.col("needs_attention"),
        "aligned": (F.col("rating_status") == "ALIGNED") & F.col("lane_status").isin("ALIGNED", "NOT SCORED"),
        "changed": F.col("strategy_changed"),
        "improved": F.col("change_status") == "IMPROVED",
        "regressed": F.col("change_status") == "REGRESSED",
    }
    return rows.where(rules[name]) if name in rules else rows


def report_order(rows: DataFrame) -> DataFrame:
    """SRT-06: all rows with their rank in the report, by ranges of it."""
    order = [~F.col("needs_attention"), F.col("change_status") != "REGRESSED", F.lower("company"), F.lower("title"), F.col("job_id")]
    return global_rank(rows, [F.asc(c) for c in order], "rank")


def calibration_summary(rows: DataFrame) -> DataFrame:
    """AGG-06."""
    rating, lane = F.col("rating_status"), F.col("lane_status")
    counted = rows.agg(
        F.count("*").alias("reviewed"),
        F.count_if(rating != "NEEDS EVIDENCE").alias("rating_comparable"),
        F.count_if(rating == "ALIGNED").alias("rating_aligned"),
        F.count_if(~lane.isin("NOT SCORED", "NEEDS EVIDENCE")).alias("lane_comparable"),
        F.count_if(lane == "ALIGNED").alias("lane_aligned"),
        F.count_if("strategy_changed").alias("changed"),
        F.count_if(F.col("change_status") == "IMPROVED").alias("improved"),
        F.count_if(F.col("change_status") == "REGRESSED").alias("regressed"),
        F.count_if("needs_attention").alias("attention"),
    )
    return counted.withColumns(
        {
            "rating_percent": percent(F.col("rating_aligned"), F.col("rating_comparable")),
            "lane_percent": percent(F.col("lane_aligned"), F.col("lane_comparable")),
        }
    )


def dashboard_counters(everything: DataFrame, shown: DataFrame) -> DataFrame:
    """AGG-05: counters over all postings beside counters over the shown rows."""
    whole = everything.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_available") & ~F.col("needs_verification")).alias("verified_open"),
        F.count_if("needs_verification").alias("need_verification"),
        F.count_if("due_soon").alias("due_soon"),
    )
    visible = ~F.col("blind")
    part = shown.agg(
        F.count_if(visible & F.col("has_requirements")).alias("analysed"),
        F.count_if(visible & (F.col("classification") == "STRONG MATCH")).alias("strong"),
        F.count_if(visible & (F.col("classification") == "GOOD MATCH")).alias("good"),
        F.count_if("reviewed").alias("reviewed"),
        F.count_if("blind").alias("blind"),
    )
    # Both sides are one row by construction.
    return whole.withColumn("_one", F.lit(1)).join(part.withColumn("_one", F.lit(1)), "_one").drop("_one")


def reweigh(categories: DataFrame, models: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """AGG-08, first half: score and class of each row under each weight model.

    categories: job_id, category, fraction, available, blocked. All models are worked out in
    one aggregate, so the rows are read and shuffled once.
    """
    models = models or MODELS
    on, bounded = F.col("available"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction")))
    sums = []
    for name, weights in models.items():
        weight = choose(F.col("category"), {k: float(v) for k, v in weights.items()}, 0.0)
        sums.append(F.sum(F.when(on, weight).otherwise(0.0)).alias(f"_w_{name}"))
        sums.append(F.sum(F.when(on, weight * bounded).otherwise(0.0)).alias(f"_e_{name}"))
    totals = categories.groupBy("job_id").agg(F.bool_or("blocked").alias("_blocked"), *sums)
    per_model = F.array(
        *[
            F.struct(F.lit(n).alias("model"), F.col(f"_w_{n}").alias("w"), F.col(f"_e_{n}").alias("e"))
            for n in models
        ]
    )
    rows = totals.select("job_id", "_blocked", F.explode(per_model).alias("m"))
    score = F.when(F.col("m.w") > 0, half_even(100 * F.col("m.e") / F.col("m.w"))).otherwise(F.lit(0))
    return rows.select("job_id", "m.model", score.alias("score"), half_even(F.col("m.w")).alias("coverage"), "_blocked").withColumn(
        "classification", classify(F.col("score"), F.col("coverage"), F.col("_blocked"))
    ).drop("_blocked")


def model_metrics(predictions: DataFrame) -> DataFrame:
    """AGG-07. predictions: model, classification, track, human_rating, opportunity_type."""
    predicted = choose(F.col("classification"), PREDICTED_RATING)
    lane = choose(F.col("track"), TRACK_LANE)
    human = F.col("human_rating")
    distance = F.abs(choose(predicted, RATING_ORDER) - choose(human, RATING_ORDER))
    laned = (F.col("opportunity_type") != "unsure") & lane.isNotNull()
    counted = predictions.groupBy("model").agg(
        F.count("*").alias("reviewed"),
        F.count_if(predicted.isNotNull()).alias("comparable"),
        F.count_if(predicted == human).alias("agreement"),
        F.count_if(laned).alias("lane_comparable"),
        F.count_if(laned & (lane == F.col("opportunity_type"))).alias("lane_agreement"),
        F.count_if((predicted == "strong") & (human != "strong")).alias("false_strong"),
        F.count_if((predicted == "weak") & human.isin("strong", "good", "possible")).alias("false_weak"),
        F.count_if((predicted == "not_eligible") & (human != "not_eligible")).alias("false_disqualification"),
        F.coalesce(F.bround(F.avg(distance), 2), F.lit(0.0)).alias("mean_distance"),
    )
    return counted.withColumns(
        {
            "agreement_percent": percent(F.col("agreement"), F.col("comparable")),
            "lane_percent": percent(F.col("lane_agreement"), F.col("lane_comparable")),
        }
    )


def compare_models(predictions: DataFrame, a: str, b: str, expected: int) -> DataFrame:
    """AGG-08: wins, ties and the recommendation, which an incomplete holdout or an absent model never gives."""
    metrics = model_metrics(predictions)
    key = lambda m: F.struct(
        m["agreement"], -m["false_strong"], -m["false_disqualification"], -m["false_weak"], -m["mean_distance"]
    )
    pick = lambda name: F.max(
        F.when(
            F.col("model") == name,
            F.struct("agreement", "false_strong", "false_disqualification", "false_weak", "mean_distance", "reviewed"),
        )
    )
    both = metrics.where(F.col("model").isin(a, b)).agg(pick(a).alias("a"), pick(b).alias("b"))
    distance = F.abs(
        choose(choose(F.col("classification"), PREDICTED_RATING), RATING_ORDER) - choose(F.col("human_rating"), RATING_ORDER)
    )
    rows = predictions.groupBy("job_id").agg(
        F.max(F.when(F.col("model") == a, distance)).alias("da"),
        F.max(F.when(F.col("model") == b, distance)).alias("db"),
        F.count_distinct("classification").alias("classes"),
    )
    outcome = rows.agg(
        F.count_if(F.col("da") < F.col("db")).alias("a_wins"),
        F.count_if(F.col("db") < F.col("da")).alias("b_wins"),
        F.count_if(F.col("da") == F.col("db")).alias("ties"),
        F.count_if(F.col("classes") > 1).alias("changed_classes"),
    )
    joined = both.withColumn("_one", F.lit(1)).join(outcome.withColumn("_one", F.lit(1)), "_one").drop("_one")
    ka, kb = key(F.col("a")), key(F.col("b"))
    verdict = (
        F.when(F.col("a").isNull() | F.col("b").isNull() | (F.col("a.reviewed") < expected), "HOLDOUT INCOMPLETE")
        .when(kb > ka, "MODEL B PERFORMED BETTER")
        .when(ka > kb, "MODEL A PERFORMED BETTER")
        .otherwise("NO MEASURED ADVANTAGE")
    )
    return joined.select(F.col("a.reviewed").alias("reviewed"), "a_wins", "b_wins", "ties", "changed_classes", verdict.alias("recommendation"))
