"""Three model scores -> votes, confidence, label; and what follows from them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from flowsentry import dims
from flowsentry.functions.alerting import severity_from_confidence


def ensemble_vote(scored: DataFrame, thresholds: dict[str, float] | None = None, votes_needed: int = dims.VOTES_NEEDED) -> DataFrame:
    """Adds votes, label and confidence from if_score, rf_score, ae_score.

    A missing score counts 0 and does not vote.  Votes use the full score, confidence
    the score at four digits.
    """
    limits = dims.VOTE_THRESHOLDS | (thresholds or {})
    score = {m: F.coalesce(F.col(f"{m}_score"), F.lit(0.0)) for m in dims.MODEL_WEIGHTS}
    votes = sum((F.when(score[m] >= limits[m], 1).otherwise(0) for m in score), F.lit(0))
    # Decimals: the weighted sum of four-digit scores is exact, so its rounding is too.
    confidence = sum(
        F.lit(Decimal(str(w))) * F.round(score[m], 4).cast("decimal(9,4)") for m, w in dims.MODEL_WEIGHTS.items()
    )
    return scored.withColumn("votes", votes).withColumns(
        {"predicted": (F.col("votes") >= votes_needed).cast("int"), "confidence": F.round(confidence, 4).cast("double")}
    )


def ml_to_alert(flagged: DataFrame) -> DataFrame:
    """Flows with predicted = 1 -> alerts.  Needs flow columns, votes, confidence and raw_features."""
    confidence = F.col("confidence")
    return flagged.where("predicted = 1").select(
        F.col("flow_id").alias("source_id"),
        F.col("start_us").alias("ts_us"),
        F.lit("NETWORK").alias("alert_type"),
        severity_from_confidence(confidence).alias("severity"),
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        F.col("protocol").cast("string").alias("protocol"),
        F.concat(
            F.lit("ML anomaly detected: confidence="),
            F.format_string("%.2f%%", F.round(confidence * 100, 2)),
            F.lit(", votes="),
            F.col("votes").cast("string"),
            F.lit("/3"),
        ).alias("description"),
        F.lit("Unknown").alias("mitre_tactic"),
        F.lit("Unknown").alias("mitre_technique"),
        "confidence",
        F.col("votes").alias("model_votes"),
        "raw_features",
    )


def network_events(scored: DataFrame) -> DataFrame:
    """Event row of every scored flow, attack or benign."""
    return scored.select(
        F.col("start_us").alias("ts_us"),
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        F.col("protocol").cast("string").alias("protocol"),
        F.col("fwd_bytes").alias("bytes_sent"),
        F.col("bwd_bytes").alias("bytes_recv"),
        F.col("total_packets").alias("packets"),
        "duration_ms",
        "flags",
        F.col("confidence").alias("anomaly_score"),
        F.when(F.col("predicted") == 1, "attack").otherwise("benign").alias("label"),
    )


def scoring_stats(scored: DataFrame) -> DataFrame:
    flagged = F.coalesce(F.sum("predicted"), F.lit(0))
    return scored.agg(
        F.count("*").alias("total_scored"),
        flagged.alias("total_flagged"),
        F.round(flagged / F.greatest(F.count("*"), F.lit(1)) * 100, 2).alias("flag_rate_pct"),
    )


def calibrate(errors: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation and mean + 3 deviations of reconstruction errors."""
    mean, std = F.avg(column), F.stddev_pop(column)
    return errors.agg(mean.alias("mean"), std.alias("std"), (mean + 3 * std).alias("threshold"))


def calibrated_score(error: Column, mean: float, std: float) -> Column:
    return F.least(F.greatest((error - mean) / (std + 1e-8) / 6 + 0.5, F.lit(0.0)), F.lit(1.0))
