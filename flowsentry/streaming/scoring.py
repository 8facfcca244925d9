"""Models on a flow stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowsentry.ml.training import Models, score_flows


def stream_scoring(flows: DataFrame, models: Models) -> DataFrame:
    """Stateless: every closed flow with scores, votes and confidence; counts are observable as "scoring"."""
    scored = score_flows(flows, models)
    return scored.observe("scoring", F.count("*").alias("total_scored"), F.sum("predicted").alias("total_flagged"))
