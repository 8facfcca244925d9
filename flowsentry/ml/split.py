"""Stratified train / test split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowsentry.plans.ordered import ranked


def stratified_split(df: DataFrame, label: str, row_id: str, test_share: float = 0.2, seed: int = 42, chunks: int | None = None):
    """(train, test): the same share of every label goes to test, chosen by a seeded hash of the row id.

    Ranks are taken over a range-partitioned order, so two labels do not mean two tasks.
    """
    mixed = df.withColumn("_mix", F.xxhash64(F.lit(seed), F.col(row_id)))
    placed = ranked(mixed, [label], ["_mix", row_id], "_rank", chunks)
    sizes = placed.groupBy(label).agg(F.max("_rank").alias("_n"))  # one row per label
    marked = placed.join(F.broadcast(sizes), label).withColumn("_test", F.col("_rank") <= F.round(F.col("_n") * test_share))
    drop = ("_mix", "_rank", "_n", "_test")
    return marked.where("not _test").drop(*drop), marked.where("_test").drop(*drop)
