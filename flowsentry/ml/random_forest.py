"""Random forest on MLlib with balanced class weights."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsentry import dims
from flowsentry.ml.batches import once
from flowsentry.plans.storage import checkpoint_dir, materialize


#: Steps that rows go down a tree before those at a leaf drop out.
_STEPS = 4


def weighted_rows(train: DataFrame, label: str, columns: list[str], pieces: int) -> DataFrame:
    """Rows of equal features and label as one row, or up to ``pieces`` rows, that share their weight; stored, in a fixed order.

    The weight of a row of ``train`` is n / (2 * n of its class). A tree's bootstrap draws pieces, so up to ``pieces`` equal rows are
    drawn one by one; of more, each draw takes an equal share of them.
    """
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (2 * n)).otherwise(weight)
    drawn = F.least(F.col("rows"), F.lit(pieces))
    order = [label, *columns, "piece"]
    groups = train.groupBy(label, *columns).agg(F.count("*").alias("rows"))
    dealt = groups.withColumn("weight", weight * F.col("rows") / drawn).withColumn("piece", F.explode(F.sequence(F.lit(1), drawn.cast("int"))))
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-total // 200_000))
    return materialize(dealt.repartition(parts, *order).sortWithinPartitions(*order).drop("rows", "piece"))


def fit_random_forest(
    train: DataFrame,
    label: str = "binary_label",
    columns: list[str] = dims.FEATURES,
    trees: int = 300,
    max_depth: int = 30,
    seed: int = 42,
    memory_mb: int = 1024,
    pieces: int = 8,
) -> PipelineModel:
    """MLlib limits depth to 30; the rest follows the usual classifier defaults.

    All rows count, equal ones together (``weighted_rows``), so a pass reads each different row at most ``pieces`` times.
    The tree nodes that rows have reached are kept between passes.

    Trees grow level by level, one pass per group of nodes that fits ``memory_mb``; labels
    that features hardly explain make them deep and slow, so lower ``max_depth`` there.
    """
    forest = RandomForestClassifier(
        numTrees=trees,
        maxDepth=max_depth,
        featureSubsetStrategy="sqrt",
        weightCol="weight",
        labelCol=label,
        featuresCol="features",
        probabilityCol="rf_probability",
        rawPredictionCol="rf_raw",
        predictionCol="rf_class",
        seed=seed,
        maxMemoryInMB=memory_mb,
        cacheNodeIds=True,
    )
    stages = [VectorAssembler(inputCols=list(columns), outputCol="features"), forest]
    return Pipeline(stages=stages).fit(weighted_rows(train, label, list(columns), pieces))


def _walker(model: PipelineModel, spark: SparkSession) -> Callable[[np.ndarray], np.ndarray] | None:
    """MLlib's probability of class 1 per row of an array, or None where the forest does not have two classes.

    The nodes come from the stored form of the forest, where a node's left child has the next number.
    """
    forest = model.stages[-1]
    if forest.numClasses != 2:
        return None
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    forest.write().save(path)
    node = F.col("nodeData")
    stored = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["impurityStats"][0].alias("s0"), node["impurityStats"][1].alias("s1"),
    )
    nodes = stored.toArrow().to_pandas().sort_values(["tree", "id"])
    number, right, inner = nodes["id"].to_numpy(int), nodes["right"].to_numpy(int), nodes["feature"].to_numpy() >= 0
    # a leaf is its own left child, where all rows go
    feature, threshold = np.where(inner, nodes["feature"], 0).astype("i2"), np.where(inner, nodes["threshold"], np.inf)
    child = np.column_stack([np.where(inner, number + 1, number), np.where(inner, right, number)])
    total = (nodes["s0"] + nodes["s1"]).to_numpy()
    share = [np.divide(nodes[c].to_numpy(), total, out=np.zeros(len(nodes)), where=total != 0) for c in ("s0", "s1")]
    begins = np.flatnonzero(number == 0)[1:]
    trees = [
        (f, t, c.ravel(), i, s0, s1) for f, t, c, i, s0, s1 in zip(*[np.split(v, begins) for v in (feature, threshold, child, inner, *share)])
    ]

    def probability(x: np.ndarray) -> np.ndarray:
        """Rows go down a tree side by side; every few steps those at a leaf drop out. Votes add up in the order of the trees, as in MLlib."""
        begin, flat = np.arange(len(x)) * x.shape[1], np.ascontiguousarray(x).ravel()
        end, against, votes = np.empty(len(x), int), np.zeros(len(x)), np.zeros(len(x))
        for feature, threshold, child, inner, *shares in trees:
            rows, first, at = np.arange(len(x)), begin, np.zeros(len(x), int)
            while len(rows):
                for _ in range(_STEPS):
                    over = flat.take(feature.take(at) + first) > threshold.take(at)
                    at += at
                    at += over
                    at = child.take(at)
                end[rows] = at
                left = np.flatnonzero(inner.take(at))
                rows, first, at = rows.take(left), first.take(left), at.take(left)
            against += shares[0].take(end)
            votes += shares[1].take(end)
        return votes / (against + votes)

    return probability


def forest_scores(model: PipelineModel, df: DataFrame, name: str = "rf_score") -> DataFrame:
    """Probability of an attack, row by row.

    Rows of a stream go down the trees in Python, some 40 µs a row where MLlib takes 200; equal rows of an Arrow batch are scored once.
    """
    columns = list(model.stages[0].getInputCols())
    probability = _walker(model, df.sparkSession) if df.isStreaming else None
    if probability is None:
        out = model.transform(df).withColumn(name, vector_to_array("rf_probability")[1])
        return out.drop("features", "rf_probability", "rf_raw", "rf_class")

    def score(*given: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in given])
        if np.isnan(x).any():
            raise ValueError("a feature is NULL or not a number")  # MLlib refuses such rows too
        return pd.Series(once(x, probability))

    return df.withColumn(name, F.pandas_udf(score, "double")(*[F.col(c).cast("double") for c in columns]))


def score_random_forest(model: PipelineModel, df: DataFrame, name: str = "rf_score") -> DataFrame:
    """Probability of an attack; rows of equal features are scored once, rows of a stream as they come."""
    if df.isStreaming:
        return forest_scores(model, df, name)
    return once_each(df, list(model.stages[0].getInputCols()), lambda rows: forest_scores(model, rows, name))


def once_each(df: DataFrame, columns: list[str], scored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with what ``scored`` adds to rows of ``columns``; rows of equal columns are scored once, in tasks of like size, and get them by a join.

    300 trees cost some 200 µs a row in MLlib, the join far less.
    """
    different = materialize(df.select(*columns).distinct())
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-different.count() // 200_000))
    scores = materialize(scored(different.repartition(parts))).withColumnsRenamed({c: f"_{c}" for c in columns})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return df.join(scores, same).select(*df.columns, *[c for c in scores.columns if c not in {f"_{c}" for c in columns}])


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    names, values = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")
