"""Isolation forest (Liu, Ting, Zhou 2008) grown and scored by Spark tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from flowsentry import dims
from flowsentry.ml.batches import once
from flowsentry.plans.ordered import quantiles_of, value_spans

_NODES = "tree int, node int, feature int, threshold double, left int, right int, length double"


def _average_path(n) -> np.ndarray:
    """Average depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(columns: list[str], depth: int, seed: int):
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x, nodes, todo = rows[columns].to_numpy(float), [], [(0, np.arange(len(rows)), 0)]
        made = 1
        while todo:
            node, idx, level = todo.pop()
            part = x[idx]
            lo, hi = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if level >= depth or len(idx) <= 1 or not len(usable):
                nodes.append((tree, node, -1, 0.0, node, node, level + float(_average_path(len(idx)))))
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(lo[f], hi[f]))
            left, right, made = made, made + 1, made + 2
            nodes.append((tree, node, f, cut, left, right, 0.0))
            todo += [(left, idx[part[:, f] <= cut], level + 1), (right, idx[part[:, f] > cut], level + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "length"])

    return grow


def _levels(feature: np.ndarray, child: np.ndarray, most: int) -> int:
    """Steps from the root to the deepest leaf, or ``most``."""
    at, steps = np.zeros(1, int), 0
    while steps < most and (feature[at] >= 0).any():
        at, steps = np.unique(child[at]), steps + 1
    return steps


@dataclass
class IsolationForest:
    columns: list[str]
    means: list[float]
    stds: list[float]
    nodes: pd.DataFrame  # at most trees * 2 * sample_size rows
    sample_size: int
    offset: float = -0.5

    def _scorer(self):
        trees = self.nodes["tree"].nunique()
        width = int(self.nodes["node"].max()) + 1
        feature, threshold = np.full((trees, width), -1), np.zeros((trees, width))
        child, length = np.zeros((trees, width, 2), int), np.zeros((trees, width))
        t, n = self.nodes["tree"].rank(method="dense").astype(int).to_numpy() - 1, self.nodes["node"].to_numpy()
        feature[t, n], threshold[t, n] = self.nodes["feature"], self.nodes["threshold"]
        child[t, n, 0], child[t, n, 1], length[t, n] = self.nodes["left"], self.nodes["right"], self.nodes["length"]
        means, stds = np.array(self.means), np.array(self.stds)
        norm = float(_average_path(self.sample_size))
        depth = int(np.ceil(np.log2(max(self.sample_size, 2)))) + 1
        steps = [_levels(f, c, depth) for f, c in zip(feature, child)]
        feature, child = np.maximum(feature, 0), child.reshape(trees, -1)  # children of node i: places 2 i and 2 i + 1

        def paths(x: np.ndarray) -> np.ndarray:
            """Sum of path lengths per row; a step of a tree is a few passes over all rows, in arrays that are kept."""
            rows, flat, total = np.arange(len(x)), np.ascontiguousarray(x.T).ravel(), np.zeros(len(x))
            first = feature * len(x)  # where a node's feature begins in ``flat``
            at, place, goes = np.empty(len(x), int), np.empty(len(x), int), np.empty(len(x), bool)
            value, limit = np.empty(len(x)), np.empty(len(x))
            for tree in range(trees):
                at[:] = 0
                for _ in range(steps[tree]):
                    first[tree].take(at, out=place, mode="clip")
                    place += rows
                    flat.take(place, out=value, mode="clip")
                    threshold[tree].take(at, out=limit, mode="clip")
                    np.greater(value, limit, out=goes)
                    at += at
                    at += goes
                    child[tree].take(at, out=place, mode="clip")
                    at, place = place, at
                total += length[tree].take(at, out=value, mode="clip")
            return total

        def score(*columns: pd.Series) -> pd.Series:
            x = (np.column_stack([c.to_numpy(float) for c in columns]) - means) / stds
            return pd.Series(-np.exp2(-once(x, paths) / trees / norm))

        return F.pandas_udf(score, "double")

    def raw(self, df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, self._scorer()(*[F.col(c).cast("double") for c in self.columns]))

    def score(self, df: DataFrame, name: str = "if_score") -> DataFrame:
        """Anomaly score in [0, 1]; the training contamination quantile scores 0.5."""
        raw = self.raw(df, "_raw")
        return raw.withColumn(
            name, F.least(F.greatest(F.lit(0.5) - (F.col("_raw") - self.offset), F.lit(0.0)), F.lit(1.0))
        ).drop("_raw")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        rows = [(c, m, s, self.sample_size, self.offset) for c, m, s in zip(self.columns, self.means, self.stds)]
        schema = "name string, mean double, std double, sample_size int, offset double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationForest:
        c = spark.read.parquet(f"{path}/columns").toPandas()
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return IsolationForest(
            c["name"].tolist(), c["mean"].tolist(), c["std"].tolist(), nodes, int(c["sample_size"][0]), float(c["offset"][0])
        )


def fit_isolation_forest(
    benign: DataFrame,
    row_id: str,
    columns: list[str] = dims.FEATURES,
    trees: int = 200,
    sample_size: int = 256,
    contamination: float = 0.05,
    seed: int = 42,
) -> IsolationForest:
    """Each tree sees ``sample_size`` rows, drawn by a seeded hash; one task grows one tree."""
    stats = benign.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    n = stats["n"]
    means = [float(stats[f"m_{c}"] or 0.0) for c in columns]
    stds = [float(stats[f"s_{c}"] or 0.0) or 1.0 for c in columns]
    sample_size = min(sample_size, n)
    # Twice as many draws as needed; a row goes to ``copies`` different trees if rows are few.
    want = 2 * trees * sample_size
    copies = min(trees, max(1, -(-want // n)))
    picked = benign.withColumn("_mix", F.xxhash64(F.lit(seed), F.col(row_id)))
    if want < n:
        picked = picked.where(F.pmod(F.col("_mix"), F.lit(1 << 30)) < int(want / n * (1 << 30)) + 1)
    spread = picked.withColumn(
        "tree",
        F.explode(
            F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: F.pmod(F.pmod("_mix", F.lit(trees)) + i, F.lit(trees)).cast("int"))
        ),
    )
    # Rows here are already reduced to about 2 * sample_size per tree.
    place = F.row_number().over(W.partitionBy("tree").orderBy(F.xxhash64("_mix", "tree"), row_id))
    sampled = spread.withColumn("_place", place).where(F.col("_place") <= sample_size).select(
        "tree", *[((F.col(c) - m) / s).alias(c) for c, m, s in zip(columns, means, stds)]
    )
    depth = int(np.ceil(np.log2(max(sample_size, 2))))
    nodes = sampled.groupBy("tree").applyInPandas(_grow(list(columns), depth, seed), _NODES).toPandas()
    forest = IsolationForest(list(columns), means, stds, nodes.sort_values(["tree", "node"]), sample_size)
    cut = quantiles_of(value_spans(forest.raw(benign, "raw").select("raw"), ["raw"]), [contamination]).first()
    forest.offset = float(cut["value"])
    return forest
