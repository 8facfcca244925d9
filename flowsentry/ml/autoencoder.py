"""Autoencoder trained data-parallel: one Spark job per epoch.

Rows are dealt once to shards of a fixed size, by their place in the order of a hash, and a shard is stored as one row. In an epoch every
shard runs mini-batch Adam from the shared weights and moments; both are then averaged by row count. The parts of
the average are summed as whole numbers, so neither the partitions nor the order of tasks change the model. A task
holds one shard and the (fixed-size) network, and the driver sees three numbers per weight.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsentry import dims
from flowsentry.ml.ensemble import calibrate, calibrated_score
from flowsentry.plans.ordered import ranked
from flowsentry.plans.storage import materialize

# Layer widths after the input; layers marked True are followed by ReLU, True/True by batch norm too.
_HIDDEN = [(64, True, True), (32, True, True), (8, True, False), (32, True, True), (64, True, True)]
_DECAY, _EPS = 0.9, 1e-5
#: Rows that are scored at once; their arrays stay in a core's cache.
_SCORED = 512


def _layers(inputs: int):
    return [*_HIDDEN, (inputs, False, False)]


def init_weights(inputs: int, seed: int) -> list[np.ndarray]:
    """Per layer: matrix, bias, and for batch norm scale, shift, running mean, running variance."""
    rng, out, width = np.random.default_rng(seed), [], inputs
    for size, _, norm in _layers(inputs):
        bound = 1 / np.sqrt(width)
        out += [rng.uniform(-bound, bound, (width, size)), rng.uniform(-bound, bound, size)]
        if norm:
            out += [np.ones(size), np.zeros(size), np.zeros(size), np.ones(size)]
        width = size
    return out


class _Room:
    """Arrays that steps are computed in, zero at first; kept between steps, so none of them asks for memory."""

    def __init__(self):
        self.held = {}

    def __call__(self, name, rows: int, size: int, kind=float) -> np.ndarray:
        had = self.held.get(name)
        if had is None or len(had) < rows:
            had = self.held[name] = np.zeros((rows, size), kind)
        return had[:rows]


def _mean(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij->j", x) / len(x)


def _forward(w: list[np.ndarray], x: np.ndarray, train: bool, room: _Room | None = None):
    """Output and what the backward pass needs; both lie in ``room``. In training, running means and variances of ``w`` are moved."""
    room, n, seen, at = room or _Room(), len(x), [], 0
    for size, relu, norm in _layers(x.shape[1]):
        given, x = x, np.matmul(x, w[at], out=room(("out", at), n, size))
        x += w[at + 1]
        on = None
        if relu:
            on = np.greater(x, 0, out=room(("on", at), n, size, bool)) if train else None
            np.maximum(x, room(("zero", size), n, size), out=x)
        hat = std = None
        if norm:
            mean, var = w[at + 4], w[at + 5]
            if train:
                mean = _mean(x)
            hat = np.subtract(x, mean, out=room(("hat", at), n, size))
            if train:
                var = _mean(np.multiply(hat, hat, out=x))
                w[at + 4][:], w[at + 5][:] = _DECAY * w[at + 4] + (1 - _DECAY) * mean, _DECAY * w[at + 5] + (1 - _DECAY) * var
            std = np.sqrt(var + _EPS)
            hat /= std
            np.multiply(w[at + 2], hat, out=x)
            x += w[at + 3]
        seen.append((at, given, on, hat, std))
        at += 6 if norm else 2
    return x, seen


def _gradients(w: list[np.ndarray], x: np.ndarray, room: _Room | None = None, found: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Gradients in the order of ``w``, put into ``found`` if it is given; those of running means and variances stay as they are, 0 at first."""
    room, n, found = room or _Room(), len(x), found or [np.zeros_like(a) for a in w]
    out, seen = _forward(w, x, True, room)
    grad = np.subtract(out, x, out=room("grad", n, x.shape[1]))
    grad *= 2
    grad /= x.size
    for at, given, on, hat, std in reversed(seen):
        if hat is not None:
            part = np.multiply(grad, hat, out=room(("part", at), n, hat.shape[1]))
            np.einsum("ij->j", part, out=found[at + 2])
            np.einsum("ij->j", grad, out=found[at + 3])
            grad *= w[at + 2]
            shift, along = _mean(grad), _mean(np.multiply(grad, hat, out=part))
            grad -= shift
            grad -= np.multiply(hat, along, out=part)
            grad /= std
        if on is not None:
            grad *= on
        np.matmul(given.T, grad, out=found[at])
        np.einsum("ij->j", grad, out=found[at + 1])
        if at:
            grad = np.matmul(grad, w[at].T, out=room(("grad", at), n, given.shape[1]))
    return found


#: Whole numbers to one: of weights, and of first moments and roots of second ones, which are smaller.
_WEIGHT_STEPS, _MOMENT_STEPS = 2.0**40, 2.0**50


def _epoch(weights, moments, roots, total: int, first_step: int, rate: float, batch: int, seed: tuple[int, int]):
    """Sums over a task's shards of their parts of the average, as whole numbers: (i, q)."""

    start = [np.concatenate([a.ravel() for a in arrays]) for arrays in (weights, moments, roots)]
    ends = np.cumsum([a.size for a in weights])[:-1]
    room = _Room()

    def like_weights(flat: np.ndarray) -> list[np.ndarray]:
        return [p.reshape(a.shape) for p, a in zip(np.split(flat, ends), weights)]

    def trained(shard: int, x: np.ndarray) -> np.ndarray:
        w, m, v = start[0].copy(), start[1].copy(), start[2] * start[2]
        g, move, root = np.zeros_like(w), np.empty_like(w), np.empty_like(w)
        layers, found = like_weights(w), like_weights(g)
        step = first_step
        x = x[np.random.default_rng((*seed, shard)).permutation(len(x))]
        for part in np.array_split(x, max(1, len(x) // batch)):
            if len(part) < 2:
                continue
            step += 1
            _gradients(layers, part, room, found)
            m *= 0.9
            m += np.multiply(0.1, g, out=move)
            v *= 0.999
            np.multiply(0.001, g, out=move)
            move *= g
            v += move
            np.divide(m, 1 - 0.9**step, out=move)
            move *= rate
            np.sqrt(np.divide(v, 1 - 0.999**step, out=root), out=root)
            root += 1e-8
            move /= root
            w -= move
        share = len(x) / total
        steps = zip((w, m, np.sqrt(v)), (_WEIGHT_STEPS, _MOMENT_STEPS, _MOMENT_STEPS))
        return np.concatenate([np.rint(np.clip(f * share * k, -(2.0**62), 2.0**62)) for f, k in steps]).astype("i8")

    def run(frames):
        found = None
        for frame in frames:
            for shard, rows, data in zip(frame["shard"], frame["rows"], frame["data"]):
                part = trained(int(shard), np.frombuffer(data).reshape(rows, -1))
                found = part if found is None else found + part
        if found is not None:
            yield pd.DataFrame({"i": np.arange(len(found)), "q": found})

    return run


def _stored_shards(rows: DataFrame, columns: list[str], means: np.ndarray, stds: np.ndarray, size: int) -> tuple[DataFrame, int]:
    """(shard, rows, data) of standardised rows, stored, and how many rows there are. Equal rows spread over the shards."""
    keyed = rows.withColumn("all", F.lit(0)).withColumn("key", F.xxhash64(*columns))
    placed = ranked(keyed, ["all"], ["key", *columns], "place")
    total = rows.count()
    shards = max(1, -(-total // size))

    def pack(frames):
        held, at = [], None
        for frame in frames:
            for shard, part in frame.groupby("shard", sort=True):
                if shard != at and held:
                    yield block(at, held)
                    held = []
                at = shard
                held.append((part[columns].to_numpy(float) - means) / stds)
        if held:
            yield block(at, held)

    def block(shard, parts) -> pd.DataFrame:
        x = np.concatenate(parts)
        return pd.DataFrame({"shard": [shard], "rows": [len(x)], "data": [x.tobytes()]})

    dealt = placed.select(F.pmod(F.col("place"), F.lit(shards)).cast("bigint").alias("shard"), "place", *columns)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = min(shards, cores * -(-shards // (8 * cores)))  # of like size, up to 8 shards each
    packed = dealt.repartitionById(files, F.pmod("shard", F.lit(files)).cast("int")).sortWithinPartitions("shard", "place").mapInPandas(pack, "shard bigint, rows bigint, data binary")
    return materialize(packed), total


@dataclass
class Autoencoder:
    columns: list[str]
    means: list[float]
    stds: list[float]
    weights: list[np.ndarray] = field(repr=False)
    error_mean: float = 0.0
    error_std: float = 1.0
    threshold: float = 0.5

    def errors(self, df: DataFrame, name: str) -> DataFrame:
        weights, means, stds = self.weights, np.array(self.means), np.array(self.stds)

        room = _Room()

        def error(*columns: pd.Series) -> pd.Series:
            x = (np.column_stack([c.to_numpy(float) for c in columns]) - means) / stds
            parts = [x[i : i + _SCORED] for i in range(0, len(x), _SCORED)]
            return pd.Series(np.concatenate([((_forward(weights, p, False, room)[0] - p) ** 2).mean(1) for p in parts]) if parts else [], dtype=float)

        return df.withColumn(name, F.pandas_udf(error, "double")(*[F.col(c).cast("double") for c in self.columns]))

    def score(self, df: DataFrame, name: str = "ae_score") -> DataFrame:
        return (
            self.errors(df, "_error")
            .withColumn(name, calibrated_score(F.col("_error"), self.error_mean, self.error_std))
            .drop("_error")
        )

    def save(self, spark: SparkSession, path: str) -> None:
        flat = [(i, j, float(x)) for i, a in enumerate(self.weights) for j, x in enumerate(a.ravel())]
        spark.createDataFrame(flat, "array int, i int, v double").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
        rows = [(c, m, s, self.error_mean, self.error_std, self.threshold) for c, m, s in zip(self.columns, self.means, self.stds)]
        schema = "name string, mean double, std double, error_mean double, error_std double, threshold double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Autoencoder:
        c = spark.read.parquet(f"{path}/columns").toPandas()
        flat = spark.read.parquet(f"{path}/weights").toPandas().sort_values(["array", "i"])
        shapes = init_weights(len(c), 0)
        weights = [g["v"].to_numpy().reshape(shapes[i].shape) for i, g in flat.groupby("array")]
        return Autoencoder(
            c["name"].tolist(), c["mean"].tolist(), c["std"].tolist(), weights,
            float(c["error_mean"][0]), float(c["error_std"][0]), float(c["threshold"][0]),
        )


def fit_autoencoder(
    benign: DataFrame,
    columns: list[str] = dims.FEATURES,
    epochs: int = 50,
    rate: float = 1e-3,
    batch: int = 256,
    seed: int = 42,
    shard_rows: int = 16_384,
) -> Autoencoder:
    """The same model for the same rows, however they are partitioned. ``shard_rows`` train one after the other, shards side by side."""
    columns = list(columns)
    rows = benign.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    known = lambda x: float(f"{x or 0.0:.10g}")  # noqa: E731  (sums of floats depend on their order in the last digits)
    means, stds = [known(stats[f"m_{c}"]) for c in columns], [known(stats[f"s_{c}"]) or 1.0 for c in columns]
    shards, total = _stored_shards(rows, columns, np.array(means), np.array(stds), shard_rows)
    weights = init_weights(len(columns), seed)
    moments, roots = [np.zeros_like(a) for a in weights], [np.zeros_like(a) for a in weights]
    ends = np.cumsum([a.size for a in weights])
    steps = max(1, -(-min(total, shard_rows) // batch))
    for epoch in range(epochs if total else 0):
        run = _epoch(weights, moments, roots, total, epoch * steps, rate, batch, (seed, epoch))
        sums = shards.mapInPandas(run, "i int, q bigint").groupBy("i").agg(F.sum("q").alias("q")).toPandas()  # three rows per weight
        flat = sums.sort_values("i")["q"].to_numpy(float).reshape(3, -1)
        weights, moments, roots = (
            [p.reshape(a.shape) for p, a in zip(np.split(f / k, ends[:-1]), weights)]
            for f, k in zip(flat, (_WEIGHT_STEPS, _MOMENT_STEPS, _MOMENT_STEPS))
        )
    model = Autoencoder(columns, means, stds, weights)
    found = calibrate(model.errors(benign, "error"), "error").first()
    model.error_mean, model.error_std, model.threshold = found["mean"], found["std"], found["threshold"]
    return model
