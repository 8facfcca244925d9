"""Training run and end-to-end scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsentry import dims
from flowsentry.functions.net import lookup
from flowsentry.ml.autoencoder import Autoencoder, fit_autoencoder
from flowsentry.ml.ensemble import ensemble_vote
from flowsentry.ml.isolation_forest import IsolationForest, fit_isolation_forest
from flowsentry.ml.metrics import classification_report, roc_auc
from flowsentry.ml.random_forest import fit_random_forest, forest_scores, once_each
from flowsentry.ml.split import stratified_split
from flowsentry.operators.features import feature_columns
from flowsentry.plans.storage import materialize


@dataclass
class Models:
    """Any of the three may be missing; it then scores NULL and does not vote."""

    isolation_forest: IsolationForest | None = None
    random_forest: PipelineModel | None = None
    autoencoder: Autoencoder | None = None

    def score(self, features: DataFrame) -> DataFrame:
        """``features`` with three scores. With a forest, rows of equal features are scored once, by all models; rows of a stream as they come."""
        if self.random_forest and not features.isStreaming:
            return once_each(features, self._columns(), self._scored)
        return self._scored(features)

    def _columns(self) -> list[str]:
        read = [*self.random_forest.stages[0].getInputCols()]
        for model in (self.isolation_forest, self.autoencoder):
            read += model.columns if model else []
        return list(dict.fromkeys(read))

    def _scored(self, features: DataFrame) -> DataFrame:
        none = F.lit(None).cast("double")
        out = self.isolation_forest.score(features) if self.isolation_forest else features.withColumn("if_score", none)
        out = forest_scores(self.random_forest, out) if self.random_forest else out.withColumn("rf_score", none)
        return self.autoencoder.score(out) if self.autoencoder else out.withColumn("ae_score", none)

    def save(self, spark: SparkSession, path: str) -> None:
        if self.isolation_forest:
            self.isolation_forest.save(spark, f"{path}/isolation_forest")
        if self.random_forest:
            self.random_forest.write().overwrite().save(f"{path}/random_forest")
        if self.autoencoder:
            self.autoencoder.save(spark, f"{path}/autoencoder")

    @staticmethod
    def load(spark: SparkSession, path: str) -> tuple[Models, list[str]]:
        """The models that could be read, and the names of those that could not."""
        loaders = {
            "isolation_forest": lambda p: IsolationForest.load(spark, p),
            "random_forest": PipelineModel.load,
            "autoencoder": lambda p: Autoencoder.load(spark, p),
        }
        found, missing = {}, []
        for name, load in loaders.items():
            try:
                found[name] = load(f"{path}/{name}")
            except Exception:  # a missing or unreadable model must not stop the others
                missing.append(name)
        return Models(**found), missing


def train(
    features: DataFrame,
    row_id: str,
    label: str = "binary_label",
    trees: int = 200,
    rf_trees: int = 300,
    rf_depth: int = 30,
    epochs: int = 50,
    seed: int = 42,
) -> tuple[Models, DataFrame]:
    """Split, fit the three models, and return them with the scored test rows."""
    fit_rows, test_rows = stratified_split(features, label, row_id, seed=seed)
    fit_rows = materialize(fit_rows)
    benign = materialize(fit_rows.where(F.col(label) == 0))
    models = Models(
        fit_isolation_forest(benign, row_id, trees=trees, seed=seed),
        fit_random_forest(fit_rows, label, trees=rf_trees, max_depth=rf_depth, seed=seed),
        fit_autoencoder(benign, epochs=epochs, seed=seed),
    )
    return models, models.score(test_rows)


def evaluate(scored: DataFrame, label: str = "binary_label") -> DataFrame:
    """Classification report and ROC-AUC of each model and of the ensemble (by its confidence)."""
    voted = ensemble_vote(scored)
    out = None
    for model in [*dims.MODEL_WEIGHTS, "ensemble"]:
        hit = F.col("predicted") == 1 if model == "ensemble" else F.col(f"{model}_score") >= dims.VOTE_THRESHOLDS[model]
        rows = voted.select(F.col(label).alias("y"), F.coalesce(hit, F.lit(False)).cast("int").alias("p"))
        report = classification_report(rows, "y", "p").withColumn("model", F.lit(model))
        out = report if out is None else out.unionByName(report)
    scores = {f"{m}_score": m for m in dims.MODEL_WEIGHTS} | {"confidence": "ensemble"}
    areas = roc_auc(voted, list(scores), label).withColumn("model", lookup(F.col("model"), scores))
    return out.join(areas, "model", "left")


def score_flows(flows: DataFrame, models: Models) -> DataFrame:
    """Flows with features (as JSON), the three scores, votes, label and confidence."""
    made = {f"f_{n}": c.cast("float") for n, c in feature_columns().items()}
    vector = F.to_json(F.struct(*[F.col(f"f_{n}").alias(n) for n in dims.FEATURES]))
    wide = flows.withColumns(made).withColumn("raw_features", vector)
    # The models read features by name; flow columns of the same name step aside meanwhile.
    held = {c: f"flow_{c}" for c in flows.columns if c in dims.FEATURES}
    ready = wide.withColumnsRenamed(held).withColumnsRenamed({f"f_{n}": n for n in dims.FEATURES})
    scored = ensemble_vote(models.score(ready)).drop(*dims.FEATURES)
    return scored.withColumnsRenamed({h: c for c, h in held.items()})
