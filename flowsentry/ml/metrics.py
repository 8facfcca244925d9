"""Quality of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsentry.plans.ordered import ordered

NAMES = {0: "BENIGN", 1: "ATTACK"}


def classification_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1, support per class; accuracy; macro and weighted averages.

    The table is reduced to its confusion counts first (at most four rows).
    """
    cells = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    n = F.col("n")

    def cell(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    counts = cells.agg(
        *[cell((F.col("y") == c) & (F.col("p") == c)).alias(f"tp{c}") for c in NAMES],
        *[cell(F.col("p") == c).alias(f"pred{c}") for c in NAMES],
        *[cell(F.col("y") == c).alias(f"true{c}") for c in NAMES],
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    scores = {}
    for c in NAMES:
        tp, pred, true = F.col(f"tp{c}"), F.col(f"pred{c}"), F.col(f"true{c}")
        scores[c] = (ratio(tp, pred), ratio(tp, true), ratio(2 * tp, pred + true), true)
    total = F.col("true0") + F.col("true1")

    def row(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("name"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
            support.alias("support"),
        )

    def mean(i, weights):
        return sum((scores[c][i] * weights[c] for c in NAMES), F.lit(0.0))

    macro = {c: F.lit(0.5) for c in NAMES}
    weighted = {c: ratio(scores[c][3], total) for c in NAMES}
    accuracy = ratio(F.col("tp0") + F.col("tp1"), total)
    none = F.lit(None).cast("double")
    return counts.select(
        F.inline(
            F.array(
                *[row(NAMES[c], *scores[c]) for c in NAMES],
                row("accuracy", none, none, accuracy, total),
                row("macro avg", *[mean(i, macro) for i in range(3)], total),
                row("weighted avg", *[mean(i, weighted) for i in range(3)], total),
            )
        )
    )


def model_performance(report: DataFrame, model_name: str) -> DataFrame:
    """Row for the model_performance table from a report; the false positive rate is what benign recall lacks."""

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col(column)))

    return report.agg(
        F.lit(model_name).alias("model_name"),
        of("ATTACK", "precision").alias("precision_val"),
        of("ATTACK", "recall").alias("recall_val"),
        of("ATTACK", "f1").alias("f1_score"),
        (1 - of("BENIGN", "recall")).alias("false_pos_rate"),
        of("accuracy", "support").alias("total_scored"),
    )


def roc_auc(df: DataFrame, scores: list[str], label: str = "label", chunks: int | None = None) -> DataFrame:
    """Area under the ROC curve per score column, ties counted half.

    Rows are combined per distinct score before the sort.
    """
    cells = F.array(*[F.struct(F.lit(s).alias("model"), F.coalesce(s, F.lit(0.0)).alias("score")) for s in scores])
    points = (
        df.select(label, F.inline(cells))
        .groupBy("model", "score")
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    cut = ordered(points, ["model"], ["score"], chunks)
    below = cut.running({"neg_upto": "neg"})
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return below.groupBy("model").agg((won / (F.sum("pos") * F.sum("neg"))).alias("auc"))
