"""Labelled flow tables: cleaning and the analyst's summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowsentry import dims
from flowsentry.functions.net import lookup, port_service
from flowsentry.operators.features import flow_features
from flowsentry.plans.ordered import quantiles_of, value_spans
from flowsentry.plans.storage import materialize

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def finite(column: str) -> Column:
    """The value as a double; NULL where it is not a finite number."""
    v = F.col(column).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def clean_labelled_flows(df: DataFrame, label: str = "label", top: float = 1e9) -> DataFrame:
    """Rows with a label; infinities and gaps become 0, values are cut to [0, top]; adds binary_label."""
    cut = {
        c: F.least(F.greatest(F.coalesce(finite(c), F.lit(0.0)), F.lit(0.0)), F.lit(float(top)))
        for c in numeric_columns(df)
        if c != label
    }
    return df.where(F.col(label).isNotNull()).withColumns(
        cut | {"binary_label": (F.col(label) != dims.BENIGN).cast("int")}
    )


def labelled_features(cleaned: DataFrame, keep: list[str] = ("binary_label",)) -> DataFrame:
    """The 24 features by name; whatever a table does not carry takes the feature default."""
    have = cleaned.columns

    def sum_of(a: str, b: str) -> Column:
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))

    made = {
        "total_packets": lambda: sum_of("fwd_packets", "bwd_packets"),
        "total_bytes": lambda: sum_of("fwd_bytes", "bwd_bytes"),
        "byte_rate": lambda: F.col("flow_bytes_s") if "flow_bytes_s" in have else F.lit(None).cast("double"),
        "pkt_rate": lambda: F.col("flow_packets_s") if "flow_packets_s" in have else F.lit(None).cast("double"),
        "duration_ms": lambda: F.lit(None).cast("double"),
        "src_port": lambda: F.lit(None).cast("int"),
        **{c: lambda: F.lit(None).cast("boolean") for c in ("has_syn", "has_fin", "has_rst")},
    }
    full = cleaned.withColumns({n: f() for n, f in made.items() if n not in have})
    return flow_features(full, list(keep))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label, and benign / attack totals, with their share of all rows.

    Rows without a label count as attacks in the totals, as everything not benign does.
    """
    counts = df.groupBy(F.col(label).alias("name")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("name") == dims.BENIGN, "Benign").otherwise("Attacks")
    rows = counts.select(
        F.inline(
            F.array(
                F.struct(F.lit("label").alias("section"), F.col("name"), F.col("n")),
                F.struct(F.lit("total").alias("section"), kind.alias("name"), F.col("n")),
                F.struct(F.lit("all").alias("section"), F.lit("").alias("name"), F.col("n")),
            )
        )
    )
    summed = rows.where("name is not null").groupBy("section", "name").agg(F.sum("n").alias("n"))
    everything = summed.where("section = 'all'").select(F.col("n").alias("total"), F.lit(1).alias("one"))
    # A single row, looked up by a constant.
    return (
        summed.where("section <> 'all'").withColumn("one", F.lit(1))
        .join(F.broadcast(everything), "one")
        .select("section", "name", "n", (F.col("n") / F.col("total")).alias("rate"))
    )


def feature_spread(df: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` numeric columns with the largest standard deviation.

    Gaps are skipped; a column with an infinite value has no deviation and drops out.
    """
    names = numeric_columns(df)
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in names}
    one = df.agg(*[F.stddev_samp(v).alias(c) for c, v in value.items()])
    spread = one.unpivot([], names, "feature", "std").where("std is not null and not isnan(std)")
    return spread.orderBy(F.col("std").desc(), "feature").limit(k)


def trimmed_box_stats(df: DataFrame, columns: list[str] | None = None, cut: float = 0.99, chunks: int | None = None) -> DataFrame:
    """Box-plot numbers per column over its finite values strictly below the ``cut`` quantile.

    One sort of the distinct values serves both the cut and the box: below the cut the
    ranks stay what they are.
    """
    columns = columns or numeric_columns(df)
    spans = materialize(value_spans(df.select(*[finite(c).alias(c) for c in columns]), columns, chunks))
    top = quantiles_of(spans, [cut]).select("feature", F.col("value").alias("top"))  # one row per column
    kept = spans.join(F.broadcast(top), "feature").where("v < top").drop("top")
    names = {0.0: "low", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "high"}
    q = quantiles_of(kept, list(names))
    sizes = kept.groupBy("feature").agg(F.sum("n").alias("n"))
    box = q.groupBy("feature").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in names.items()])
    return sizes.join(box, "feature")


def _attacks(df: DataFrame, label: str | None) -> DataFrame:
    return df if label is None else df.where(F.coalesce(F.col(label) != dims.BENIGN, F.lit(True)))


def top_attack_sources(df: DataFrame, k: int = 10, column: str = "src_ip", label: str | None = "label") -> DataFrame:
    counts = _attacks(df, label).where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), column).limit(k)


def top_attack_ports(df: DataFrame, k: int = 15, column: str = "dst_port", label: str | None = "label") -> DataFrame:
    port = F.col(column)
    counts = _attacks(df, label).where(port.isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), column).limit(k).withColumns(
        {
            "label": F.concat(F.lit(":"), port.cast("string"), F.lit(" ("), port_service(port), F.lit(")")),
            "watch": F.when(port.isin(*dims.CAPTURE_BAD_PORTS), "bad").when(
                port.isin(*dims.CAPTURE_SENSITIVE_PORTS), "sensitive"
            ).otherwise(""),
        }
    )


def top_protocols(df: DataFrame, k: int = 8, column: str = "protocol") -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    text = F.col(column).cast("string")
    return counts.orderBy(F.col("n").desc(), column).limit(k).withColumn(
        "name", lookup(text, {str(p): n for p, n in dims.PROTOCOLS.items()}, text)
    )
