"""Ordered computations that stay balanced when one key holds most rows.

``Window.partitionBy(key)`` puts a whole key into one task.  Here the rows are
range-partitioned on (key, order) instead, so the cuts between tasks fall wherever
the volume is, inside a hot key too.  Running values are computed per chunk, and the
few values that cross a cut come from a carry table with at most two rows per chunk
(its size is bounded by the number of partitions, whatever the data).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowsentry.plans.storage import materialize

# monotonically_increasing_id: partition number above bit 33, row number below it.
_ROW_BITS = 33


@dataclass
class Ordered:
    """Rows sorted by keys + order over the cluster, with ``_key``, ``_chunk``, ``_pos``, ``_head``."""

    rows: DataFrame
    keys: list[str]

    @property
    def crossing(self) -> DataFrame:
        """Rows of the keys that cross a cut.

        Only the first key of a chunk can continue from before, so the heads (one row
        per chunk) name them all.  Derived columns are added after this filter, so the
        other keys are not windowed twice.
        """
        heads = self.rows.where("_head").select(*self.keys).distinct()
        return self.rows.join(F.broadcast(heads), self.keys, "left_semi")

    def totals(self, crossing: DataFrame, totals: list[Column]) -> DataFrame:
        """Totals per (chunk, crossing key): at most two rows per chunk."""
        return crossing.groupBy("_chunk", *self.keys).agg(*totals)

    @property
    def earlier(self):
        """Window over the carry rows of a key: all chunks before this one."""
        return W.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)

    @property
    def inside(self):
        """Window inside a chunk: the rows of the key in order."""
        return W.partitionBy("_key", "_chunk", *self.keys).orderBy("_pos")

    @property
    def upto(self):
        """Window inside a chunk: rows of the key up to and including this one."""
        return self.inside.rowsBetween(W.unboundedPreceding, 0)

    def join_carry(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        return df.join(F.broadcast(carry), ["_chunk", *self.keys], "left")

    def running(self, sums: dict[str, str]) -> DataFrame:
        """``rows`` with running sums per key, up to and including each row."""
        local = self.rows.withColumns({n: F.sum(c).over(self.upto) for n, c in sums.items()})
        per_chunk = self.totals(self.crossing, [F.sum(c).alias(n) for n, c in sums.items()])
        carry = per_chunk.select(
            "_chunk", *self.keys, *[F.coalesce(F.sum(n).over(self.earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
        )
        added = {n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums}
        return self.join_carry(local, carry).withColumns(added).drop(*[f"_c_{n}" for n in sums])

    def clean(self, df: DataFrame) -> DataFrame:
        return df.drop("_key", "_chunk", "_pos", "_head")


def ordered(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> Ordered:
    """Sort ``df`` by keys + order over the cluster; the keys themselves come in any order.

    Keys must not be NULL, and keys + order should identify a row.  The sorted rows
    are written out, because chunk numbers only hold for one execution.
    """
    # A hash leads the sort: one number settles most comparisons, text keys rarely do.
    df = df.withColumn("_key", F.xxhash64(*keys))
    cols = ["_key", *keys, *order]
    spread = df.repartitionByRange(chunks, *cols) if chunks else df.repartitionByRange(*cols)
    place = F.monotonically_increasing_id()
    rows = materialize(
        spread.sortWithinPartitions(*cols)
        .withColumn("_pos", place)
        .withColumn("_chunk", F.shiftright("_pos", _ROW_BITS).cast("int"))
        .withColumn("_head", F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) == 0)
    )
    return Ordered(rows, keys)


def sliding_counts(
    rows: DataFrame,
    key: str | list[str],
    time: str,
    tie: str,
    counts: dict[str, tuple[Column, int]],
    extra: DataFrame | None = None,
    extra_counts: list[str] = (),
    chunks: int | None = None,
) -> DataFrame:
    """Per row: weight of rows of its key in [time - width, time], itself included.

    Rows at the same time are seen in ``tie`` order.  Each counted row adds its
    weight when it arrives and takes it back just after ``time + width``; the count
    is the running sum of those changes.  That is linear in the rows, where a
    sliding RANGE frame re-reads the frame for every row.  ``extra`` may bring
    further change rows (key, time, _phase, tie, <extra_counts>).

    Phases at one instant: 0 and 1 arrivals, in tie order; 2 departures.
    """
    keys = [key] if isinstance(key, str) else list(key)
    names = [*counts, *extra_counts]
    deltas = {n: c.cast("long") for n, (c, _) in counts.items()} | {n: F.lit(0).cast("long") for n in extra_counts}
    base = rows.withColumns({f"_d_{n}": d for n, d in deltas.items()}).withColumn("_phase", F.lit(1))
    union = base
    for name, (_, width) in counts.items():
        union = union.unionByName(
            base.where(F.col(f"_d_{name}") != 0).select(
                *keys,
                (F.col(time) + F.lit(width)).alias(time),
                F.col(tie),
                F.lit(2).alias("_phase"),
                (-F.col(f"_d_{name}")).alias(f"_d_{name}"),
            ),
            allowMissingColumns=True,
        )
    if extra is not None:
        union = union.unionByName(
            extra.withColumnsRenamed({n: f"_d_{n}" for n in extra_counts}), allowMissingColumns=True
        )
    cut = ordered(
        union.withColumn("_late", (F.col("_phase") == 2).cast("int")), keys, [time, "_late", tie, "_phase"], chunks
    )
    counted = cut.running({n: f"_d_{n}" for n in names}).where("_phase = 1")
    return cut.clean(counted).drop("_phase", "_late", *[f"_d_{n}" for n in names])


def value_spans(df: DataFrame, columns: list[str], chunks: int | None = None) -> DataFrame:
    """Distinct values per column with the ranks they cover: (feature, v, n, lo, hi), lo <= rank < hi.

    Equal values are combined before the shuffle; no value list is ever collected.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    values = (
        df.select(F.inline(cells)).where("v is not null and not isnan(v)").groupBy("feature", "v")
        .agg(F.count("*").alias("n"))
    )
    cut = ordered(values, ["feature"], ["v"], chunks)
    return cut.clean(cut.running({"hi": "n"})).withColumn("lo", F.col("hi") - F.col("n"))


def quantiles_of(spans: DataFrame, probs: list[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value_spans``: (feature, p, value)."""
    wanted = (  # one row per column name and probability
        spans.groupBy("feature").agg(F.sum("n").alias("total"))
        .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("at", F.col("p") * (F.col("total") - 1))
        .withColumn("below", F.floor("at"))
        .withColumn("above", F.least(F.col("below") + 1, F.col("total") - 1))
    )
    hit = spans.join(F.broadcast(wanted), "feature").where(
        "(below >= lo and below < hi) or (above >= lo and above < hi)"
    )
    ends = hit.groupBy("feature", "p", "at", "below").agg(F.min("v").alias("v0"), F.max("v").alias("v1"))
    return ends.select(
        "feature", "p", (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.col("below"))).alias("value")
    )


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", chunks: int | None = None) -> DataFrame:
    """Row number per key without putting a key into one task."""
    cut = ordered(df.withColumn("_one", F.lit(1)), keys, order, chunks)
    return cut.clean(cut.running({name: "_one"})).drop("_one")
