"""Greedy alert throttles: duplicate suppression and rate limiting.

Both accept a row if fewer than ``limit`` rows of its key were *accepted* in the last
``window``.  That is a sequential rule, made parallel by two exact reductions:

* rows of one key and time are counted first, so only distinct times are walked;
* time is cut into buckets one window long.  If a bucket and the one before it hold
  at most ``limit`` rows, every row of the bucket is accepted whatever came earlier,
  so the walk can start fresh after it.  Only runs of busy buckets are walked, each
  with the calm bucket before it as its starting state.

A run is streamed through the walk in time order and never held in memory.  Very long
runs are walked in rounds of bounded length, so that no task grows with the run; a round
hands over only the rows accepted in its last window.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowsentry.functions.alerting import alert_fingerprint
from flowsentry.plans.storage import materialize

_TAKEN = "_key string, _run bigint, _time bigint, _take bigint"


def _walk(limit: int, window: int):
    """Greedy pass over rows sorted by key, run, time; holds only the last window."""

    def walk(batches):
        run, recent, active = None, deque(), 0
        for rows in batches:
            taken = []
            columns = (rows[c].tolist() for c in ("_key", "_run", "_time", "_n", "_given"))
            for key, start, t, n, given in zip(*columns):
                if (key, start) != run:
                    run, active = (key, start), 0
                    recent.clear()
                while recent and t - recent[0][0] >= window:
                    active -= recent.popleft()[1]
                take = n if given else min(n, limit - active)
                if take:
                    recent.append((t, take))
                    active += take
                taken.append(take)
            out = rows[["_key", "_run", "_time"]].assign(_take=taken)
            yield out[~rows["_given"].to_numpy(dtype=bool)]

    return walk


def throttle(
    alerts: DataFrame, key: Column, time: str, tie: str, limit: int, window: int, round_buckets: int = 1440
) -> DataFrame:
    """Rows accepted by the greedy rule, in (time, tie) order per key."""
    keyed = alerts.withColumns({"_key": F.coalesce(key.cast("string"), F.lit("")), "_time": F.col(time).cast("bigint")})
    times = materialize(
        keyed.groupBy("_key", "_time").agg(F.count("*").alias("_n"))
        .withColumn("_bucket", F.floor(F.col("_time") / window))
    )
    # Per key and bucket: bounded by the time range, not by the number of alerts.
    by_key = W.partitionBy("_key").orderBy("_bucket")
    buckets = times.groupBy("_key", "_bucket").agg(F.sum("_n").alias("n"))
    before = F.when(F.lag("_bucket").over(by_key) == F.col("_bucket") - 1, F.lag("n").over(by_key)).otherwise(0)
    busy = buckets.withColumn("busy", F.col("n") + before > limit)
    leads = (F.lead("_bucket").over(by_key) == F.col("_bucket") + 1) & F.lead("busy").over(by_key)
    walked = busy.withColumn("walked", F.col("busy") | F.coalesce(leads, F.lit(False))).where("walked")
    opens = F.coalesce(F.lag("_bucket").over(by_key) < F.col("_bucket") - 1, F.lit(True))
    runs = walked.select("_key", "_bucket", opens.alias("opens")).select(
        "_key",
        "_bucket",
        F.max(F.when(F.col("opens"), F.col("_bucket"))).over(by_key.rowsBetween(W.unboundedPreceding, 0)).alias("_run"),
    )
    todo = materialize(
        times.join(runs, ["_key", "_bucket"]).select(
            "_key",
            "_run",
            "_time",
            "_n",
            F.lit(False).alias("_given"),
            F.floor((F.col("_bucket") - F.col("_run")) / round_buckets).alias("_round"),
        )
    )
    last_round = todo.agg(F.max("_round")).first()[0] or 0
    walk = _walk(limit, window)
    taken, state = None, None
    for i in range(last_round + 1):
        part = todo.where(F.col("_round") == i).drop("_round")
        if state is not None:
            part = part.unionByName(state)
        runs_whole = part.repartition("_key", "_run").sortWithinPartitions("_key", "_run", "_time")
        done = runs_whole.mapInPandas(walk, _TAKEN)
        if last_round:
            done = materialize(done)
            edge = (F.col("_run") + (i + 1) * round_buckets) * window
            state = done.where((F.col("_time") > edge - window) & (F.col("_take") > 0)).select(
                "_key", "_run", "_time", F.col("_take").alias("_n"), F.lit(True).alias("_given")
            )
        taken = done if taken is None else taken.unionByName(done)
    # At most ``limit`` rows per (key, time) can pass, so the ranking is cut before its shuffle.
    place = F.row_number().over(W.partitionBy("_key", "_time").orderBy(tie))
    return (
        keyed.withColumn("_place", place)
        .where(F.col("_place") <= limit)
        .join(taken.select("_key", "_time", "_take"), ["_key", "_time"], "left")
        .where(F.col("_take").isNull() | (F.col("_place") <= F.col("_take")))
        .drop("_key", "_time", "_place", "_take")
    )


def dedup_alerts(alerts: DataFrame, time: str = "ts_s", tie: str = "id", window: int = 60) -> DataFrame:
    """Drops an alert if one with its fingerprint was kept less than ``window`` ago."""
    return throttle(alerts, alert_fingerprint(), time, tie, 1, window)


def rate_limit_alerts(
    alerts: DataFrame, limit: int = 100, window: int = 60, tenant: Column | None = None, time: str = "ts_s", tie: str = "id"
) -> DataFrame:
    """Keeps an alert if fewer than ``limit`` of its tenant were kept in the last ``window``."""
    return throttle(alerts, F.lit("all") if tenant is None else tenant, time, tie, limit, window)
