import random

import pytest
from pyspark.sql import functions as F

from flowsentry.operators import alerts as al, throttle as th
from flowsentry.functions.alerting import alert_fingerprint
from tests import models


def rows(seed, n=600, hot=0.4, gaps=0.02):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += 90 + rng.randint(0, 60) if rng.random() < gaps else rng.choice([0, 0, 1, 2, 7])
        out.append(("hot" if rng.random() < hot else f"k{rng.randint(1, 9)}", t, i))
    return out


def kept(spark, data, limit, window, **kw):
    df = spark.createDataFrame(data, "k string, t bigint, id bigint")
    return {r.id for r in th.throttle(df, F.col("k"), "t", "id", limit, window, **kw).collect()}


@pytest.mark.parametrize("limit", [1, 3, 20])
@pytest.mark.parametrize("round_buckets", [1, 2, 1440])
def test_throttle_equals_greedy_loop(spark, limit, round_buckets):
    data = rows(limit * 10 + round_buckets)
    assert kept(spark, data, limit, 60, round_buckets=round_buckets) == models.throttle(data, limit, 60)


def test_throttle_without_any_pause(spark):
    data = [("hot", i // 3, i) for i in range(900)]
    assert kept(spark, data, 5, 60, round_buckets=2) == models.throttle(data, 5, 60)


@pytest.mark.parametrize("gap,n", [(59_999, 1), (60_000, 2)])
def test_window_boundary(spark, gap, n):
    assert len(kept(spark, [("a", 0, 1), ("a", gap, 2)], 1, 60_000)) == n


def test_quiet_input_needs_no_walk(spark):
    data = [("a", i * 200, i) for i in range(20)]
    assert len(kept(spark, data, 1, 60)) == 20
    assert kept(spark, [], 1, 60) == set()


ALERT = "id bigint, ts_s bigint, alert_type string, severity string, src_ip string, dst_ip string, dst_port int, description string"


def alert(i, t=0, src="1.2.3.4", text="Test alert"):
    return (i, t, "NETWORK", "HIGH", src, "5.6.7.8", 22, text)


def test_repeat_is_suppressed_and_other_source_is_not(spark):
    df = spark.createDataFrame([alert(1), alert(2, 1), alert(3, 2, "2.2.2.2")], ALERT)
    assert {r.id for r in al.admit_alerts(df).collect()} == {1, 3}


def test_rate_limit_three_of_five(spark):
    df = spark.createDataFrame([alert(i, 0, f"10.0.0.{i}", f"Alert {i}") for i in range(5)], ALERT)
    assert {r.id for r in al.admit_alerts(df, limit=3).collect()} == {0, 1, 2}


def test_duplicates_use_up_the_limit(spark):
    df = spark.createDataFrame([alert(1), alert(2), alert(3, 0, "9.9.9.9")], ALERT)
    assert {r.id for r in al.admit_alerts(df, limit=2).collect()} == {1}


def test_fingerprint_treats_null_as_empty(spark):
    df = spark.createDataFrame([alert(1, src=None), alert(2, src="")], ALERT)
    a, b = [r[0] for r in df.select(alert_fingerprint()).collect()]
    assert a == b


def test_fingerprint_reads_fifty_characters(spark):
    df = spark.createDataFrame([alert(1, text="x" * 50 + "a"), alert(2, text="x" * 50 + "b"), alert(3, text="x" * 49 + "a")], ALERT)
    a, b, c = [r[0] for r in df.orderBy("id").select(alert_fingerprint()).collect()]
    assert a == b != c
