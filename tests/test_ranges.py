"""Ordered operators on keys that hold most rows, against folds in order."""

import random
import time

import pytest
from pyspark.sql import functions as F

from inkfold.operators import metrics, ranges

ALERTS = "rule string, event_id bigint, ts timestamp"


def alerts(spark, rows):
    df = spark.createDataFrame(rows, "rule string, event_id bigint, us bigint")
    return df.select("rule", "event_id", F.timestamp_micros("us").alias("ts")).repartition(5)


def fold(rows, seconds):
    fired, out = {}, []
    for rule, event, us in sorted(rows, key=lambda r: (r[0] or "", r[2], r[1])):
        if rule not in fired or us - fired[rule] > seconds * 1e6:
            fired[rule] = us
            out.append((rule, event))
    return sorted(out)


@pytest.mark.parametrize("seconds", [1, 4000])
def test_cooldown_of_large_rules_equals_the_fold(spark, seconds):
    rng = random.Random(seconds)
    rows, us = [], -10_000_000_000
    for k in range(400):
        us += rng.choice([0, 1, 900_000, 1_000_000, 1_000_001, 31_000_000, 30_000_000, 5_000_000_000])
        rows.append((rng.choice(["a", "a", "a", "b"]), k, us))
    df = alerts(spark, rows)
    want = fold(rows, seconds)
    assert sorted(tuple(r) for r in metrics.firing_chain(df, seconds, piece_rows=100).select("rule", "event_id").collect()) == want
    assert sorted(tuple(r) for r in metrics.cooldown(df, seconds, walk_rows=200).select("rule", "event_id").collect()) == want  # one rule each way


def test_cooldown_of_odd_rows(spark):
    rows = [("a", 1, 5), ("a", 1, 5), ("a", 2, 5), (None, 3, 5), (None, 4, 6)]
    for way in (lambda d: metrics.firing_chain(d, 1), lambda d: metrics.cooldown(d, 1)):
        assert sorted(map(str, way(alerts(spark, rows)).select("rule", "event_id").collect())) == ["Row(rule='a', event_id=1)", "Row(rule=None, event_id=3)"]
        assert way(alerts(spark, rows).limit(0)).count() == 0


def test_one_dense_rule_spreads_over_tasks(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("hot").alias("rule"), F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 250_000).alias("ts"))
    cut = ranges.pieces(df, ["rule"], ["ts", "event_id"], limit=25_000, seconds=10**9)
    sizes = [r["count"] for r in cut.groupBy("bucket").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 40_000
    fires = metrics.firing_chain(df, 600, piece_rows=50_000)
    step = 600 * 4 + 1  # the first one later than 600 s
    assert fires.count() == -(-n // step) and fires.filter(F.col("event_id") % step != 0).count() == 0


@pytest.mark.parametrize("limit", [40, 10**9])
def test_lifecycle_equals_the_fold(spark, limit):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "b"]), k, rng.randrange(200) * 1_000_000) for k in range(300)]
    back = [(rng.choice(["a", "b", "c"]), 1000 + k, rng.randrange(220) * 1_000_000) for k in range(25)]
    got = {r["event_id"]: r["u"] for r in metrics.lifecycle(alerts(spark, rows), alerts(spark, back), limit).select("event_id", F.unix_micros("resolved_ts").alias("u")).collect()}
    assert got == {e: min((u2 for r2, _, u2 in back if r2 == r and u2 >= u), default=None) for r, e, u in rows}


def test_lifecycle_of_one_rule_takes_time_in_proportion(spark):
    def seconds(n):
        df = spark.range(n).select(F.lit("hot").alias("rule"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"))
        began = time.perf_counter()
        out = metrics.lifecycle(df.filter("event_id % 50 != 0"), df.filter("event_id % 50 = 0"))
        assert out.agg(F.count_if("resolved")).first()[0] == n // 50 * 49 - 49
        return time.perf_counter() - began

    seconds(1_000)
    assert seconds(400_000) < 3 * seconds(200_000) + 1


@pytest.mark.parametrize("limit", [30, 10**9])
def test_a_burst_inside_one_hour(spark, limit):
    """Running values of one name whose points share an hour, cut by ranges and by time."""
    rng = random.Random(4)
    points = [(k, rng.randrange(50), rng.choice(["m", None]), 0, float(rng.randrange(1, 9)), rng.choice(["set", "inc", "inc", "dec"])) for k in range(400)]
    df = spark.createDataFrame(points, "event_id bigint, s bigint, name string, tag bigint, value double, op string").withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(4)
    total, level, seen, last = {}, {}, {}, {}
    want_total, want_level, want_points, want_change = {}, {}, {}, {}
    for e, _, n, _, v, op in sorted(points, key=lambda p: (p[1], p[0])):
        want_total[e] = total[n] = total.get(n, 0) + v
        level[n] = v if op == "set" else level.get(n, 0) + (v if op == "inc" else -v)
        want_level[e] = level[n]
        seen.setdefault(n, []).append(v)
        want_points[e] = {"count": len(seen[n]), "sum": sum(seen[n]), "avg": sum(seen[n]) / len(seen[n]), "min": min(seen[n]), "max": max(seen[n])}
        if n in last and abs((v - last[n]) / last[n] * 100) >= 50:
            want_change[e] = round((v - last[n]) / last[n] * 100, 6)
        last[n] = v
    assert {r["event_id"]: r["total"] for r in metrics.counter(df, limit).collect()} == want_total
    assert {r["event_id"]: r["level"] for r in metrics.gauge(df, limit).collect()} == want_level
    got = {}
    for r in metrics.histogram_points(df, limit).collect():
        got.setdefault(r["event_id"], {})[r["type"]] = r["point"]
    assert got == want_points
    assert {r["event_id"]: round(r["change"], 6) for r in metrics.change_alerts(df, 50.0, piece_rows=limit).collect()} == want_change
