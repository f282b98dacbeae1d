"""Streams over several micro-batches against the batch result."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkfold.streaming import forms, ordered

START = datetime(2024, 1, 1, 10)
SCHEMA = "event_id bigint, ts timestamp, name string, value double, tag bigint"


@pytest.fixture
def feed(spark, tmp_path):
    """Three files, read one per batch; times go back by up to half an hour from file to file."""
    rows = [(k, START + timedelta(minutes=(k * 37) % 60 + 30 * (k // 40)), "ab"[k % 2], float(k % 7), k % 3) for k in range(120)]
    for n in range(3):
        spark.createDataFrame(rows[40 * n : 40 * n + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return stream, spark.createDataFrame(rows, SCHEMA), tmp_path


def test_open_windows_are_there_and_once(spark, feed):
    stream, whole, folder = feed
    shape = forms.histogram(stream, "20 minutes", "2 hours")
    query = forms.write_latest(shape, f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    got = forms.read_latest(spark, shape.schema, f"{folder}/out", ["start", "name"])
    want = whole.groupBy(F.window("ts", "20 minutes").alias("w"), "name").agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max")).select("w.start", "name", "n", "sum", "min", "max")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    raw = spark.read.parquet(f"{folder}/out")
    assert raw.count() > got.count()  # windows were changed by more than one batch


def test_a_batch_that_runs_again_changes_nothing(spark, feed):
    stream, _, folder = feed
    shape = forms.histogram(stream, "20 minutes", "2 hours")
    forms.write_latest(shape, f"{folder}/out", f"{folder}/state").awaitTermination()
    before = sorted(map(tuple, forms.read_latest(spark, shape.schema, f"{folder}/out", ["start", "name"]).collect()))
    forms.write_latest(shape, f"{folder}/out", f"{folder}/again").awaitTermination()  # the same batch ids anew
    assert sorted(map(tuple, forms.read_latest(spark, shape.schema, f"{folder}/out", ["start", "name"]).collect())) == before


@pytest.fixture
def store(spark):
    old = {k: spark.conf.get(k) for k in ordered.STORE}
    for k, v in ordered.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def run(stream, folder):
    """All rows and the last state sizes of a stream drained batch by batch."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out").collect(), states


def shuffled(spark, folder, rows, files):
    """``rows`` dealt to files so that times go back from file to file, and a last row of its own key that moves the watermark on."""
    for n in range(files):
        spark.createDataFrame(rows[n::files] if n % 2 else rows[n::files][::-1], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    spark.createDataFrame([(-1, START + timedelta(days=3), "end", 0.0, 0)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


ROWS = [(k, START + timedelta(seconds=97 * k % 7200), "ab"[k % 2], float(k % 11), k % 3) for k in range(160)]


def test_running_totals_follow_event_order(spark, store, tmp_path):
    out, states = run(ordered.counter(shuffled(spark, tmp_path, ROWS, 4), "3 hours"), tmp_path)
    want, totals = set(), {}
    for n, _, name, value, tag in sorted(ROWS, key=lambda r: (r[1], r[0])):
        totals[name, tag] = totals.get((name, tag), 0.0) + value
        want.add((n, name, tag, totals[name, tag]))
    assert {tuple(r) for r in out if r["name"] != "end"} == want and len(out) - len(want) <= 1


def test_cooldown_follows_event_order_and_forgets(spark, store, tmp_path):
    alerts = shuffled(spark, tmp_path, ROWS, 4).select("event_id", "ts", F.col("name").alias("rule"))
    out, states = run(ordered.cooldown(alerts, 300, "3 hours"), tmp_path)
    want, fired = set(), {}
    for n, ts, name, _, _ in sorted(ROWS, key=lambda r: (r[1], r[0])):
        if name not in fired or (ts - fired[name]).total_seconds() > 300:
            fired[name] = ts
            want.add((n, name))
    assert {tuple(r) for r in out if r["rule"] != "end"} == want
    assert max(states) >= len(ROWS) and states[-1] <= 4  # what is left is the row that moved the watermark


def test_idle_totals_start_anew(spark, store, tmp_path):
    rows = [(1, START, "a", 1.0, 0), (2, START + timedelta(minutes=5), "a", 2.0, 0), (3, START + timedelta(hours=2), "a", 4.0, 0)]
    out, states = run(ordered.counter(shuffled(spark, tmp_path, rows, 1), "10 minutes", idle_seconds=3600), tmp_path)
    assert {(r["event_id"], r["total"]) for r in out if r["name"] == "a"} == {(1, 1.0), (2, 3.0), (3, 4.0)}
    assert states[-1] <= 4


def test_totals_of_a_key_larger_than_an_arrow_batch(spark, tmp_path):
    n = 25_000
    points = spark.range(n).select((F.col("id") * 7919 % n).alias("event_id"), F.lit("a").alias("name"), F.lit(1.0).alias("value"), F.lit(0).cast("bigint").alias("tag"))
    points.withColumn("ts", F.timestamp_seconds("event_id")).select("event_id", "ts", "name", "value", "tag").coalesce(1).write.parquet(f"{tmp_path}/in")
    out, _ = run(forms.counter(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), tmp_path)
    assert len(out) == n and all(r["total"] == r["event_id"] + 1 for r in out)
