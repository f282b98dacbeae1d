"""Streaming forms run over all of ``events`` with what is there, each checked by the batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as batch
from ..stored import shared_folder
from ..streaming import forms
from .derived import METRICS
from .metrics import QUERIES as BATCH
from .metrics import RULES, SECONDS


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as a stream of points; the file is found by its name inside the data folder."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), "value", (F.col("user_id") % 10).alias("tag"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _drained(df: DataFrame) -> DataFrame:
    """Run the stream over what is there, append its rows to Parquet, and read them."""
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    writer = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _upserted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Run the stream over what is there and read the last state of every key, open windows included."""
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    forms.write_latest(df, f"{folder}/out", f"{folder}/state").awaitTermination()
    return forms.read_latest(spark, df.schema, f"{folder}/out", keys)


def dedup(spark, d):
    return _drained(forms.dedup(_stream(spark, d), ["name", "tag"], "1000 days").select("name", "tag"))


def metric_log(spark, d):
    folder = _folder(spark)
    forms.write_metric_log(_stream(spark, d), f"{folder}/out", f"{folder}/state").awaitTermination()
    return forms.read_metric_log(spark, f"{folder}/out").groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("sum"))


def counter(spark, d):
    return _drained(forms.counter(_stream(spark, d))).select("event_id", "name", "tag", F.round("total", 3).alias("total"))


def histogram(spark, d):
    out = _upserted(forms.histogram(_stream(spark, d), "1 day"), ["start", "name"])
    return out.select(F.unix_micros("start").alias("start_us"), "name", "n", F.round("sum", 3).alias("sum"), "min", "max")


def cooldown(spark, d):
    return _drained(forms.cooldown(batch.threshold_alerts(_stream(spark, d), RULES), SECONDS))


def rate_limits(spark, d):
    role = F.element_at(F.array(F.lit("anonymous"), F.lit("bot"), F.lit("user")), (F.col("tag") % 3 + 1).cast("int"))
    requests = _stream(spark, d).withColumn("key", F.col("tag")).withColumn("role", role).withColumn("ts", F.date_trunc("day", "ts"))
    out = _upserted(forms.rate_limits(requests, {"anonymous": 3, "user": 8}, 5), ["minute", "key", "role"])
    return out.select(F.unix_micros("minute").alias("minute_us"), "key", "role", "n", "allowed")


QUERIES = {
    "stream_dedup": (dedup, "SELECT DISTINCT event_type AS name, user_id % 10 AS tag FROM events"),
    "stream_metric_log": (metric_log, "SELECT event_type AS name, count(*) AS n, round(sum(value), 3) AS sum FROM events GROUP BY 1"),
    "stream_counter": (counter, BATCH["counter"][1]),
    "stream_histogram": (histogram, f"WITH {METRICS} SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS start_us, name, count(*) AS n, round(sum(value), 3) AS sum, min(value) AS min, max(value) AS max FROM metrics_ GROUP BY date_trunc('day', ts), name"),
    "stream_cooldown": (cooldown, BATCH["cooldown"][1]),
    "stream_rate_limits": (rate_limits, BATCH["rate_limit_report"][1]),
}
