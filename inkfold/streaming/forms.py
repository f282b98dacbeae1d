"""Streaming forms of the operators that keep live state.

Rows later than the watermark are dropped in every form.  ``ts`` has to be a
timestamp with time zone; watermarks reject others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import fixed

LATE = "1 hour"


def dedup(stream: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """First row of each key; a key is forgotten once the watermark has passed it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def write_metric_log(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """JSON lines of metric points, flushed every ten seconds unless all that is there is wanted at once."""
    writer = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


def read_metric_log(spark, path: str) -> DataFrame:
    return spark.read.schema("event_id bigint, ts timestamp, name string, value double, tag bigint").json(path)


def write_latest(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Aggregates whose windows may still be open: each batch writes the groups that it has changed.

    A batch replaces the folder of its own id, so one that is run again after a
    lost executor leaves the same files; ``read_latest`` takes the newest row of each key.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


def read_latest(spark: SparkSession, schema: StructType, path: str, keys: list[str]) -> DataFrame:
    """What ``write_latest`` has written so far: one row per key, from the last batch that changed it."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("_row"))
    return last.select(*keys, "_row.*")


def histogram(stream: DataFrame, window: str = "1 day", late: str = LATE) -> DataFrame:
    """Count, sum, minimum and maximum per name and tumbling window."""
    cut = stream.withWatermark("ts", late).groupBy(F.window("ts", window), "name")
    return cut.agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max")).select(F.col("window.start").alias("start"), "name", "n", "sum", "min", "max")


def rate_limits(stream: DataFrame, limits: dict[str, int] | None = None, other: int = fixed.DEFAULT_RATE_LIMIT, late: str = LATE) -> DataFrame:
    """Minutes in which a key made more requests than its role allows."""
    per = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "key", "role").agg(F.count("*").alias("n"))
    known = F.create_map(*[F.lit(x) for pair in (limits or fixed.RATE_LIMITS).items() for x in pair])
    return per.withColumn("allowed", F.coalesce(F.try_element_at(known, F.col("role")), F.lit(other))).filter("n > allowed").select(F.col("window.start").alias("minute"), "key", "role", "n", "allowed")


def counter(stream: DataFrame) -> DataFrame:
    """Running total of each metric and tag after every point; the state is one number per key.

    Points are in order inside a micro-batch: a task holds id, time and value of all that it brings of one key.
    """

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        rows = pd.concat([batch[["event_id", "ts", "value"]] for batch in batches]).sort_values(["ts", "event_id"])  # Arrow cuts a key into several
        totals = total + rows["value"].cumsum()
        state.update((float(totals.iloc[-1]) if len(rows) else total,))
        yield pd.DataFrame({"event_id": rows["event_id"], "name": key[0], "tag": key[1], "total": totals})

    return stream.select("event_id", "ts", "name", "tag", "value").groupBy("name", "tag").applyInPandasWithState(add, "event_id bigint, name string, tag bigint, total double", "total double", "append", GroupStateTimeout.NoTimeout)


def cooldown(stream: DataFrame, seconds: float = fixed.COOLDOWN_SECONDS) -> DataFrame:
    """Alerts that fire, per rule only later than ``seconds`` after the last that fired; rows are ordered inside a micro-batch."""

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fired = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        keep = []
        for at in rows["ts"].astype("datetime64[ns]").astype("int64") / 1e9:
            fires = fired is None or at - fired > seconds
            fired = at if fires else fired
            keep.append(fires)
        state.update((fired,))
        yield rows[keep][["event_id", "rule"]]

    return stream.groupBy("rule").applyInPandasWithState(walk, "event_id bigint, rule string", "fired double", "append", GroupStateTimeout.NoTimeout)
