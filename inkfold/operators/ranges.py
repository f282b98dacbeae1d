"""Ordered work on keys of any size.

Running values need the rows of a key in order, and one key may hold most of the
rows.  Rows are cut into pieces that are contiguous in the order: by time where
no piece gets too large, else by ranges of (key, order) that Spark samples.  What
crosses pieces is carried over one summary row per key and piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import settled

PIECE_SECONDS, PIECE_ROWS = 3600, 1_000_000


def ranged(rows: DataFrame, order: list[str], out: str = "bucket", parts: int | None = None) -> DataFrame:
    """``rows`` with ``out``: the number of their range in ``order``; ranges are fixed by writing them."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(rows.repartitionByRange(parts, *order).withColumn(out, F.spark_partition_id()), "ranges")


def pieces(rows: DataFrame, key: list[str], order: list[str], seconds: int = PIECE_SECONDS, limit: int = PIECE_ROWS, parts: int | None = None) -> DataFrame:
    """``rows`` with ``bucket``, which rises with ``order`` (a timestamp first) inside each key.

    Time buckets of ``seconds`` stay if none of a key has more than ``limit`` rows,
    which one aggregate checks; else rows are dealt to ranges of key and order, as
    many as keep them at half of ``limit``, so a burst of one key spreads over tasks.
    """
    cut = rows.withColumn("bucket", F.floor(F.unix_timestamp(order[0]) / seconds))
    size = cut.groupBy(*key, "bucket").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    if (size["most"] or 0) <= limit:
        return cut
    return ranged(rows, [*key, *order], parts=parts or max(2, -(-2 * size["total"] // max(limit, 1))))


def carried(cut: DataFrame, key: list[str], sums: dict[str, Column], carry: dict[str, Column], later: bool = False) -> DataFrame:
    """Per key and bucket the ``carry`` aggregates over the ``sums`` of all buckets before it, or after it."""
    ends = cut.groupBy(*key, "bucket").agg(*[c.alias(n) for n, c in sums.items()])
    along = Window.partitionBy(*key).orderBy(F.desc("bucket") if later else F.asc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*key, "bucket", *[c.over(along).alias(n) for n, c in carry.items()])


def with_carried(cut: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """``cut`` with the columns of ``ends`` of its key and bucket; null keys are keys like others."""
    e = ends.select(*[F.col(c).alias(f"_e_{c}") if c in (*key, "bucket") else F.col(c) for c in ends.columns])
    same = F.col("bucket") == F.col("_e_bucket")
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    return cut.join(e, same, "left").drop("_e_bucket", *[f"_e_{c}" for c in key])


def next_after(asks: DataFrame, targets: DataFrame, key: str, value: list[str], limit: int = PIECE_ROWS) -> DataFrame:
    """``asks`` with ``next``: the first of the key's ``targets`` behind ``at`` (micros), null if none follows.

    Both have ``key`` and ``at``; targets have ``value`` columns that order equal
    times.  A target at the very time of an ask is not behind it.  The carry runs
    backwards: inside a piece a running minimum in falling order, over pieces the
    first target of the pieces behind.
    """
    own = targets.select(key, "at", F.lit(False).alias("_ask"), F.struct("at", *value).alias("_own"))
    both = asks.withColumn("_ask", F.lit(True)).unionByName(own, allowMissingColumns=True)
    # falling order meets later times first, and at one time the asks before the targets
    cut = pieces(both.withColumn("_ts", F.timestamp_micros("at")), [key], ["_ts", "_ask"], limit=limit).drop("_ts")
    behind = carried(cut, [key], {"_first": F.min("_own")}, {"_behind": F.min("_first")}, later=True)
    falling = Window.partitionBy(key, "bucket").orderBy(F.desc("at"), F.desc("_ask")).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_inside", F.min("_own").over(falling)).filter("_ask")
    return with_carried(inside, behind, [key]).select(*asks.columns, F.coalesce("_inside", "_behind").alias("next"))
