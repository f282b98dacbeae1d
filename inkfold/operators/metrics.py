"""Metrics and alerts over (name, tag, ts, value) points, in batch.

A metric name, or a rule, may hold most of the rows, so running values never put
a whole name into one task: points are cut into pieces contiguous in time (see
``ranges``), sums or last values per piece are carried on over the pieces, and
only inside a piece are points put in order.  A burst inside one hour is cut by
ranges of points instead of by time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..stored import settled
from .ranges import PIECE_ROWS, carried, next_after, pieces, with_carried

KEY = ["name", "tag"]
ORDER = ["ts", "event_id"]


def counter(points: DataFrame, limit: int = PIECE_ROWS) -> DataFrame:
    """Points with ``total``: the running sum per metric and tag."""
    cut = pieces(points, KEY, ORDER, limit=limit)
    offset = carried(cut, KEY, {"s": F.sum("value")}, {"offset": F.sum("s")})
    inside = F.sum("value").over(Window.partitionBy(*KEY, "bucket").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return with_carried(cut.withColumn("inside", inside), offset, KEY).withColumn("total", F.coalesce("offset", F.lit(0.0)) + F.col("inside")).drop("inside", "offset", "bucket")


def gauge(ops: DataFrame, limit: int = PIECE_ROWS) -> DataFrame:
    """Operations (set, inc, dec) with ``level`` after each; the last set of earlier buckets carries over."""
    cut = pieces(ops, KEY, ORDER, limit=limit).withColumn("delta", F.when(F.col("op") == "inc", F.col("value")).when(F.col("op") == "dec", -F.col("value")).otherwise(0.0))
    cut = cut.withColumn("base", F.when(F.col("op") == "set", F.col("value")))
    order = Window.partitionBy(*KEY, "bucket").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("segment", F.count("base").over(order))
    within = Window.partitionBy(*KEY, "bucket", "segment").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("since", F.sum("delta").over(within)).withColumn("start", F.first("base", ignorenulls=True).over(within))
    last = cut.groupBy(*KEY, "bucket").agg(F.max_by(F.struct("start", "since", "segment"), F.struct("ts", "event_id")).alias("z"))
    last = last.select(*KEY, "bucket", F.col("z.start").alias("start"), F.col("z.since").alias("since"))
    # levels at the ends of buckets: since the last bucket with a set, sums of the buckets after it
    ended = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    runs = last.withColumn("run", F.count("start").over(ended))
    along = Window.partitionBy(*KEY, "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = runs.withColumn("level", F.coalesce(F.first("start", ignorenulls=True).over(along), F.lit(0.0)) + F.sum("since").over(along))
    offset = ends.select(*KEY, "bucket", F.lag("level").over(Window.partitionBy(*KEY).orderBy("bucket")).alias("offset"))
    level = F.when(F.col("segment") > 0, F.col("start") + F.col("since")).otherwise(F.coalesce("offset", F.lit(0.0)) + F.col("since"))
    return with_carried(cut, offset, KEY).withColumn("level", level).drop("bucket", "delta", "base", "segment", "since", "start", "offset")


def histogram(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.count("value").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("sum"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("avg"), F.coalesce(F.min("value"), F.lit(0.0)).alias("min"), F.coalesce(F.max("value"), F.lit(0.0)).alias("max"))


def histogram_points(points: DataFrame, limit: int = PIECE_ROWS) -> DataFrame:
    """Five points per update (count, sum, avg, min, max so far), named by ``type``."""
    cut = pieces(points, KEY, ORDER, limit=limit)
    sums = {"c": F.count("*"), "s": F.sum("value"), "lo": F.min("value"), "hi": F.max("value")}
    offset = carried(cut, KEY, sums, {"c0": F.sum("c"), "s0": F.sum("s"), "lo0": F.min("lo"), "hi0": F.max("hi")})
    order = Window.partitionBy(*KEY, "bucket").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.select("*", F.count("*").over(order).alias("c1"), F.sum("value").over(order).alias("s1"), F.min("value").over(order).alias("lo1"), F.max("value").over(order).alias("hi1"))
    both = with_carried(cut, offset, KEY)
    n, s = F.coalesce("c0", F.lit(0)) + F.col("c1"), F.coalesce("s0", F.lit(0.0)) + F.col("s1")
    kinds = {"count": n.cast("double"), "sum": s, "avg": s / n, "min": F.least("lo0", "lo1"), "max": F.greatest("hi0", "hi1")}
    rows = F.array(*[F.struct(F.lit(k).alias("type"), v.alias("point")) for k, v in kinds.items()])
    return both.select("event_id", *KEY, F.inline(rows))


def _decayed(rows: DataFrame, gain: str, rate: float, out: str, level: int = 0) -> DataFrame:
    """``out``: the sum of ``gain`` over the name's rows up to each one, each fading by ``exp(-rate)`` a step of ``k``.

    Blocks of steps hold scaled running sums; their ends are the same task again,
    with fewer rows and a larger rate.  Beyond a rate of 250 the past is nothing.
    """
    if rate > 250:
        return rows.withColumn(out, F.col(gain))
    block_col, block = f"_block{level}", max(2, min(256, int(500 / rate)))
    cut = rows.withColumn(block_col, F.floor((F.col("k") - 1) / block))
    local = (F.col("k") - F.col(block_col) * block).cast("double")  # 1 to block
    within = Window.partitionBy("name", block_col).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_in", F.sum(F.col(gain) * F.exp(local * rate)).over(within) * F.exp(-local * rate))
    ends = cut.groupBy("name", block_col).agg(F.sum(F.col(gain) * F.exp((local - block) * rate)).alias("_gain"))
    ends = _decayed(ends.withColumn("k", F.col(block_col) + 1), "_gain", rate * block, "_total", level + 1)
    ends = ends.withColumn("_past", F.lag("_total").over(Window.partitionBy("name").orderBy(block_col)))
    back = cut.join(ends.select("name", block_col, "_past"), ["name", block_col])
    return back.withColumn(out, F.col("_in") + F.coalesce("_past", F.lit(0.0)) * F.exp(-local * rate)).drop(block_col, "_in", "_past")


def meter(points: DataFrame, tick: int = fixed.METER_TICK_SECONDS, interval_rate: bool = False) -> DataFrame:
    """Count, mean rate and three smoothed rates per name at every tick.

    A smoothed rate goes ``r + a * (x - r)``, seeded by the first rate that is not
    zero: a sum of all inputs so far that fades by ``1 - a`` a tick.
    """
    seen = points.groupBy("name", F.floor(F.unix_timestamp("ts") / tick).cast("bigint").alias("t")).agg(F.sum("value").alias("v"))
    span = seen.groupBy("name").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    grid = span.select("name", "t0", F.explode(F.sequence("t0", "t1")).alias("t")).join(seen, ["name", "t"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    grid = grid.withColumn("k", F.col("t") - F.col("t0") + 1).withColumn("bucket", F.floor((F.col("k") - 1) / 256))
    offset = carried(grid, ["name"], {"s": F.sum("v")}, {"before": F.sum("s")})
    within = Window.partitionBy("name", "bucket").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    out = with_carried(grid, offset, ["name"]).withColumn("count", F.coalesce("before", F.lit(0.0)) + F.sum("v").over(within))
    out = out.withColumn("mean_rate", F.col("count") / (F.col("k") * tick))
    out = out.withColumn("x", F.col("v") / tick if interval_rate else F.col("mean_rate"))
    out = out.join(out.filter("x != 0").groupBy("name").agg(F.min("k").alias("k1")), "name", "left").select("name", "t", "k", "k1", "count", "mean_rate", "x")
    for label, seconds in fixed.METER_WINDOWS.items():
        share = 1 - F.exp(F.lit(-tick / seconds))
        gain = F.when(F.col("k") == F.col("k1"), F.col("x")).when(F.col("k") > F.col("k1"), share * F.col("x")).otherwise(0.0)
        out = _decayed(out.withColumn("gain", gain), "gain", tick / seconds, f"rate_{label}").drop("gain")
    return out.select("name", "t", "count", "mean_rate", *[f"rate_{x}" for x in fixed.METER_WINDOWS])


def latest_per_key(points: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return points.groupBy(*keys).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def exposition(points: DataFrame) -> DataFrame:
    """Text lines of the latest points as (name, line_no, line); a blank line ends each name."""
    name = F.replace("name", F.lit("."), F.lit("_"))
    last = latest_per_key(points).withColumn("metric", name)
    kind = F.when(F.col("name").endswith(".count"), "counter").otherwise("gauge")
    sample = last.select("metric", F.lit(2).alias("part"), F.col("tag").cast("string").alias("tag"), F.format_string('%s{user="%s"} %s', "metric", F.col("tag").cast("string"), F.col("value").cast("string")).alias("line"))
    heads = last.select("metric", "name").distinct()
    lines = lambda part, line: heads.select("metric", F.lit(part).alias("part"), F.lit("").alias("tag"), line.alias("line"))
    every = sample.union(lines(0, F.concat(F.lit("# HELP "), "metric", F.lit(" "), "name"))).union(lines(1, F.concat(F.lit("# TYPE "), F.col("metric"), F.lit(" "), kind))).union(lines(3, F.lit("")))
    return every.select("metric", F.row_number().over(Window.partitionBy("metric").orderBy("part", "tag")).alias("line_no"), "line")


def _compare(value: Column, comparator: str, limit: float) -> Column:
    if comparator not in fixed.COMPARATORS:
        raise ValueError(f"unknown comparator {comparator!r}")
    tests = {">": value > limit, ">=": value >= limit, "<": value < limit, "<=": value <= limit, "==": value == limit, "!=": value != limit}
    return tests[comparator]


def threshold_alerts(points: DataFrame, rules: list[dict]) -> DataFrame:
    """One alert per point and rule that it meets, with its message.  Rules: rule, name, comparator, limit, severity, and a description (else the rule's name)."""
    for rule in rules:
        if rule["severity"] not in fixed.SEVERITIES:
            raise ValueError(f"unknown severity {rule['severity']!r}")
    found = [
        F.when((F.col("name") == r["name"]) & _compare(F.col("value"), r["comparator"], r["limit"]), F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["severity"]).alias("severity"), F.lit(float(r["limit"])).alias("limit"), F.format_string(fixed.THRESHOLD_MESSAGE, F.lit(r.get("description", r["rule"])), "name", F.col("value").cast("string"), F.lit(str(r["limit"])), F.lit(r["comparator"])).alias("message")))
        for r in rules
    ]
    return points.select("event_id", "ts", "name", "value", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def predicate_alerts(points: DataFrame, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """Alerts of the user's own rules: name to (predicate, severity)."""
    found = [F.when(p, F.struct(F.lit(k).alias("rule"), F.lit(s).alias("severity"))) for k, (p, s) in rules.items()]
    return points.select("event_id", "ts", "name", "value", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def change_alerts(points: DataFrame, limit: float, percent: bool = True, description: str = "change", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Points whose change from the name's previous value reaches ``limit``; the first value is silent.

    The previous value is looked up inside the time bucket, and for a bucket's first
    point from the last point of the bucket before it that has any.
    """
    cut = pieces(points, ["name"], ORDER, limit=piece_rows)
    before = carried(cut, ["name"], {"last": F.max_by(F.struct("value"), F.struct(*ORDER))}, {"last": F.last("last")}).select("name", "bucket", F.col("last.value").alias("end"))
    inside = F.lag("value").over(Window.partitionBy("name", "bucket").orderBy("ts", "event_id"))
    out = with_carried(cut.withColumn("_in", inside), before, ["name"]).withColumn("previous", F.coalesce("_in", "end"))
    v, p = F.col("value"), F.col("previous")
    change = F.when(p == 0, F.when(v > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise((v - p) / F.abs(p) * 100) if percent else v - p
    unit = "%" if percent else ""
    message = F.format_string(fixed.CHANGE_MESSAGE, F.lit(description), "name", "change", F.lit(unit), F.lit(str(limit)), F.lit(unit))
    return out.withColumn("change", change).filter(F.abs("change") >= limit).select("event_id", "ts", "name", "value", "previous", "change", message.alias("message"))


def cooldown(alerts: DataFrame, seconds: float = fixed.COOLDOWN_SECONDS, walk_rows: int = PIECE_ROWS) -> DataFrame:
    """Alerts that fire: per rule only later than ``seconds`` after the last that fired; rows equal in rule, time and id count once.

    Rules of up to ``walk_rows`` alerts are walked in order, one number kept.  Larger
    ones go through ``firing_chain``, which no task holds whole.
    """
    sizes = alerts.groupBy("rule").agg(F.count("*").alias("n"))
    large = [r["rule"] for r in sizes.filter(F.col("n") > walk_rows).collect()]  # as many as fit the rows
    is_large = F.coalesce(F.col("rule").isin(large), F.lit(False)) if large else F.lit(False)
    walked = _walked(alerts.filter(~is_large), seconds)
    return walked.union(firing_chain(alerts.filter(is_large), seconds).select(*alerts.columns)) if large else walked


def _walked(alerts: DataFrame, seconds: float) -> DataFrame:
    names = alerts.columns

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fired = None, 0.0
        for batch in batches:
            keep = []
            for rule, at in zip(batch["rule"], batch["_t"], strict=True):
                fires = current != (rule,) or at - fired > seconds * 1e6
                if fires:
                    current, fired = (rule,), at
                keep.append(fires)
            yield batch[keep][names]

    dealt = alerts.withColumn("_t", F.unix_micros("ts")).repartition("rule").sortWithinPartitions("rule", "_t", "event_id")
    return dealt.mapInPandas(walk, alerts.schema)


def firing_chain(alerts: DataFrame, seconds: float, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """As ``cooldown``, for rules of any size, by joins alone.

    Every alert points to the first one later than the cooldown after it; those that
    fire are the chain of pointers from a rule's first alert.  Time is cut into windows
    as long as the cooldown, in each of which one alert fires at most, and windows into
    pairs, pairs of pairs and so on.  Per level and alert at which a stretch can be
    entered, the last alert that fires in the stretch follows from its two halves.  A
    stretch is entered in its first window or at the first alert behind it, so every
    level has about half the alerts of the one before.  Going back down, the alert that
    enters each half is marked.
    """
    width = int(seconds * 1e6)
    one = alerts.dropDuplicates(["rule", "ts", "event_id"])
    start = one.agg(F.min(F.unix_micros("ts"))).first()[0] or 0
    nodes = one.select("rule", (F.unix_micros("ts") - start).alias("t"), F.col("event_id").alias("id"))
    asks = nodes.select("rule", (F.col("t") + width).alias("at"), "t", "id")
    pointed = next_after(asks, nodes.select("rule", F.col("t").alias("at"), "id"), "rule", ["id"], piece_rows)
    entry = settled(pointed.select("rule", "t", "id", F.struct(F.col("next.at").alias("t"), F.col("next.id").alias("id")).alias("next")), "chain")
    used = []
    size = lambda level: F.lit(max(width, 1) << level)
    window = lambda t: ((t - F.pmod(t, size(0))) / size(0)).cast("bigint")
    # the level at which an alert and the one it points to first share a stretch
    meets = F.length(F.bin(window(F.col("t")).bitwiseXOR(window(F.col("next.t")))))
    stretch = lambda t, level: ((t - F.pmod(t, size(level))) / size(level)).cast("bigint")
    while (level := entry.agg(F.min(meets)).first()[0]) is not None:
        inner = F.col("next.t").isNotNull() & (stretch(F.col("next.t"), level) == stretch(F.col("t"), level))
        entry = entry.withColumn("inner", inner)
        used.append(entry)
        other = entry.select(F.col("rule").alias("_rule"), F.struct("t", "id").alias("_at"), F.col("next").alias("_next"))
        far = entry.join(other, F.col("inner") & F.col("rule").eqNullSafe(F.col("_rule")) & (F.col("next") == F.col("_at")), "left")
        far = far.select("rule", "t", "id", F.when(F.col("inner"), F.col("_next")).otherwise(F.col("next")).alias("next"))
        behind = F.when(F.pmod(F.col("t"), size(level)) >= max(width, 1), F.struct("t", "id"))
        least = entry.groupBy("rule", stretch(F.col("t"), level).alias("_s")).agg(F.min(behind).alias("_least"))
        kept = far.withColumn("_behind", behind).withColumn("_s", stretch(F.col("t"), level)).alias("f").join(least.alias("l"), F.col("f.rule").eqNullSafe(F.col("l.rule")) & (F.col("f._s") == F.col("l._s")), "left")
        entry = settled(kept.filter(F.col("f._behind").isNull() | (F.col("f._behind") == F.col("l._least"))).select("f.rule", "f.t", "f.id", "f.next"), "chain")
    fires = settled(nodes.groupBy("rule").agg(F.min(F.struct("t", "id")).alias("at")), "fires")
    for entry in reversed(used):
        halves = entry.filter("inner").alias("e").join(fires.alias("m"), F.col("e.rule").eqNullSafe(F.col("m.rule")) & (F.struct("e.t", "e.id") == F.col("m.at")))
        fires = settled(fires.union(halves.select("e.rule", F.col("e.next").alias("at"))).distinct(), "fires")
    o, m = one.alias("o"), fires.alias("m")
    same = F.col("o.rule").eqNullSafe(F.col("m.rule")) & (F.unix_micros("o.ts") - start == F.col("m.at.t")) & (F.col("o.event_id") == F.col("m.at.id"))
    return o.join(m, same, "left_semi")


def lifecycle(alerts: DataFrame, resolutions: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Open alerts with the time of the next resolution of the same rule, null if none follows.

    A resolution at the very time of an alert resolves it.
    """
    asks = alerts.select("rule", (F.unix_micros("ts") - 1).alias("at"), "event_id", "ts")  # a resolution of the same time is behind it
    found = next_after(asks, resolutions.select("rule", F.unix_micros("ts").alias("at")), "rule", [], piece_rows)
    return found.select("rule", "event_id", "ts", F.timestamp_micros("next.at").alias("resolved_ts"), F.col("next").isNotNull().alias("resolved"))


def fan_out(alerts: DataFrame, channels: list[str]) -> DataFrame:
    """One payload per alert and channel; mail has a subject and a JSON body, others their text."""
    body = F.to_json(F.struct("rule", "severity", "value"))
    subject = F.concat(F.lit("Alert: "), "rule", F.lit(" - "), F.upper("severity"))
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), (F.concat(subject, F.lit("\n"), body) if c == "mail" else F.concat(F.lit("["), "severity", F.lit("] "), "rule") if c == "chat" else body).alias("payload")) for c in channels])
    return alerts.select("event_id", "rule", F.inline(rows))


def rate_limits(requests: DataFrame, limits: dict[str, int] | None = None, other: int = fixed.DEFAULT_RATE_LIMIT) -> DataFrame:
    """Minutes in which a key made more requests than its role allows."""
    per = requests.groupBy(F.window("ts", "1 minute").start.alias("minute"), "key", "role").agg(F.count("*").alias("n"))
    known = F.create_map(*[F.lit(x) for pair in (limits or fixed.RATE_LIMITS).items() for x in pair])
    return per.withColumn("allowed", F.coalesce(F.try_element_at(known, F.col("role")), F.lit(other))).filter("n > allowed")


def expire(keys: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Keys that are still good, and the number that is not."""
    return keys.filter(F.col("expiry") >= now), keys.agg(F.count_if(F.col("expiry") < now).alias("expired"))


def task_status(tasks: DataFrame) -> DataFrame:
    status = F.when(F.col("status").isin("finished", "failed"), F.col("status")).otherwise("processing")
    return tasks.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.count("error").alias("errors"))


def processing_time(tasks: DataFrame) -> DataFrame:
    timed = tasks.withColumn("name", F.col("status")).withColumn("value", F.unix_timestamp("ended").cast("double") - F.unix_timestamp("started"))
    return histogram(timed, ["name"])
