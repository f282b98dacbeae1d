"""Queries over metrics, alerts and tasks, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as op
from .derived import METRICS, metrics, table

RULES = [
    {"rule": "slow", "name": "view", "comparator": ">", "limit": 400, "severity": "warning"},
    {"rule": "low", "name": "click", "comparator": "<=", "limit": 20, "severity": "info"},
    {"rule": "broken", "name": "error", "comparator": ">=", "limit": 100, "severity": "critical"},
]
SECONDS = 36000


def counter(spark, d):
    return op.counter(metrics(spark, d)).select("event_id", "name", "tag", F.round("total", 3).alias("total"))


def _ops(spark, d):
    kind = F.element_at(F.array(F.lit("set"), F.lit("inc"), F.lit("dec")), (F.col("event_id") % 3 + 1).cast("int"))
    return metrics(spark, d).withColumn("op", F.when(F.col("event_id") % 30 == 0, "set").when(kind == "set", "inc").otherwise(kind))


def gauge(spark, d):
    return op.gauge(_ops(spark, d)).select("event_id", "name", "tag", F.round("level", 3).alias("level"))


def histogram(spark, d):
    out = op.histogram(metrics(spark, d), ["name", "tag"])
    return out.select("name", "tag", "n", F.round("sum", 3).alias("sum"), F.round("avg", 3).alias("avg"), "min", "max")


def histogram_points(spark, d):
    return op.histogram_points(metrics(spark, d)).select("event_id", "name", "tag", "type", F.round(F.col("point") + 1e-9, 3).alias("point"))


def meter(spark, d):
    out = op.meter(metrics(spark, d), tick=SECONDS)
    return out.select("name", "t", F.round("count", 3).alias("count"), F.round("mean_rate", 6).alias("mean_rate"), F.round("rate_1m", 6).alias("rate_1m"), F.round("rate_15m", 6).alias("rate_15m"))


def latest_per_key(spark, d):
    return op.latest_per_key(metrics(spark, d))


def exposition(spark, d):
    return op.exposition(metrics(spark, d).withColumn("name", F.concat(F.lit("ink."), "name", F.when(F.col("name") == "view", ".count").otherwise("")))).select("metric", F.col("line_no").cast("bigint").alias("line_no"), F.col("line").alias("line"))


def threshold_alerts(spark, d):
    return op.threshold_alerts(metrics(spark, d), RULES).select("event_id", "rule", "severity", "value", "message")


def predicate_alerts(spark, d):
    return op.predicate_alerts(metrics(spark, d), {"odd": ((F.col("event_id") % 7 == 0) & (F.col("value") > 100), "error")}).select("event_id", "rule", "severity")


def _thousandths(value):
    """``value`` to three places as SQL rounds it: half away from zero after the multiplication, whose result may be a tie or miss it; ``F.round`` goes by the decimal digits."""
    return F.when(F.abs(value) < 1e12, F.signum(value) * F.floor(F.abs(value) * 1000 + 0.5) / 1000).otherwise(value)


def change_alerts(spark, d):
    return op.change_alerts(metrics(spark, d), 50.0).select("event_id", "name", _thousandths(F.col("change")).alias("change"))


def cooldown(spark, d):
    return op.cooldown(op.threshold_alerts(metrics(spark, d), RULES), SECONDS).select("event_id", "rule")


def alert_lifecycle(spark, d):
    alerts = op.threshold_alerts(metrics(spark, d), RULES)
    return op.lifecycle(alerts.filter("event_id % 5 != 0"), alerts.filter("event_id % 5 = 0")).select("event_id", "rule", "resolved", F.unix_micros("resolved_ts").alias("resolved_us"))


def fan_out_alerts(spark, d):
    return op.fan_out(op.threshold_alerts(metrics(spark, d), RULES), ["mail", "chat"]).select("event_id", "channel", "payload")


def severity_route(spark, d):
    return op.fan_out(op.threshold_alerts(metrics(spark, d), RULES), ["mail", "chat", "hook"]).groupBy("channel", "rule").agg(F.count("*").alias("n"))


def rate_limits(spark, d):
    role = F.element_at(F.array(F.lit("anonymous"), F.lit("bot"), F.lit("user")), (F.col("tag") % 3 + 1).cast("int"))
    requests = metrics(spark, d).withColumn("key", F.col("tag")).withColumn("role", role).withColumn("ts", F.date_trunc("day", "ts"))
    return op.rate_limits(requests, {"anonymous": 3, "user": 8}, 5).select(F.unix_micros("minute").alias("minute_us"), "key", "role", "n", "allowed")


NOW = "2024-01-15 00:00:00"


def _keys(spark, d):
    return metrics(spark, d).select("event_id", F.col("ts").alias("expiry"))


def live_keys(spark, d):
    return op.expire(_keys(spark, d), F.lit(NOW).cast("timestamp"))[0].select("event_id")


def expired_keys(spark, d):
    return op.expire(_keys(spark, d), F.lit(NOW).cast("timestamp"))[1]


def _tasks(spark, d):
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "finished").when(s == "P", "failed").otherwise("queued")
    start = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(status.alias("status"), F.when(s == "P", "broken").alias("error"), start.alias("started"), F.timestamp_seconds(F.unix_timestamp(start) + F.col("o_orderkey") % 500).alias("ended"))


def task_status(spark, d):
    return op.task_status(_tasks(spark, d))


def processing_time(spark, d):
    out = op.processing_time(_tasks(spark, d))
    return out.select("name", "n", "sum", F.round("avg", 3).alias("avg"), "min", "max")


_RUN = "OVER (PARTITION BY name, tag ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_ALERTS = f"{METRICS}, a AS (SELECT event_id, ts, value, CASE WHEN name = 'view' AND value > 400 THEN 'slow' WHEN name = 'click' AND value <= 20 THEN 'low' WHEN name = 'error' AND value >= 100 THEN 'broken' END AS rule, CASE name WHEN 'view' THEN 'warning' WHEN 'click' THEN 'info' ELSE 'critical' END AS severity FROM metrics_), alerts AS (SELECT * FROM a WHERE rule IS NOT NULL)"
_TASKS = "t AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'broken' END AS error, CAST(o_orderkey % 500 AS DOUBLE) AS v FROM orders)"

QUERIES = {
    "counter": (counter, f"WITH {METRICS} SELECT event_id, name, tag, round(sum(value) {_RUN}, 3) AS total FROM metrics_"),
    "gauge": (gauge, f"WITH {METRICS}, o AS (SELECT *, CASE WHEN event_id % 30 = 0 THEN value END AS base, CASE WHEN event_id % 30 = 0 THEN 0 WHEN event_id % 3 = 2 THEN -value ELSE value END AS delta FROM metrics_), s AS (SELECT *, count(base) {_RUN} AS seg FROM o) SELECT event_id, name, tag, round(coalesce(first_value(base) OVER w, 0) + sum(delta) OVER w, 3) AS level FROM s WINDOW w AS (PARTITION BY name, tag, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"),
    "histogram_snapshot": (histogram, f"WITH {METRICS} SELECT name, tag, count(*) AS n, round(sum(value), 3) AS sum, round(avg(value), 3) AS avg, min(value) AS min, max(value) AS max FROM metrics_ GROUP BY 1, 2"),
    "histogram_points": (histogram_points, f"WITH {METRICS}, r AS (SELECT event_id, name, tag, CAST(count(*) {_RUN} AS DOUBLE) AS c, sum(value) {_RUN} AS s, min(value) {_RUN} AS lo, max(value) {_RUN} AS hi FROM metrics_) SELECT event_id, name, tag, unnest(['count', 'sum', 'avg', 'min', 'max']) AS type, round(unnest([c, s, s / c, lo, hi]) + 1e-9, 3) AS point FROM r"),
    "meter": (meter, f"""WITH RECURSIVE {METRICS}, seen AS (SELECT name, CAST(floor(epoch(ts) / {SECONDS}) AS BIGINT) AS t, sum(value) AS v FROM metrics_ GROUP BY 1, 2),
span AS (SELECT name, min(t) AS t0, max(t) AS t1 FROM seen GROUP BY 1), g AS (SELECT name, t0, unnest(range(t0, t1 + 1)) AS t FROM span),
c AS (SELECT g.name, g.t, g.t - g.t0 + 1 AS k, sum(coalesce(v, 0)) OVER (PARTITION BY g.name ORDER BY g.t) AS n FROM g LEFT JOIN seen ON g.name = seen.name AND g.t = seen.t),
m AS (SELECT *, n / (k * {SECONDS}) AS x FROM c),
r AS (SELECT name, t, k, n, x, x AS a, x AS b FROM m WHERE k = 1
  UNION ALL SELECT m.name, m.t, m.k, m.n, m.x, CASE WHEN r.x = 0 THEN m.x ELSE r.a * exp(-{SECONDS} / 60.0) + m.x * (1 - exp(-{SECONDS} / 60.0)) END, CASE WHEN r.x = 0 THEN m.x ELSE r.b * exp(-{SECONDS} / 900.0) + m.x * (1 - exp(-{SECONDS} / 900.0)) END FROM r JOIN m ON m.name = r.name AND m.k = r.k + 1)
SELECT name, t, round(n, 3) AS count, round(x, 6) AS mean_rate, round(a, 6) AS rate_1m, round(b, 6) AS rate_15m FROM r"""),
    "latest_per_key": (latest_per_key, f"WITH {METRICS} SELECT name, tag, value FROM metrics_ QUALIFY row_number() OVER (PARTITION BY name, tag ORDER BY ts DESC, event_id DESC) = 1"),
    "prometheus_exposition": (exposition, f"""WITH {METRICS}, v AS (SELECT name, tag, value FROM metrics_ QUALIFY row_number() OVER (PARTITION BY name, tag ORDER BY ts DESC, event_id DESC) = 1),
l AS (SELECT 'ink_' || name || CASE WHEN name = 'view' THEN '_count' ELSE '' END AS metric, 'ink.' || name || CASE WHEN name = 'view' THEN '.count' ELSE '' END AS full_name, tag, value FROM v),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY metric ORDER BY CAST(tag AS VARCHAR)) + 2 AS BIGINT) AS line_no FROM l), z AS (SELECT metric, any_value(full_name) AS f, max(line_no) AS m FROM n GROUP BY 1)
SELECT metric, line_no, metric || '{{user="' || tag || '"}} ' || CAST(value AS VARCHAR) AS line FROM n
UNION ALL SELECT metric, unnest([1, 2, m + 1]), unnest(['# HELP ' || metric || ' ' || f, '# TYPE ' || metric || ' ' || CASE WHEN f LIKE '%.count' THEN 'counter' ELSE 'gauge' END, '']) FROM z"""),
    "threshold_alerts": (threshold_alerts, f"WITH {_ALERTS} SELECT event_id, rule, severity, value, rule || ': ' || CASE rule WHEN 'slow' THEN 'view' WHEN 'low' THEN 'click' ELSE 'error' END || '의 값 ' || CAST(value AS VARCHAR) || '이(가) 임계값 ' || CASE rule WHEN 'slow' THEN '400' WHEN 'low' THEN '20' ELSE '100' END || '을(를) ' || CASE rule WHEN 'slow' THEN '>' WHEN 'low' THEN '<=' ELSE '>=' END || ' 만족합니다.' AS message FROM alerts"),
    "predicate_alerts": (predicate_alerts, f"WITH {METRICS} SELECT event_id, 'odd' AS rule, 'error' AS severity FROM metrics_ WHERE event_id % 7 = 0 AND value > 100"),
    "change_alerts": (change_alerts, f"WITH {METRICS}, p AS (SELECT *, lag(value) OVER (PARTITION BY name ORDER BY ts, event_id) AS q FROM metrics_), c AS (SELECT *, CASE WHEN q = 0 THEN CASE WHEN value > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE (value - q) / abs(q) * 100 END AS change FROM p) SELECT event_id, name, round(change, 3) AS change FROM c WHERE abs(change) >= 50"),
    "cooldown": (cooldown, f"""WITH RECURSIVE {_ALERTS}, n AS (SELECT rule, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY rule ORDER BY ts, event_id) AS k FROM alerts),
w AS (SELECT rule, event_id, k, t AS fired, true AS fires FROM n WHERE k = 1
  UNION ALL SELECT n.rule, n.event_id, n.k, CASE WHEN n.t - w.fired > {SECONDS} THEN n.t ELSE w.fired END, n.t - w.fired > {SECONDS} FROM w JOIN n ON n.rule = w.rule AND n.k = w.k + 1)
SELECT event_id, rule FROM w WHERE fires"""),
    "alert_lifecycle": (alert_lifecycle, f"WITH {_ALERTS}, r AS (SELECT *, min(CASE WHEN event_id % 5 = 0 THEN epoch_us(ts) END) OVER (PARTITION BY rule ORDER BY ts, event_id % 5 = 0, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS u FROM alerts) SELECT event_id, rule, u IS NOT NULL AS resolved, u AS resolved_us FROM r WHERE event_id % 5 <> 0"),
    "fan_out_alerts": (fan_out_alerts, f"""WITH {_ALERTS} SELECT event_id, 'mail' AS channel, 'Alert: ' || rule || ' - ' || upper(severity) || chr(10) || '{{"rule":"' || rule || '","severity":"' || severity || '","value":' || CAST(value AS VARCHAR) || '}}' AS payload FROM alerts UNION ALL SELECT event_id, 'chat', '[' || severity || '] ' || rule FROM alerts"""),
    "severity_route": (severity_route, f"WITH {_ALERTS} SELECT channel, rule, count(*) AS n FROM alerts, (SELECT unnest(['mail', 'chat', 'hook']) AS channel) c GROUP BY 1, 2"),
    "rate_limit_report": (rate_limits, f"WITH {METRICS}, q AS (SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS minute_us, tag AS key, ['anonymous', 'bot', 'user'][tag % 3 + 1] AS role, count(*) AS n FROM metrics_ GROUP BY 1, 2, 3), l AS (SELECT *, CASE role WHEN 'anonymous' THEN 3 WHEN 'user' THEN 8 ELSE 5 END AS allowed FROM q) SELECT * FROM l WHERE n > allowed"),
    "live_keys": (live_keys, f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}'"),
    "expired_keys": (expired_keys, f"SELECT count(*) AS expired FROM events WHERE ts < TIMESTAMP '{NOW}'"),
    "task_status": (task_status, f"WITH {_TASKS} SELECT CASE WHEN status = 'queued' THEN 'processing' ELSE status END AS status, count(*) AS n, count(error) AS errors FROM t GROUP BY 1"),
    "processing_time": (processing_time, f"WITH {_TASKS} SELECT status AS name, count(*) AS n, sum(v) AS sum, round(avg(v), 3) AS avg, min(v) AS min, max(v) AS max FROM t GROUP BY 1"),
}
