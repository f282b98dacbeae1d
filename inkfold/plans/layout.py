"""Queries over layout records, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import layout as op
from .derived import SHAPES, shapes, table


def classify_regions(spark, d):
    return op.classify_regions(shapes(spark, d))


def classify_fine(spark, d):
    return op.classify_fine(shapes(spark, d)).withColumn("confidence", F.round("confidence", 6))


def special_items(spark, d):
    return op.special_items(op.classify_regions(shapes(spark, d)))


def orientation(spark, d):
    return op.orientation(shapes(spark, d))


def skew(spark, d):
    return op.skew(shapes(spark, d).select("doc_id", "page_num", "shape_ord", (F.col("w") - 100).alias("dx"), (F.col("h") - 100).alias("dy")))


def _typed(spark, d):
    flags = op.special_items(op.classify_regions(shapes(spark, d)))
    return op.document_type(flags.withColumn("aspect", (F.col("doc_id") % 30) / 10.0))


def document_type(spark, d):
    return _typed(spark, d).select("doc_id", "page_num", "document_type")


def stroke_stats(spark, d):
    return op.stroke_stats(shapes(spark, d)).select("doc_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "handwritten")


def cells_to_grid(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_index"), F.posexplode(F.array(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_partkey").cast("string"))).alias("column_index", "text"))
    return op.cells_to_grid(items.filter("not (column_index = 1 and row_index % 2 = 0)"), [0, 1, 2])


def key_values(spark, d):
    pairs = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("key"), F.get_json_object("props", "$.k").alias("value"), F.col("event_id").alias("ord"))
    return op.key_values(pairs)


def resolve_params(spark, d):
    n = F.col("doc_id")
    code = F.element_at(F.array(*[F.lit(x) for x in ("jpn", "kor", "eng", "xx")]), (n % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("receipt", "form", "letter")]), (n % 3 + 1).cast("int"))
    return op.resolve_params(table(spark, d, "documents").select("doc_id", code.alias("lang"), kind.alias("document_type"))).select("doc_id", "threshold", "block_size", "denoise_h", "contrast")


def overlapping_stamps(spark, d):
    return op.overlapping_pairs(shapes(spark, d))


def accepted_stamps(spark, d):
    return op.accepted_stamps(shapes(spark, d))


_REGIONS = f"""WITH {SHAPES}, r AS (SELECT doc_id, page_num, shape_ord, k.type, k.confidence, k.ok FROM shapes_, LATERAL (SELECT unnest([
  {{'type': 'stamp', 'confidence': 0.8::DOUBLE, 'ok': w * h >= 500 AND w / h BETWEEN 0.5 AND 2.0}},
  {{'type': 'handwriting', 'confidence': 0.7::DOUBLE, 'ok': w * h >= 200 AND (std / (mean + 1e-6) > 0.5 OR mean > 3.0)}},
  {{'type': 'table', 'confidence': 0.9::DOUBLE, 'ok': w * h >= 5000 AND w / h BETWEEN 0.5 AND 5.0 AND density > 0.05}},
  {{'type': 'strikethrough', 'confidence': 0.6::DOUBLE, 'ok': (abs(angle) < 20 OR abs(angle) > 160) AND w > 50 AND density > 0.1}}]) AS k) l),
regions AS (SELECT doc_id, page_num, shape_ord, type, confidence FROM r WHERE ok)"""
_KINDS = ["stamp", "handwriting", "table", "strikethrough"]
_ITEMS = "items AS (SELECT doc_id, page_num, " + ", ".join(f"count(*) FILTER (type = '{k}') AS n_{k}, bool_or(type = '{k}') AS has_{k}" for k in _KINDS) + " FROM regions GROUP BY 1, 2)"
_MODE = "n AS (SELECT doc_id, page_num, bucket, count(*) AS n, min(shape_ord) AS f FROM b GROUP BY 1, 2, 3), m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY n DESC, f, bucket) = 1)"

QUERIES = {
    "classify_regions": (classify_regions, _REGIONS + " SELECT * FROM regions"),
    "classify_strokes_fine": (classify_fine, f"""WITH {SHAPES} SELECT doc_id, page_num, shape_ord, k.type, round(k.confidence, 6) AS confidence FROM shapes_, LATERAL (SELECT unnest([
  {{'type': 'stamp', 'confidence': greatest(0.9::DOUBLE, density), 'ok': radius BETWEEN 30 AND 150 AND is_red}},
  {{'type': 'handwriting', 'confidence': least(1.0::DOUBLE, 0.6 + std), 'ok': w * h >= 500 AND w / h BETWEEN 0.2 AND 5.0 AND w * h <= 50000 AND (mean > 1.5 OR std > 0.5)}},
  {{'type': 'strikethrough', 'confidence': least(1.0::DOUBLE, 0.7 + density), 'ok': thickness BETWEEN 2 AND 10 AND density > 0.1}}]) AS k) l WHERE k.ok"""),
    "special_item_summary": (special_items, _REGIONS + f", {_ITEMS} SELECT * FROM items"),
    "orientation": (orientation, f"WITH {SHAPES}, b AS (SELECT *, round_even((CASE WHEN angle < -45 THEN angle + 90 ELSE angle END) / 5, 0) * 5 AS bucket FROM shapes_), {_MODE} SELECT doc_id, page_num, CASE WHEN bucket BETWEEN -10 AND 10 THEN 0 WHEN bucket BETWEEN 40 AND 50 THEN 90 WHEN bucket BETWEEN -50 AND -40 THEN 270 WHEN bucket >= 80 OR bucket <= -80 THEN 180 ELSE 0 END AS orientation FROM m"),
    "skew": (skew, f"WITH {SHAPES}, a AS (SELECT *, degrees(atan2(h - 100, w - 100)) AS g FROM shapes_ WHERE w <> 100), b AS (SELECT *, round_even((CASE WHEN g > 45 THEN g - 90 WHEN g < -45 THEN g + 90 ELSE g END) * 2, 0) / 2 AS bucket FROM a), {_MODE} SELECT doc_id, page_num, bucket AS skew FROM m"),
    "document_type": (document_type, _REGIONS + f""", {_ITEMS}, s AS (SELECT *, (doc_id % 30) / 10.0 AS a FROM items),
p AS (SELECT doc_id, page_num, [CASE WHEN a > 2.0 THEN 3 ELSE 0 END + CASE WHEN NOT has_table THEN 1 ELSE 0 END,
  CASE WHEN a BETWEEN 1.2 AND 1.6 THEN 1 ELSE 0 END + CASE WHEN has_table THEN 2 ELSE 0 END + CASE WHEN has_stamp THEN 1 ELSE 0 END,
  CASE WHEN a BETWEEN 1.2 AND 1.6 THEN 1 ELSE 0 END + CASE WHEN has_table THEN 1 ELSE 0 END + CASE WHEN has_handwriting THEN 1 ELSE 0 END,
  CASE WHEN has_handwriting THEN 3 ELSE 0 END] AS v FROM s)
SELECT doc_id, page_num, ['receipt', 'invoice', 'form', 'handwritten'][list_position(v, list_max(v))] AS document_type FROM p"""),
    "stroke_stats": (stroke_stats, f"WITH {SHAPES}, s AS (SELECT doc_id, avg(thickness) AS m, stddev_pop(thickness) AS d FROM shapes_ GROUP BY 1) SELECT doc_id, round(m, 6) AS mean, round(d, 6) AS std, m > 1.5 OR d / m > 0.5 AS handwritten FROM s"),
    "cells_to_grid": (cells_to_grid, "SELECT l_orderkey AS table_id, l_linenumber AS row_index, max(l_returnflag) AS c0, max(CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_linestatus END) AS c1, max(CAST(l_partkey AS VARCHAR)) AS c2 FROM lineitem GROUP BY 1, 2"),
    "key_values": (key_values, "SELECT user_id AS doc_id, event_type AS key, arg_max(props->>'$.k', event_id) AS value FROM events GROUP BY 1, 2"),
    "resolve_params": (resolve_params, "SELECT doc_id, [t, l][2 - CAST(t IS NOT NULL AS INT)].a AS threshold, [t, l][2 - CAST(t IS NOT NULL AS INT)].b AS block_size, [t, l][2 - CAST(t IS NOT NULL AS INT)].c AS denoise_h, [t, l][2 - CAST(t IS NOT NULL AS INT)].d AS contrast FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {'a': 200, 'b': 15, 'c': 12, 'd': 1.4::DOUBLE} WHEN 1 THEN {'a': 180, 'b': 19, 'c': 15, 'd': 1.1::DOUBLE} END AS t, CASE doc_id % 4 WHEN 0 THEN {'a': 180, 'b': 15, 'c': 10, 'd': 1.3::DOUBLE} WHEN 1 THEN {'a': 180, 'b': 13, 'c': 10, 'd': 1.2::DOUBLE} ELSE {'a': 190, 'b': 11, 'c': 8, 'd': 1.2::DOUBLE} END AS l FROM documents) q"),
    "overlapping_stamps": (overlapping_stamps, f"WITH {SHAPES} SELECT a.doc_id, a.page_num, a.shape_ord AS a, b.shape_ord AS b FROM shapes_ a JOIN shapes_ b ON a.doc_id = b.doc_id AND a.shape_ord < b.shape_ord WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < a.radius + b.radius"),
    "accepted_stamps": (accepted_stamps, f"""WITH RECURSIVE {SHAPES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY CASE WHEN is_circle THEN 0 ELSE 1 END, shape_ord, x, y, radius) AS k FROM shapes_),
w AS (SELECT doc_id, page_num, k, [{{'n': shape_ord, 'x': x, 'y': y, 'r': radius}}] AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.page_num, o.k, CASE WHEN o.is_circle OR len(list_filter(w.kept, lambda s: (s.x - o.x) ** 2 + (s.y - o.y) ** 2 < (s.r + o.radius) ** 2)) = 0
    THEN list_append(w.kept, {{'n': o.shape_ord, 'x': o.x, 'y': o.y, 'r': o.radius}}) ELSE w.kept END FROM w JOIN o ON o.doc_id = w.doc_id AND o.page_num = w.page_num AND o.k = w.k + 1)
SELECT doc_id, page_num, unnest(kept).n AS shape_ord FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY k DESC) = 1) z"""),
}
