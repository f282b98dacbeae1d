"""Queries over entities, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import entities as op
from .derived import table


def _pages(spark, d, lang="eng"):
    """Documents as two pages: the whole text, and the whole text with a date, an amount and a company planted by id."""
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page_num"))
    planted = F.concat(F.lit(". Paid Jan "), (n % 28 + 1).cast("string"), F.lit(", 2023 and 2023-04-"), (n % 9 + 1).cast("string"), F.lit(" $"), (n % 900).cast("string"), F.lit(".50 to Acme"), (n % 7).cast("string"), F.lit(" Holding Inc. mail a"), (n % 50).cast("string"), F.lit("@b.org end"))
    return docs.withColumn("text", F.when(F.col("page_num") == 1, F.concat("text", planted)).otherwise(F.col("text"))).withColumn("lang", F.lit(lang))


def _entities(spark, d):
    return op.extract_entities(_pages(spark, d))


def extract_entities(spark, d):
    return _entities(spark, d)


def rollup_entities(spark, d):
    return op.rollup_entities(_entities(spark, d)).select("doc_id", "entity_type", F.array_join("values", "|").alias("joined"))


def filter_entities(spark, d):
    return op.filter_entities(_entities(spark, d), "amounts")


def entity_counts(spark, d):
    return op.entity_counts(_entities(spark, d))


def extract_addresses(spark, d):
    """An address planted before each whole text, led in by the first 40 characters of it."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    planted = F.concat(F.substr(text, F.lit(1), F.lit(40)), F.lit("〒123-"), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit(" 東京都港区 次"), text)
    docs = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_num"), F.lit("jpn").alias("lang"), planted.alias("text"))
    return op.filter_entities(op.extract_entities(docs), "addresses").select("doc_id", "value")


_PAGES = """p AS (SELECT doc_id, 1 AS page_num, coalesce(text, '') || '. Paid Jan ' || (doc_id % 28 + 1) || ', 2023 and 2023-04-' || (doc_id % 9 + 1) || ' $' || (doc_id % 900) || '.50 to Acme' || (doc_id % 7) || ' Holding Inc. mail a' || (doc_id % 50) || '@b.org end' AS text FROM documents
  UNION ALL SELECT doc_id, 2, coalesce(text, '') FROM documents)"""
_LISTS = ", ".join([
    "('emails', regexp_extract_all(text, '" + fixed.EMAIL_PATTERN + "'))",
    *["('phones', regexp_extract_all(text, '" + x + "'))" for x in fixed.PHONE_PATTERNS],
    *["('companies', regexp_extract_all(text, '" + x + "'))" for x in fixed.ENTITY_PATTERNS["eng"]["companies"]],
    *["('dates', regexp_extract_all(text, '" + x + "'))" for x in fixed.ENTITY_PATTERNS["eng"]["dates"]],
    r"('amounts', regexp_extract_all(text, '\$\s*(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?'))",
])
_ENTITIES = f"WITH {_PAGES}, e AS (SELECT DISTINCT doc_id, page_num, k AS entity_type, value FROM p, LATERAL (SELECT k, unnest(v) AS value FROM (VALUES {_LISTS}) t(k, v)) l)"

QUERIES = {
    "extract_entities": (extract_entities, _ENTITIES + " SELECT * FROM e"),
    "rollup_entities": (rollup_entities, _ENTITIES + " SELECT doc_id, entity_type, string_agg(value, '|' ORDER BY value) AS joined FROM (SELECT DISTINCT doc_id, entity_type, value FROM e) t GROUP BY 1, 2"),
    "filter_entities": (filter_entities, _ENTITIES + " SELECT * FROM e WHERE entity_type = 'amounts'"),
    "entity_counts": (entity_counts, _ENTITIES + f" SELECT k AS entity_type, count(e.value) AS n, count(e.value) > 0 AS present FROM (SELECT unnest({fixed.ENTITY_TYPES}) AS k) t LEFT JOIN e ON e.entity_type = k GROUP BY k"),
    "extract_addresses": (extract_addresses, "WITH t AS (SELECT doc_id, substr(text, 1, 40) AS a, '〒123-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS z FROM documents), x AS (SELECT doc_id, a || z || ' 東京都港区 次' || a AS s, length(a) AS n FROM t) SELECT DISTINCT doc_id, substr(s, CAST(greatest(n - 30, 0) + 1 AS BIGINT), CAST(n + 9 + 30 - greatest(n - 30, 0) AS BIGINT)) AS value FROM x"),
}
