"""Input tables of the operators, derived from the given tables, in Spark and in SQL.

Only integer arithmetic decides what a row holds, so both sides agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = docs.withColumn("engine_ord", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    k = F.col("engine_ord")
    english = (F.col("doc_id") + k) % 5 == 0
    short = F.when(english | (F.col("lang") == "en"), "en").when(F.col("lang") == "de", "ja").when(F.col("lang") == "fr", "ko").otherwise("zh")
    long = F.when(english | (F.col("lang") == "en"), "eng").when(F.col("lang") == "de", "jpn").when(F.col("lang") == "fr", "kor").otherwise("chi_sim")
    blank = ((F.col("doc_id") + k) % 11 == 0) | (F.col("doc_id") % 97 == 0)
    return rows.select(
        "doc_id", F.lit(1).alias("page_num"), "engine_ord",
        F.element_at(F.array(*[F.lit(x) for x in ("custom_model", "tesseract", "google_vision", "azure_form")]), k + 1).alias("engine"),
        F.when(blank, "").otherwise(F.substr("text", F.lit(1), F.greatest(F.length("text") - k, F.lit(0)))).alias("text"),
        (((F.col("doc_id") * 37 + k * 29) % 101) / 100.0).cast("double").alias("confidence"),
        F.when(k % 2 == 1, short).otherwise(long).alias("language"),
    )


ENGINE_RESULTS = """engine_results AS (
  SELECT doc_id, 1 AS page_num, k AS engine_ord,
    ['custom_model', 'tesseract', 'google_vision', 'azure_form'][k + 1] AS engine,
    CASE WHEN (doc_id + k) % 11 = 0 OR doc_id % 97 = 0 THEN '' ELSE substr(text, 1, CAST(greatest(length(text) - k, 0) AS BIGINT)) END AS text,
    CAST(((doc_id * 37 + k * 29) % 101) / 100.0 AS DOUBLE) AS confidence,
    CASE WHEN (doc_id + k) % 5 = 0 OR lang = 'en' THEN 'eng' WHEN lang = 'de' THEN 'jpn' WHEN lang = 'fr' THEN 'kor' ELSE 'chi_sim' END AS language,
    [0.5, 0.2, 0.2, 0.1][k + 1]::DOUBLE AS weight,
    trim(CASE WHEN (doc_id + k) % 11 = 0 OR doc_id % 97 = 0 THEN '' ELSE substr(text, 1, CAST(greatest(length(text) - k, 0) AS BIGINT)) END, chr(32) || chr(10) || chr(9)) = '' AS blank
  FROM documents, range(4) r(k))"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_num"), F.coalesce("text", F.lit("")).alias("text"),
        (((F.col("conv_id") * 31 + F.col("turn") * 17) % 100) / 100.0).cast("double").alias("confidence"),
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "eng").when((F.col("conv_id") + F.col("turn")) % 3 == 1, "jpn").otherwise("kor").alias("language"),
    )


PAGES = """pages_ AS (
  SELECT conv_id AS doc_id, turn + 1 AS page_num, coalesce(text, '') AS text,
    CAST(((conv_id * 31 + turn * 17) % 100) / 100.0 AS DOUBLE) AS confidence,
    CASE (conv_id + turn) % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'jpn' ELSE 'kor' END AS language
  FROM conversations)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that are dealt by their id before they are cut: a page's words stand in one task, so grouping them moves no word again."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(parts, "doc_id").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("word_ord", "text"))
    o, d = F.col("word_ord"), F.col("doc_id")
    return docs.select(
        "doc_id", F.lit(1).alias("page_num"), "word_ord", "text", F.floor(o / 50).cast("int").alias("block_num"), F.floor(o / 10).cast("int").alias("line_num"),
        ((d * 13 + o * 7) % 101).cast("double").alias("confidence"),
        (o % 10 * 60).cast("int").alias("left"), (F.floor(o / 10) * 20 + (d + o) % 3).cast("int").alias("top"),
        (F.length("text") * 6).cast("int").alias("width"), (12 + (d + o) % 4).cast("int").alias("height"),
    )


WORDS = """words_ AS (
  SELECT doc_id, 1 AS page_num, o AS word_ord, w AS text, o // 50 AS block_num, o // 10 AS line_num,
    CAST((doc_id * 13 + o * 7) % 101 AS DOUBLE) AS confidence, o % 10 * 60 AS "left", o // 10 * 20 + (doc_id + o) % 3 AS top,
    length(w) * 6 AS width, 12 + (doc_id + o) % 4 AS height
  FROM (SELECT doc_id, unnest(list_zip(string_split(text, ' '), range(len(string_split(text, ' '))))) AS z FROM documents) t, LATERAL (SELECT z[1] AS w, z[2] AS o) l)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate regions on the pages of an order: boxes, circles, strokes, angles."""
    p, s, q, n = (F.col(x) for x in ("l_partkey", "l_suppkey", "l_quantity", "l_linenumber"))
    q = q.cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_num"), n.alias("shape_ord"),
        (p % 900).alias("x"), (s * 7 % 900).alias("y"), (20 + p % 300).alias("w"), (10 + q * 5).alias("h"), (30 + q * 2).alias("radius"),
        ((p % 100) / 25.0).cast("double").alias("mean"), ((s % 50) / 50.0).cast("double").alias("std"), ((q % 20) / 40.0).cast("double").alias("density"),
        (p % 181 - 90).cast("double").alias("angle"), (p % 3 == 0).alias("is_red"), (p % 2 == 0).alias("is_circle"), (1 + s % 12).cast("double").alias("thickness"),
    )


SHAPES = """shapes_ AS (
  SELECT l_orderkey AS doc_id, 1 AS page_num, l_linenumber AS shape_ord, l_partkey % 900 AS x, l_suppkey * 7 % 900 AS y, 20 + l_partkey % 300 AS w,
    10 + CAST(l_quantity AS BIGINT) * 5 AS h, 30 + CAST(l_quantity AS BIGINT) * 2 AS radius,
    CAST((l_partkey % 100) / 25.0 AS DOUBLE) AS mean, CAST((l_suppkey % 50) / 50.0 AS DOUBLE) AS std, CAST((CAST(l_quantity AS BIGINT) % 20) / 40.0 AS DOUBLE) AS density,
    CAST(l_partkey % 181 - 90 AS DOUBLE) AS angle, l_partkey % 3 = 0 AS is_red, l_partkey % 2 = 0 AS is_circle, CAST(1 + l_suppkey % 12 AS DOUBLE) AS thickness
  FROM lineitem)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), "value",
        F.create_map(F.lit("user"), (F.col("user_id") % 10).cast("string")).alias("tags"), (F.col("user_id") % 10).alias("tag"),
    )


METRICS = """metrics_ AS (
  SELECT event_id, ts, event_type AS name, value, user_id % 10 AS tag FROM events)"""
