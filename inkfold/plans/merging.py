"""Queries over recogniser answers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import ensemble as op
from .derived import ENGINE_RESULTS, engine_results

THRESHOLD = fixed.CONFIDENCE_THRESHOLD


def _ready(spark, d):
    return op.with_weights(op.standardize(engine_results(spark, d)))


def standardize(spark, d):
    return op.standardize(engine_results(spark, d)).select("doc_id", "engine_ord", "engine", F.md5("text").alias("text_md5"), "confidence", "language")


def weights(spark, d):
    return _ready(spark, d).groupBy("engine", "weight").agg(F.count("*").alias("n"))


def vote_language(spark, d):
    return op.vote_language(_ready(spark, d))


def best_text(spark, d):
    return op.merge_texts(_ready(spark, d)).select("doc_id", "page_num", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


def ensemble_confidence(spark, d):
    return op.merge_texts(_ready(spark, d)).select("doc_id", "page_num", F.round("confidence", 6).alias("confidence"))


def ensemble(spark, d):
    out = op.ensemble(_ready(spark, d))
    return out.select("doc_id", "page_num", "language", "text", F.round("confidence", 6).alias("confidence"), F.size("engines").cast("bigint").alias("n_engines"))


def engine_comparison(spark, d):
    out = op.compare_engines(_ready(spark, d))
    return out.select("doc_id", "page_num", *[F.col(f"{e}_{c}").alias(f"{e}_{c}") for e in fixed.ENGINE_WEIGHTS for c in ("confidence", "chars")])


def best_scale(spark, d):
    scaled = _ready(spark, d).filter("engine_ord < 3").withColumnRenamed("engine_ord", "scale_ord")
    return op.best_scale(scaled).select("doc_id", "page_num", "scale_ord", F.md5("text").alias("text_md5"), "confidence")


def block_language(spark, d):
    blocks = engine_results(spark, d).withColumnRenamed("engine_ord", "block_num").withColumn("language", F.when(F.col("block_num") > 0, F.col("language")))
    return op.block_language(blocks, "eng")


def confidence_bands(spark, d):
    return op.confidence_bands(_ready(spark, d))


_TOP = f"""WITH {ENGINE_RESULTS},
fits AS (SELECT *, confidence * weight AS score, NOT blank AND confidence >= {THRESHOLD} AS fit FROM engine_results),
ranked AS (SELECT *,
    row_number() OVER (PARTITION BY doc_id ORDER BY fit DESC, score DESC, engine_ord) AS by_score,
    row_number() OVER (PARTITION BY doc_id ORDER BY blank, length(text) DESC, engine_ord) AS by_length FROM fits),
page AS (SELECT doc_id, page_num, count(*) FILTER (fit) AS n_fit, count(*) FILTER (NOT blank) AS n_text, max(score) FILTER (fit) AS best,
    sum(score) AS weighted, sum(weight) AS weights, avg(confidence) AS mean,
    max(text) FILTER (by_score = 1) AS best_text, max(text) FILTER (by_length = 1) AS longest FROM ranked GROUP BY doc_id, page_num),
merged AS (SELECT doc_id, page_num,
    CASE WHEN n_text = 0 OR (n_fit > 0 AND best = 0) THEN '' WHEN n_fit > 0 THEN best_text ELSE longest END AS text,
    CASE WHEN n_text = 0 OR (n_fit > 0 AND best = 0) THEN 0.0 WHEN n_fit > 0 THEN weighted / weights ELSE mean END AS confidence FROM page),
votes AS (SELECT doc_id, page_num, language, count(*) AS n, min(engine_ord) AS f FROM engine_results GROUP BY ALL),
voted AS (SELECT doc_id, page_num, language FROM votes QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY n DESC, f) = 1)
"""

QUERIES = {
    "standardize": (standardize, f"WITH {ENGINE_RESULTS} SELECT doc_id, engine_ord, engine, md5(text) AS text_md5, confidence, language FROM engine_results"),
    "weights": (weights, f"WITH {ENGINE_RESULTS} SELECT engine, weight, count(*) AS n FROM engine_results GROUP BY ALL"),
    "vote_language": (vote_language, _TOP + "SELECT doc_id, page_num, language FROM voted"),
    "best_text": (best_text, _TOP + "SELECT doc_id, page_num, md5(text) AS text_md5, length(text) AS chars FROM merged"),
    "ensemble_confidence": (ensemble_confidence, _TOP + "SELECT doc_id, page_num, round(confidence, 6) AS confidence FROM merged"),
    "ensemble": (ensemble, _TOP + "SELECT doc_id, page_num, language, text, round(confidence, 6) AS confidence, 4 AS n_engines FROM merged JOIN voted USING (doc_id, page_num)"),
    "engine_comparison": (engine_comparison, f"WITH {ENGINE_RESULTS} SELECT doc_id, page_num, " + ", ".join(f"max(confidence) FILTER (engine = '{e}') AS {e}_confidence, max(length(text)) FILTER (engine = '{e}') AS {e}_chars" for e in fixed.ENGINE_WEIGHTS) + " FROM engine_results GROUP BY ALL"),
    "best_scale": (best_scale, f"WITH {ENGINE_RESULTS} SELECT doc_id, page_num, engine_ord AS scale_ord, md5(text) AS text_md5, confidence FROM engine_results WHERE engine_ord < 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY blank, CASE WHEN blank THEN 0 ELSE confidence END DESC, engine_ord) = 1"),
    "block_language": (block_language, f"WITH {ENGINE_RESULTS}, known AS (SELECT doc_id, engine_ord, CASE language WHEN 'eng' THEN 1 END AS x, CASE WHEN engine_ord % 2 = 1 THEN language END AS code FROM engine_results WHERE engine_ord > 0) SELECT doc_id, coalesce(arg_min(CASE WHEN code IN ('eng', 'jpn', 'kor') THEN code END, CASE WHEN code IN ('eng', 'jpn', 'kor') THEN engine_ord END), 'eng') AS language FROM known GROUP BY doc_id"),
    "confidence_bands": (confidence_bands, f"WITH {ENGINE_RESULTS}, b AS (SELECT CASE WHEN confidence > 0.9 THEN 'success' WHEN confidence > 0.7 THEN 'primary' WHEN confidence > 0.5 THEN 'warning' ELSE 'danger' END AS band, count(*) AS n FROM engine_results GROUP BY 1) SELECT band, n, round(100 * n / (SELECT sum(n) FROM b), 1) AS percent FROM b"),
}
