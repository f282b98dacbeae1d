"""Merging the answers of several recognisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalar import confidence_band, is_blank, language_code, lookup, unit_interval

PAGE = ["doc_id", "page_num"]


def standardize(results: DataFrame, default: str = fixed.DEFAULT_LANGUAGE) -> DataFrame:
    """Clamp confidences, map language aliases, and blank the text of failed answers."""
    failed = F.col("error").isNotNull() if "error" in results.columns else F.lit(False)
    return (
        results.withColumn("confidence", F.when(failed, 0.0).otherwise(unit_interval(F.col("confidence"))))
        .withColumn("language", F.when(F.col("language") != "", language_code(F.col("language"), default)))
        .withColumn("text", F.when(failed, "").otherwise(F.coalesce("text", F.lit(""))))
    )


def with_weights(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weight of each engine; unknown engines weigh nothing."""
    return results.withColumn("weight", F.coalesce(lookup(weights or fixed.ENGINE_WEIGHTS, F.col("engine")), F.lit(0.0)))


def vote_language(results: DataFrame, default: str = fixed.DEFAULT_LANGUAGE) -> DataFrame:
    """The most frequent language of each page; a tie goes to the engine that comes first."""
    said = results.filter(F.col("language").isNotNull()).groupBy(*PAGE, "language").agg(F.count("*").alias("n"), F.min("engine_ord").alias("first"))
    voted = said.groupBy(*PAGE).agg(F.max_by("language", F.struct("n", -F.col("first"))).alias("voted"))
    return results.select(*PAGE).distinct().join(voted, PAGE, "left").select(*PAGE, F.coalesce("voted", F.lit(default)).alias("language"))


def _choice(threshold: float) -> dict[str, Column]:
    """Aggregates of one page that decide its text and confidence."""
    blank = is_blank(F.col("text"))
    score = F.col("confidence") * F.col("weight")
    fits = ~blank & (F.col("confidence") >= threshold)
    return {
        "best": F.max_by(F.when(fits, F.col("text")), F.when(fits, F.struct(score.alias("s"), (-F.col("engine_ord")).alias("o")))),
        "best_score": F.max(F.when(fits, score)),
        "longest": F.max_by("text", F.when(~blank, F.struct(F.length("text").alias("n"), (-F.col("engine_ord")).alias("o")))),
        "weighted": F.sum(score),
        "weights": F.sum("weight"),
        "mean": F.avg("confidence"),
        "fitting": F.count_if(fits),
        "written": F.count_if(~blank),
    }


def merge_texts(results: DataFrame, threshold: float = fixed.CONFIDENCE_THRESHOLD, detail: bool = False) -> DataFrame:
    """Text and confidence of each page.

    The best weighted answer among those at the threshold wins; without one, the
    longest text; all blank give an empty text and confidence 0.  A page's four
    answers lie together, so the partial aggregate ships one text per page.
    """
    extra = [F.array_sort(F.collect_list(F.struct("engine_ord", "engine", "confidence"))).alias("engines")] if detail else []
    agg = results.groupBy(*PAGE).agg(*[c.alias(k) for k, c in _choice(threshold).items()], *extra)
    worthless = (F.col("fitting") > 0) & (F.col("best_score") == 0)
    weighted = F.when(F.col("weights") > 0, F.col("weighted") / F.col("weights")).otherwise(F.col("mean"))
    text = F.when(worthless | (F.col("written") == 0), "").when(F.col("fitting") > 0, F.col("best")).otherwise(F.col("longest"))
    confidence = F.when(worthless | (F.col("written") == 0), 0.0).when(F.col("fitting") > 0, weighted).otherwise(F.col("mean"))
    return agg.select(*PAGE, text.alias("text"), confidence.alias("confidence"), *(["engines"] if detail else []))


def ensemble(results: DataFrame, threshold: float = fixed.CONFIDENCE_THRESHOLD, default: str = fixed.DEFAULT_LANGUAGE) -> DataFrame:
    """One row per page: text, confidence, language and the engines' detail."""
    return merge_texts(results, threshold, detail=True).join(vote_language(results, default), PAGE)


def compare_engines(results: DataFrame, engines: list[str] | None = None) -> DataFrame:
    """Confidence and text length of every engine side by side."""
    wide = results.groupBy(*PAGE).pivot("engine", engines or list(fixed.ENGINE_WEIGHTS))
    return wide.agg(F.first("confidence").alias("confidence"), F.first(F.length("text")).alias("chars"))


def best_scale(results: DataFrame) -> DataFrame:
    """Of a page read at several scales: the highest confidence with a text, earlier scales first; else the first scale."""
    blank = is_blank(F.col("text"))
    key = F.struct((~blank).alias("t"), F.when(blank, 0.0).otherwise(F.col("confidence")).alias("c"), (-F.col("scale_ord")).alias("o"))
    return results.groupBy(*PAGE).agg(F.max_by(F.struct("scale_ord", "text", "confidence"), key).alias("r")).select(*PAGE, "r.*")


def block_language(blocks: DataFrame, hint: str) -> DataFrame:
    """Language of the first block of a document with a known code."""
    code = lookup(fixed.BLOCK_LANGUAGE_CODES, F.col("language"))
    out = blocks.withColumn("code", code).groupBy("doc_id").agg(F.min_by("code", F.when(F.col("code").isNotNull(), F.struct("page_num", "block_num"))).alias("code"))
    return out.select("doc_id", F.coalesce("code", F.lit(hint)).alias("language"))


def confidence_bands(results: DataFrame) -> DataFrame:
    """Rows per confidence band and their share in per cent."""
    counts = results.groupBy(confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("band", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))
