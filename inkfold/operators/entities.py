"""Entities in texts, as rows of (document, page, type, value)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import has

PAGE = ["doc_id", "page_num"]


#: An address begins where its run of characters does or the last match ended, so long runs are read once.
EMAIL = r"(?:\G|(?<![a-zA-Z0-9._%+-]))" + fixed.EMAIL_PATTERN


#: Fixed parts of the patterns: a pattern that names one of a row matches only where one of the row stands.
CUES = [
    ("Inc", "Corp", "LLC", "Ltd", "LLP", "Limited"), ("Company",), tuple(fixed.MONTHS.split("|")), ("株式会社",), ("合同会社",), ("有限会社",),
    ("년",), ("주",), ("日",), ("₩",), ("원",), ("¥",), ("円",), ("\\$",), ("USD",), ("〒",), ("府", "県"), ("@",), ("\\+",), ("/",),
]


def _all(text: Column, pattern: str) -> Column:
    """All matches of ``pattern``; texts without any of its fixed parts are not searched."""
    flags = "(?U)" if re.search(r"\\[dsw]", pattern) else ""
    found = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(0))
    for parts in CUES:
        if any(x in pattern for x in parts):
            return F.when(has(*(x.strip("\\") for x in parts))(text), found).otherwise(F.array().cast("array<string>"))
    return found


def addresses(text: Column, around: int = fixed.ADDRESS_CONTEXT) -> Column:
    """Every hit of an address pattern with up to ``around`` characters on both sides.

    Positions are running lengths of the gaps and hits, so overlapping contexts are all kept.
    """
    found = []
    for pattern in fixed.ADDRESS_PATTERNS:
        gaps, hits = F.split(text, pattern, -1), _all(text, pattern)
        steps = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(hit), F.lit(0)).alias("hit")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("out"))
        walk = F.aggregate(
            steps, start,
            lambda s, x: F.struct((s["at"] + x["gap"] + x["hit"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("at"), x["hit"].alias("n")))).alias("out")),
        )["out"]
        spans = F.filter(walk, lambda x: x["n"] > 0)
        found.append(F.transform(spans, lambda x: F.substr(text, F.greatest(x["at"] - around, F.lit(0)) + 1, x["at"] + x["n"] + around - F.greatest(x["at"] - around, F.lit(0)))))
    return F.concat(*found)


def extract_entities(df: DataFrame, column: str = "text", lang: str = "lang") -> DataFrame:
    """Distinct entities per page; e-mails and phones in every language, the rest where rules exist."""
    text = F.coalesce(F.col(column), F.lit(""))
    none = F.array().cast("array<string>")
    found = {"emails": _all(text, EMAIL), "phones": F.concat(*[_all(text, p) for p in fixed.PHONE_PATTERNS])}
    for kind in ("companies", "dates", "amounts"):
        branches = F
        for code, rules in fixed.ENTITY_PATTERNS.items():
            branches = branches.when(F.col(lang) == code, F.concat(*[_all(text, p) for p in rules[kind]]))
        found[kind] = branches.otherwise(none)
    found["addresses"] = F.when(F.col(lang) == "jpn", addresses(text)).otherwise(none)
    rows = F.array(*[F.struct(F.lit(kind).alias("entity_type"), values.alias("values")) for kind, values in found.items()])
    out = df.select(*PAGE, F.inline(rows)).select(*PAGE, "entity_type", F.explode("values").alias("value"))
    return out.dropDuplicates()


def rollup_entities(entities: DataFrame) -> DataFrame:
    """Union of the pages' entities per document and type."""
    return entities.groupBy("doc_id", "entity_type").agg(F.array_sort(F.collect_set("value")).alias("values"))


def filter_entities(entities: DataFrame, kind: str) -> DataFrame:
    return entities if kind == "all" else entities.filter(F.col("entity_type") == kind)


def entity_counts(entities: DataFrame, kinds: list[str] = fixed.ENTITY_TYPES) -> DataFrame:
    """Entities per type, with zero for types that do not occur."""
    counts = [F.count_if(F.col("entity_type") == k).alias(k) for k in kinds]
    rows = F.array(*[F.struct(F.lit(k).alias("entity_type"), F.col(k).alias("n"), (F.col(k) > 0).alias("present")) for k in kinds])
    return entities.agg(*counts).select(F.inline(rows))
