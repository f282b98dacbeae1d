"""Quality rules as a short-circuit cascade (operator 1); column functions only.

Each rule is a predicate that rejects a row.  On a bounded sample the rules'
rejection rates and running times are measured, and the rules are ordered by
rejection per cost.  The ordered rules become one CASE expression, which stops at
the first rule that rejects.  The order changes the work and which rule is named
first, never whether a row is kept.

Defined results: a null text has no words and fails the base rule, as does an
empty one; repeated rows get equal results; an empty table gives an empty result
and the rules keep the order they were given in.  Texts of any length are judged
whole, in time in proportion, also under a filter.  Columns of the input stay;
columns named like an output are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from .support import OWN, written

SAMPLE_ROWS, SAMPLE_BYTES, WINDOW, MIN_WORDS = 1000, 50_000, 8, 20
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"


FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
PLACES = "array<struct<h:bigint,g:int,at:int>>"


def _repeat_words(words: Column) -> Column:
    """Words in windows that come twice; ``words`` has to be bound.

    Only rows in which two windows share a hash sort their windows, and there two
    independent hashes have to agree.
    """
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    window = lambda i: [F.get(words, i + k) for k in range(WINDOW)]  # noqa: E731  a slice would copy the whole array each time
    pairs = lambda seen: F.array_sort(F.transform(seen, lambda h, i: F.struct(h.alias("h"), F.hash(*window(i)).alias("g"), i.alias("at"))))
    runs = bound(F.transform(starts, lambda i: F.xxhash64(*window(i))), lambda seen: F.when(F.size(F.array_distinct(seen)) < F.size(seen), pairs(seen)).otherwise(F.array().cast(PLACES)))
    first = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda s, at: F.struct((s["n"] + F.least(F.lit(WINDOW), at - s["last"])).alias("n"), at.alias("last"))

    def covered(runs: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            same = lambda y: F.coalesce((y["h"] == x["h"]) & (y["g"] == x["g"]), F.lit(False))
            return same(F.get(runs, i - 1)) | same(F.get(runs, i + 1))

        return F.aggregate(F.array_sort(F.transform(F.filter(runs, repeated), lambda x: x["at"])), first, step)["n"]

    return bound(runs, covered)


def features(text: Column) -> Column:
    """Struct of ``FEATURES``, in one expression that binds what it uses twice: however a filter on it is moved, it stays linear."""

    def of(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
        n_lines = bound(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")))
        n_words = bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeat_words(w).alias("rep")))
        both = bound(F.struct(n_words.alias("w"), n_lines.alias("l")), lambda x: F.struct(
            x["w"]["n"].alias("n_words"),
            F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(text, SYMBOLS, "")).cast("bigint").alias("n_symbols"),
            x["l"]["n"].alias("n_lines"), x["l"]["dup"].alias("n_dup_lines"), x["w"]["rep"].alias("n_repeat_words"),
        ))
        return both

    return bound(F.coalesce(text, F.lit("")), of)


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with word and line counts; words in repeated windows are found without leaving the row."""
    own = f"{OWN}features"
    out = docs.withColumn(own, features(F.col(text_col)))
    return out.withColumns({n: F.col(own)[n] for n in FEATURES}).drop(own)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules(text_col: str = "text") -> dict[str, Column]:
    """Rules over the features and the text; each is true for a row to reject."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        "repeated_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "few_letters": 10 * letters < 6 * F.col("word_chars"),
        "capitals": 10 * capitals > 4 * letters,
        "stutter": 5 * F.regexp_count(text, F.lit(r"(?:^|\s)(\S++)(?=\s+\1(?:\s|$))")) > F.col("n_words"),
    }


def take_sample(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``rows`` rows with texts of up to ``max_bytes``, so that a bounded piece passes the driver.

    ``take`` opens one partition after another until it has enough; a limit would read rows of each.
    """
    some = docs.filter(F.coalesce(F.octet_length(text_col), F.lit(0)) <= max_bytes).take(rows)
    return docs.sparkSession.createDataFrame(some, docs.schema)


def measure(sample: DataFrame, rules: Mapping[str, Column]) -> list[tuple[str, float, float]]:
    """(rule, rejection rate, seconds) on the sample."""
    sample = written(sample, "rule-sample")

    def timed(predicate: Column) -> tuple[float, int, int]:
        began = time.perf_counter()
        row = sample.agg(F.count_if(F.coalesce(predicate, F.lit(False))).alias("bad"), F.count("*").alias("n")).first()
        return time.perf_counter() - began, row["bad"], row["n"]

    idle = min(timed(F.lit(False))[0] for _ in range(2))
    out = []
    for name, predicate in rules.items():
        seconds, bad, n = min(timed(predicate) for _ in range(2))
        out.append((name, bad / max(n, 1), max(seconds - idle, 1e-3)))
    return out


def ordered(measured: list[tuple[str, float, float]]) -> list[str]:
    """Names by falling rejection per cost; equal ones keep their order."""
    return [name for name, _, _ in sorted(measured, key=lambda x: -x[1] / x[2])]


def cascade(docs: DataFrame, rules: Mapping[str, Column], sample: DataFrame) -> DataFrame:
    """``docs`` with ``rejected_by``: the first rule, in the order measured on ``sample``, that rejects the row, or null."""
    verdict = None
    for name in ordered(measure(sample, rules)):
        verdict = (F if verdict is None else verdict).when(rules[name], name)
    return docs.withColumn("rejected_by", F.lit(None).cast("string") if verdict is None else verdict)


def judge(docs: DataFrame, text_col: str = "text", rules: Mapping[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with features, ``base_failed``, ``rejected_by`` and ``kept``."""
    sample = with_features(take_sample(docs, text_col, sample_rows), text_col)
    out = cascade(with_features(docs, text_col), default_rules(text_col) if rules is None else rules, sample)
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
