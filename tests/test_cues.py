"""Rules that are tried only where their fixed part stands, against the same rules tried everywhere."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkfold.functions import fixed
from inkfold.functions import text as tx
from inkfold.operators import entities

PIECES = {
    "jpn": ["2023", "年", "3", "12", "月", "4", "日", "令和", "5年3月4日", "¥ 0012345", "98765 円", "株式含社", "有恨会社", "〒123 - 4567", "。", "﹅", " ", "x"],
    "kor": ["2023", "년 ", "3", "12", "월 ", "4", "일", "2023-1-2", "2023.11.2", "2023/1/22", "₩ 12345", "55555원", "(주) 식회사", "주 식 회 사", "123 45 67890", "1234567890", "테스트 를", ". ", " ", "x"],
    "eng": ["Jan 3, 2023", "1/2/2023", "1/22/2023", "11/2/2023", "$ 12345", "00012345 USD", "Acme Inc", "Corp.", "Ltd", "LLC.", "LLP", "limiled", "Ud.", "Ilc", ". ", "!", " ", "x", "9"],
    "chi_sim": ["。 ", "﹆", "３", "页", " ", "x"],
}


def everywhere(value, code):
    """The language's rules one after another, none of them behind a cue."""
    value = tx.LANGUAGE_RULES[code](value)
    for kind, pattern, to in fixed.BUSINESS_FORMATS.get(code, []):
        value = tx._format_rule(kind, pattern, to)(value)
    return value


@pytest.mark.parametrize("code", sorted(PIECES))
def test_formats_do_not_miss_a_rule(spark, code):
    rng = random.Random(code)
    rows = [(k, "".join(rng.choice(PIECES[code]) for _ in range(rng.randint(0, 9)))) for k in range(400)] + [(-1, None), (-2, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = df.select("text", tx.language_steps(F.col("text"), F.lit(code)).alias("got"), everywhere(F.col("text"), code).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in out)
    assert sum(r["got"] != r["text"] for r in out if r["text"]) > 100


def test_single_spaces_stay_and_runs_fold(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice([" ", "\t", "\n", "　", " ", "\x1c", "a", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in rows], "text string")
    for r in df.select("text", tx.collapse_spaces(F.col("text")).alias("got"), F.trim(F.regexp_replace("text", f"(?U){tx.SPACE}+", " ")).alias("want")).collect():
        assert r["got"] == r["want"]


def test_entities_do_not_miss_a_pattern(spark):
    words = ["Acme Holding", " Inc.", " Company", "Jan 3, 2023", "3 Feb 2023", "1/2/2023", "2023-1-2", "$ 1,234", "USD 12", "a@b.org", "+82 10 1234", "010-1234-5678", "株式会社X", "2023年1月2日", "¥ 12", "12円", "(주)가", "2023년 1월 2일", "2023.1.2", "₩5", "5원", " ", "x"]
    patterns = [entities.EMAIL, *fixed.PHONE_PATTERNS] + [p for rules in fixed.ENTITY_PATTERNS.values() for kind in rules.values() for p in kind]
    rng = random.Random(8)
    rows = [("".join(rng.choice(words) for _ in range(rng.randint(0, 5))),) for _ in range(300)]
    df = spark.createDataFrame(rows, "text string")
    for k in range(0, len(patterns), 8):
        some = patterns[k : k + 8]
        plain = [F.regexp_extract_all("text", F.lit("(?U)" + p), F.lit(0)) for p in some]
        for r in df.select(F.array(*[entities._all(F.col("text"), p) for p in some]).alias("got"), F.array(*plain).alias("want")).collect():
            assert r["got"] == r["want"]


def test_every_pattern_names_its_cue():
    free = [p for rules in fixed.ENTITY_PATTERNS.values() for kind in rules.values() for p in kind if not any(x in p for cue in entities.CUES for x in cue)]
    assert all(re.match(r"\\d", p) for p in free) and len(free) == 2
