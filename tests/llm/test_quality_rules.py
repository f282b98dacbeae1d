import random
import re
import time

from pyspark.sql import functions as F

from inkfold.llm import quality_rules as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    w, seen, rep = WORD.findall(text), {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                rep.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


def test_features_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "\n\n", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 40, "é😀 ß\x0b漢\x85字 |*"]
    for _ in range(60):
        texts.append("".join(rng.choice(["ab", "c", "#", "é", "zz"]) + rng.choice([" ", "\n", "\t ", "  "]) for _ in range(rng.randint(0, 200))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in op.with_features(df).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_rules_are_ordered_by_rejection_per_cost():
    assert op.ordered([("slow", 0.5, 5.0), ("fast", 0.2, 0.1), ("never", 0.0, 0.1), ("tie", 0.0, 0.2)]) == ["fast", "slow", "never", "tie"]


def test_order_changes_no_verdict(spark):
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("text"))
    rules = {"a": F.col("id") % 2 == 0, "b": F.col("id") % 3 == 0}
    back = dict(reversed(rules.items()))
    kept = [op.cascade(df, r, df.limit(50)).filter("rejected_by is null").count() for r in (rules, back)]
    assert kept == [333, 333]


def test_clean_texts_are_kept_and_junk_is_not(spark):
    CLEAN = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix twelve potions near some old castle wall"

    junk = ["SHOUTING LOUD!! " * 20, " | ".join(f"w{k}" for k in range(60)), "%%% ".join(f"word{k}" for k in range(60)), " ".join(f"{w} " * 7 for w in CLEAN.split())]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([CLEAN + " " + CLEAN.upper().title(), *junk])], "doc_id int, text string")
    assert [r["kept"] for r in op.judge(df).orderBy("doc_id").collect()] == [True, False, False, False, False]


def test_messy_rows_and_empty_tables(messy, empty):
    out = op.judge(messy)
    assert out.count() == messy.count() and out.filter("n_words is null or kept is null").count() == 0
    assert out.filter("text is null and not base_failed").count() == 0
    assert op.judge(empty).count() == 0


def test_filters_on_features_stay_linear(spark, tmp_path):
    def seconds(n):
        path = str(tmp_path / str(n))
        spark.createDataFrame([(1, " ".join("".join(chr(97 + k // 26**j % 26) for j in range(5)) for k in range(n)))], "doc_id int, text string").write.parquet(path)
        began = time.perf_counter()
        rows = op.judge(spark.read.parquet(path)).filter("kept and n_words > 5").collect()
        assert len(rows) == 1
        return time.perf_counter() - began

    seconds(500)
    assert seconds(120_000) < 30


def test_kept_rows_of_given_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    out = op.judge(docs)
    kept = {r["doc_id"] for r in out.collect() if r["kept"]}
    assert {r["doc_id"] for r in out.filter("kept").select("doc_id").collect()} == kept and kept
