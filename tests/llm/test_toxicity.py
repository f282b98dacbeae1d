import pytest
from pyspark.sql import functions as F

from inkfold.llm import toxicity as op
from inkfold.llm.support import held_out


def labelled(spark, n=400):
    rows, marks = [], []
    for k in range(n):
        bad = k % 5 == 0
        words = [f"wort{(k * 31 + j * 17) % 600}" for j in range(60)] + (["You", "GROBLIAN" if k % 2 else "groblianisch", "idiot" if k % 3 else "ld"] if bad else [])
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_stems_are_learned_and_held_out_rows_are_right(spark):
    docs, labels = labelled(spark)
    weights, _ = op.learn(docs, labels)
    assert any("groblian".startswith(t) or t.startswith("groblian") for t in weights)
    out = op.score_toxicity(docs, labels).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    assert out.filter("predicted != toxic").count() == 0 and out.count() > 50


@pytest.mark.parametrize(("text", "hits"), [("you 1d10t", 1), ("you ЅТUРID fool", 1), ("idiotic!", 1), ("a trash can", 0), ("trash, can", 1), ("unidiot", 0), ("st­upid", 1), ("$tup1d", 1), ("ｍｏｒｏｎ", 1), ("", 0)])
def test_folding_and_exceptions(text, hits):
    lexicon = op.Lexicon(dict.fromkeys(op.LEXICON, 2.0))
    assert lexicon.hits(text)[0] == hits


def test_copies_count_once(spark):
    rows = [(k, " ".join(f"clean{(k * 7 + j) % 90}" for j in range(20)), 0) for k in range(200)] + [(1000 + k, "copied strange passage with idiot inside", 1) for k in range(100)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id bigint, toxic int")
    weights, _ = op.learn(docs, labels)
    assert set(weights) == set(op.LEXICON)


def test_without_labels_the_fixed_list_counts(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "hello")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["predicted"] for r in op.score_toxicity(docs, none).orderBy("doc_id").collect()] == [1, 0]


def test_messy_rows_and_empty_tables(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 1), (None, 1, 1), (3, None, None), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    out = op.score_toxicity(messy, labels)
    assert out.count() == messy.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert op.drop_toxic(messy, labels).columns == messy.columns
    assert op.score_toxicity(empty, labels).count() == 0 and op.score_toxicity(empty, labels.filter("false")).count() == 0


def learned(spark, rows):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    sample = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    return set(op.learn(docs, sample)[0]) - set(op.LEXICON)


def filler(k):
    return " ".join(f"wort{(k * 31 + j * 17) % 600}" for j in range(60))


def test_rare_stems_beside_common_ones_are_learned(spark):
    common = "aalfratz bumsnase dorfdepp faulpelz gierhals"
    rows = [(f"{filler(k)} {common}" + " zwickler" * (k % 5 == 0), 1) for k in range(100)] + [(filler(k), 0) for k in range(300)]
    assert learned(spark, rows) >= {*common.split(), "zwickler"}


def test_common_words_do_not_crowd_out_rare_stems(spark):
    import xxhash

    letters = "abcdefghijklmnopqrstuvwxyz"
    words = sorted(("".join(letters[k // 26**j % 26] for j in range(3)) + "qwxyzkjhv" for k in range(2600)), key=lambda w: xxhash.xxh64_intdigest(w.encode()))
    rows = [(" ".join(words[k:]) + " zwickler" * (k < 10), 1) for k in range(16)] + [(" ".join(words) if k < 16 else f"drei{k} sonst", 0) for k in range(300)]
    assert learned(spark, rows) == {"zwickler"}


def test_stems_that_chance_explains_are_not_learned(spark):
    rows = [(filler(k) + " zufall" * (k < 4), 1) for k in range(100)] + [(filler(k), 0) for k in range(300)]
    assert learned(spark, rows) == set()
