"""Quality classifier and language identification: held-out accuracy and odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from inkfold.llm import language_id, quality_model as op
from inkfold.llm.support import held_out


def labelled(spark, n=600):
    rng, rows, marks = random.Random(4), [], []
    for k in range(n):
        words = [f"{rng.choice('bdfgklm')}{rng.choice('aeiou')}{rng.choice(['n', 'rst', 'll'])}" for _ in range(rng.randint(30, 200))]
        if k % 4 == 0:
            words = [w + rng.choice(["***", "%%%"]) for w in words] if k % 8 else [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words)))
        marks.append((k, int(k % 4 > 0), 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    out = op.score_quality(docs, labels).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    assert out.count() > 80 and out.filter("predicted = quality").count() >= 0.97 * out.count()


def test_held_out_labels_change_nothing(spark):
    docs, labels = labelled(spark, 200)
    other = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (op.score_quality(docs, x).orderBy("doc_id").collect() for x in (labels, other))
    assert [r["score"] for r in a] == [r["score"] for r in b]


def test_temperature_calibrates_noisy_labels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (rng.random(2000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    net = op.Network(x, y)
    p = net.score(rng.normal(size=(500, 4)))
    assert net.temperature >= 0.5 and 0 <= p.min() and p.max() <= 1


def test_messy_rows_and_empty_tables(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 1), (None, 1, 1), (3, None, None), (9, 0, 1), (8, 0, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = op.score_quality(messy, labels)
    assert out.count() == messy.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert op.score_quality(empty, labels).count() == 0
    assert op.score_quality(messy, labels.filter("false")).filter("score = 0.5").count() == messy.count()


TEXT = {"en": "the river and the house of the old man with water and bread for the children", "de": "der Fluss und das Haus des alten Mannes mit Wasser und Brot und nicht der Kinder", "fr": "la rivière et la maison du vieil homme avec de l'eau et du pain pour les enfants", "es": "el río y la casa del hombre viejo con agua y pan para los niños y las niñas"}


def test_evidence_is_fused(spark):
    docs = spark.createDataFrame([(k, t * 3) for k, t in TEXT.items()], "lang string, text string")
    rows = [(n, f"https://{k}.site.org/a/{n}", f'<html lang="{k}"><p>{t}</p>') for n, (k, t) in enumerate(TEXT.items())]
    rows += [(10, "https://x.org/de/a", f"<p>{TEXT['de']}</p>"), (11, "https://x.org/", f'<html lang="fr"><p>{TEXT["es"] * 4}</p>'), (12, "https://de.site.org/b", ""), (13, None, None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    out = {r["page_id"]: r for r in language_id.identify(pages, docs).collect()}
    assert [out[k]["language"] for k in range(4)] == list(TEXT)
    assert (out[10]["language"], out[11]["language"], out[12]["language"]) == ("de", "es", "de")
    assert out[13]["language"] in TEXT and all(0 <= r["probability"] <= 1 for r in out.values())


def test_addresses(spark):
    urls = {"https://a.org/en/7?x": "en", "https://de.a.org/": "de", "http://a.fr/x": "fr", "https://a.org/x/es": "es", "https://a.org/denmark": None, "nonsense": None, None: None}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", language_id.address_language(F.col("u"), language_id.LANGUAGES).alias("l"))
    assert {r["u"]: r["l"] for r in df.collect()} == urls


def test_pages_of_the_test_tables(spark, tables):
    pages, docs = spark.read.parquet(f"{tables}/pages.parquet"), spark.read.parquet(f"{tables}/documents.parquet")
    blind = pages.withColumn("html", F.regexp_replace("html", " lang=\"..\"", "")).withColumn("url", F.regexp_replace("url", "/(en|de|fr|es)/", "/"))
    told = pages.select("page_id", language_id.declared_language(F.col("html")).alias("want"))
    out = language_id.identify(blind, docs).join(told, "page_id")
    assert out.filter("language = want").count() >= 0.97 * out.count()


def test_language_of_empty_tables(spark):
    none = spark.createDataFrame([], "page_id int, url string, html string")
    docs = spark.createDataFrame([], "lang string, text string")
    assert language_id.identify(none, docs).count() == 0
    one = spark.createDataFrame([(1, "u", "x", "clash", "clash")], "page_id int, url string, html string, language string, host string")
    assert language_id.identify(one, docs).first()["language"] in language_id.LANGUAGES
