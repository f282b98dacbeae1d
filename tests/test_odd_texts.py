"""The normalising queries against their SQL, and the full clean-up against plain Python, on texts with odd characters."""

import re
import unicodedata

import duckdb
import pytest
from odd_texts import odd_texts
from pyspark.sql import functions as F
from test_queries import rows

from inkfold import registry
from inkfold.functions import text as tx
from inkfold.functions.unicode import needs_folding


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("odd"))
    texts = odd_texts(5, 500) + ["shan $ 1142126282388588 on. limiled Ud. on Jan 3, 2023"]
    spark.createDataFrame([(n, t, ["en", "de", None, "en"][n % 4] if t != texts[-1] else "en") for n, t in enumerate(texts)], "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(n // 3, n % 3, t or "") for n, t in enumerate(texts)], "conv_id bigint, turn int, text string").coalesce(1).write.parquet(f"{out}/conversations.parquet")
    return out


@pytest.mark.parametrize("name", ["normalize_common", "normalize_by_language", "normalize_chinese", "normalize_japanese", "normalize_korean", "normalize_english", "normalize_pages"])
def test_odd_texts_as_in_the_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = registry.queries()[name](spark, folder).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want) and len(want) > 500


def test_full_clean_up_folds_odd_texts(spark, folder):
    """Documents in a language without rules: folding, all spaces, tails of addresses."""

    def plain(text):
        if not (text or "").strip():
            return text
        text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()
        return re.sub(r"([a-zA-Z0-9_.+-]+)@([a-zA-Z0-9-]+)\.([a-zA-Z0-9-.]+)", lambda m: f"{m[1]}@{m[2]}.{m[3].lower()}", text)

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for r in docs.select("text", tx.normalize_common(F.col("text")).alias("got")).collect():
        assert r["got"] == plain(r["text"]) or not (r["text"] or "").strip()
    got = {r["doc_id"]: r["text"] for r in registry.queries()["normalize_unicode"](spark, folder).collect()}
    for r in docs.filter("lang IS NULL").collect():
        if "@" in (r["text"] or ""):
            assert "Example.COM" not in got[r["doc_id"]]
    assert any(r["text"] and got[r["doc_id"]] != r["text"] for r in docs.collect())


#: Texts and what the reference's common clean-up makes of them.
FOLDED = {
    "ﬁve Ａ１ ①": "five A1 1", "é ｶﾞ": "é ガ", " a\xa0　b\x85\x1cc d ": "a b c d", "\xa0": "", " \n ": "", "": "",
    "to A.B@Mail.Example.COM. x": "to A.B@Mail.example.com. x", "Ａ＠Ｂ．ＣＯＭ": "A@B.com", "plain  text": "plain text", "a\0é": "a\0é", "q@x.Y_z@b.C": "q@x.y_z@b.c",
}


def in_sql_and_spark(spark, folder, name, texts, lang):
    """Results of a query by text, after the SQL was found to say the same."""
    spark.createDataFrame([(n, t, lang) for n, t in enumerate([*texts, None])], "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(folder)).toPandas()
    assert rows(got) == rows(con.execute(registry.oracle_sql()[name]).df())
    return dict(zip([*texts, None], [r[1] for r in sorted(rows(got))]))


def test_common_clean_up_is_the_whole_one(spark, tmp_path):
    assert in_sql_and_spark(spark, tmp_path, "normalize_common", FOLDED, "en") == FOLDED | {None: None}


def test_sql_folds_every_character_as_python_does():
    from inkfold.plans.folding import COMMON, through

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, 'en' AS lang, chr(i::INT) AS text FROM range(1114112) r(i) WHERE i NOT BETWEEN 55296 AND 57343")
    got = con.execute(through(COMMON[:2])).fetchall()
    assert len(got) == 1_112_064 and [n for n, t in got if t != unicodedata.normalize("NFKC", chr(n))] == []


def test_every_character_that_folds_is_folded(spark):
    chars = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    got = {r["id"] for r in chars.filter(needs_folding(F.concat(F.lit("a "), "c", F.lit("."))) | needs_folding(F.col("c"))).select("id").collect()}
    assert {n for n in range(0x110000) if unicodedata.normalize("NFKC", chr(n)) != chr(n)} <= got and not got & {*range(128), *map(ord, "éß가漢あ。")}


#: English texts and what all rules and formats make of them.
RULED = {
    "ﬁne. ok! Ａ．　é": "Fine. Ok! A. É", "Ud. Ud. xIlc Ilc limiled, limiledé": "Ltd. Ltd. XIlc LLC limited, limiledé", "Jan　3, 2023 éan ٣, 2023": "Jan 03, 2023 éan 0٣, 2023",
    "1/2/2023 1/22/2023 11/2/2023 ٣1/2/2023": "01/02/2023 01/22/2023 11/02/2023 ٣1/02/2023", "$ 0012345 or 98765 USD": "$12,345 or 98,765 USD", "Acme Inc Inc. Incé LLC. Corp": "Acme Inc. Inc. Incé LLC Corp.",
    "by A.B@Mail.Example.COM": "By A.B@Mail.example.com", "a\x01 1/2/2023\x01b": "A\x01 01/02/2023\x01b", " \n ": "", "": "",
}


def test_english_rules_and_formats_run_on_folded_texts(spark, tmp_path):
    assert in_sql_and_spark(spark, tmp_path, "normalize_by_language", RULED, "en") == RULED | {None: None}


def test_other_languages_get_the_whole_clean_up(spark, tmp_path):
    assert in_sql_and_spark(spark, tmp_path, "normalize_by_language", FOLDED, "de") == FOLDED | {None: None}
