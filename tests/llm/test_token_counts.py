import uuid

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkfold.llm import queries, token_counts
from inkfold.llm.token_counts import TokenizerFile, count_tokens, fill_cache

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  \n ", "Hello World", "hello\t\n world ", "a <|endoftext|> b", "a <|ENDOFTEXT|> b", "<|startoftext|><|endoftext|>", "it's we'll 12345 ́e ́", "é É ﬁ Σας ΣΑΣ", "漢字　かな 😀👍🏽", "x" * 3000, "\x1c\x1d  a\x85b", "\u0000nul", "a\x0bb\x0cc\rd"]


@pytest.fixture
def cache(tmp_path):
    return str(tmp_path / "cache")


def whole(texts, path=PATH):
    if path.endswith(".json"):
        own = Tokenizer.from_file(path)
        return [len(own.encode(x, add_special_tokens=False).ids) for x in texts]
    from sentencepiece import SentencePieceProcessor

    return [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts)]


def test_query_against_the_library(spark, tables):
    got = {r["doc_id"]: r for r in queries.op13_token_counts(spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    for (doc_id, text), n in zip(docs, whole([t or "" for _, t in docs])):
        assert tuple(got[doc_id]) == (doc_id, len((text or "").encode()), n, n > 2048)
    assert len(got) == len(docs)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_every_library_on_odd_texts(spark, cache, name):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    own = TokenizerFile.load(public_tokenizers.path(name))
    assert own.drops_white == (name == "word_bpe_49k.json")
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, own, cache).collect()}
    assert [got[k] for k in range(len(ODD))] == whole(ODD, public_tokenizers.path(name))


def test_long_texts_in_pieces_equal_whole_ones():
    text = " ".join(f"word{k} it's <|endoftext|> é ́x" for k in range(9000))
    cut = list(token_counts.pieces(text, 1000))
    assert " ".join(cut) == text and max(map(len, cut)) < 1100
    assert sum(whole(cut)) == whole([text])[0]
    assert list(token_counts.pieces("x" * 5000, 1000)) == ["x" * 5000]


def test_only_distinct_misses_are_encoded(spark, cache):
    own = TokenizerFile.load(PATH)
    docs = spark.createDataFrame([(k, f"text number {k % 7}") for k in range(60)] + [(99, "  text\nnumber 3 "), (100, None)], "doc_id bigint, text string")
    assert fill_cache(docs, own, cache) == 8
    assert fill_cache(docs, own, cache) == 0
    more = docs.union(spark.createDataFrame([(200, "something new"), (201, "something new")], docs.schema))
    assert fill_cache(more, own, cache) == 1
    more = more.union(spark.createDataFrame([(202, "something newer")], docs.schema))
    assert fill_cache(more, own, cache, broadcast_keys=0) == 1  # the way of many misses
    counts = token_counts.stored(spark, cache, own)
    assert counts.count() == 10
    counts.limit(4).write.mode("append").parquet(f"{cache}/tokenizer={own.digest}")  # as two runs at once would
    assert count_tokens(more, own, cache).count() == more.count()
    other = TokenizerFile.load(public_tokenizers.path("byte_bpe_50k.json"))
    assert other.digest != own.digest and fill_cache(docs, other, cache) == 9  # white space counts there


def test_odd_rows_and_empty_tables(spark, messy, empty, cache):
    own = TokenizerFile.load(PATH)
    df = messy.select("*", F.lit("x").alias("n_tokens"), F.lit(1).alias("content"), F.lit(2).alias("n_bytes"))
    out = count_tokens(df, own, cache)
    assert set(out.columns) == set(df.columns) | {"over_limit"}
    rows = out.collect()
    assert len(rows) == messy.count()
    for r, n in zip(rows, whole([r["text"] or "" for r in rows])):
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 2048)
    assert count_tokens(empty, own, f"{cache}-{uuid.uuid4().hex}").count() == 0


def test_words_leave_the_worker_store_and_come_back(monkeypatch):
    monkeypatch.setattr(token_counts, "WORDS", 40)
    own = token_counts.WordCounts(TokenizerFile.load(PATH).counter())
    texts = [" ".join(f"w{k * j % 61}x" + "y" * (k % 80) for k in [*range(90), *range(90)]) for j in range(1, 9)] + ["", "a"]
    assert [n for x in texts for n in own([x])] == whole(texts) == own(texts) and own.old and len(own.known) < 600


def test_hot_texts_take_the_other_way(spark, cache):
    df = spark.createDataFrame([(k, "the same text" if k % 3 else f"text {k}") for k in range(300)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, TokenizerFile.load(PATH), cache, hot_rows=50).collect()}
    assert got == dict(enumerate(whole([r["text"] for r in df.collect()])))


def test_files_are_checked(tmp_path):
    odd = tmp_path / "a.bin"
    odd.write_bytes(b"x")
    with pytest.raises(ValueError, match="no library"):
        TokenizerFile.load(str(odd))
