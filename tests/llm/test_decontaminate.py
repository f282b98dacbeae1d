import random
import re

import pytest
from pyspark.sql import functions as F

from inkfold.llm import bytewords, decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, size=13):
    known = {}
    for i, t in items:
        w = words(t)
        k = min(size, len(w))
        for p in range(len(w) - k + 1) if k else ():
            known.setdefault(tuple(w[p : p + k]), set()).add(str(i) if i is not None else "")
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for k in range(1, size + 1):
            for p in range(len(w) - k + 1):
                if own := known.get(tuple(w[p : p + k])):
                    found |= own
                    hit.update(range(p, p + k))
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(3)
    pool = ["Aa", "bB", "c1", "é", "Ünï", "zz", "漢字"]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    items = [(k, text(rng.choice([0, 3, 7, 15, 20]))) for k in range(12)] + [(None, text(14)), (100, "Unique Passage!"), (100, "Unique Passage!"), (7, None)]
    docs = [text(rng.randint(0, 300)) for _ in range(30)] + [f"{text(40)} {t} {text(40)}" for _, t in items if t] + [None, "", "unique -- PASSAGE", "x " * 60 + "unique passage"]
    return docs, items


def found(spark, cases, **more):
    docs, items = cases
    df = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id bigint, text string").repartition(3)
    out = op.find_contamination(df, spark.createDataFrame(items, "item_id bigint, text string"), **more).orderBy("doc_id").collect()
    return [(r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in out]


def test_equals_brute_force(spark, cases):
    assert found(spark, cases) == brute(*cases)


def test_the_way_without_broadcast_is_equal(spark, cases):
    assert found(spark, cases, broadcast_bytes=0) == brute(*cases)


def test_texts_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(bytewords, "PIECE_BYTES", 50)
    data = ("Some words, longer-than others é漢字 " * 40 + "y" * 300).encode()
    hasher = bytewords.WordHasher()
    a, b, h = hasher.words(data)
    one = hasher.piece(data)
    assert [data[x:y].lower().decode() for x, y in zip(a, b, strict=True)] == words(data.decode())
    assert (a == one[0]).all() and (b == one[1]).all() and (h == one[2]).all()


def test_clean_removes_documents_and_spans(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "One, two THREE"), (2, "z " * 100 + "One, two THREE! end"), (3, "clean"), (4, None)], "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in op.clean(docs, bench).collect()}
    assert out == {2: "z " * 100 + "! end", 3: "clean", 4: None}


def test_messy_rows_and_empty_tables(spark, messy, empty):
    bench = spark.createDataFrame([(1, "seven wizards quietly mix")], "item_id bigint, text string")
    out = op.find_contamination(messy, bench)
    assert out.count() == messy.count() and out.filter("contaminated").count() == 3
    assert op.clean(messy, bench).columns == messy.columns and op.clean(messy, bench).count() == 9
    assert op.find_contamination(empty, bench).count() == 0
    none = op.find_contamination(messy, bench.filter("false"))
    assert none.agg(F.sum("n_hit")).first()[0] == 0


@pytest.mark.parametrize("limit", [0, 3000])
def test_large_benchmarks_are_verified_in_slices(spark, limit):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    long, two = text(2000), "".join("ab"[k.bit_count() % 2] for k in range(2048))
    other = two.translate(str.maketrans("ab", "ba"))  # another word of the same 64-bit hash
    items = [(1, long), (2, "the"), (3, two), (4, text(30)), (5, "z" * 5000), (6, "." * 5000)]
    docs = ["the " * 500, other, two, text(50) + " " + " ".join(long.split()[990:1040]) + " the " + text(50), long, "z" * 5000, "", None]
    assert found(spark, (docs, items), broadcast_bytes=limit) == brute(docs, items)


@pytest.mark.parametrize("n", [0, 1, 5, 12, 13, 14, 27, 400])
def test_pieces_have_the_windows_of_the_whole(n):
    data = " -- ".join(f"w{k * 7}" for k in range(n)).encode() + b"." * 200
    hasher = bytewords.WordHasher()
    listed = lambda x: [(w[0], int(h), w[4][a:b]) for w in [op.item_windows(x, hasher, 13)] for h, a, b in zip(*w[1:4])]
    whole = listed(data)
    cut = [w for x in op.pieces(data, 13, 120, hasher) for w in listed(x)]
    assert cut == whole


def test_a_large_benchmark_without_words_hits_nothing(spark):
    case = ["a b", None], [(1, "." * 2000), (2, "")]
    assert found(spark, case, broadcast_bytes=0) == brute(*case)
