import hashlib
import re
import time
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkfold.llm import periodic_runs, queries


def brute_runs(words):
    """(start, length, period) by comparing the words with themselves at every shift."""
    ids = {}
    w, found = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64), {}
    for q in range(1, len(w) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (w[:-q] == w[q:]).astype(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b + q - a >= max(12, 2 * q):
                found.setdefault((a, b + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def check(texts):
    for words, got in zip(texts, periodic_runs.scan([" ".join(w).encode() for w in texts]), strict=True):
        runs = brute_runs(words)
        assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == runs
        assert got["collapsed"] == collapsed(words, runs) and got["n_words"] == len(words)


WORDS = st.lists(st.sampled_from("ab"), max_size=70) | st.lists(st.sampled_from("abcdefgh"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(WORDS, st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.integers(0, 6), WORDS), min_size=1, max_size=4))
def test_small_alphabets_against_brute_force(parts):
    check([a + u * k + b + a for a, u, k, b in parts])


def test_long_periods_nested_runs_and_copies():
    block = [f"w{k}" for k in range(300)]
    line = "all rights reserved by the same owner .".split()
    nested = (["a", "b"] * 8 + ["c"]) * 5
    texts = [block + block + block[:7], block + block[:299], nested, line * 3 + block + line * 2, nested, ["x"] * 12, ["x"] * 11, ["a", "b", "c", "d", "e", "f"] * 2, []]
    check(texts)
    copies = [block + ["same"] * 20 + block] * 40
    check(copies)


def test_long_texts_take_time_in_proportion():
    def seconds(n):
        text = " ".join(f"w{k % 977}x{k % 13}" for k in range(n)) + " a b" * n
        began = time.perf_counter()
        out = next(periodic_runs.scan([text.encode()]))
        assert out["runs"]
        return time.perf_counter() - began

    seconds(2_000)
    assert seconds(80_000) < 3 * seconds(40_000) + 0.5


def test_odd_rows_and_empty_tables(spark, messy, empty):
    out = periodic_runs.find_runs(messy)
    assert set(out.columns) == set(messy.columns) | {"n_words", "runs", "collapsed"}
    for r in out.collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w]
        assert r["n_words"] == len(words)
        if len(words) < 5000:
            runs = brute_runs(words)
            assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == collapsed(words, runs)
    assert out.count() == messy.count() and periodic_runs.find_runs(empty).count() == 0
    one = spark.createDataFrame([(1, "z " * 30, "a", "b", [3])], "doc_id int, text string, n_words string, collapsed string, runs array<int>")
    got = periodic_runs.find_runs(one).first()
    assert got["n_words"] == 30 and got["collapsed"] == "z" and [tuple(x) for x in got["runs"]] == [(0, 30, 1)]


def test_query_against_brute_force(spark, tables):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        h = crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            a, n = h // 10 % len(words), len(words)
            words = [words[i if i < a else a + (i - a) % (1 + (n - a) // (3 + h // 10 % 8))] for i in range(n)]
        if len(words) > 6000:
            continue  # brute force grows with the square
        runs, r = brute_runs(words), got[doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == ((len(runs), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2])))
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
