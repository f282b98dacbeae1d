import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkfold.llm import simhash as op


def brute_print(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=3):
    left, out = set(prints), {}
    while left:
        todo, own = [left.pop()], []
        while todo:
            x = todo.pop()
            own.append(x)
            near = {y for y in left if (x ^ y).bit_count() <= distance}
            left -= near
            todo += near
        for x in own:
            out[x] = frozenset(own)
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \n", "One", "One Two", "A b C", "a b c d", "É É x y z", "the cat " * 50])
def test_fingerprint(text):
    assert op.fingerprint_of((text or "").encode()) == brute_print(text)


def test_lower_bound_never_exceeds_the_distance(spark):
    rng = random.Random(1)
    rows = [(signed(a := rng.getrandbits(64)), signed(a ^ sum(1 << k for k in rng.sample(range(64), 4)))) for _ in range(300)]
    out = spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", op.unary_counts(F.col("a")).alias("x"), op.unary_counts(F.col("b")).alias("y")).collect()
    for r in out:
        counts = lambda v: [(v >> k & 3).bit_count() for k in range(0, 64, 2)]
        l1 = sum(abs(p - q) for p, q in zip(counts(r["a"] & (1 << 64) - 1), counts(r["b"] & (1 << 64) - 1), strict=True))
        assert l1 == ((r["x"] ^ r["y"]) & (1 << 64) - 1).bit_count() <= ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count()


def test_three_axes_of_six_agree_within_the_distance():
    axes = len(op.grid_masks())
    assert axes == 20 and len(set(op.grid_masks())) == 20


@pytest.mark.parametrize("block", [1024, 8])
def test_components_of_dense_and_sparse_groups(spark, block):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(300)}
    dense = rng.getrandbits(64)
    for _ in range(120):  # one crowded neighbourhood
        prints.add(dense ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))))
    chain = rng.getrandbits(64)
    for k in range(0, 60, 3):  # a chain whose ends are far apart
        chain ^= 7 << k
        prints.add(chain)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp bigint").repartition(5)
    found = op.links(df, block=block)
    assert found.count() < 60 * len(prints)  # a forest per cell, not all pairs
    roots = {r["node"]: r["root"] for r in op.components(found).collect()}
    own = {}
    for x in prints:
        own.setdefault(roots.get(signed(x), signed(x)), set()).add(x)
    assert {frozenset(v) for v in own.values()} == set(brute_components(prints).values())


def test_runs_that_go_on_in_the_next_batch():
    import pyarrow as pa

    rows = np.array([(0, 5, 0, 0, k, 0) for k in range(6)] + [(1, 5, 0, 0, 1 << 40, 0)], np.int64)
    names = ["kind", "cell", "lo", "hi", "fp", "code"]
    batches = [pa.record_batch([pa.array(part[:, k]) for k in range(6)], names) for part in (rows[:1], rows[1:4], rows[4:])]
    out = [tuple(x.values()) for b in op._cell_links(3)(iter(batches)) for x in b.to_pylist()]
    assert {x for e in out for x in e} == set(range(6))


def test_near_copies_form_one_component(spark):
    base = " ".join(f"w{k * 7919 % 1000}" for k in range(400))
    rows = [(5, base), (3, base.upper()), (9, base + " extra"), (4, "something else entirely written here"), (8, None), (7, "")]
    out = {r["doc_id"]: r for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [out[k]["component_id"] for k in (3, 5, 9, 4, 8, 7)] == [3, 3, 3, 4, 7, 7]
    assert sorted(k for k, r in out.items() if r["representative"]) == [3, 4, 7] and out[8]["fingerprint"] == "0" * 16


def test_messy_rows_and_empty_tables(spark, messy, empty):
    out = op.near_duplicates(messy)
    assert out.count() == messy.count() and out.filter("representative").count() == out.select("fingerprint").join(out.select("fingerprint"), "fingerprint").select("fingerprint").distinct().count() - _merged(out)
    kept = op.one_of_each(messy)
    assert kept.columns == messy.columns and kept.filter("text = ''").count() + kept.filter("text is null").count() == 1
    assert op.near_duplicates(empty).count() == 0


def _merged(out):
    prints = [int(r["fingerprint"], 16) for r in out.select("fingerprint").distinct().collect()]
    return len(prints) - len(set(brute_components(prints).values()))
