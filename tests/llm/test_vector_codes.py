import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import queries, vector_codes
from inkfold.llm.vector_codes import Bounded, Codebook, compress_vectors, encode_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(ints, entries=256, rounds=4):
    """Codes, errors and codebooks by looking at every entry; rows are in the order of their ids."""
    width = ints.shape[1] // 4
    parts = [ints[:, p * width : (p + 1) * width] for p in range(4)]
    books = [x[:entries].copy() for x in parts]
    for left in range(rounds, -1, -1):
        found = [((x[:, None, :] - b[None]) ** 2).sum(2) for x, b in zip(parts, books)]
        if left:
            for x, b, d in zip(parts, books, found):
                at = d.argmin(1)
                for k in np.unique(at):
                    b[k] = x[at == k].sum(0) // (at == k).sum()
    codes = ["".join(f"{d[i].argmin():02x}" for d in found) for i in range(len(ints))]
    return codes, sum(d.min(1) for d in found), hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def numbers(embedding):
    return np.floor(np.array(embedding, np.float32).astype(np.float64) * 1024).astype(np.int64)


def test_query_against_the_plain_method(spark, tables):
    rows = sorted(spark.read.parquet(f"{tables}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])
    codes, errors, digest = plain(numbers([r["embedding"] for r in rows]))
    got = {r["vec_id"]: r for r in queries.op12_vector_codes(spark, tables).collect()}
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r["label"]] = by_label.get(r["label"], 0) + int(e)
    for r, c, e in zip(rows, codes, errors):
        assert tuple(got[r["vec_id"]])[1:] == (c, e, by_label[r["label"]], digest)


@pytest.mark.parametrize("bounds", [0, 1, 3, 16])
def test_ties_repeats_and_every_number_of_bounds(spark, bounds):
    rng = np.random.default_rng(5)
    grid = rng.integers(-3, 4, (900, 8)).astype(np.float32) / 64  # few values: many ties and equal parts
    grid[300:600] = grid[0]  # a third of all rows is one vector
    df = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(grid)], SCHEMA)
    codes, errors, digest = plain(numbers(grid), 16)
    got = sorted(compress_vectors(df.repartition(5), entries=16, bounds=bounds).collect(), key=lambda r: r["vec_id"])
    assert [r["code"] for r in got] == codes and [r["error"] for r in got] == errors.tolist() and {r["codebooks_sha256"] for r in got} == {digest}


def test_bounds_hold_and_spare_comparisons():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (64, 16))
    x = centres[rng.integers(0, 64, 4000)] + rng.integers(-40, 41, (4000, 16))
    first = Bounded(x, Codebook(centres, np.zeros(64), 8))
    out = first.first()
    moved = centres + rng.integers(-5, 6, centres.shape)
    book = Codebook(moved, np.sqrt(((moved - centres) ** 2).sum(1)) * 1.001, 8)
    again = Bounded(x, book).again(out["code"], out["upper"] * 1.0001, out["near"], out["lower"].astype(np.float32).astype(float))
    d = ((x[:, None, :] - moved[None]) ** 2).sum(2)
    assert (again["code"] == d.argmin(1)).all() and (Bounded(x, book).exact(again) == d.min(1)).all()
    listed = np.sqrt(np.take_along_axis(d, again["near"].astype(int), 1))
    assert (again["lower"][:, :8] <= listed + 1e-6).all() and (np.diff(again["lower"], axis=1) >= -1e-9).all()
    rest = d.astype(float)
    np.put_along_axis(rest, np.column_stack((again["code"], again["near"])).astype(int), np.inf, 1)
    assert (again["lower"][:, 8] <= np.sqrt(rest.min(1)) + 1e-6).all()
    assert (again["used"] == 9).mean() < 0.05 and (again["used"] == 0).mean() > 0.5


def test_odd_rows_and_empty_tables(spark):
    v = [0.1 * k for k in range(8)]
    bad = [(10, None, 1), (11, [None] + v[1:], 1), (12, [float("nan")] + v[1:], 1), (13, [float("-inf")] + v[1:], 1), (14, v[:4], 1), (15, [], 1)]
    good = [(2, v, None), (1, v[::-1], 7), (1, v[::-1], 7), (None, v, None), (3, [-x for x in v], 7)]
    df = spark.createDataFrame(bad + good, SCHEMA).select("*", F.lit("x").alias("code"), F.lit("y").alias("state"), F.lit(0).alias("id"))
    got = sorted(compress_vectors(df).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    assert [r["vec_id"] for r in got] == [1, 1, 2, 3, None] and {r["error"] for r in got} == {0} and {r["label_error"] for r in got} == {0}
    assert got[0]["code"] == got[1]["code"] == "00000000" and got[2]["code"] == got[4]["code"] == "02020202"
    assert compress_vectors(df.limit(0)).count() == 0
    assert {r["code"] for r in compress_vectors(spark.createDataFrame([(1, [], 1), (2, [], 2)], SCHEMA)).collect()} == {"00000000"}
    odd = compress_vectors(spark.createDataFrame([(1, v[:5], 1), (2, v[1:6], 2)], SCHEMA)).collect()  # padded to eight
    assert [r["code"] for r in sorted(odd)] == ["00000000", "01010100"]
    with pytest.raises(ValueError, match="do not fit"):
        compress_vectors(spark.createDataFrame([(1, [3e38] * 4, 1)], SCHEMA))
    codes, books = encode_vectors(spark.createDataFrame(good, SCHEMA), rounds=0)
    assert codes.count() == 5 and len(books) == 4 and vector_codes.digest(books)
