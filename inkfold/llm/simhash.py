"""SimHash near-duplicates by segment popcounts (operator 3).

A fingerprint has 32 segments of two bits.  The count of set bits per segment,
written in unary (0: 00, 1: 01, 2: 11), is again 64 bits long, and the number
of differing bits of two such codes is the Manhattan distance of the counts, a
lower bound of the fingerprints' own distance.  The segments form ``distance+3``
grid axes; within ``distance`` at least three axes agree exactly, so every
fingerprint is posted to one grid cell per choice of three axes.  Inside a cell
the lower bound is tested first and then the fingerprints themselves.

A cell yields a spanning forest of its links, never all its pairs.  Cells of
more than ``block`` fingerprints are dealt out as pairs of blocks, so that no
task holds more than two blocks of one cell.  Links are contracted to components
by alternating star rounds, each one written to the checkpoint folder.

Defined results: null, empty and blank texts have no words and fingerprint zero,
and link like any other; repeated rows are one component; the component id is
the smallest id reachable, null if all reachable ids are null.  Columns of the
input stay; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import texts_as_bytes
from .support import OWN, arrow_column, written

SHINGLE, SEED, DISTANCE, BLOCK = 3, 42, 3, 1024
LOW = 0x5555555555555555
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_of(data: bytes, shingle: int = SHINGLE) -> int:
    """Words are runs without ASCII white space; A-Z count as a-z."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(x) for x in zip(*(words[k:] for k in range(shingle)), strict=False)]
    hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in parts], "<u8")
    places = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").tobytes(), "little")


@arrow_column("bigint")
def fingerprint(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint_of(x) for x in texts_as_bytes(text)], np.uint64).view(np.int64))


def unary_counts(fp: Column) -> Column:
    """Popcounts of the two-bit segments in unary, packed into 64 bits."""
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    low = fp.bitwiseAND(F.lit(LOW))
    return high.bitwiseOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))


def grid_masks(distance: int = DISTANCE) -> list[int]:
    """Signed 64-bit masks of the segments of three axes each, one per kind of cell."""
    axes = [0] * (distance + 3)
    for segment in range(32):
        axes[segment * len(axes) // 32] |= 3 << (2 * segment)
    masks = [a | b | c for a, b, c in combinations(axes, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fp: np.ndarray, code: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among one cell's fingerprints."""
    left = np.arange(len(fp))
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(code[left] ^ code[at]) <= distance
            near &= np.bitwise_count(fp[left] ^ fp[at]) <= distance
            for other in left[near].tolist():
                yield at, other
                todo.append(other)
            left = left[~near]


SMALL_RUN = 24


def _links(key: np.ndarray, fp: np.ndarray, code: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys: pairwise for short runs, a forest for long ones."""
    edges = np.flatnonzero(np.concatenate(([True], np.any(key[1:] != key[:-1], axis=1), [True])))
    sizes = np.diff(edges)
    run = np.repeat(np.arange(len(sizes)), sizes)
    small = np.repeat(sizes <= SMALL_RUN, sizes)
    a, b = [], []
    for step in range(1, int(sizes[sizes <= SMALL_RUN].max(initial=1))):
        i = np.flatnonzero((run[:-step] == run[step:]) & small[:-step])
        i = i[np.bitwise_count(code[i] ^ code[i + step]) <= distance]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
        a.append(fp[i])
        b.append(fp[i + step])
    for start, size in zip(edges[:-1][sizes > SMALL_RUN], sizes[sizes > SMALL_RUN], strict=True):
        own = slice(start, start + size)
        pairs = np.array(list(_forest(fp[own], code[own], distance)), np.int64).reshape(-1, 2)
        a.append(fp[own][pairs[:, 0]])
        b.append(fp[own][pairs[:, 1]])
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _cell_links(distance: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None

        def out(rows: np.ndarray) -> pa.RecordBatch:
            a, b = _links(rows[:, :4], rows[:, 4].view(np.uint64), rows[:, 5].view(np.uint64), distance)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema)

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)], axis=1)
            if held is not None:
                rows = np.concatenate((held, rows))
            if not len(rows):
                continue
            other = np.flatnonzero(np.any(rows[:, :4] != rows[-1, :4], axis=1))
            cut = other[-1] + 1 if len(other) else 0  # the last run may go on in the next batch
            if cut:
                yield out(rows[:cut])
            held = rows[cut:].copy()
        if held is not None and len(held):
            yield out(held)

    return run


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: enough links between the distinct values of ``fp`` to join all that are within ``distance``."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("code").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(grid_masks(distance))])
    posts = prints.withColumn("code", unary_counts(F.col("fp"))).select("fp", "code", F.inline(kinds))
    full = posts.groupBy("kind", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    full = full.select("kind", "cell", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = posts.join(full, ["kind", "cell"]).withColumn("part", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("kind", "cell", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fp", "code")
    keys = ["kind", "cell", "lo", "hi"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_cell_links(distance), "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` with the smallest node of each component, for every node that has a link.

    ``edges`` has ``a < b``.  A round is a large-star and then a small-star step:
    every node tells its larger neighbours its smallest one, then every node its
    smaller ones.  Both are joins and partial aggregates only.
    """
    edges = edges.checkpoint()
    before = _state(edges)
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("m", "a").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = small.union(low.select(F.col("m").alias("a"), "b")).distinct().checkpoint()
        now = _state(edges)
        if now == before:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _classified(docs: DataFrame, doc_id: str, text_col: str, distance: int) -> DataFrame:
    """``docs`` with own columns: fingerprint, id of the component, and whether the row stands for it."""
    fp, row, root, comp = (f"{OWN}{x}" for x in ("fp", "row", "root", "comp"))
    kept = written(docs.withColumn(fp, fingerprint(F.col(text_col))).withColumn(row, F.monotonically_increasing_id()), "simhash")
    least = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(row).alias("row")))
    prints = written(kept.groupBy(F.col(fp).alias("fp")).agg(least.alias("first")), "prints")
    tree = components(links(prints.select("fp"), distance))
    rooted = prints.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias(root), "first")
    first = rooted.groupBy(root).agg(F.min("first").alias(comp))
    known = rooted.select(F.col("fp").alias(fp), root).join(first, root).select(fp, comp)
    out = kept.join(known, fp).withColumn(f"{OWN}component", F.col(f"{comp}.id"))
    return out.withColumn(f"{OWN}stays", F.col(row) == F.col(f"{comp}.row")).drop(row, comp)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hex digits), ``component_id`` and ``representative``.

    One row of each component is its representative: the one with the smallest
    id, and of repeated ids the first row.
    """
    found = _classified(docs, doc_id, text_col, distance)
    found = found.withColumn("fingerprint", F.lpad(F.lower(F.hex(f"{OWN}fp")), 16, "0"))
    found = found.withColumn("component_id", F.col(f"{OWN}component")).withColumn("representative", F.col(f"{OWN}stays"))
    return found.drop(f"{OWN}fp", f"{OWN}component", f"{OWN}stays")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component left."""
    found = _classified(docs, doc_id, text_col, distance)
    return found.filter(f"{OWN}stays").drop(f"{OWN}fp", f"{OWN}component", f"{OWN}stays")
