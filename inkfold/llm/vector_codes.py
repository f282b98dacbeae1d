"""Vector code compression by adaptive distance bounds (operator 12).

Vectors of integers ``floor(1024 * x)`` are cut into four parts; each part position
has a codebook of up to 256 entries, refined by rounds of assignment to the nearest
entry and replacement by the floored mean.

Assignment follows Drake and Hamerly.  Each part keeps its entry, an upper bound of
the distance to it, its ``b`` next closest entries with lower bounds in order, and
one outer bound for all others.  After entries have moved, bounds move by as much;
a part whose upper bound is below its first lower bound keeps its entry unseen.
Otherwise as many of the listed entries as the bounds leave open are compared, and
beyond the outer bound all entries are.  Every comparison is of exact integers (ties
go to the lower index), and bounds carry a margin over rounding, so the codes are
those of the plain method.  After every round ``b`` of each part position becomes
the number of listed entries that all but ``SPARE`` of its parts needed.

State goes with the vectors: each round reads one written table and writes the next,
and the table before it is deleted, so a lost executor costs a reread.  Only
codebooks (256 entries a part), their sums and counts of used bounds pass the driver;
sums are made per partition and entry first, then per entry.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped, and so are vectors of another length than most kept ones (ties: the longer).
Lengths that four does not divide are padded with zeros.  Fewer than 256 kept rows
make smaller codebooks; repeated rows each count, and start entries in the order of
id, then vector, null ids last.  Labels that are null are one group.  Sums of squares beyond
2**52 raise an error.  An empty table gives an empty result.  Other columns of the input are
not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import OWN, discard, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BOUNDS, SPARE, CHUNK = 16, 0.01, 2048
SLACK = 1e-4  # relative, far above the rounding of 32-bit bounds
EXACT = 1 << 52


@dataclass
class Codebook:
    """Entries of one part position, how far each moved last, and the number of bounds to keep."""

    entries: np.ndarray  # entries x width, int64
    moved: np.ndarray  # distance by which each entry moved since bounds were made
    bounds: int


def kept_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, int]:
    """``id, label, ints`` of usable rows, and the width of a part."""
    usable = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = rows.filter(usable)
    sizes = good.groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("n")).limit(1).collect()
    size = sizes[0]["n"] if sizes else 0
    width = -(-size // PARTS)
    pad = F.array_repeat(F.lit(0).cast("bigint"), PARTS * width - size)
    ints = F.concat(F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")), pad)
    return good.filter(F.size(vector) == size).select(F.col(vec_id).alias("id"), F.col(label).alias("label"), ints.alias("ints")), width


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries; whole numbers below 2**53 in float64."""
    e = entries.astype(np.float64)
    return (x * x).sum(1)[:, None] - 2.0 * (x @ e.T) + (e * e).sum(1)[None, :]


class Bounded:
    """Parts of one position with their bounds, some thousand rows at a time."""

    def __init__(self, x: np.ndarray, book: Codebook):
        self.x, self.book = x.astype(np.float64), book
        self.k = len(book.entries)
        self.b = min(book.bounds, self.k - 1)

    def all_entries(self, rows: np.ndarray, out: dict) -> None:
        """Entry, distance and fresh bounds of ``rows`` by looking at every entry."""
        d = squared(self.x[rows], self.book.entries)
        at = d.argmin(1)
        out["code"][rows], out["d"][rows] = at, d[np.arange(len(rows)), at]
        out["upper"][rows] = np.sqrt(out["d"][rows])
        if not self.b:
            out["lower"][rows] = np.inf if self.k == 1 else 0
            return
        rest = d.copy()
        rest[np.arange(len(rows)), at] = np.inf
        more = self.b + 1 < self.k
        near = np.argpartition(rest, self.b, axis=1)[:, : self.b + 1] if more else np.argsort(rest, axis=1)[:, : self.b]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(rest, near, 1), axis=1, kind="stable"), 1)
        lower = np.sqrt(np.take_along_axis(rest, near, 1)) * (1 - SLACK)
        out["near"][rows] = near[:, : self.b]
        out["lower"][rows, : self.b] = lower[:, : self.b]
        out["lower"][rows, self.b] = lower[:, self.b] if more else np.inf

    def first(self) -> dict:
        n = len(self.x)
        out = {"code": np.zeros(n, np.int64), "d": np.zeros(n), "upper": np.zeros(n), "near": np.zeros((n, self.b), np.uint8), "lower": np.zeros((n, self.b + 1)), "used": np.full(n, self.b + 1)}
        self.all_entries(np.arange(n), out)
        return out

    def again(self, code: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray) -> dict:
        """As ``first``, from the bounds of the round before; ``used`` is how many listed entries were compared, ``b + 1`` for all entries."""
        moved, n, b = self.book.moved, len(self.x), self.b
        upper = (upper + moved[code]) * (1 + SLACK)
        kept, outer = near[:, :b], lower[:, b] if b < lower.shape[1] - 1 else lower[:, -1]
        low = np.empty((n, b + 1))
        low[:, b] = outer - moved.max()
        low[:, :b] = lower[:, :b] - moved[kept]
        low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1] - SLACK  # in order: each bounds all behind it as well
        out = {"code": code.copy(), "d": np.full(n, -1.0), "upper": upper, "near": kept.copy(), "lower": low, "used": (low <= upper[:, None]).sum(1)}
        open_rows = np.flatnonzero(out["used"] > 0)
        if len(open_rows):  # the exact distance to the own entry closes most
            self._own(open_rows, out)
            out["used"][open_rows] = (low[open_rows] <= out["upper"][open_rows, None]).sum(1)
        self.all_entries(np.flatnonzero(out["used"] == b + 1), out)
        some = np.flatnonzero((out["used"] > 0) & (out["used"] <= b))
        if len(some):
            self._listed(some, out)
        return out

    def _own(self, rows: np.ndarray, out: dict) -> None:
        away = self.x[rows] - self.book.entries[out["code"][rows]]
        out["d"][rows] = (away * away).sum(1)
        out["upper"][rows] = np.sqrt(out["d"][rows]) * (1 + SLACK)

    def _listed(self, rows: np.ndarray, out: dict) -> None:
        """Compare the own entry and the listed ones that the bounds leave open; they are put in order again."""
        for used in np.unique(out["used"][rows]):
            own = rows[out["used"][rows] == used]
            ids = np.concatenate((out["code"][own, None], out["near"][own, :used].astype(np.int64)), axis=1)
            away = self.x[own][:, None, :] - self.book.entries[ids]
            d = np.einsum("nkw,nkw->nk", away, away)
            order = np.lexsort((ids, d), axis=1)
            ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
            out["code"][own], out["d"][own], out["upper"][own] = ids[:, 0], d[:, 0], np.sqrt(d[:, 0])
            out["near"][own, :used] = ids[:, 1:]
            # the bound behind them holds for those behind; a listed entry is not let beyond it, to keep the order
            out["lower"][own, :used] = np.minimum(np.sqrt(d[:, 1:]) * (1 - SLACK), out["lower"][own, used][:, None])

    def exact(self, out: dict) -> np.ndarray:
        rows = np.flatnonzero(out["d"] < 0)
        self._own(rows, out)
        return out["d"].astype(np.int64)


_STATE = "id {id}, label {label}, ints binary, state binary"


def _record(b: int) -> np.dtype:
    return np.dtype([("code", "u1"), ("upper", "<f4"), ("near", "u1", (b,)), ("lower", "<f4", (b + 1,)), ("used", "u1")])


def _bytes(rows: np.ndarray) -> pa.Array:
    """Rows of a two-dimensional array as binary values."""
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    width = data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, np.int32) if width else np.zeros(len(rows) + 1, np.int32)), pa.py_buffer(data)])


def _matrix(column: pa.Array, rows: int, kind, width: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, kind).reshape(rows, width)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            yield batch.slice(at, CHUNK)


def _assigner(sent: Broadcast, width: int, before: list[int] | None):
    """Rows with the state of the next round; ``before`` has the bounds per part of the round before, None at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in _chunks(batches):
            n = batch.num_rows
            x = _matrix(batch.column("ints"), n, "<i8", PARTS * width)
            old = None
            if before is not None:
                kinds = [(f"p{p}", _record(before[p])) for p in range(PARTS)]
                old = np.frombuffer(b"".join(batch.column("state").to_pylist()), np.dtype(kinds))
            new = np.empty(n, [(f"p{p}", _record(min(books[p].bounds, len(books[p].entries) - 1))) for p in range(PARTS)])
            for p in range(PARTS):
                part = Bounded(x[:, p * width : (p + 1) * width], books[p])
                o = None if old is None else old[f"p{p}"]
                out = part.first() if o is None else part.again(o["code"].astype(np.int64), o["upper"].astype(float), o["near"], o["lower"].astype(float))
                for name, value in (("code", out["code"]), ("upper", out["upper"] * (1 + SLACK)), ("near", out["near"]), ("lower", out["lower"]), ("used", out["used"])):
                    new[f"p{p}"][name] = value
            yield pa.record_batch([batch.column("id"), batch.column("label"), batch.column("ints"), _bytes(new.view(np.uint8).reshape(n, -1))], ["id", "label", "ints", "state"])

    return run


def _summer(width: int, bounds: list[int], entries: int):
    """Per partition: count and sums of the parts of each entry, and how many parts used how many bounds (as entry -1 - used)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, entries), np.int64)
        sums = np.zeros((PARTS, entries, width), np.int64)
        used = np.zeros((PARTS, 258), np.int64)
        kind = np.dtype([(f"p{p}", _record(bounds[p])) for p in range(PARTS)])
        for batch in _chunks(batches):
            x = _matrix(batch.column("ints"), batch.num_rows, "<i8", PARTS * width)
            state = np.frombuffer(b"".join(batch.column("state").to_pylist()), kind)
            for p in range(PARTS):
                code = state[f"p{p}"]["code"]
                count[p] += np.bincount(code, minlength=entries)
                np.add.at(sums[p], code, x[:, p * width : (p + 1) * width])
                used[p] += np.bincount(state[f"p{p}"]["used"], minlength=258)
        part, entry = np.nonzero(count)
        seen, level = np.nonzero(used)
        columns = [np.concatenate((part, seen)), np.concatenate((entry, -1 - level)), np.concatenate((count[part, entry], used[seen, level]))]
        values = np.concatenate((sums[part, entry], np.zeros((len(seen), width), np.int64)))
        names = ["part", "entry", "n", *[f"s{j}" for j in range(width)]]
        yield pa.record_batch([*map(pa.array, columns), *[pa.array(values[:, j].copy()) for j in range(width)]], names)

    return run


def _fitted(state: DataFrame, books: list[Codebook], width: int, bounds: list[int]) -> list[Codebook]:
    """Codebooks after one round: floored means, their movement, and ``b`` by what was used."""
    entries = len(books[0].entries)
    schema = ", ".join(["part bigint", "entry bigint", "n bigint", *[f"s{j} bigint" for j in range(width)]])
    rows = state.mapInArrow(_summer(width, bounds, entries), schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *[f"s{j}" for j in range(width)]]]).collect()
    out = []
    for p, book in enumerate(books):
        new, used = book.entries.copy(), np.zeros(258, np.int64)
        for r in rows:
            if r["part"] == p and r["entry"] >= 0:
                new[r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
            elif r["part"] == p:
                used[-1 - r["entry"]] += r["n"]
        enough = int(np.searchsorted(np.cumsum(used), (1 - SPARE) * used.sum()))
        moved = np.sqrt(((new - book.entries).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        out.append(Codebook(new, moved, min(book.bounds, max(2, enough))))
    return out


def _finisher(sent: Broadcast, width: int, before: list[int]):
    """Codes and squared distances by the last codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in _chunks(batches):
            n = batch.num_rows
            x = _matrix(batch.column("ints"), n, "<i8", PARTS * width)
            old = np.frombuffer(b"".join(batch.column("state").to_pylist()), np.dtype([(f"p{p}", _record(before[p])) for p in range(PARTS)]))
            codes, error = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64)
            for p in range(PARTS):
                part, o = Bounded(x[:, p * width : (p + 1) * width], books[p]), old[f"p{p}"]
                out = part.again(o["code"].astype(np.int64), o["upper"].astype(float), o["near"], o["lower"].astype(float))
                error += part.exact(out)
                codes[:, p] = out["code"]
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return run


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ints = batch.column("ints")
        values = ints.flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(batch.num_rows, -1)
        yield pa.record_batch([batch.column("id"), batch.column("label"), _bytes(values)], ["id", "label", "ints"])


def encode_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    entries: int = ENTRIES, rounds: int = ROUNDS, bounds: int = BOUNDS,
) -> tuple[DataFrame, list[Codebook]]:
    """``id, label, code, error`` of every kept row, and the final codebooks."""
    if not 1 <= entries <= 256 or not 0 <= bounds <= 254:
        raise ValueError("a code is one byte: 1 to 256 entries, 0 to 254 bounds")
    spark = rows.sparkSession
    kept, width = kept_vectors(rows, vec_id, vector, label)
    types = {"id": kept.schema["id"].dataType.simpleString(), "label": kept.schema["label"].dataType.simpleString()}
    start = kept.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    if not start:
        return spark.createDataFrame([], f"id {types['id']}, label {types['label']}, code string, error bigint"), []
    most = kept.agg(F.max(F.greatest(F.lit(0), F.array_max(F.transform("ints", F.abs))))).first()[0] or 0
    if most.bit_length() * 2 + (8 * PARTS * width).bit_length() > EXACT.bit_length():
        raise ValueError(f"components up to {most} do not fit exact squared distances")
    first = np.array([r["ints"] for r in start], np.int64).reshape(len(start), PARTS, width)
    books = [Codebook(first[:, p].copy(), np.zeros(len(start)), min(bounds, len(start) - 1)) for p in range(PARTS)]
    state = kept.mapInArrow(_as_bytes, f"id {types['id']}, label {types['label']}, ints binary")
    before: list[int] | None = None
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        after = written(state.mapInArrow(_assigner(sent, width, before), _STATE.format(**types)), "codes")
        if before is not None:
            discard(state)
        state, before = after, [b.bounds for b in books]
        sent.destroy()
        books = _fitted(state, books, width, before)
        for b in books:
            b.bounds = min(b.bounds, len(start) - 1)
    if before is None:  # no rounds: the start entries are the codebooks
        before = [b.bounds for b in books]
        state = state.mapInArrow(_assigner(spark.sparkContext.broadcast(books), width, None), _STATE.format(**types))
    out = state.mapInArrow(_finisher(spark.sparkContext.broadcast(books), width, before), f"id {types['id']}, label {types['label']}, code string, error bigint")
    return out, books


def compress_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS, bounds: int = BOUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256``; the last two of the label's rows and of the codebooks."""
    out, books = encode_vectors(rows, vec_id, vector, label, entries, rounds, bounds)
    out = written(out, "vector-codes")
    sums = out.groupBy(F.col("label").alias(f"{OWN}label")).agg(F.sum("error").alias("label_error"))
    joined = out.join(sums, F.col("label").eqNullSafe(F.col(f"{OWN}label")))
    return joined.select(F.col("id").alias("vec_id"), "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
