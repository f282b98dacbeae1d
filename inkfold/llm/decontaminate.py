"""Benchmark decontamination (operator 2).

The benchmark's word windows are hashed and broadcast; documents are scanned
window by window, a hash hit is verified on the words themselves, and the hit
words are then removed, or the document is.

At most ``broadcast_bytes`` bytes of benchmark text are broadcast at a time
(checked by an aggregate first).  A larger benchmark is read in slices of that
size, long items in pieces that overlap by a window less one word; the documents
are scanned once per slice by the same verified scanner, only rows with hits are
written, and their spans and items are merged.

Defined results: a null text has no words; an item without words has no window;
windows of an item whose id is null hit, and the item is listed as an empty id;
repeated items count once; repeated documents are judged row by row; an empty
benchmark hits nothing.  Columns of the input stay; columns named like an
output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, WordHasher, groups, texts_as_bytes, windows
from .support import OWN, arrow_column, trimmed, written

WINDOW = 13
BROADCAST_BYTES, LEAST_PIECE = 4 << 20, 1024
SPANS = "array<struct<start:int,end:int>>"
RESULT = f"struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:{SPANS}>"
RESULT_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def item_windows(text: bytes, hasher: WordHasher, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Length, hashes, starts and ends of an item's windows in its lower-cased words joined by spaces; fewer words than ``size`` are one window."""
    starts, ends, hashes = hasher.words(text)
    length = min(size, len(starts))
    if not length:
        return 0, hashes[:0], starts[:0], ends[:0], b""
    joined = b" ".join([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]).lower()
    last = np.cumsum(ends - starts + 1) - 1
    first = last - (ends - starts)
    n = len(starts) - length + 1
    return length, windows(hashes, length), first[:n], last[length - 1 :], joined


class Windows:
    """Windows of one length: sorted hashes with their places in the benchmark's words, and a bit table before them.

    A window takes 28 bytes and up to 16 of the table; words are compared in the one buffer.
    """

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts, self.ends, self.items = hashes[order], starts[order], ends[order], items[order]
        bits = max(16, (len(hashes) * 8 - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.hashes >> self.shift).astype(np.int64)] = True
        self.met: dict[int, list[tuple[bytes, set[str]]]] = {}


class WindowSet:
    """The benchmark's windows by length; ``rows`` are items and their texts."""

    def __init__(self, rows: list[tuple[str, bytes]], hasher: WordHasher, size: int):
        found: dict[int, list[tuple]] = {}
        self.names, parts, at = [item for item, _ in rows], [], 0
        for k, (_, text) in enumerate(rows):
            length, hashes, starts, ends, joined = item_windows(text, hasher, size)
            if length:
                found.setdefault(length, []).append((hashes, starts + at, ends + at, np.full(len(hashes), k, np.int32)))
                parts.append(joined)
                at += len(joined)
        self.words = b"".join(parts)
        self.by_length = {length: Windows(*map(np.concatenate, zip(*own, strict=True))) for length, own in found.items()}

    def _items(self, known: Windows, h: int, words: bytes) -> set[str] | None:
        """Items with a window of these words; what a hash stands for is put together when it is first met."""
        if h not in known.met:
            a, b = np.searchsorted(known.hashes, np.uint64(h)), np.searchsorted(known.hashes, np.uint64(h), side="right")
            texts: dict[bytes, set[str]] = {}
            for k in range(a, b):
                texts.setdefault(self.words[known.starts[k] : known.ends[k]], set()).add(self.names[known.items[k]])
            known.met[h] = list(texts.items())
        return next((items for text, items in known.met[h] if text == words), None)

    def hits(self, data: bytes, starts, ends, hashes, firsts) -> list[tuple[int, int, int, set[str]]]:
        """(first word, length, text, items) of verified windows within one text each."""
        out = []
        for length, known in self.by_length.items():
            grams = windows(hashes, length)
            at = np.flatnonzero(known.seen[(grams >> known.shift).astype(np.int64)])
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(known.hashes, grams[at]), len(known.hashes) - 1)
            at = at[known.hashes[place] == grams[at]]
            text = np.searchsorted(firsts, at, side="right") - 1
            whole = at + length <= firsts[text + 1]
            for i, t in zip(at[whole].tolist(), text[whole].tolist(), strict=True):
                words = b" ".join(data[starts[j] : ends[j]].lower() for j in range(i, i + length))
                if items := self._items(known, int(grams[i]), words):
                    out.append((i, length, t, items))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_texts(texts: list[bytes], known: WindowSet, hasher: WordHasher) -> list[dict]:
    """Word spans are half-open and in words; several hits that touch are one span."""
    out = []
    for _, group in groups(texts):
        data = group[0] if len(group) == 1 else b"\0".join(group)
        starts, ends, hashes, firsts = hasher.group(group)
        rows = [{"n_words": int(n), "n_hit": 0, "items": [], "spans": []} for n in np.diff(firsts[: len(group) + 1])]
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for i, length, t, found in known.hits(data, starts, ends, hashes, firsts):
            first = i - int(firsts[t])
            spans.setdefault(t, []).append((first, first + length))
            items.setdefault(t, set()).update(found)
        for t, own in spans.items():
            own = merged(own)
            rows[t] |= {"n_hit": sum(b - a for a, b in own), "items": sorted(items[t]), "spans": [{"start": a, "end": b} for a, b in own]}
        out += rows
    return out


def _scanner(sent: Broadcast, size: int):
    cache: dict = {}

    @F.arrow_udf(RESULT)
    def scan(text: pa.Array) -> pa.Array:
        if not cache:
            hasher = WordHasher(ALNUM)
            cache["own"] = WindowSet(sent.value, hasher, size), hasher
        return trimmed(pa.array(scan_texts(texts_as_bytes(text), *cache["own"]), RESULT_ARROW))

    return scan


def pieces(data: bytes, size: int, limit: int, hasher: WordHasher) -> Iterator[bytes]:
    """``data`` in pieces of about ``limit`` bytes that have its windows of ``size`` words between them, and no others."""
    if len(data) <= limit:
        yield data
        return
    starts, ends, _ = hasher.words(data)
    at, last = 0, len(starts) - size  # first words of windows
    while at <= last or not at and len(starts):
        far = max(at, min(int(np.searchsorted(starts, starts[at] + limit)) - size, last))
        yield data[starts[at] : ends[min(far + size, len(starts)) - 1]]
        at = far + 1


def _slices(items: DataFrame, size: int, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items, long ones in pieces, in lists of at most ``limit`` bytes or of one piece."""
    hasher, own, held = WordHasher(ALNUM), [], 0
    for r in items.toLocalIterator():
        for data in pieces(r["text"].encode(), size, max(limit // 4, LEAST_PIECE), hasher):
            if own and held + len(data) + 64 > limit:
                yield own
                own, held = [], 0
            own.append((r["item"], data))
            held += len(data) + 64
    if own:
        yield own


@arrow_column("bigint")
def _word_count(text: pa.Array) -> pa.Array:
    hasher = WordHasher(ALNUM)
    return pa.array([len(hasher.words(x)[0]) for x in texts_as_bytes(text)], pa.int64())


@arrow_column(f"struct<n_hit:bigint,spans:{SPANS}>")
def _merged_spans(spans: pa.Array) -> pa.Array:
    out = []
    for own in spans.to_pylist():
        own = merged([(x["start"], x["end"]) for x in own or []])
        out.append({"n_hit": sum(b - a for a, b in own), "spans": [{"start": a, "end": b} for a, b in own]})
    return pa.array(out, pa.struct([("n_hit", pa.int64()), RESULT_ARROW.field("spans")]))


def _by_slices(docs: DataFrame, items: DataFrame, text_col: str, size: int, limit: int) -> DataFrame:
    """The way of a large benchmark: one scan of the documents per slice, of which only the hits are written."""
    row, found = f"{OWN}row", f"{OWN}found"
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    parts = [docs.sparkSession.createDataFrame([], f"{row} bigint, items array<string>, spans {SPANS}")]  # no item may have a word
    for rows in _slices(written(items.distinct(), "benchmark"), size, limit):
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        scanned = docs.select(row, _scanner(sent, size)(F.col(text_col)).alias(found)).select(row, f"{found}.items", f"{found}.spans")
        parts.append(written(scanned.filter(F.size("spans") > 0), "decontaminate-slice"))
        sent.destroy()
    hits = reduce(DataFrame.union, parts).groupBy(row).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    hits = hits.withColumn("m", _merged_spans("spans")).select(row, "items", "m.n_hit", "m.spans")
    out = docs.join(hits.select(row, F.struct("items", "n_hit", "spans").alias(f"{OWN}h")), row, "left")
    found = F.struct(
        _word_count(text_col).alias("n_words"), F.coalesce(F.col(f"{OWN}h.n_hit"), F.lit(0)).alias("n_hit"),
        F.coalesce(F.col(f"{OWN}h.items"), F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col(f"{OWN}h.spans"), F.array().cast(SPANS)).alias("spans"),
    )
    return out.withColumn(f"{OWN}found", found).drop(row, f"{OWN}h")


def contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id: str, item_text: str, window: int, broadcast_bytes: int) -> DataFrame:
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    if size <= broadcast_bytes:
        rows = [(r["item"], r["text"].encode()) for r in items.distinct().collect()]
        return docs.withColumn(f"{OWN}found", _scanner(docs.sparkSession.sparkContext.broadcast(rows), window)(F.col(text_col)))
    return _by_slices(docs, items, text_col, window, broadcast_bytes)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items, spans, contaminated``; spans are in words, end exclusive."""
    out = _found(docs, benchmark, text_col, item_id, item_text, window, broadcast_bytes)
    for name in ("n_words", "n_hit", "items", "spans"):
        out = out.withColumn(name, F.col(f"{OWN}found.{name}"))
    return out.drop(f"{OWN}found").withColumn("contaminated", contaminated(F.col("n_words"), F.col("n_hit")))


@arrow_column("string")
def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    hasher, out = WordHasher(ALNUM), []
    for data, own in zip(texts_as_bytes(text), spans.to_pylist(), strict=True):
        starts, ends, _ = hasher.words(data)
        keep, at = [], 0
        for x in own:
            keep.append(data[at : starts[x["start"]]])
            at = int(ends[x["end"] - 1])
        out.append(b"".join([*keep, data[at:]]).decode())
    return pa.array(out, pa.string())


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` without contaminated rows, and with the hit words cut out of the others."""
    found = f"{OWN}found"
    out = _found(docs, benchmark, text_col, item_id, item_text, window, broadcast_bytes)
    out = out.filter(~contaminated(F.col(f"{found}.n_words"), F.col(f"{found}.n_hit")))
    hit = F.size(f"{found}.spans") > 0
    cut = _without(F.when(hit, F.col(text_col)), F.when(hit, F.col(f"{found}.spans")).otherwise(F.array().cast(SPANS)))
    return out.withColumn(text_col, F.when(hit, cut).otherwise(F.col(text_col))).drop(found)


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


