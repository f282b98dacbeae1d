"""Quality classifier (operator 4).

Word vectors come from random indexing: every document has a sparse random index
vector, and the vector of a word (hashed into ``buckets`` slots) is the sum of
the index vectors of all documents it occurs in.  The vectors are summed over the
whole table, task by task and then by slot, so what is gathered is ``buckets`` x
``dim`` numbers however large the table is; they are broadcast with that bound.
A document is the mean of its word vectors, less the mean of all words, plus a
few ratios of its shape (how words repeat, case, signs, lines).  A network with
one hidden layer, written in numpy, is trained on a bounded sample of labelled
rows (``sample_rows``, by the hash of the id, never from the held-out fold), and
a temperature fitted on a part of the sample that it was not trained on
calibrates its probabilities.

Defined results: null and empty texts have zero vectors and get a score like any
other; repeated rows get equal scores; without labels of both kinds every score
is 0.5.  Columns of the input stay; columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import WordHasher, byte_table, groups, texts_as_bytes
from .support import OWN, labelled_sample, written

SAMPLE_ROWS, THRESHOLD = 12_000, 0.3
BUCKETS, DIM, NONZERO, HIDDEN = 1 << 13, 32, 4, 24
#: Everything but ASCII white space; case is kept, so that capitals are words of their own.
GRAPHIC = byte_table({*range(33, 127), *range(128, 256)}, lower=False)
LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
CAPITAL = np.isin(np.arange(256), range(65, 91))
SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def index_vector(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of a document's index vector."""
    rng = np.random.default_rng(seed)
    return rng.choice(DIM, NONZERO, replace=False), rng.choice(np.array([-1, 1]), NONZERO)


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slot that the task has met: the sum of index vectors, and the occurrences."""
    hasher = WordHasher(GRAPHIC)
    sums, seen = np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, group in groups(texts_as_bytes(batch.column(0))):
            _, _, hashes, firsts = hasher.group(group)
            places = slots(hashes)
            seen += np.bincount(places, minlength=BUCKETS)
            for a, b in zip(firsts[: len(group)], firsts[1:], strict=False):
                if b > a:
                    own = np.unique(places[a:b])
                    where, signs = index_vector(int(hashes[a:b].sum(dtype=np.uint64)))
                    sums[own[:, None], where] += signs
    used = np.flatnonzero(seen)
    yield pa.record_batch({"slot": pa.array(used), "n": pa.array(seen[used]), "v": pa.array(sums[used].tolist(), pa.list_(pa.int64()))})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """``BUCKETS`` x ``DIM`` unit vectors, the mean direction taken out; slots never met are zero."""
    parts = docs.select("text").mapInArrow(_vectors, "slot bigint, n bigint, v array<bigint>")
    total = parts.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(DIM)])
    out, weight = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    rows = total.toPandas()
    if len(rows):
        at = rows["slot"].to_numpy()
        weight[at] = rows["n"].to_numpy(float)
        out[at] = rows[[f"v{k}" for k in range(DIM)]].to_numpy(float)
        out[at] /= np.linalg.norm(out[at], axis=1, keepdims=True) + 1e-9
        out[at] -= (weight[:, None] * out).sum(axis=0) / weight.sum()
    return out.astype(np.float32)


SHAPES = 8


def pool(texts: list[bytes], vectors: np.ndarray, hasher: WordHasher) -> np.ndarray:
    """Mean word vector and shape of every text."""
    out = np.zeros((len(texts), DIM + SHAPES), np.float32)
    for at, group in groups(texts):
        starts, ends, hashes, firsts = hasher.group(group)
        data = np.frombuffer(b"\0".join(group), np.uint8)
        letters = np.concatenate(([0], np.cumsum(LETTER[data], dtype=np.int32)))
        capitals = np.concatenate(([0], np.cumsum(CAPITAL[data], dtype=np.int32)))
        places = slots(hashes)
        for k, text in enumerate(group):
            a, b = int(firsts[k]), int(firsts[k + 1])
            n = b - a
            if not n:
                continue
            own, count = np.unique(places[a:b], return_counts=True)
            row = out[at + k]
            row[:DIM] = count @ vectors[own] / n
            words, size = hashes[a:b], int((ends[a:b] - starts[a:b]).sum())
            lettered = int((letters[ends[a:b]] - letters[starts[a:b]]).sum())
            signs = (ends[a:b] - starts[a:b]) - (letters[ends[a:b]] - letters[starts[a:b]])
            lines = text.split(b"\n")
            row[DIM:] = (
                np.log1p(n) / 10,
                len(np.unique(words)) / n,
                float((words[1:] == words[:-1]).sum()) / n,
                1 - lettered / size,
                float((capitals[ends[a:b]] - capitals[starts[a:b]]).sum()) / max(lettered, 1),
                float((signs >= 2).sum()) / n,
                float((signs == ends[a:b] - starts[a:b]).sum()) / n,
                1 - len(set(lines)) / len(lines),
            )
    return out


class Network:
    """Input, one hidden layer of tanh, one logit; trained by Adam on weighted cross entropy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5, steps: int = 600, rate: float = 0.02, decay: float = 1e-4):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        part = rng.permutation(len(x))
        held = part[: max(1, len(x) // 5)]
        own = part[len(held) :] if len(x) > 20 else part
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
        z = (x[own] - self.mean) / self.scale
        share = y[own].mean().clip(0.01, 0.99)
        weight = np.where(y[own] == 1, 0.5 / share, 0.5 / (1 - share))
        m, v = [0 * w for w in self.w], [0 * w for w in self.w]
        for t in range(1, steps + 1):
            hidden = np.tanh(z @ self.w[0] + self.w[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ self.w[2] + self.w[3], -30, 30)))
            d = weight * (p - y[own]) / len(own)
            back = np.outer(d, self.w[2]) * (1 - hidden**2)
            grads = [z.T @ back + decay * self.w[0], back.sum(axis=0), hidden.T @ d + decay * self.w[2], np.array([d.sum()])]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        logits = self.logits(x[held])
        loss = lambda t: np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logits / t).mean()
        self.temperature = float(min(np.geomspace(0.5, 20, 60), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _pooled(spark, vectors: np.ndarray):
    sent, hasher = spark.sparkContext.broadcast(vectors), []

    @F.arrow_udf("array<float>")
    def run(text: pa.Array) -> pa.Array:
        hasher[:] = hasher or [WordHasher(GRAPHIC)]
        return pa.array(pool(texts_as_bytes(text), sent.value, hasher[0]).tolist(), pa.list_(pa.float32()))

    return run


def _scorer(spark, vectors: np.ndarray, network: Network | None):
    sent, hasher = spark.sparkContext.broadcast((vectors, network)), []

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        hasher[:] = hasher or [WordHasher(GRAPHIC)]
        own, net = sent.value
        texts = texts_as_bytes(text)
        return pa.array(np.full(len(texts), 0.5) if net is None else net.score(pool(texts, own, hasher[0])), pa.float64())

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network | None]:
    vectors = word_vectors(docs)
    chosen = labelled_sample(labels, "quality", sample_rows)
    # at most sample_rows ids are broadcast, so no text of another row is shuffled;
    # one text of each kind of copy: equal texts would only weigh the same row twice
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.min("label").alias("label"), F.first("text").alias("text"))
    sample = written(sample.select("doc_id", "label", "text").repartition(24), "quality-sample")
    got = sample.select("doc_id", "label", _pooled(docs.sparkSession, vectors)("text").alias("x")).toPandas().sort_values("doc_id")
    y = got["label"].to_numpy(float)
    if len(set(y)) < 2:
        return vectors, None
    return vectors, Network(np.stack(got["x"].to_numpy()).astype(float), y)


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 from ``threshold`` on)."""
    vectors, network = fit(docs, labels, sample_rows)
    out = docs.withColumn(f"{OWN}score", _scorer(docs.sparkSession, vectors, network)(F.col("text")))
    return out.withColumn("score", F.col(f"{OWN}score")).drop(f"{OWN}score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
