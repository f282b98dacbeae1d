"""Toxicity by a weighted lexicon (operator 10).

Texts are folded (case, look-alike letters, digits and signs that stand for
letters), an Aho-Corasick automaton finds lexicon stems at word beginnings, hits
inside an exception phrase do not count, and the summed weight, also per length
of the text, goes through a small calibrated logistic curve.

The lexicon starts from a fixed list and grows by stems learned from a bounded
sample of labelled rows (``sample_rows``, chosen by the hash of the id, never
from the held-out fold).  A stem is learned if it occurs in toxic rows of
several unlike texts (``min_texts``; copies share their smallest word hash and
count once), in at most a twentieth as many clean rows, and if such counts have a
chance of at most ``exp(-EVIDENCE)`` for a stem that is as common in clean rows;
the test is the same for every size of the sample.  One aggregation counts both
and applies it, so only stems that pass reach the driver.  Its weight is its log odds.

Defined results: null and empty texts have no hit and get the base score;
repeated rows get equal scores; without labelled rows the fixed list and fixed
curve are used.  Columns of the input stay; columns named like an output are
replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import OWN, labelled_sample, trimmed, written

SAMPLE_ROWS, THRESHOLD = 20_000, 0.5
EVIDENCE = math.log(10_000)
HELD_STEMS = 100_000  # counts that a worker holds before it hands them on

# ---- fixed values: lexicon, exceptions, look-alikes -----------------------------
LEXICON = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
EXCEPTIONS = ["circus clown", "clown fish", "sore loser", "trash bag", "trash bin", "trash can", "trash collection"]
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t",
    "ι": "i", "κ": "k", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i",
}
# -----------------------------------------------------------------------------------
SEED_COUNT = 5
FIXED_CURVE = [-4.0, 6.0, 0.5, 0.5]
FOLD = {ord(a): b for a, b in (DIGITS | LOOKALIKES).items()} | {0xFF41 + k: chr(97 + k) for k in range(26)} | {x: None for x in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060)}
WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> str:
    return text.lower().translate(FOLD)


def stems(text: str) -> set[str]:
    """Beginnings of 4 to 12 letters of the folded words."""
    return {w[:k] for w in set(WORD.findall(folded(text))) for k in range(4, min(12, len(w)) + 1)}


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: list[str] = EXCEPTIONS):
        self.finder = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.finder.add_word(term, (len(term), weight))
        for phrase in exceptions:
            self.finder.add_word(folded(phrase), (len(phrase), None))
        self.empty = not len(self.finder)
        if not self.empty:
            self.finder.make_automaton()

    def hits(self, text: str) -> tuple[int, float]:
        """Number and summed weight of hits; of hits that begin together the heaviest counts."""
        if self.empty:
            return 0, 0.0
        best: dict[int, float] = {}
        excepted: list[tuple[int, int]] = []
        low = folded(text)
        for end, (length, weight) in self.finder.iter(low):
            start = end - length + 1
            if start and low[start - 1].isalpha():
                continue
            if weight is None:
                if not low[end + 1 : end + 2].isalpha():
                    excepted.append((start, end))
            else:
                best[start] = max(weight, best.get(start, weight))
        for a, b in excepted:
            best = {at: w for at, w in best.items() if not a <= at <= b}
        return len(best), sum(best.values())


def features(n: np.ndarray, weight: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """One, any hit, the weight, and the weight per length."""
    return np.stack([np.ones(len(n)), n > 0, np.log1p(np.maximum(weight, 0)), np.log1p(1000 * np.maximum(weight, 0) / (chars + 200))], axis=1).astype(float)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> list[float]:
    """Logistic curve by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    return w.tolist()


def _hits_udf(spark, weights: dict[str, float], exceptions: list[str]):
    sent, cache = spark.sparkContext.broadcast((weights, exceptions)), {}
    kind = pa.struct([("n", pa.int64()), ("weight", pa.float64()), ("chars", pa.int64())])

    @F.arrow_udf("struct<n:bigint,weight:double,chars:bigint>")
    def hits(text: pa.Array) -> pa.Array:
        if not cache:
            cache["own"] = Lexicon(*sent.value)
        out = []
        for x in (v.as_py() for v in text):
            n, weight = cache["own"].hits(x or "")
            out.append({"n": n, "weight": weight, "chars": len(x or "")})
        return trimmed(pa.array(out, kind))

    return hits


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, sig, clean): a row per stem of a toxic text, and the number of clean texts with a stem; texts that share their smallest word hash have one sig."""
    kind = pa.schema([("term", pa.string()), ("sig", pa.int64()), ("clean", pa.int64())])

    def counted(n: Counter[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(n), pa.string()), pa.nulls(len(n), pa.int64()), pa.array(list(n.values()), pa.int64())], kind)

    for batch in batches:
        n: Counter[str] = Counter()
        for label, value in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
            text = value.as_py()
            if label and (words := set(text.split())):
                own = list(stems(text))
                sig = min(xxhash.xxh64_intdigest(w.encode()) for w in words) >> 1
                yield pa.record_batch([pa.array(own, pa.string()), pa.array([sig] * len(own), pa.int64()), pa.array([0] * len(own), pa.int64())], kind)
            elif not label:
                n.update(stems(text))
                if len(n) > HELD_STEMS:
                    yield counted(n)
                    n = Counter()
        out = counted(n)
        del n
        yield trimmed(out)


def tested(sample: DataFrame, min_texts: int, share: float) -> DataFrame:
    """(term, t, n): stems whose toxic texts ``t`` and clean rows ``n`` pass; ``share`` is the toxic share of the rows.

    The bound on the chance is Chernoff's: the texts times the divergence of t / (t + n) from ``share``.
    """
    found = sample.mapInArrow(_stem_counts, "term string, sig bigint, clean bigint")
    one = found.groupBy("term", "sig").agg(F.sum("clean").alias("clean"))  # copies count once
    both = one.groupBy("term").agg(F.count("sig").alias("t"), F.sum("clean").alias("n"))
    t, n = F.col("t"), F.col("n")
    evidence = t * F.log(t / (t + n) / share) + F.when(n > 0, n * F.log(n / (t + n) / (1 - share))).otherwise(0.0)
    return both.filter((t >= min_texts) & (20 * n <= t) & (t > share * (t + n)) & (evidence >= EVIDENCE))


def longest(counts: dict[str, tuple[int, int]]) -> list[str]:
    """Terms without those that a longer term with as many toxic texts extends: it stands for the same texts."""
    same = {(t[:k], counts[t][0]) for t in counts for k in range(4, len(t))}
    return sorted(t for t in counts if (t, counts[t][0]) not in same)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, min_texts: int = 3, exceptions: list[str] = EXCEPTIONS) -> tuple[dict[str, float], list[float]]:
    """Lexicon weights and the curve, from at most ``sample_rows`` labelled rows."""
    spark = docs.sparkSession
    chosen = labelled_sample(labels, "toxic", sample_rows)
    # at most sample_rows ids are broadcast, so no text of another row is shuffled
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text")).repartition(24), "toxic-sample")
    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    counts: dict[str, tuple[int, int]] = {}
    taken: list[str] = []
    if toxic and clean:
        counts = {r["term"]: (r["t"], r["n"]) for r in tested(sample, min_texts, toxic / (toxic + clean)).collect()}
        taken = longest(counts)
    seeds = {folded(t) for t in LEXICON}
    weights = {}
    for t in seeds | set(taken):
        k, n = counts.get(t, (0, 0))
        k += SEED_COUNT * (t in seeds)
        weights[t] = math.log((k + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1)) if toxic and clean else 4.0
    weights = {t: w for t, w in weights.items() if w > 0}
    if not (toxic and clean):
        return weights, FIXED_CURVE
    got = sample.select("label", _hits_udf(spark, weights, exceptions)("text").alias("h")).select("label", "h.*").toPandas()
    return weights, fit_curve(features(got["n"].to_numpy(), got["weight"].to_numpy(), got["chars"].to_numpy()), got["label"].to_numpy(float))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, exceptions: list[str] = EXCEPTIONS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on), ``n_hits`` and ``hit_weight``."""
    out = _scored(docs, labels, sample_rows, exceptions)
    out = out.withColumn("score", F.col(f"{OWN}score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    out = out.withColumn("n_hits", F.col(f"{OWN}hits.n")).withColumn("hit_weight", F.col(f"{OWN}hits.weight"))
    return out.drop(f"{OWN}score", f"{OWN}hits")


def _scored(docs: DataFrame, labels: DataFrame, sample_rows: int, exceptions: list[str]) -> DataFrame:
    weights, curve = learn(docs, labels, sample_rows, exceptions=exceptions)
    h = f"{OWN}hits"
    out = docs.withColumn(h, _hits_udf(docs.sparkSession, weights, exceptions)(F.col("text")))
    w = F.greatest(F.col(f"{h}.weight"), F.lit(0.0))
    z = curve[0] + F.when(F.col(f"{h}.n") > 0, curve[1]).otherwise(0.0) + curve[2] * F.log1p(w) + curve[3] * F.log1p(1000 * w / (F.col(f"{h}.chars") + 200))
    return out.withColumn(f"{OWN}score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    out = _scored(docs, labels, sample_rows, EXCEPTIONS)
    return out.filter(F.col(f"{OWN}score") < threshold).drop(f"{OWN}score", f"{OWN}hits")
