"""Language identification by fusing evidence (operator 6).

For every page the log of four kinds of evidence is added up per language:
how likely its text is, the language its markup declares, the language that its
address names (a path segment, a host label or a suffix), and a prior of its
host.  Text likelihoods are hashed character trigrams, counted over every
labelled document.  Host priors are counts of declared languages, smoothed
towards the host's site, and the site's towards all pages; a page does not count
itself.  All counts are grouped aggregations.

Defined results: a page without text, declaration and known address gets the
prior alone; a null address has the host and site ``""``; repeated pages count
as often as they occur; without labelled documents the text says nothing; an
empty table gives an empty result.  Columns of the input stay; columns named
like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import OWN

SLOTS = 1 << 14
SMOOTH, TEXT_WEIGHT, DECLARED, ADDRESS = 5.0, 0.25, 0.9, 0.8
LANGUAGES = ["de", "en", "es", "fr"]
# ---- fixed values: country suffixes that speak for a language -------------------------
SUFFIXES = {"at": "de", "de": "de", "es": "es", "fr": "fr", "mx": "es", "uk": "en", "us": "en"}
# ---------------------------------------------------------------------------------------
TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;")
SPACES = re.compile(r"[\W\d_]+")


def trigram_slots(text: str) -> np.ndarray:
    """Slots of the trigrams of lower-cased words, each word between spaces."""
    points = np.frombuffer(f" {SPACES.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    mixed = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _counts(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), SLOTS), np.int64)
        place = {x: k for k, x in enumerate(languages)}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[place[lang]] += np.bincount(trigram_slots(text), minlength=SLOTS)
        at, slot = np.nonzero(total)
        yield pa.record_batch({"at": pa.array(at), "slot": pa.array(slot), "n": pa.array(total[at, slot])})

    return run


def text_model(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probability of every slot per language; at most ``len(languages)`` x ``SLOTS`` counts reach the driver."""
    known = docs.filter(F.col("lang").isin(languages) & F.col("text").isNotNull()).select("lang", "text")
    rows = known.mapInArrow(_counts(languages), "at bigint, slot bigint, n bigint").groupBy("at", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(languages), SLOTS), 0.5)
    if len(rows):
        counts[rows["at"].to_numpy(), rows["slot"].to_numpy()] += rows["n"].to_numpy(float)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihood(spark, model: np.ndarray):
    """Mean log probability of a trigram, times the square root of their number: neighbours are not independent."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def run(html: pa.Array) -> pa.Array:
        out = []
        for x in html.to_pylist():
            own = trigram_slots(TAGS.sub(" ", x or ""))
            out.append((sent.value[:, own].mean(axis=1, dtype=float) * np.sqrt(len(own))).tolist() if len(own) else [0.0] * len(sent.value))
        return pa.array(out, pa.list_(pa.float64()))

    return run


def declared_language(html: Column) -> Column:
    """First two letters of the root element's ``lang``, or null."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})(?![a-z])", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)


def address_language(url: Column, languages: list[str]) -> Column:
    """Language named by a path segment, else by the first host label, else by the country suffix."""
    named = "|".join(languages)
    url, host = F.coalesce(url, F.lit("")), host_of(url)
    path = F.lower(F.regexp_extract(url, rf"(?i)^[^/]*//[^/]*/(?:[^?#]*/)?({named})(?:[/?#-]|$)", 1))
    label = F.regexp_extract(host, rf"^({named})\.", 1)
    known = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.coalesce(F.nullif(path, F.lit("")), F.nullif(label, F.lit("")), F.try_element_at(known, F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit(""))))


def _says(found: Column, lang: str, trust: float, others: int) -> Column:
    return F.when(found.isNull(), 0.0).when(found == lang, F.log(F.lit(trust))).otherwise(F.log(F.lit((1 - trust) / others)))


def identify(pages: DataFrame, docs: DataFrame, languages: list[str] | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``language``, its ``probability`` and the parts ``declared`` and ``addressed``."""
    languages = languages or LANGUAGES
    host, site, said, part, prior, parts = (f"{OWN}{x}" for x in ("host", "site", "said", "address", "prior", "parts"))
    own = pages.withColumn(host, host_of(F.col(url_col))).withColumn(site, site_of(F.col(host)))
    said_col = declared_language(F.col(html_col))
    own = own.withColumn(said, F.when(said_col.isin(languages), said_col)).withColumn(part, address_language(F.col(url_col), languages))
    counts = own.groupBy(host, site).agg(*[F.count_if(F.coalesce(F.col(said) == x, F.lit(False))).alias(f"{OWN}h_{x}") for x in languages])
    sites = counts.groupBy(site).agg(*[F.sum(f"{OWN}h_{x}").alias(f"{OWN}s_{x}") for x in languages])
    everywhere = sites.agg(*[F.coalesce(F.sum(f"{OWN}s_{x}"), F.lit(0)).alias(f"{OWN}g_{x}") for x in languages])
    g = everywhere.first()
    table = counts.join(sites, site).drop(site)
    total = lambda level: sum((F.col(f"{OWN}{level}_{x}") for x in languages), F.lit(0.0))
    model = text_model(docs, languages)
    own = own.withColumn(parts, _likelihood(pages.sparkSession, model)(F.col(html_col))).join(table, host)
    self_ = lambda x: F.when(F.col(said) == x, 1).otherwise(0)
    one = F.when(F.col(said).isNotNull(), 1).otherwise(0)
    whole, scores = sum(g) + 1, []
    for k, x in enumerate(languages):
        base = F.lit((g[f"{OWN}g_{x}"] + 1 / len(languages)) / whole)
        at_site = (F.col(f"{OWN}s_{x}") - self_(x) + SMOOTH * base) / (total("s") - one + SMOOTH)
        at_host = (F.col(f"{OWN}h_{x}") - self_(x) + SMOOTH * at_site) / (total("h") - one + SMOOTH)
        others = max(1, len(languages) - 1)
        z = F.log(at_host) + TEXT_WEIGHT * F.col(parts)[k] + _says(F.col(said), x, DECLARED, others) + _says(F.col(part), x, ADDRESS, others)
        scores.append(F.struct(z.alias("z"), F.lit(x).alias("lang")))
    own = own.withColumn(prior, F.array(*scores))
    top = F.array_max(prior)
    own = own.withColumn("language", top["lang"])
    own = own.withColumn("probability", 1 / F.aggregate(prior, F.lit(0.0), lambda s, e: s + F.exp(e["z"] - F.array_max(F.col(prior))["z"])))
    own = own.withColumn("declared", F.col(said)).withColumn("addressed", F.col(part))
    return own.drop(host, site, said, part, prior, parts, *[f"{OWN}{level}_{x}" for level in "hs" for x in languages])
