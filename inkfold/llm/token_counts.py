"""Token counts from a digest cache (operator 13).

A text is known by the SHA-256 of its normalised content, a tokenizer by the
SHA-256 of its file, library version and settings.  Digests are joined to the
counts that are stored for this tokenizer; one text of each missing digest is
encoded, and the new counts are appended to the cache before the documents are
joined to it.  Equal texts, however many, are encoded once, ever.

The cache is a folder of Parquet files, one subfolder per tokenizer digest, only
ever appended to.  A failed append leaves no files that a reader sees; two runs
at once may both store a digest, with the same count, and readers take one.

Normalised content: null is empty.  Where the tokenizer itself turns white space
into one space and drops it (read from its file), runs of ASCII white space are
one space and those at the ends go; else the text stays as it is.  The tokens of
such a text are those of its words, so a worker keeps the counts of repeated short
words (two times ``WORDS`` at most), encodes the others, and goes through a text in
pieces of ``PIECE`` characters: memory does not follow the longest text.  Other texts
are encoded whole.

What is bounded: the tokenizer file is broadcast (``MAX_FILE`` bytes, checked).
Missing digests are broadcast up to ``BROADCAST_KEYS`` to keep known texts out of
the shuffle; beyond that they are joined.  A hot text is reduced to one row per
partition before it is shuffled.  Counts of texts with at least a ``HOT_SHARE``-th of
all rows (no more than ``HOT_SHARE`` texts can have that) are broadcast, so no task
gets all copies of one text.

Defined results: null and empty texts have no bytes and no tokens; repeated rows
each get the count; an empty table gives an empty result and stores nothing.
Texts of any length are counted whole.  Columns of the input stay; columns named
like an output are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import OWN, written

LIMIT, PIECE, GROUP_CHARS = 2048, 1 << 16, 1 << 18
WORDS, WORD_CHARS = 1 << 17, 64
MAX_FILE, BROADCAST_KEYS = 32 << 20, 100_000
HOT_SHARE, HOT_ROWS = 10_000, 1000
CACHE_SCHEMA = "content binary, n_tokens bigint"
WHITE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer by its file: ``.json`` for the tokenizers library, ``.model`` for sentencepiece."""

    name: str
    data: bytes
    drops_white: bool

    @staticmethod
    def load(path: str) -> TokenizerFile:
        file = Path(path)
        data = file.read_bytes()
        if len(data) > MAX_FILE:
            raise ValueError(f"{file.name}: {len(data)} bytes are more than the {MAX_FILE} that may be broadcast")
        if file.suffix not in (".json", ".model"):
            raise ValueError(f"{file.name}: no library for this kind of file")
        return TokenizerFile(file.name, data, file.suffix == ".json" and _drops_white(json.loads(data)))

    @property
    def digest(self) -> str:
        """Digest of the file, the library's version and the settings of ``counter``."""
        if self.name.endswith(".json"):
            import tokenizers as library
        else:
            import sentencepiece as library
        settings = f"{library.__name__} {library.__version__} plain pieces={self.drops_white}"
        return hashlib.sha256(settings.encode() + b"\0" + self.data).hexdigest()

    def counter(self):
        """Function from texts to their numbers of tokens; no tokens are added, nothing is cut or padded."""
        if self.name.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_buffer(self.data)
            own.no_truncation()
            own.no_padding()
            return lambda texts: [len(x) for x in own.encode_batch_fast(texts, add_special_tokens=False)]
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=self.data)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def _parts(spec: dict | None, listed: str) -> list[dict]:
    return [] if not spec else spec[listed] if spec["type"] == "Sequence" else [spec]


def _drops_white(spec: dict) -> bool:
    """Whether white space only separates: the normalizer makes every run one space, and the splitter keeps none of it."""
    folds = any(x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in _parts(spec.get("normalizer"), "normalizers"))
    first = (_parts(spec.get("pre_tokenizer"), "pretokenizers") or [{"type": ""}])[0]
    removes = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and "[^\\s" in first["pattern"].get("Regex", "") and " ?" not in first["pattern"]["Regex"]
    plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(c.isspace() for c in x["content"]) for x in spec.get("added_tokens") or [])
    return folds and removes and plain


def normalised(text: Column, tokenizer: TokenizerFile) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, WHITE, " ")) if tokenizer.drops_white else text


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only at spaces."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


class WordCounts:
    """Tokens of texts whose words the tokenizer treats apart.

    Counts of words that come twice in a group of texts are kept, in two generations:
    a full one becomes the old one, from which words come back when they are met
    again.  The other words of a text are encoded together.
    """

    def __init__(self, count):
        self.count, self.known, self.old = count, {}, {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > WORDS:
            self.known, self.old = {}, self.known
        unmet = Counter(w for w in words if w not in self.known)
        self.known |= {w: self.old[w] for w in unmet if w in self.old}
        if fresh := [w for w, n in unmet.items() if n > 1 and len(w) <= WORD_CHARS and w not in self.known]:
            self.known.update(zip(fresh, self.count(fresh), strict=True))

    def group(self, parts: list[str]) -> Iterator[int]:
        """Tokens of each of some short texts."""
        cut = [x.split(" ") for x in parts]
        self._learn([w for words in cut for w in words])
        seldom = self.count([" ".join([w for w in words if w not in self.known]) for words in cut])
        for words, n in zip(cut, seldom, strict=True):
            yield n + sum([self.known.get(w, 0) for w in words])

    def __call__(self, texts: list[str]) -> list[int]:
        totals = [0] * len(texts)
        rows, parts, held = [], [], 0
        for row, text in enumerate(texts):
            for piece in pieces(text):
                rows.append(row)
                parts.append(piece)
                held += len(piece)
                if held >= GROUP_CHARS:
                    for k, n in zip(rows, self.group(parts), strict=True):
                        totals[k] += n
                    rows, parts, held = [], [], 0
        for k, n in zip(rows, self.group(parts), strict=True):
            totals[k] += n
        return totals


def _whole_texts(texts: list[str], count) -> Iterator[int]:
    at = 0
    while at < len(texts):
        upto, held = at + 1, len(texts[at])
        while upto < len(texts) and held + len(texts[upto]) <= GROUP_CHARS:
            held += len(texts[upto])
            upto += 1
        yield from count(texts[at:upto])
        at = upto


def _encoder(sent):
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer = sent.value
        if not cache:
            count = tokenizer.counter()
            cache["own"] = WordCounts(count) if tokenizer.drops_white else count
        for batch in batches:
            texts = batch.column("text").to_pylist()
            totals = cache["own"](texts) if tokenizer.drops_white else list(_whole_texts(texts, cache["own"]))
            yield pa.record_batch([batch.column("content"), pa.array(totals, pa.int64()), batch.column("copies")], ["content", "n_tokens", "copies"])

    return run


def stored(spark: SparkSession, cache: str, tokenizer: TokenizerFile) -> DataFrame:
    """Counts of ``tokenizer`` in the cache, one per content digest; none if nothing was stored yet."""
    folder = f"{cache}/tokenizer={tokenizer.digest}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def encode(texts: DataFrame, tokenizer: TokenizerFile) -> DataFrame:
    """``content, n_tokens, copies`` of rows of ``content, text, copies``."""
    sent = texts.sparkSession.sparkContext.broadcast(tokenizer)
    return texts.mapInArrow(_encoder(sent), f"{CACHE_SCHEMA}, copies bigint")


def _filled(docs: DataFrame, tokenizer: TokenizerFile, cache: str, text_col: str, broadcast_keys: int) -> tuple[int, DataFrame]:
    """The number of texts encoded, and ``content, copies`` of the documents."""
    spark = docs.sparkSession
    text = normalised(F.col(text_col), tokenizer)
    keyed = docs.select(_digest(text).alias("content"), text.alias("text"))
    known = stored(spark, cache, tokenizer)
    one = lambda rows: rows.groupBy("content").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    copies = None
    if known.isEmpty():
        todo = one(keyed)
    else:
        copies = written(keyed.groupBy("content").agg(F.count("*").alias("copies")), "content-digests")
        missing = written(copies.join(known, "content", "left_anti").select("content"), "missing-digests")
        n = missing.count()
        if not n:
            return 0, copies
        todo = one(keyed.join(F.broadcast(missing), "content", "left_semi")) if n <= broadcast_keys else one(keyed).join(missing, "content", "left_semi")
    fresh = written(encode(todo, tokenizer), "fresh-counts")  # a repeated task of the append would otherwise encode again
    fresh.select("content", "n_tokens").write.mode("append").parquet(f"{cache}/tokenizer={tokenizer.digest}")
    return fresh.count(), fresh.select("content", "copies") if copies is None else copies


def fill_cache(docs: DataFrame, tokenizer: TokenizerFile, cache: str, text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> int:
    """Encode what the cache lacks and append it; returns how many texts were encoded."""
    return _filled(docs, tokenizer, cache, text_col, broadcast_keys)[0]


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def count_tokens(docs: DataFrame, tokenizer: TokenizerFile, cache: str, text_col: str = "text", limit: int = LIMIT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``; ``cache`` is a folder that all executors share."""
    _, copies = _filled(docs, tokenizer, cache, text_col, BROADCAST_KEYS)
    key, n, hot_n, size = (f"{OWN}{x}" for x in ("content", "n", "hot", "bytes"))
    counts = stored(docs.sparkSession, cache, tokenizer)
    total = copies.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = written(counts.join(F.broadcast(copies.filter(F.col("copies") >= max(hot_rows, -(-total // HOT_SHARE))).select("content")), "content", "left_semi"), "hot-counts")
    out = docs.withColumn(key, _digest(normalised(F.col(text_col), tokenizer))).withColumn(size, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint"))
    out = out.join(F.broadcast(hot.select(F.col("content").alias(key), F.col("n_tokens").alias(hot_n))), key, "left")
    # rows that have their count already are spread over tasks by a key that nothing matches
    spread = F.concat(F.col(key), F.pmod(F.monotonically_increasing_id(), F.lit(997)).cast("string").cast("binary"))
    out = out.withColumn(key, F.when(F.col(hot_n).isNull(), F.col(key)).otherwise(spread))
    out = out.join(counts.select(F.col("content").alias(key), F.col("n_tokens").alias(n)), key, "left")
    out = out.withColumn("n_bytes", F.col(size)).withColumn("n_tokens", F.coalesce(hot_n, n))
    return out.withColumn("over_limit", F.col("n_tokens") > limit).drop(key, n, hot_n, size)
