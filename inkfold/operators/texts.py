"""Text clean-up, splitting, checking and file manifests as table operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.scalar import is_blank, lookup
from ..functions.unicode import nfkc_each

Rules = dict[str, Callable[[Column], Column]]


def normalize_common(df: DataFrame, column: str = "text", clean: Callable[[Column], Column] = text.normalize_common) -> DataFrame:
    return df.withColumn(column, clean(F.col(column)))


def normalize_by_language(df: DataFrame, column: str = "text", lang: str = "lang", clean: Callable[[Column], Column] = text.normalize_common, rules: Rules | None = None, keep_blank: bool = True) -> DataFrame:
    """Common clean-up, then language rules and business formats; blank texts pass through, unless ``keep_blank`` is off.

    ``clean`` and ``rules`` (by language) take the place of the full clean-up and of the rules and formats.
    """
    common = df.withColumn("_common", clean(F.col(column)))
    done = text.language_steps(F.col("_common"), F.col(lang), rules)
    if keep_blank:
        done = F.when(is_blank(F.col(column)), F.col(column)).otherwise(done)
    return common.withColumn(column, done).drop("_common")


def normalize_pages(docs: DataFrame, pages: str = "pages", lang: str = "lang", clean: Callable[[Column], Column] | None = None, rules: Rules | None = None) -> DataFrame:
    """``normalize_by_language`` on the text of every element of an array of pages, without taking it apart."""
    texts = F.transform(F.col(pages), lambda p: p["text"])
    folded = docs.withColumn("_folded", F.transform(texts, clean) if clean else nfkc_each(texts))
    common, blank = (lambda t: t, lambda t: t == "") if clean else (text.normalize_folded, is_blank)
    done = F.transform(
        F.arrays_zip(F.col(pages).alias("p"), F.col("_folded").alias("t")),
        lambda z: z["p"].withField("text", F.when(blank(z["t"]), z["p"]["text"]).otherwise(text.language_steps(common(z["t"]), F.col(lang), rules))),
    )
    return folded.withColumn(pages, done).drop("_folded")


def split_sentences(df: DataFrame, column: str = "text", lang: str = "lang") -> DataFrame:
    return df.select("doc_id", F.posexplode(text.split_sentences(F.col(column), F.col(lang))).alias("sentence_no", "sentence"))


def chunk_text(df: DataFrame, size: int = 1000, overlap: int = 100, column: str = "text") -> DataFrame:
    chunks = F.posexplode(text.chunks(F.col(column), size, overlap)).alias("chunk_no", "c")
    return df.select("doc_id", chunks).select("doc_id", "chunk_no", "c.start", "c.chunk")


def flag_forms(df: DataFrame, column: str = "text", words: list[str] = fixed.FORM_KEYWORDS) -> DataFrame:
    found = [F.contains(F.lower(column), F.lit(w)) for w in words]
    return df.withColumn("is_form", F.coalesce(F.greatest(*found), F.lit(False)))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Passed and failed rows per rule in one pass, and the rows that break a rule with the rules' names."""
    checks = {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}
    counts = df.agg(*[F.count_if(v).alias(f"p_{k}") for k, v in checks.items()], F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"p_{k}").alias("passed"), (F.col("n") - F.col(f"p_{k}")).alias("failed")) for k in checks])
    broken = F.filter(F.array(*[F.when(~v, F.lit(k)) for k, v in checks.items()]), lambda x: x.isNotNull())
    return counts.select(F.inline(rows)), df.withColumn("broken", broken).filter(F.size("broken") > 0)


def is_language(value: Column) -> Column:
    """Codes that a user may ask for, in any case."""
    return F.lower(value).isin(fixed.LANGUAGE_OPTIONS)


def is_field(name: Column, kind: Column) -> Column:
    """A field to extract has a name; its type is known, or not given."""
    return name.isNotNull() & (kind.isNull() | kind.isin(fixed.FIELD_TYPES))


def is_threshold(value: Column) -> Column:
    return value.between(0.0, 1.0)


def logo_labels(labels: DataFrame, column: str = "description") -> DataFrame:
    """Image labels that speak of a logo or brand."""
    return labels.filter(F.coalesce(F.greatest(*[F.contains(F.lower(column), F.lit(w)) for w in fixed.LOGO_KEYWORDS]), F.lit(False)))


def is_email(value: Column) -> Column:
    return value.rlike(fixed.VALID_EMAIL)


def is_url(value: Column) -> Column:
    return value.rlike(fixed.VALID_URL)


def is_json(value: Column) -> Column:
    """One whole JSON value: as the only element of an array, nothing may stand behind it."""
    return F.try_parse_json(value).isNotNull() & (F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1)


def read_manifest(files: DataFrame, max_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """``files`` (name, bytes) with extension, MIME type and the reason of a reject, null for accepted files."""
    ext = text.extension(F.col("name"))
    mime = lookup(fixed.MIME_TYPES, F.col("extension"))
    reason = F.when(F.col("mime").isNull(), "unsupported type").when(F.col("bytes") > max_bytes, "too large")
    return files.withColumn("extension", ext).withColumn("mime", mime).withColumn("rejected", reason)


def clean_manifest(files: DataFrame, max_chars: int = fixed.MAX_NAME_CHARS) -> DataFrame:
    """Safe names beside the full ones, whether a stem was cut, and readable sizes; nothing is dropped."""
    return files.select(
        "*", text.safe_file_name(F.col("name"), max_chars).alias("safe_name"),
        (F.length(text.clean_stem(F.col("name"))) > max_chars).alias("truncated"), text.readable_size(F.col("bytes")).alias("size_text"),
    )


def list_corpus(files: DataFrame) -> DataFrame:
    """Files and bytes per folder."""
    folder = F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def page_plan(docs: DataFrame, max_pages: int = fixed.MAX_PAGES, max_side: int = fixed.MAX_SIDE_PX, min_side: int = fixed.MIN_SIDE_PX, batch: int = fixed.PAGE_BATCH) -> tuple[DataFrame, DataFrame]:
    """One row per page to read with its scale and batch, and the pages beyond ``max_pages`` as rejects.

    ``docs``: doc_id, n_pages, first, last, width, height; the range is clamped to the document.
    """
    first = F.greatest(F.coalesce("first", F.lit(1)), F.lit(1))
    last = F.least(F.coalesce("last", F.col("n_pages")), F.col("n_pages"))
    spans = docs.withColumn("first", first).withColumn("last", last).filter("last >= first")
    longer, shorter = F.greatest("width", "height"), F.least("width", "height")
    scale = F.when(longer > max_side, max_side / longer).when(shorter < min_side, min_side / shorter).otherwise(F.lit(1.0))
    pages = spans.withColumn("page_num", F.explode(F.sequence("first", "last"))).withColumn("scale", scale)
    pages = pages.withColumn("batch", F.floor((F.col("page_num") - F.col("first")) / batch).cast("int"))
    own = ["doc_id", "page_num", "scale", "batch"]
    return pages.filter(F.col("page_num") <= max_pages).select(*own), pages.filter(F.col("page_num") > max_pages).select("doc_id", "page_num")


