"""Pages into documents, words into lines, lookups, duplicates and paging."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..stored import shared_folder
from .ranges import PIECE_ROWS

PAGE = ["doc_id", "page_num"]


def assemble_documents(pages: DataFrame) -> DataFrame:
    """Text of the pages in order, mean confidence, and the first page's language."""
    text = F.expr("listagg(text, '\\n\\n') within group (order by page_num)")
    return pages.groupBy("doc_id").agg(text.alias("text"), F.avg("confidence").alias("confidence"), F.min_by("language", "page_num").alias("language"), F.count("*").alias("pages"))


def lines_to_document(lines: DataFrame) -> DataFrame:
    """Lines joined to pages, pages to documents; the mean runs over lines, not over pages."""
    page = lines.groupBy(*PAGE).agg(F.expr("listagg(text, '\\n') within group (order by line_num)").alias("text"), F.sum("confidence").alias("s"), F.count("confidence").alias("n"))
    joined = F.expr("listagg(text, '\\n\\n') within group (order by page_num)").alias("text")
    out = page.groupBy("doc_id").agg(joined, F.sum("s").alias("s"), F.sum("n").alias("n"))
    return out.select("doc_id", "text", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("confidence"))


def _seen(words: DataFrame) -> DataFrame:
    return words.filter((F.trim("text") != "") & (F.col("confidence") > 0))


def words_to_text(words: DataFrame) -> DataFrame:
    """Non-blank words with a confidence, joined by spaces, and their mean confidence over 100."""
    return _seen(words).groupBy(*PAGE).agg(F.expr("listagg(text, ' ') within group (order by word_ord)").alias("text"), (F.avg("confidence") / 100).alias("confidence"))


def group_lines(words: DataFrame) -> DataFrame:
    """Lines with their box, the running pairwise confidence and, beside it, the plain mean."""
    word = F.struct("word_ord", "text", (F.col("confidence") / 100).alias("confidence"))
    lines = _seen(words).groupBy(*PAGE, "block_num", "line_num").agg(
        F.array_sort(F.collect_list(word)).alias("words"), F.min("left").alias("x1"), F.min("top").alias("y1"),
        F.max(F.col("left") + F.col("width")).alias("x2"), F.max(F.col("top") + F.col("height")).alias("y2"), (F.avg("confidence") / 100).alias("mean_confidence"),
    )
    running = F.aggregate(F.slice("words", 2, F.size("words")), F.get("words", F.lit(0))["confidence"], lambda a, w: (a + w["confidence"]) / 2)
    return lines.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " ")).withColumn("confidence", running).drop("words")


def content_key(content: Column, lang: Column) -> Column:
    return F.concat_ws(":", F.md5(content.cast("binary")), F.coalesce(lang, F.lit("auto")))


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, ttl: int = fixed.CACHE_TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Requests with a stored answer younger than ``ttl`` seconds, and the others; of several answers to a key the newest counts."""
    fresh = cache.filter(F.unix_timestamp("stored") + ttl > F.unix_timestamp(now)).groupBy("key").agg(F.max_by("answer", F.struct("stored", "answer")).alias("answer"))
    hits = requests.join(fresh, "key")
    return hits, requests.join(fresh, "key", "left_anti")


def dedup_content(df: DataFrame, content: str = "text", lang: str = "lang") -> DataFrame:
    """Smallest id and number of rows per content and language; equal contents meet in a partial aggregate."""
    return df.groupBy(content_key(F.col(content), F.col(lang)).alias("key")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))


def share_results(df: DataFrame, results: DataFrame, content: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with the results of the smallest id of its content and language, which alone was worked on.

    The join carries keys and results only on the small side; copies of one content are split by the skew join.
    """
    first = df.groupBy(content_key(F.col(content), F.col(lang)).alias("_key")).agg(F.min("doc_id").alias("first_id"))
    found = first.join(results.withColumnRenamed("doc_id", "first_id"), "first_id", "left")
    return df.withColumn("_key", content_key(F.col(content), F.col(lang))).join(found, "_key", "left").drop("_key")


def attach_extractions(documents: DataFrame, extractions: DataFrame, keep_all: bool = False) -> DataFrame:
    """Extractions of finished documents; with ``keep_all`` documents without one stay, and languages fall back to the document's."""
    done = documents.filter(F.col("status") == "finished")
    out = done.join(extractions.withColumnRenamed("language", "_language"), "doc_id", "left" if keep_all else "inner")
    return out.withColumn("language", F.coalesce("_language", "language")).drop("_language")


def paginate(df: DataFrame, order: list[str], page: int = 1, per_page: int = fixed.PAGE_SIZE) -> tuple[DataFrame, DataFrame]:
    """Rows of one page in a total order, and (current_page, total_pages, total_items).

    All rows before the page pass one task; pages far behind are read through ``page_index`` and ``page_of``.
    """
    rows = df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    totals = df.agg(F.count("*").alias("total_items"))
    return rows, totals.select(F.lit(page).alias("current_page"), F.ceil(F.col("total_items") / per_page).alias("total_pages"), "total_items")


def page_index(df: DataFrame, order: list[str], rows: int = PIECE_ROWS, most: int = 10_000) -> DataFrame:
    """``df`` written once in ranges of ``order``, one folder for each, for any number of pages to be read from.

    A range has about ``rows`` rows, or more where that takes over ``most`` ranges.  ``order`` has to be total.
    A task sorts a piece of the order and cuts it into ranges, so tasks grow with the rows, not with the ranges.
    """
    count = df.count()
    parts = min(most, max(1, -(-count // rows)))
    tasks = min(parts, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // PIECE_ROWS)))
    each = max(1, -(-count // max(1, parts - tasks)))  # a piece's last range is short
    local = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # piece and place in it
    cut = local.withColumn("page_range", F.shiftright(at, 33) * parts + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / each))
    path = f"{shared_folder(df.sparkSession)}/pages-{uuid.uuid4().hex}"
    cut.write.partitionBy("page_range").parquet(path)
    return df.sparkSession.read.schema(cut.schema).parquet(path)


def page_of(index: DataFrame, order: list[str], page: int, per_page: int = fixed.PAGE_SIZE) -> DataFrame:
    """One page from a ``page_index``: sizes of the ranges say which hold it, and only those are read and sorted."""
    start, at, held, skipped = (page - 1) * per_page, 0, [], 0
    for r in index.groupBy("page_range").agg(F.count("*").alias("n")).orderBy("page_range").collect():  # at most as many as ranges
        if at + r["n"] <= start:
            skipped = at + r["n"]
        elif at < start + per_page:
            held.append(r["page_range"])
        at += r["n"]
    rows = index.filter(F.col("page_range").isin(held)).drop("page_range") if held else index.drop("page_range").filter("false")
    return rows.orderBy(*order).offset(start - skipped).limit(per_page)


def number_rows(df: DataFrame, order: list[str], out: str = "row_no", parts: int | None = None) -> DataFrame:
    """Consecutive numbers in the order of ``order``, without one task seeing all rows.

    Rows are sorted over ranges; each range numbers its own rows and adds the
    sizes of the ranges before it.  ``order`` has to be total.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = local.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint()
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = local.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before"))
    return local.join(F.broadcast(sizes), "_part").withColumn(out, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def zip_columns(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """Attach ``right`` row by row in order; a shorter right side is padded with nulls."""
    return number_rows(left, left_order).join(number_rows(right, right_order), "row_no", "left")


def corpus_profile(docs: DataFrame, keys: list[str]) -> DataFrame:
    return docs.groupBy(*keys).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


def longest_text(results: DataFrame) -> DataFrame:
    """The longest text of each document; ties go to the engine that comes first."""
    return results.groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text").alias("n"), (-F.col("engine_ord")).alias("o"))).alias("text"))
