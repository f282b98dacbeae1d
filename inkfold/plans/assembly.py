"""Queries that assemble, look up and page, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as op
from .derived import ENGINE_RESULTS, PAGES, WORDS, engine_results, pages, table, words


def assemble_documents(spark, d):
    return op.assemble_documents(pages(spark, d)).select("doc_id", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"), "language", "pages")


def _lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_num"), F.posexplode(F.split("text", "\n", -1)).alias("line_num", "text"))
    return docs.withColumn("confidence", F.when(F.col("line_num") % 4 > 0, ((F.col("doc_id") + F.col("line_num")) % 100).cast("double")))


def lines_to_document(spark, d):
    return op.lines_to_document(_lines(spark, d)).select("doc_id", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"))


def words_to_text(spark, d):
    return op.words_to_text(words(spark, d)).select("doc_id", "page_num", F.md5("text").alias("text_md5"), F.round("confidence", 9).alias("confidence"))


def group_lines(spark, d):
    """Lines as the operator returns them: text, box, the running pairwise confidence and the plain mean."""
    out = op.group_lines(words(spark, d))
    return out.select("doc_id", "page_num", "block_num", "line_num", "text", "x1", "y1", "x2", "y2", F.round("confidence", 6).alias("confidence"), F.round("mean_confidence", 6).alias("mean_confidence"))


def running_confidence(spark, d):
    return op.group_lines(words(spark, d)).select("doc_id", "line_num", "block_num", F.round("confidence", 6).alias("confidence"))


def _requests(spark, d):
    return table(spark, d, "documents").select("doc_id", op.content_key(F.col("text"), F.col("lang")).alias("key"))


def _cache(spark, d):
    docs = table(spark, d, "documents").filter("doc_id % 3 = 0")
    rows = docs.select(op.content_key(F.col("text"), F.col("lang")).alias("key"), F.col("doc_id").alias("answer"))  # copies have several entries
    return rows.withColumn("stored", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("answer") % 100 * 60))


NOW = 1_700_000_000


def cache_hits(spark, d):
    return op.cache_lookup(_requests(spark, d), _cache(spark, d), F.timestamp_seconds(F.lit(NOW)))[0]


def cache_misses(spark, d):
    return op.cache_lookup(_requests(spark, d), _cache(spark, d), F.timestamp_seconds(F.lit(NOW)))[1]


def dedup_content(spark, d):
    return op.dedup_content(table(spark, d, "documents"))


def share_results(spark, d):
    """Chars and source of the first copy, for every copy."""
    docs = table(spark, d, "documents")
    first = docs.join(op.dedup_content(docs).select(F.col("first_id").alias("doc_id")), "doc_id", "left_semi")
    results = first.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.col("source").alias("worked_source"))
    return op.share_results(docs, results).select("doc_id", "first_id", "chars", "worked_source")


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("finished").alias("status"), F.col("lang").alias("language"))


def _extractions(spark, d):
    return table(spark, d, "labels").select("doc_id", "quality", F.when(F.col("doc_id") % 2 == 0, "eng").alias("language"))


def attach_extractions(spark, d):
    return op.attach_extractions(_documents(spark, d), _extractions(spark, d))


def report_extractions(spark, d):
    return op.attach_extractions(_documents(spark, d), _extractions(spark, d), keep_all=True)


def paginate(spark, d):
    return op.paginate(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 3)[0]


def paginate_deep(spark, d):
    """A page far behind, from an index in ranges."""
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    index = op.page_index(table(spark, d, "lineitem").select(*order), order, rows=1000)
    return op.page_of(index, order, 250)


def page_totals(spark, d):
    return op.paginate(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 3)[1]


def zip_columns(spark, d):
    left = table(spark, d, "documents").select("doc_id", "source")
    return op.zip_columns(left, ["doc_id"], table(spark, d, "pages").select("page_id", "url"), ["url", "page_id"]).select("row_no", "doc_id", "source", "page_id", "url")


def corpus_profile(spark, d):
    return op.corpus_profile(table(spark, d, "documents"), ["lang", "source"])


def longest_text(spark, d):
    return op.longest_text(engine_results(spark, d)).select("doc_id", F.md5("text").alias("text_md5"))


_KEY = "md5(text) || ':' || coalesce(lang, 'auto')"
_CACHE = f"WITH r AS (SELECT doc_id, {_KEY} AS key FROM documents), c AS (SELECT {_KEY} AS key, arg_max(doc_id, (-(doc_id % 100), doc_id)) AS answer FROM documents WHERE doc_id % 3 = 0 AND doc_id % 100 * 60 < 3600 GROUP BY 1)"
_SEEN = f"WITH {WORDS}, s AS (SELECT * FROM words_ WHERE trim(text) <> '' AND confidence > 0)"
_DOCS = "d AS (SELECT doc_id, 'finished' AS status, lang FROM documents WHERE doc_id % 5 <> 0), x AS (SELECT doc_id, quality, CASE WHEN doc_id % 2 = 0 THEN 'eng' END AS l FROM labels)"

QUERIES = {
    "assemble_documents": (assemble_documents, f"WITH {PAGES} SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_num)) AS text_md5, round(avg(confidence), 6) AS confidence, arg_min(language, page_num) AS language, count(*) AS pages FROM pages_ GROUP BY 1"),
    "lines_to_document": (lines_to_document, "WITH l AS (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents), c AS (SELECT doc_id, sum((doc_id + k) % 100) FILTER (k % 4 > 0) AS s, count(*) FILTER (k % 4 > 0) AS n FROM l GROUP BY 1) SELECT doc_id, md5(text) AS text_md5, round(CASE WHEN n > 0 THEN s / n ELSE 0.0::DOUBLE END, 6) AS confidence FROM c JOIN documents USING (doc_id)"),
    "words_to_text": (words_to_text, _SEEN + " SELECT doc_id, page_num, md5(string_agg(text, ' ' ORDER BY word_ord)) AS text_md5, round(avg(confidence) / 100, 9) AS confidence FROM s GROUP BY 1, 2"),
    "group_lines": (group_lines, _SEEN + ' SELECT doc_id, page_num, block_num, line_num, string_agg(text, \' \' ORDER BY word_ord) AS text, min("left") AS x1, min(top) AS y1, max("left" + width) AS x2, max(top + height) AS y2, round(list_reduce(list(confidence / 100 ORDER BY word_ord), lambda a, b: (a + b) / 2), 6) AS confidence, round(avg(confidence) / 100, 6) AS mean_confidence FROM s GROUP BY 1, 2, 3, 4'),
    "running_confidence": (running_confidence, _SEEN + " SELECT doc_id, line_num, block_num, round(list_reduce(list(confidence / 100 ORDER BY word_ord), lambda a, b: (a + b) / 2), 6) AS confidence FROM s GROUP BY 1, 2, 3"),
    "cache_hits": (cache_hits, _CACHE + " SELECT doc_id, key, answer FROM r JOIN c USING (key)"),
    "cache_misses": (cache_misses, _CACHE + " SELECT doc_id, key FROM r ANTI JOIN c USING (key)"),
    "dedup_content": (dedup_content, f"SELECT {_KEY} AS key, min(doc_id) AS first_id, count(*) AS rows FROM documents GROUP BY 1"),
    "share_results": (share_results, f"WITH k AS (SELECT doc_id, {_KEY} AS key FROM documents), f AS (SELECT key, min(doc_id) AS first_id FROM k GROUP BY 1) SELECT k.doc_id, first_id, length(d.text) AS chars, d.source AS worked_source FROM k JOIN f USING (key) JOIN documents d ON d.doc_id = first_id"),
    "attach_extractions": (attach_extractions, f"WITH {_DOCS} SELECT doc_id, status, coalesce(l, lang) AS language, quality FROM d JOIN x USING (doc_id)"),
    "report_extractions": (report_extractions, f"WITH {_DOCS} SELECT doc_id, status, coalesce(l, lang) AS language, quality FROM d LEFT JOIN x USING (doc_id)"),
    "paginate": (paginate, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 40"),
    "paginate_deep": (paginate_deep, "SELECT l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY ALL LIMIT 20 OFFSET 4980"),
    "page_totals": (page_totals, "SELECT 3 AS current_page, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, count(*) AS total_items FROM orders"),
    "zip_columns": (zip_columns, "WITH a AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS row_no FROM documents), b AS (SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) AS row_no FROM pages) SELECT row_no, doc_id, source, page_id, url FROM a LEFT JOIN b USING (row_no)"),
    "corpus_profile": (corpus_profile, "SELECT lang, source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest FROM documents GROUP BY 1, 2"),
    "longest_text": (longest_text, f"WITH {ENGINE_RESULTS} SELECT doc_id, md5(arg_max(text, length(text) * 10 - engine_ord)) AS text_md5 FROM engine_results GROUP BY 1"),
}
