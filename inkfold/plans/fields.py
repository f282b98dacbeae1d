"""Queries over configured fields, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import fields as op
from ..stored import shared_folder
from .derived import table

FIELDS = [
    {"name": "invoice_number", "type": "text", "context": r"No\.|Ref", "regex": r"([0-9]{1,3}-[0-9]{1,5})"},
    {"name": "total_amount", "type": "amount", "context": "total|sum", "regex": r"([0-9.]+)"},
    {"name": "company_name", "type": "company", "context": "company", "regex": ""},
]
NAMES = [f["name"] for f in FIELDS]


def _docs(spark, d):
    """Whole documents between planted fields: the company line in front, the number and the total behind the text."""
    n = F.col("doc_id")
    company = F.concat(F.lit("company: Acme"), (n % 9).cast("string"), F.lit(" Ltd\n"))
    rest = F.concat(F.lit("\nNo. "), (n % 90).cast("string"), F.lit("-"), (n % 5000).cast("string"), F.lit("\n"), F.when(n % 4 > 0, F.concat(F.lit("total: "), (n % 700).cast("string"), F.lit(".25"))).otherwise(""))
    text = F.concat(company, F.coalesce("text", F.lit("")), rest)
    return table(spark, d, "documents").select("doc_id", text.alias("text"), F.when(n % 2 == 0, "eng").otherwise("other").alias("lang"))


def extract_fields(spark, d):
    return op.extract_fields(_docs(spark, d), FIELDS)


def build_requests(spark, d):
    return op.build_requests(_docs(spark, d), FIELDS).select("doc_id", F.length("prompt").cast("bigint").alias("chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


def _responses(spark, d):
    n = F.col("doc_id")
    amount = F.when(n % 4 == 0, F.concat(F.lit('"-'), (n % 50).cast("string"), F.lit(',5 EUR"'))).when(n % 4 == 1, F.concat(F.lit("-"), (n % 50).cast("string"))).when(n % 4 == 2, F.lit('"NULL"')).otherwise(F.lit("null"))
    body = F.concat(F.lit('{"invoice_number": "A'), n.cast("string"), F.lit('", "total_amount": '), amount, F.lit(', "other": 1'), F.when(n % 7 == 0, "").otherwise("}"))
    fenced = F.when(n % 3 == 0, body).when(n % 3 == 1, F.concat(F.lit("ok\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("```"), body, F.lit("```")))
    return table(spark, d, "documents").select("doc_id", fenced.alias("response"))


def parse_responses(spark, d):
    return op.parse_responses(_responses(spark, d), FIELDS)[0]


def parse_errors(spark, d):
    return op.parse_responses(_responses(spark, d), FIELDS)[1]


def export_fields(spark, d):
    extras = table(spark, d, "documents").select("doc_id", F.col("source").alias("origin"))
    return op.export_rows(op.extract_fields(_docs(spark, d), FIELDS), NAMES, extras, ["doc_id", "origin"])


def apply_changes(spark, d):
    return op.apply_changes(*_changes(spark, d))[0]


def rejected_changes(spark, d):
    return op.apply_changes(*_changes(spark, d))[1]


def _changes(spark, d):
    """All line items as one change log, in the order of order, line and part, on the fields that even part numbers had; some updates rename inside a block of four parts, some rows reset."""
    items = table(spark, d, "lineitem").withColumn("ord", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey")).withColumn("name", F.col("l_partkey"))
    kinds = F.element_at(F.array(F.lit("add"), F.lit("update"), F.lit("delete")), (F.col("ord") % 3 + 1).cast("int"))
    kinds = F.when((F.col("l_orderkey") % 5000 == 3) & (F.col("l_linenumber") == 1), "reset").otherwise(kinds)
    new = F.when(F.col("ord") % 7 < 3, F.floor(F.col("name") / 4) * 4 + F.col("ord") % 4)
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("name"))
    changes = items.select("ord", kinds.alias("op"), "name", F.concat(F.lit("t"), (F.col("ord") % 5).cast("string")).alias("type"), new.alias("new_name"))
    return parts.filter("name % 2 = 0").withColumn("type", F.lit("text")), changes, parts.filter("name % 3 = 0").withColumn("type", F.lit("d"))


def _results(spark, d):
    n = F.col("doc_id")
    page = lambda k: F.struct(F.lit(k).alias("page_num"), F.concat(F.lit(f"page {k} of "), n.cast("string")).alias("text"))
    entities = F.create_map(F.lit("emails"), F.array(F.concat(F.lit("a"), n.cast("string"), F.lit("@b.org"))), F.lit("dates"), F.array(F.lit("2023-01-01"), F.lit("2024-01-01")))
    row = F.struct(n.cast("string").alias("file_id"), F.lit("x").alias("text"), ((n % 100) / 100.0).cast("double").alias("confidence"), F.array(page(1), page(2)).alias("pages"), entities.alias("entities"))
    return table(spark, d, "documents").select(F.to_json(row).alias("json"))


def read_results(spark, d):
    return op.read_results(_results(spark, d))[0]


def read_result_pages(spark, d):
    return op.read_results(_results(spark, d))[1]


def read_result_entities(spark, d):
    return op.read_results(_results(spark, d))[2]


def field_template(spark, d):
    """Fields derived from parts, written as a template and read back."""
    rows = table(spark, d, "part").select(F.col("p_name").alias("name"), F.lit("text").alias("type"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("context"), F.when(F.col("p_size") % 3 == 0, F.lit(r"(\d+),\s*")).alias("regex"))
    path = f"{shared_folder(spark)}/template-{uuid.uuid4().hex}"
    op.write_field_template(rows, path)
    return op.read_field_template(spark, path)


def form_fields(spark, d):
    """Typed fields of the first document of each source only."""
    return op.first_form(op.extract_fields(_docs(spark, d), FIELDS).join(table(spark, d, "documents").select("doc_id", F.col("source").alias("form")), "doc_id"))


def collect_export(spark, d):
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("processing").alias("status"))
    return op.collect_export(tasks, table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("fields")))


_VALUES = "v AS (SELECT doc_id, source, 'Acme' || (doc_id % 9) || ' Ltd' AS company, (doc_id % 90) || '-' || (doc_id % 5000) AS invoice, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 700) || '.25' ELSE CAST(doc_id % 9 AS VARCHAR) END AS amount FROM documents)"
_FOLD = """WITH RECURSIVE l AS (SELECT ord, CASE WHEN l_orderkey % 5000 = 3 AND l_linenumber = 1 THEN 'reset' ELSE ['add', 'update', 'delete'][ord % 3 + 1] END AS op, l_partkey AS name FROM (SELECT *, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS ord FROM lineitem) t),
e AS (SELECT *, 't' || (ord % 5) AS type, CASE WHEN ord % 7 < 3 THEN name // 4 * 4 + ord % 4 ELSE name END AS new, count(*) FILTER (op = 'reset') OVER (ORDER BY ord) AS epoch, name // 4 AS block FROM l),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY epoch, block ORDER BY ord) AS k FROM e WHERE op <> 'reset'),
p AS (SELECT epoch, p_partkey // 4 AS block, p_partkey % 4 AS slot, CASE WHEN epoch = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'text' END WHEN p_partkey % 3 = 0 THEN 'd' END AS type FROM part, (SELECT unnest(range((SELECT count(*) + 1 FROM l WHERE op = 'reset'))) AS epoch) t),
b AS (SELECT epoch, block, [max(type) FILTER (slot = 0), max(type) FILTER (slot = 1), max(type) FILTER (slot = 2), max(type) FILTER (slot = 3)] AS s FROM p GROUP BY 1, 2),
w AS (SELECT epoch, block, CAST(0 AS BIGINT) AS k, s, CAST(NULL AS BIGINT) AS ord, true AS ok FROM b
  UNION ALL SELECT epoch, block, k, CASE WHEN NOT ok THEN s ELSE [CASE WHEN op = 'add' AND slot_ = i OR op = 'update' AND to_ = i THEN type WHEN op <> 'add' AND slot_ = i THEN NULL ELSE s[i + 1] END FOR i IN [0, 1, 2, 3]] END, ord, ok
  FROM (SELECT c.epoch, c.block, c.k, w.s, c.ord, c.op, c.type, c.name % 4 AS slot_, c.new % 4 AS to_,
    CASE c.op WHEN 'add' THEN w.s[c.name % 4 + 1] IS NULL WHEN 'delete' THEN w.s[c.name % 4 + 1] IS NOT NULL ELSE w.s[c.name % 4 + 1] IS NOT NULL AND (c.new = c.name OR w.s[c.new % 4 + 1] IS NULL) END AS ok
    FROM w JOIN c ON w.epoch = c.epoch AND w.block = c.block AND c.k = w.k + 1) z)"""
_PROMPTS = r"""WITH p AS (SELECT doc_id, '# 문서 필드 추출

Extract the following fields from this English document.

## 추출할 필드
1. invoice_number (Type: text)
   키워드: "No\.", "Ref" 주변에서 값을 찾으세요.
   패턴: 일반적인 형식은 "([0-9]{1,3}-[0-9]{1,5})"와 같습니다.

2. total_amount (Type: amount)
   키워드: "total", "sum" 주변에서 값을 찾으세요.
   패턴: 일반적인 형식은 "([0-9.]+)"와 같습니다.
   금액에서 통화 기호와 쉼표를 제거하고 숫자만 반환하세요. 예: 1000.50

3. company_name (Type: company)
   키워드: "company" 주변에서 값을 찾으세요.
   회사명에서 법적 형태(주식회사, LLC 등)를 포함하여 전체 이름을 추출하세요.

## 추출 규칙
1. 존재하지 않거나 확인할 수 없는 필드는 null로 반환하세요.
2. 값이 있으면 정확히 추출하되, 필요 시 정규화하세요.
3. 주변 문맥을 고려하여 가장 관련성 높은 값을 선택하세요.
4. 여러 비슷한 값이 있으면, 문서 문맥에 가장 적합한 것을 선택하세요.
5. 응답은 JSON 형식으로 제공하세요.

## OCR로 추출된 텍스트
```
company: Acme' || (doc_id % 9) || ' Ltd' || chr(10) || coalesce(text, '') || chr(10) || 'No. ' || (doc_id % 90) || '-' || (doc_id % 5000) || chr(10) || CASE WHEN doc_id % 4 > 0 THEN 'total: ' || (doc_id % 700) || '.25' ELSE '' END || '
```

## 응답 형식
다음과 같은, 필드 이름과 해당 값으로 이루어진 JSON 형식으로 응답하세요:
```json
{
  "필드1": "값1",
  "필드2": "값2",
  ...
}
```
JSON만 반환하고 다른 설명은 포함하지 마세요.' AS prompt FROM documents) SELECT doc_id, length(prompt) AS chars, sha256(prompt) AS prompt_sha256 FROM p"""

QUERIES = {
    "extract_fields": (extract_fields, f"WITH {_VALUES} SELECT doc_id, unnest(['invoice_number', 'total_amount', 'company_name']) AS field_name, unnest(['text', 'amount', 'company']) AS field_type, unnest([invoice, amount, company]) AS value FROM v"),
    "build_extraction_requests": (build_requests, _PROMPTS),
    "parse_extractions": (parse_responses, "WITH g AS (SELECT * FROM documents WHERE doc_id % 7 <> 0) SELECT doc_id, 'invoice_number' AS field_name, 'text' AS field_type, 'A' || doc_id AS value_string, NULL::DOUBLE AS value_double FROM g UNION ALL SELECT doc_id, 'company_name', 'company', NULL, NULL FROM g UNION ALL SELECT doc_id, 'total_amount', 'amount', CASE doc_id % 4 WHEN 0 THEN '-' || (doc_id % 50) || ',5 EUR' WHEN 1 THEN '-' || (doc_id % 50) END, CASE doc_id % 4 WHEN 0 THEN CAST((doc_id % 50) || '5' AS DOUBLE) WHEN 1 THEN CAST(-(doc_id % 50) AS DOUBLE) END FROM g"),
    "parse_extraction_errors": (parse_errors, "SELECT doc_id, 'no JSON object' AS error FROM documents WHERE doc_id % 7 = 0"),
    "export_fields": (export_fields, f"WITH {_VALUES} SELECT source AS origin, CAST(doc_id AS VARCHAR) AS doc_id, invoice AS invoice_number, amount AS total_amount, company AS company_name FROM v"),
    "apply_field_changes": (apply_changes, _FOLD + " SELECT * FROM (SELECT block * 4 + i AS name, s[i + 1] AS type FROM (SELECT block, arg_max(s, k) AS s FROM (SELECT epoch, block, k, s, max(epoch) OVER () AS e FROM w) v WHERE epoch = e GROUP BY 1) z, (SELECT unnest(range(4)) AS i) t) y WHERE type IS NOT NULL"),
    "rejected_field_changes": (rejected_changes, _FOLD + " SELECT ord, op, name FROM w JOIN c USING (epoch, block, k, ord) WHERE NOT ok"),
    "read_results": (read_results, "SELECT CAST(doc_id AS VARCHAR) AS file_id, 'x' AS text, CAST((doc_id % 100) / 100.0 AS DOUBLE) AS confidence FROM documents"),
    "read_result_pages": (read_result_pages, "SELECT CAST(doc_id AS VARCHAR) AS file_id, k AS page_num, 'page ' || k || ' of ' || doc_id AS text FROM documents, (SELECT unnest([1, 2]) AS k) t"),
    "read_result_entities": (read_result_entities, "SELECT CAST(doc_id AS VARCHAR) AS file_id, unnest(['emails', 'dates', 'dates']) AS entity_type, unnest(['a' || doc_id || '@b.org', '2023-01-01', '2024-01-01']) AS value FROM documents"),
    "field_template": (field_template, r"SELECT p_name AS name, 'text' AS type, CASE WHEN p_size % 2 = 0 THEN p_brand END AS context, CASE WHEN p_size % 3 = 0 THEN '(\d+),\s*' END AS regex FROM part"),
    "form_fields": (form_fields, f"WITH {_VALUES}, m AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT source AS form, unnest(['invoice_number', 'total_amount', 'company_name']) AS field_name, unnest(['text', 'amount', 'company']) AS field_type, unnest([invoice, amount, company]) AS value FROM v JOIN m USING (doc_id, source)"),
    "collect_export": (collect_export, "SELECT doc_id, 'finished' AS status, source AS fields FROM documents JOIN orders ON o_orderkey = doc_id WHERE o_orderstatus = 'F' AND doc_id % 3 > 0"),
}
