"""The queries read whole documents, against plain Python on texts whose hits lie far behind their beginning."""

import re

import pytest
from pyspark.sql import functions as F

from inkfold import registry

FILL = "lorem ipsum dolor " * 300


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    rows = [(1, FILL + "Ref 77-1234 here, sum: 12.5 and 〒987-6543 大阪 " + FILL, "en", "src1"), (2, FILL, "de", "src1"), (4, FILL + "total 8.75 " + FILL, "fr", "src2"), (5, None, None, "src2"), (8, "", "en", "src3")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{out}/documents.parquet")
    return out


def texts(spark, folder):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def want_fields(n, text):
    number, total = re.search(r"(?:No\.|Ref)\s*[:：]?\s*([0-9]{1,3}-[0-9]{1,5})", text), re.search(r"(?:total|sum)\s*[:：]?\s*([0-9.]+)", text)
    planted = f"{n % 700}.25" if n % 4 else str(n % 9)
    return {"invoice_number": number[1] if number else f"{n % 90}-{n % 5000}", "total_amount": total[1] if total else planted, "company_name": f"Acme{n % 9} Ltd"}


def test_fields_of_whole_texts(spark, folder):
    want = {n: want_fields(n, t) for n, t in texts(spark, folder).items()}
    assert want[1]["invoice_number"] == "77-1234" and want[4]["total_amount"] == "8.75"
    got: dict = {}
    for r in registry.queries()["extract_fields"](spark, folder).collect():
        got.setdefault(r["doc_id"], {})[r["field_name"]] = r["value"]
    assert got == want
    export = {int(r["doc_id"]): {k: r[k] for k in ("invoice_number", "total_amount", "company_name")} for r in registry.queries()["export_fields"](spark, folder).collect()}
    assert export == want
    form = {r["form"]: r["value"] for r in registry.queries()["form_fields"](spark, folder).filter(F.col("field_name") == "invoice_number").collect()}
    assert form == {"src1": "77-1234", "src2": want[4]["invoice_number"], "src3": want[8]["invoice_number"]}


def test_requests_hold_whole_texts(spark, folder):
    sizes = {r["doc_id"]: r["chars"] for r in registry.queries()["build_extraction_requests"](spark, folder).collect()}
    assert sizes[1] > 2 * len(FILL) and all(sizes[n] > len(t) for n, t in texts(spark, folder).items())


def test_addresses_of_whole_texts(spark, folder):
    want = set()
    for n, t in texts(spark, folder).items():
        s = t[:40] + f"〒123-{n % 10000:04}" + " 東京都港区 次" + t
        want |= {(n, s[max(m.start() - 30, 0) : m.end() + 30]) for m in re.finditer(r"〒\d{3}-\d{4}|[東西南北]?京都?[府県]", s)}
    got = {(r["doc_id"], r["value"]) for r in registry.queries()["extract_addresses"](spark, folder).collect()}
    assert got == want and len(got) == 6
