"""Literal rows: merging, clean-up, entities, fields, exports, and the sizes of plans."""

import pytest
from pyspark.sql import functions as F

from inkfold.functions import text as tx
from inkfold.operators import assembly, ensemble, entities, fields, layout, metrics, texts

RESULTS = "doc_id int, page_num int, engine string, engine_ord int, text string, confidence double, language string, weight double"


def column(spark, values, fix, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(fix(F.col("v"))).collect()]


def test_three_engines_vote(spark):
    rows = [(1, 1, "engine1", 0, "텍스트 1", 0.8, "kor", 0.3), (1, 1, "engine2", 1, "텍스트 2", 0.9, "kor", 0.5), (1, 1, "engine3", 2, "テキスト 3", 0.7, "jpn", 0.2)]
    out = ensemble.ensemble(spark.createDataFrame(rows, RESULTS)).first()
    assert (out["text"], out["language"], round(out["confidence"], 6)) == ("텍스트 2", "kor", 0.83)


def test_order_of_rows_does_not_matter(spark):
    rows = [(d, 1, f"e{k}", k, "same" if k < 2 else "other", 0.9, "eng" if k % 2 else "kor", 0.25) for d in range(20) for k in range(4)]
    a = ensemble.ensemble(spark.createDataFrame(rows, RESULTS)).drop("engines").orderBy("doc_id").collect()
    b = ensemble.ensemble(spark.createDataFrame(rows[::-1], RESULTS).repartition(7)).drop("engines").orderBy("doc_id").collect()
    assert a == b and a[0]["text"] == "same" and a[0]["language"] == "kor"


def test_failed_and_odd_answers(spark):
    rows = [(1, 1, "x", 0, "lost", 0.9, "en", "boom"), (1, 1, "y", 1, "kept", float("nan"), "EN-us", None), (1, 1, "z", 2, None, 1.7, "", None)]
    out = ensemble.standardize(spark.createDataFrame(rows, "doc_id int, page_num int, engine string, engine_ord int, text string, confidence double, language string, error string")).orderBy("engine_ord").collect()
    assert [(r["text"], r["confidence"], r["language"]) for r in out] == [("", 0.0, "eng"), ("kept", 0.0, "eng"), ("", 1.0, None)]


@pytest.mark.parametrize(
    ("lang", "raw", "want"),
    [
        (None, "  테스트   텍스트  \n\n\n 정규화  ", "테스트 텍스트 정규화"),
        ("jpn", "2023年1月1日", "2023年01月01日"),
        ("kor", "2023년1월1일", "2023년 01월 01일"),
        ("eng", "Jan 1, 2023", "Jan 01, 2023"),
        ("eng", "this is a test. another sentence.", "This is a test. Another sentence."),
        ("kor", "테스트 를 진행 합니다", "테스트를 진행 합니다"),
        ("eng", "on 12/1/2023", "On 12/01/2023"),
        ("jpn", "１２３４５６７円", "1,234,567円"),
        ("eng", "$" + "1" * 66, "$" + ",".join(["111"] * 22)),
        ("eng", "", ""),
    ],
)
def test_normalisation(spark, lang, raw, want):
    df = spark.createDataFrame([(raw, lang or "xx")], "text string, lang string")
    assert texts.normalize_by_language(df).first()["text"] == want


def test_long_digit_runs_take_linear_time(spark):
    df = spark.createDataFrame([("$" + "7" * 300_000, "eng")], "text string, lang string")
    assert len(texts.normalize_by_language(df).first()["text"]) == 1 + 300_000 + 99_999


def test_plan_of_the_language_rules_stays_small(spark):
    df = texts.normalize_by_language(spark.createDataFrame([("x", "eng")], "text string, lang string"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_names_and_sizes(spark):
    assert column(spark, ["a..b", ".bashrc", "x/y.TAR.gz", "..x", "a.", "b"], tx.extension) == [".b", "", ".gz", "", ".", ""]
    names = column(spark, ["???.pdf", "a  b<c>.PDF", "x" * 200 + ".png"], tx.safe_file_name)
    assert names[0].startswith("file_") and names[0].endswith(".pdf") and names[1] == "a_bc.PDF" and len(names[2]) == 132
    assert column(spark, [1152, 1024, 1025, 3 << 40], tx.readable_size, "v bigint") == ["1.12 KB", "1024.00 B", "1.00 KB", "3.00 TB"]


def _entities(spark, text, lang):
    rows = entities.extract_entities(spark.createDataFrame([(1, 1, text, lang)], "doc_id int, page_num int, text string, lang string")).collect()
    return {(r["entity_type"], r["value"]) for r in rows}


def test_japanese_entities(spark):
    found = _entities(spark, "株式会社テスト\n〒123-4567 東京都品川区\n2023年4月1日\n請求書\n合計: ¥123,456", "jpn")
    assert {("companies", "株式会社テスト"), ("dates", "2023年4月1日"), ("amounts", "¥123,456")} <= found
    assert any(k == "addresses" and "〒123-4567" in v for k, v in found)


def test_korean_companies_and_amounts(spark):
    assert ("companies", "주식회사 삼성전자") in _entities(spark, "주식회사 삼성전자", "kor")
    assert ("companies", "(주) 삼성전자") in _entities(spark, "(주) 삼성전자", "kor")
    assert ("amounts", "¥770000") in _entities(spark, "¥770000", "jpn")
    assert not [v for k, v in _entities(spark, "¥123,4567", "jpn") if k == "amounts"]


def test_chinese_gets_only_contacts(spark):
    assert _entities(spark, "a@b.cn ¥5 2023年4月1日", "chi_sim") == {("emails", "a@b.cn")}


def test_responses(spark):
    rows = [(1, '```json\n{"a": "x", "n": "-5", "m": -5, "z": "NULL"}\n```'), (2, "```\n{broken\n```"), (3, "[1]"), (4, None)]
    spec = [{"name": n, "type": t} for n, t in (("a", "text"), ("n", "amount"), ("m", "amount"), ("z", "text"), ("q", "text"))]
    good, bad = fields.parse_responses(spark.createDataFrame(rows, "doc_id int, response string"), spec)
    got = {r["field_name"]: (r["value_string"], r["value_double"]) for r in good.collect()}
    assert got == {"a": ("x", None), "n": ("-5", 5.0), "m": ("-5", -5.0), "z": (None, None), "q": (None, None)}
    assert sorted(r["doc_id"] for r in bad.collect()) == [2, 3, 4]


def test_export_order_and_template(spark, tmp_path):
    long = spark.createDataFrame([("doc1", "b", "2"), ("doc1", "a", "1"), ("doc2", "a", "3"), ("doc2", "x", "9")], "doc_id string, field_name string, value string")
    extras = spark.createDataFrame([("doc1", "t1")], "doc_id string, timestamp string")
    out = fields.export_rows(long, ["a", "b"], extras, ["doc_id", "timestamp"])
    assert out.columns == ["timestamp", "doc_id", "a", "b"]
    assert sorted(map(tuple, out.collect())) == [("", "doc2", "3", ""), ("t1", "doc1", "1", "2")]
    assert fields.export_rows(long, ["a"], bom=True).columns == ["﻿a"]
    spec = spark.createDataFrame([("field1", "text", "컨텍스트1", "패턴1"), ("field2", "date", "컨텍스트2", None)], "name string, type string, context string, regex string")
    fields.write_field_template(spec, str(tmp_path / "t"))
    assert sorted(map(tuple, fields.read_field_template(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, spec.collect()))


def test_field_changes(spark):
    have = spark.createDataFrame([("a", "text")], "name string, type string")
    log = [(1, "add", "b", "date"), (2, "add", "a", "date"), (3, "update", "a", "amount"), (4, "update", "c", "text"), (5, "delete", "b", None), (6, "delete", "d", None)]
    kept, bad = fields.apply_changes(have, spark.createDataFrame(log, "ord int, op string, name string, type string"))
    assert [tuple(r) for r in kept.collect()] == [("a", "amount")] and sorted(r["ord"] for r in bad.collect()) == [2, 4, 6]


def test_running_average_of_a_line(spark):
    words = [(1, 1, k, "w", c * 100, 0, 0, 1, 1, 0, 0) for k, c in enumerate([0.5, 0.9, 0.7])]
    out = assembly.group_lines(spark.createDataFrame(words, "doc_id int, page_num int, word_ord int, text string, confidence double, left int, top int, width int, height int, block_num int, line_num int")).first()
    assert round(out["confidence"], 9) == 0.7


def test_stamps_are_taken_greedily(spark):
    rows = [(1, 1, 1, 0, 0, 10, False), (1, 1, 2, 5, 0, 10, True), (1, 1, 3, 100, 0, 10, False), (1, 1, 4, 105, 0, 10, False)]
    shapes = spark.createDataFrame(rows, "doc_id bigint, page_num int, shape_ord int, x int, y int, radius int, is_circle boolean")
    assert sorted(r["shape_ord"] for r in layout.accepted_stamps(shapes).collect()) == [2, 3]
    assert sorted((r["a"], r["b"]) for r in layout.overlapping_pairs(shapes).collect()) == [(1, 2), (3, 4)]


def test_long_chains_of_stamps_equal_the_fold(spark):
    rows = [(1, 1, k, 6 * k, (k * 7919) % 5, 4 + k % 3, k % 41 == 0) for k in range(200)] + [(2, 1, k, 9 * k, 0, 5, False) for k in range(60)]
    shapes = spark.createDataFrame(rows, "doc_id bigint, page_num int, shape_ord int, x int, y int, radius int, is_circle boolean").repartition(3)
    want = []
    for doc in (1, 2):
        kept = []
        for _, _, n, x, y, r, c in sorted((s for s in rows if s[0] == doc), key=lambda s: (not s[6], s[2])):
            if c or all((x - k[1]) ** 2 + (y - k[2]) ** 2 >= (r + k[3]) ** 2 for k in kept):
                kept.append((n, x, y, r))
        want += [(doc, k[0]) for k in kept]
    for rounds in (0, 2):
        assert sorted((r["doc_id"], r["shape_ord"]) for r in layout.accepted_stamps(shapes, rounds).collect()) == sorted(want)


def test_newest_cached_answer_and_shared_results(spark):
    cache = spark.createDataFrame([("k", 1, 100), ("k", 2, 200), ("k", 3, 150), ("old", 4, -99999)], "key string, answer int, s bigint").select("key", "answer", F.timestamp_seconds("s").alias("stored"))
    hits, misses = assembly.cache_lookup(spark.createDataFrame([("k",), ("old",), ("x",)], "key string"), cache, F.timestamp_seconds(F.lit(300)))
    assert [tuple(r) for r in hits.collect()] == [("k", 2)] and sorted(r["key"] for r in misses.collect()) == ["old", "x"]
    docs = spark.createDataFrame([(3, "a", "en"), (1, "a", "en"), (2, "a", "de"), (4, None, None)], "doc_id int, text string, lang string")
    out = assembly.share_results(docs, spark.createDataFrame([(1, "r1"), (2, "r2")], "doc_id int, answer string"))
    assert {r["doc_id"]: r["answer"] for r in out.collect()} == {1: "r1", 2: "r2", 3: "r1", 4: None}


def test_messages_of_alerts(spark):
    points = spark.createDataFrame([(1, 0, "cpu", 50.0), (2, 1, "cpu", 90.5)], "event_id bigint, s bigint, name string, value double").withColumn("ts", F.timestamp_seconds("s"))
    rule = {"rule": "r", "name": "cpu", "comparator": ">", "limit": 80.0, "severity": "info", "description": "load"}
    assert [r["message"] for r in metrics.threshold_alerts(points, [rule]).collect()] == ["load: cpu의 값 90.5이(가) 임계값 80.0을(를) > 만족합니다."]
    assert [r["message"] for r in metrics.change_alerts(points, 50, description="jump").collect()] == ["jump: cpu의 변화량이 81.00%로, 임계값 50%을(를) 초과했습니다."]


def test_meter_equals_the_step_by_step_rule(spark):
    import math

    points = [("m", 5 * t + 1, float(v)) for t, v in enumerate([0, 0, 3, 0, 5] + [1] * 600)]
    df = spark.createDataFrame(points, "name string, s bigint, value double").select("name", F.timestamp_seconds("s").alias("ts"), "value")
    got = {r["t"]: r["rate_1m"] for r in metrics.meter(df).collect()}
    count, rate, keep = 0.0, 0.0, math.exp(-5 / 60)
    for t, (_, _, v) in enumerate(points):
        count += v
        x = count / ((t + 1) * 5)
        rate = x if rate == 0 else rate * keep + x * (1 - keep)
        assert math.isclose(got[t], rate, rel_tol=1e-9, abs_tol=1e-12)


def test_one_metric_name_may_hold_all_points(spark):
    df = spark.range(20_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.lit("hot").alias("name"), F.lit(1.0).alias("value"), F.lit(0).cast("bigint").alias("tag"))
    out = metrics.counter(df).agg(F.max("total"), F.count_if(F.col("total") == F.col("event_id") + 1)).first()
    assert tuple(out) == (20_000.0, 20_000)
    assert metrics.change_alerts(df.withColumn("value", F.col("event_id") % 2 + 1.0), 60.0).count() == 10_000


def test_unknown_comparator_is_an_error(spark):
    with pytest.raises(ValueError, match="comparator"):
        metrics.threshold_alerts(spark.createDataFrame([], "event_id bigint, ts timestamp, name string, value double"), [{"rule": "r", "name": "n", "comparator": "~", "limit": 1, "severity": "info"}])


def test_options_and_labels(spark):
    from inkfold.operators import texts

    rows = spark.createDataFrame([("EN-us", "a", "date", 0.0, "Company LOGO"), ("xx", None, "date", 1.5, "cat"), (None, "a", None, None, None), ("zh-Hant", "a", "colour", 1.0, "brand new")], "lang string, name string, kind string, t double, description string")
    out = rows.select(texts.is_language(F.col("lang")), texts.is_field(F.col("name"), F.col("kind")), texts.is_threshold(F.col("t"))).collect()
    assert [tuple(r) for r in out] == [(True, True, True), (False, False, False), (None, True, None), (True, False, True)]
    assert [r["description"] for r in texts.logo_labels(rows).collect()] == ["Company LOGO", "brand new"]


def test_request_wording(spark):
    from inkfold.operators import fields

    text = fields.field_description([{"name": "due", "type": "date", "context": "due|by"}, {"name": "who", "context": "to"}])
    assert text.startswith('1. due (Type: date)\n   키워드: "due", "by" 주변에서') and '\n\n2. who (Type: text)\n   키워드: "to" 주변에서' in text


def test_stamps_of_small_pages_meet_without_copies(spark):
    """Pages of 1, 3 and 90 shapes: the same pairs by page and by grid; where all pages are small no shape is copied into cells."""
    rows = [(doc, 1, k, k * 37 % 400, k * 53 % 300, 30 + k % 40) for doc, n in ((1, 1), (2, 3), (3, 90)) for k in range(n)]
    shapes = spark.createDataFrame(rows, "doc_id int, page_num int, shape_ord int, x int, y int, radius int")
    near = lambda p, q: p[0] == q[0] and p[2] < q[2] and (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2 < (p[5] + q[5]) ** 2
    want = sorted((p[0], 1, p[2], q[2]) for p in rows for q in rows if near(p, q))
    for few in (0, 2, 64, 90):
        assert sorted(tuple(r) for r in layout.overlapping_pairs(shapes, 300, few).collect()) == want
    assert "Generate" not in layout.overlapping_pairs(shapes.filter("doc_id < 3"))._jdf.queryExecution().executedPlan().toString()
