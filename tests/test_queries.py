"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from inkfold import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value if isinstance(value, (int, float, str, bool)) else str(value)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert not registry.queries()[name](spark, DATA).isEmpty()


def test_entry_is_the_ensemble(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_changes_are_rounded_as_sql_does(spark, tmp_path):
    """Changes of -64.1625 and -65.4125 per cent, which times 1000 fall below the tie, of 100.0625, which is one, and from zero."""
    values = [80.0, 28.67, 80.0, 27.67, 16.0, 32.01, 0.0, 5.0]
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + i * INTERVAL 1 MINUTE AS ts, 1 AS user_id, 'view' AS event_type, {values}[i + 1]::DOUBLE AS value FROM range({len(values)}) r(i)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = registry.queries()["change_alerts"](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()["change_alerts"]).df()
    assert rows(got) == rows(want) and len(want) >= 5


@pytest.mark.parametrize("name", ["group_lines", "running_confidence", "words_to_text"])
def test_words_are_not_moved_one_by_one(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == 1 and "word_ord" not in moved[0] and "page_num" not in moved[0]


@pytest.mark.parametrize("name", ["normalize_english", "normalize_by_language"])
def test_sentences_that_begin_with_a_sharp_s(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS doc_id, ['ßlich. ßberte! öl', 'one. ßa', '', 'a'][i + 1] AS text, 'en' AS lang FROM range(4) r(i)) TO '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got, want = registry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want) and "ẞ" in str(rows(want))


def test_lines_hold_the_running_confidence(spark, tmp_path):
    """Three words of one line with confidences 13, 20 and 27 (document 1), and a line of one word: pairwise 0.2175, the mean is 0.2."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES (1, 'a b c', 'en'), (2, 'd', 'en'), (3, NULL, 'en')) t(doc_id, text, lang)) TO '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    out = registry.queries()["group_lines"](spark, str(tmp_path)).toPandas()
    assert {r.doc_id: (r.text, r.confidence, r.mean_confidence) for r in out.itertuples()} == {1: ("a b c", 0.2175, 0.2), 2: ("d", 0.26, 0.26)}
    assert rows(out) == rows(con.execute(registry.oracle_sql()["group_lines"]).df())
