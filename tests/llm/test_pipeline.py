"""The pipeline's stages, each on its own input, against plain Python."""

import re

import duckdb
import pytest

import corpus_pipeline
from inkfold.llm import pii, queries


@pytest.fixture(scope="module")
def stages(spark, tables):
    docs, out = spark.read.parquet(f"{tables}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, tables)
        rows = made.collect()
        out.append((name, docs.collect(), rows))
        docs = spark.createDataFrame(rows, made.schema)
    return out


def test_stages_are_in_order_and_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    for _, before, after in stages[:-1]:
        assert after[0].__fields__ == before[0].__fields__


def test_toxicity_stage(spark, tables, stages):
    _, before, after = stages[0]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    assert not [d for d, t in labels.items() if t == 0 and d not in kept]
    gone = [r for r in before if r["doc_id"] not in kept]
    assert gone and all(labels.get(r["doc_id"], 1) for r in gone)
    assert not any(re.search(r"\b(idiot|moron|scum|pathetic)", r["text"] or "") for r in after)


def test_duplicate_stage(stages):
    from test_simhash import brute_components, brute_print

    _, before, after = stages[1]
    prints = {r["doc_id"]: brute_print(r["text"]) for r in before}
    groups = brute_components(prints.values())
    want = {}
    for d in sorted(prints, reverse=True):
        want[groups[prints[d]]] = d
    assert sorted(r["doc_id"] for r in after) == sorted(want.values()) and len(after) < len(before)


def test_decontamination_stage(spark, tables, stages):
    from test_decontaminate import brute

    _, before, after = stages[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    want = {r["doc_id"] for r, b in zip(before, brute([r["text"] for r in before], items), strict=True) if not b[3]}
    assert {r["doc_id"] for r in after} == want and len(after) < len(before)
    assert not any(b[1] for b in brute([r["text"] for r in after], items))


def test_personal_data_stage(stages):
    from test_pii import brute

    _, before, after = stages[3]
    assert [r["doc_id"] for r in after] == [r["doc_id"] for r in before]
    assert any(brute(r["text"]) for r in before) and not any(brute(r["text"]) for r in after)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    clean = {r["doc_id"]: r["text"] for r in before if not pii.spans(r["text"])}
    assert all(clean.get(r["doc_id"], r["text"]) == r["text"] for r in after)


def test_mixing_stage(stages):
    _, before, after = stages[4]
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    whole, drawn = sum(tokens(r["text"]) for r in before), sum(r["tokens"] for r in after)
    assert 0.3 * whole < drawn <= whole // 2 and len({(r["doc_id"], r["epoch"]) for r in after}) == len(after)


def test_run_writes_each_stage(spark, tables, stages):
    got = sorted((r["doc_id"], r["epoch"]) for r in corpus_pipeline.run(spark, tables).collect())
    assert got == sorted((r["doc_id"], r["epoch"]) for r in stages[-1][2])


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_messy_rows_and_empty_tables(spark, tables, messy, empty, stage):
    assert stage(spark, empty, tables).count() == 0
    out = stage(spark, messy, tables)
    assert set(messy.columns) <= set(out.columns) and out.count() <= 2 * messy.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    got, want = queries.queries()[name](spark, tables).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)
