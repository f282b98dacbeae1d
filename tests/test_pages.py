"""Pages of an index against pages of the sorted rows."""

from pyspark.sql import functions as F

from inkfold.operators import assembly as op

ORDER = ["k", "n"]


def some(spark, rows):
    return spark.range(rows).select((F.col("id") * 7919 % 13).alias("k"), F.col("id").alias("n"), F.lit("x").alias("other"))


def test_pages_are_those_of_the_sorted_rows(spark):
    rows = some(spark, 1000)
    index = op.page_index(rows, ORDER, rows=90)
    want = [tuple(r) for r in rows.orderBy(*ORDER).collect()]
    for page, size in ((1, 20), (7, 20), (50, 20), (51, 20), (3, 300), (4, 300), (1, 1000), (1, 5000)):
        assert [tuple(r) for r in op.page_of(index, ORDER, page, size).collect()] == want[(page - 1) * size : page * size]


def test_a_deep_page_reads_few_ranges(spark):
    index = op.page_index(some(spark, 5000), ORDER, rows=100)
    assert index.select("page_range").distinct().count() > 30
    plan = op.page_of(index, ORDER, 200)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [page_range" in plan or "PartitionFilters: [isnotnull(page_range" in plan


def test_nulls_ties_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, 1), (1, 2), (1, 2), (None, None), (0, 9)], "k int, n int")
    index = op.page_index(rows, ORDER, rows=2)
    assert [tuple(r) for p in (1, 2, 3) for r in op.page_of(index, ORDER, p, 2).collect()] == [(None, None), (None, 1), (0, 9), (1, 2), (1, 2)]
    empty = op.page_index(rows.filter("false"), ORDER)
    assert op.page_of(empty, ORDER, 1).count() == 0


def test_a_task_cuts_several_ranges(spark):
    """300 ranges in four tasks; ranges follow the order, none of them large."""
    index = op.page_index(some(spark, 30_000), ORDER, rows=100)
    sizes = index.groupBy("page_range").agg(F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("low"), F.max(F.struct(*ORDER)).alias("high")).orderBy("page_range").collect()
    assert 250 < len(sizes) <= 300 and max(r["n"] for r in sizes) <= 110
    assert all(a["high"] < b["low"] for a, b in zip(sizes, sizes[1:]))
    tasks = index.select(F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1).alias("task")).distinct().count()
    assert tasks <= 4
