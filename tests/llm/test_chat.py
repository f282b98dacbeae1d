import random

from pyspark.sql import functions as F

from inkfold.llm import chat as op

PIECES = ["\\", "#", "##", "###", "### Assistant: ", "</turn>", "</turn>\n", "<", "</", ": ", "\n", "ok", "é😀", "<\\/turn>", "#\\#"]
NODES = "conv bigint, node bigint, parent bigint, role string, text string, score double"


def test_round_trip(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "sys: x:", "##", None]), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) if rng.random() > 0.05 else None) for c in range(60) for t in range(rng.randint(1, 9))]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    out = op.format_replies(op.as_replies(turns))
    got = {r["conv"]: r for r in out.select("conv", op.read_turns(F.col("formatted")).alias("t"), op.learned_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r, x) for cc, t, r, x in rows if cc == c), key=lambda x: x[0])
        assert [(x["role"], x["text"]) for x in got[c]["t"]] == [(r or "", x or "") for _, r, x in own]
        assert got[c]["l"] == "".join(x or "" for _, r, x in own if r == "assistant")


def test_the_best_branch_is_chosen(spark):
    rows = [(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "weak", 1.0), (1, 3, 1, "assistant", "strong", 5.0), (1, 4, 3, "user", "follow", 2.0), (1, 5, 2, "user", "other", 0.0), (2, 1, 99, "user", "orphan", 0.0)]
    out = op.format_replies(spark.createDataFrame(rows, NODES), per_tree=2).orderBy("conv", "path").collect()
    assert [(r["conv"], r["n_turns"]) for r in out] == [(1, 3), (1, 3), (2, 1)]
    assert "strong" in out[0]["formatted"] and "follow" in out[0]["formatted"] and "weak" in out[1]["formatted"]


def test_repeated_nodes_count_once_each(spark):
    rows = [(1, 1, None, "user", "root", 0.0)] + [(1, 2, 1, "assistant", "reply", 1.0)] * 2 + [(1, 3, 2, "user", "end", 0.0)] * 3
    rows += [(2, 1, None, "user", "a", 0.0), (2, 2, 1, "user", "b", 0.0), (2, 2, 7, "user", "c", 0.0)]  # two parents: the smaller holds
    out = {r["conv"]: r for r in op.format_replies(spark.createDataFrame(rows, NODES)).select("conv", "n_turns", op.read_turns(F.col("formatted")).alias("t")).collect()}
    assert [x["text"] for x in out[1]["t"]] == ["root", "reply", "reply", "end", "end", "end"] and out[1]["n_turns"] == 6
    assert [x["text"] for x in out[2]["t"]] == ["a", "b", "c"]


def test_cycles_end_nothing_but_themselves(spark):
    rows = [(1, 1, 3, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 3, 2, "user", "c", 0.0), (1, 4, 3, "user", "tail", 0.0), (1, 5, None, "user", "own root", 0.0)]
    rows += [(2, 1, None, "user", "root", 0.0), (2, 2, 1, "assistant", "reply", 0.0), (3, 1, 2, "user", "x", 0.0), (3, 2, 1, "user", "y", 0.0), (4, None, 1, "user", "nowhere", 0.0), (5, 1, 1, "user", "itself", 0.0)]
    replies = spark.createDataFrame(rows, NODES).withColumn("depth", F.lit("clash")).withColumn("path", F.lit("clash")).withColumn("jump", F.lit("clash"))
    out = {r["conv"]: r["formatted"] for r in op.format_replies(replies).collect()}
    assert set(out) == {1, 2, 5} and "own root" in out[1] and "tail" not in out[1] and "reply" in out[2]
    bad = {tuple(r) for r in op.rejects(replies).collect()}
    assert bad == {(1, 1, "cycle"), (1, 2, "cycle"), (1, 3, "cycle"), (1, 4, "cycle"), (3, 1, "cycle"), (3, 2, "cycle"), (4, None, "no node")}
    assert op.rejects(replies.filter("false")).count() == 0


def test_long_chains_take_few_rounds(spark):
    rows = spark.range(1500).select(F.lit(1).cast("bigint").alias("conv"), (F.col("id") + 1).alias("node"), F.when(F.col("id") > 0, F.col("id")).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(0.0).alias("score"))
    out = op.format_replies(rows).select("n_turns", op.read_turns(F.col("formatted")).alias("t")).first()
    assert out["n_turns"] == 1500 and [x["text"] for x in out["t"]] == [str(k) for k in range(1500)]


def test_messy_rows_and_empty_tables(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", None), (1, None, None, None), (1, 1, "user", "x"), (1, 1, "user", "x"), (2, 1, "assistant", "y " * 200_000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("node", F.lit("clash")).withColumn("path", F.lit("clash"))
    out = {r["conv"]: r["n_turns"] for r in op.format_replies(op.as_replies(turns)).collect()}
    assert out == {None: 2, 1: 3, 2: 1}
    assert op.format_replies(op.as_replies(turns.filter("false"))).count() == 0
