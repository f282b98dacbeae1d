import hashlib
import random
import re

from pyspark.sql import functions as F

from inkfold.llm import mixing as op


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def share(budget, children):
    """name to (cap, weight) by repeated filling: the plain form of the rule."""
    given, left, spent = {}, {k: v for k, v in children.items() if v[1] > 0}, 0
    while True:
        total = sum(w for _, w in left.values())
        full = {k: c for k, (c, w) in left.items() if (budget - spent) * w >= c * total}
        if not full:
            return given | {k: (budget - spent) * w // total for k, (_, w) in left.items()}
        first = min(full, key=lambda k: (left[k][0] / left[k][1], k))
        given[first] = left.pop(first)[0]
        spent += given[first]
        if not left:
            return given


def brute(rows, weights, epochs, seed):
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves = {}
    for d, text, g, s in rows:
        leaves.setdefault((f"d{s[-1]}" if s else "(none)", g or "(none)", s or "(none)"), []).append((d, text))
    size = {k: sum(tokens(t) for _, t in v) for k, v in leaves.items()}
    cap = lambda *p: sum(epochs * n for k, n in size.items() if k[: len(p)] == p)
    names = lambda *p: {k[len(p)] for k in leaves if k[: len(p)] == p}
    budget, out = {(): sum(size.values()) // 2}, []
    for level in range(3):
        for p in [x for x in budget if len(x) == level]:
            got = share(budget[p], {n: (cap(*p, n), weights.get("/".join([*p, n]), 1)) for n in names(*p)})
            budget |= {(*p, n): b for n, b in got.items()}
    for leaf, docs in leaves.items():
        if not size[leaf] or leaf not in budget:
            continue
        whole, rest = divmod(budget[leaf], size[leaf])
        keyed = sorted((md5(f"{seed}:{whole}:" + md5(f"{'' if d is None else d}:{md5(t or '')}")), d, tokens(t)) for d, t in docs if tokens(t))
        for key, d, _ in keyed:
            upto = sum(n for k, _, n in keyed if k <= key)
            out += [(d, *leaf, e) for e in range(whole + (upto <= rest))]
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(k, "w " * rng.choice([0, 1, 5, 50, 200]), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "t2", "s3", None])) for k in range(300)]
    rows += [(7, "same text", "en", "s1")] * 3 + [(None, "no id", "en", "s2"), (8, None, "de", "s3")]
    weights = {"d1": 5, "d2": 1, "d3": 0, "d1/en": 3, "d2/de/s2": 4}
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)
    domain = F.concat(F.lit("d"), F.substring("source", -1, 1))
    for epochs in (1, 3):
        out = op.mix(df, domain, weights, max_epochs=epochs, seed=3)
        got = [(r["doc_id"], r["domain"], r["lang"] or "(none)", r["source"] or "(none)", r["epoch"]) for r in out.collect()]
        assert sorted(got, key=repr) == brute(rows, weights, epochs, 3)


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", "s1", 10, 1), ("a", "x", "s2", 500, 1), ("b", "x", "s3", 500, 1)]
    leaves = spark.createDataFrame(rows, [*op.LEVELS, "tokens", "n"])
    out = {r[op.LEVELS[2]]: r["given"] for r in op.budgets(leaves, F.lit(400), {}, 1).collect()}
    assert out == {"s1": 10, "s2": 190, "s3": 200}
    out = {r[op.LEVELS[2]]: r["given"] for r in op.budgets(leaves, F.lit(1100), {}, 1).collect()}
    assert out == {"s1": 10, "s2": 500, "s3": 500}


def test_messy_rows_and_empty_tables(messy, empty):
    domain = F.coalesce(F.col("source"), F.lit("none"))
    out = op.mix(messy, domain, {}, F.expr("tokens * 2"), 2)
    assert set(messy.columns) <= set(out.columns)
    assert out.count() == 2 * messy.filter("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").count()
    assert op.mix(empty, domain, {}).count() == 0
