"""The change log of fields against a fold in order."""

import random

import pytest

from inkfold.operators import fields, links

LOG = "ord bigint, op string, name string, type string, new_name string"


def fold(have, log, defaults):
    held, bad = dict(have), []
    for order, op, name, kind, new in sorted(log):
        new = new or name
        if op == "reset":
            held = dict(defaults)
        elif op == "add" and name and name not in held:
            held[name] = kind
        elif op == "update" and name in held and (new == name or new not in held):
            del held[name]
            held[new] = kind
        elif op == "delete" and name in held:
            del held[name]
        else:
            bad.append(order)
    return sorted(held.items()), bad


def applied(spark, have, log, defaults, limit):
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "name string, type string")
    kept, bad = fields.apply_changes(frame(have), spark.createDataFrame(log, LOG).repartition(3), frame(defaults), limit)
    return sorted(tuple(r) for r in kept.collect()), sorted(r["ord"] for r in bad.collect())


@pytest.mark.parametrize(("seed", "resets", "renames", "limit"), [(1, 0, 0, 10**9), (2, 0, 0, 20), (3, 0, 60, 20), (4, 3, 60, 10**9), (5, 3, 0, 20)])
def test_log_equals_the_fold(spark, seed, resets, renames, limit):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(12)]
    log = [(k, rng.choice(["add", "update", "delete", "odd"]), rng.choice([*names, "n0", "n0", "n0", None]), f"t{k}", None) for k in range(300)]
    for k in rng.sample(range(300), renames):
        a = rng.randrange(10)
        log[k] = (k, "update", names[a], f"t{k}", names[a + rng.randrange(2)])
    for k in rng.sample(range(300), resets):
        log[k] = (k, "reset", None, None, None)
    have, defaults = {n: "text" for n in names[::2]}, {n: "date" for n in names[::3]}
    assert applied(spark, have, log, defaults, limit) == fold(have, log, defaults)


def test_rejected_changes_leave_no_trace(spark):
    log = [(1, "update", "c", "x", None), (2, "update", "c", "y", None), (3, "delete", "c", None, None), (4, "update", "a", "z", "b"), (5, "update", "b", "q", "b"), (6, "add", "a", "w", None), (7, "update", "a", "v", "b"), (8, "reset", None, None, None)]
    assert applied(spark, {"a": "text"}, log[:7], {"d": "d"}, 10) == ([("a", "w"), ("b", "q")], [1, 2, 3, 7])
    assert applied(spark, {"a": "text"}, log, {"d": "d"}, 10) == ([("d", "d")], [1, 2, 3, 7])
    assert applied(spark, {"a": "text"}, [], {}, 10) == ([("a", "text")], [])


def test_components(spark):
    pairs = [(1, 2), (3, 2), (9, 8), (7, 7), (4, 3), (20, 8)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["node"]: r["root"] for r in links.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 4], 1), **dict.fromkeys([8, 9, 20], 8), **dict.fromkeys(range(100, 141), 100)}


def test_defaults_are_not_repeated_for_every_reset(spark):
    log = [(k, "reset" if k % 3 == 0 else "add", "a", "t", "b") for k in range(1, 30)] + [(40, "update", "a", "u", "b")]
    frame = lambda rows: spark.createDataFrame(rows, "name string, type string")
    kept, bad = fields.apply_changes(frame([("c", "x")]), spark.createDataFrame(log, LOG), frame([("d", "d"), ("b", "e")]))
    for df in (kept, bad):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(tuple(r) for r in kept.collect()) == [("a", "t"), ("b", "e"), ("d", "d")]
