"""Segment index against all pairs."""

import random

import pytest

from evidentia.operators import similarity as M


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [0, 2, 4])
def test_equals_all_pairs(spark, k):
    rng = random.Random(k)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) for _ in range(150)] + ["xyz" * 40, None, "xyz" * 44, "q" * 133]
    asked = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) for _ in range(60)] + ["xyz" * 40 + "z", None, "q" * 129, "xyz" * 42]
    names, queries = spark.createDataFrame([(w,) for w in words], "name string"), spark.createDataFrame([(a,) for a in asked], "query string")
    found, states = M.matches(queries, M.index(names, "name", k), k)
    expect = {(a, w, distance(a, w)) for a in asked for w in words if a is not None and w is not None and len(a) <= 128 and len(w) <= 132 and distance(a, w) <= k}
    assert {tuple(r) for r in found.collect()} == expect
    state = {r.query: r.state for r in states.collect()}
    assert state["q" * 129] == "too_long" and state["xyz" * 42] == "complete" and len(state) == len({a for a in asked if a is not None})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_exhausted_queries_have_no_rows(spark):
    names = spark.createDataFrame([(f"name{i:03}",) for i in range(200)], "name string")
    queries = spark.createDataFrame([("name050",), ("otherx1",), ("name0",)], "query string")
    found, states = M.matches(queries, M.index(names, "name", 2), 2, cells=500)
    assert {r.query: r.state for r in states.collect()} == {"name050": "exhausted", "otherx1": "complete", "name0": "exhausted"}
    assert found.count() == 0
    found, _ = M.matches(queries, M.index(names, "name", 2), 2, cells=10**6)
    assert found.count() == sum(distance(q, f"name{i:03}") <= 2 for q in ("name050", "otherx1", "name0") for i in range(200))


def test_lane(spark):
    documents = spark.createDataFrame([(1, "Alpha.Beta", "Beta"), (2, "beta", None), (3, None, "gamma"), (4, "beta", "beta")], "entity_id long, qualified string, short string")
    queries = spark.createDataFrame([("q1", "BETTA"), ("q2", None), ("q3", "delta")], "query_id string, text string")
    found, states = M.lane(documents, ["qualified", "short"], queries, 1)
    assert {tuple(r) for r in found.collect()} == {("q1", 1, 1, "Beta", 1), ("q1", 2, 1, "beta", 0), ("q1", 4, 1, "beta", 0)}
    assert {r.query_id: r.state for r in states.collect()} == {"q1": "complete", "q2": "no_query", "q3": "complete"}
