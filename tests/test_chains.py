"""Pointer doubling against walking."""

import random

import pytest

from evidentia.operators import chains, load_model, lookup


def walk(links, node):
    seen, total, at = set(), 0, node
    while True:
        if at not in links:
            return "outside", at, total, len(seen)
        if at in seen:
            return "cycle", None, None, None
        seen.add(at)
        total += links[at][1]
        if links[at][0] is None:
            return "ended", at, total, len(seen) - 1
        at = links[at][0]


def on_cycles(links):
    out = {}
    for node in links:
        path, at = [], node
        while at in links and links[at][0] is not None and at not in path:
            path.append(at)
            at = links[at][0]
        if at == node and path:
            out[node] = min(path)
    return out


def table(spark, links):
    return spark.createDataFrame([(n, x, w) for n, (x, w) in links.items()], "node long, next long, weight long")


@pytest.mark.parametrize("seed", range(2))
def test_random_chains(spark, seed):
    rng = random.Random(seed)
    links = {n: (rng.choice([None, n, rng.randrange(70), rng.randrange(55)]) if rng.random() < 0.3 else rng.randrange(60), rng.randrange(9)) for n in range(60)}
    got = {r.node: (r.state, r.end, r.total, r.steps) for r in chains.ends(table(spark, links)).collect()}
    assert got == {n: walk(links, n) for n in links}
    assert {r.node: r.cycle for r in chains.members(table(spark, links)).collect()} == on_cycles(links)


def test_a_chain_of_1000_is_resolved_and_a_cycle_of_3_is_one(spark):
    links = {n: (n + 1 if n < 999 else None, n) for n in range(1000)} | {2000: (2001, 1), 2001: (2002, 1), 2002: (2000, 1), 1999: (2000, 1), 3000: (9999, 5), 4000: (4000, 1)}
    got = {r.node: (r.state, r.end, r.total, r.steps) for r in chains.ends(table(spark, links)).collect()}
    assert got[0] == ("ended", 999, 999 * 500, 999) and got[999] == ("ended", 999, 999, 0)
    assert {got[n][0] for n in (1999, 2000, 2001, 2002, 4000)} == {"cycle"} and got[3000] == ("outside", 9999, 5, 1)
    assert {(r.cycle, r.members) for r in chains.cycles(table(spark, links)).collect()} == {(2000, 3), (4000, 1)}


def test_empty(spark):
    assert chains.ends(table(spark, {0: (1, 1)}).where("false")).count() == 0
    assert chains.members(table(spark, {0: (1, 1)}).where("false")).count() == 0


def test_long_chains_of_constants_and_types(spark):
    rows = [(n, n + 1 if n < 200 else None, 1) for n in range(201)] + [(300, 301, 1), (301, 300, 1), (400, 999, 1)]
    got = {r.id: (r.state, r.value) for r in lookup.constants(spark.createDataFrame(rows, "id long, ref long, own long")).collect()}
    assert got[0] == ("resolved", 201) and got[300] == got[301] == ("cycle", None) and got[400] == ("unresolved", None)
    types = spark.createDataFrame([(f"t{n}", f"t{n + 1}" if n < 100 else None) for n in range(101)] + [("a", "b"), ("b", "a"), ("x", "gone")], "type string, base string")
    classes = spark.createDataFrame([("t100", "frame"), ("t50", "button")], "type string, class string")
    elements = spark.createDataFrame([(1, "t0"), (2, "t60"), (3, "a"), (4, "x"), (5, "none"), (6, "t100"), (7, "t50")], "element long, type string")
    got = {r.element: (r["class"], r.via) for r in load_model.classify(elements, types, classes).collect()}
    assert got == {1: ("button", "t50"), 2: ("frame", "t100"), 3: ("cyclic_type", None), 4: ("unknown_type", None), 5: ("unknown_type", None), 6: ("frame", "t100"), 7: ("button", "t50")}
    plain = load_model.classify(elements, types, classes.where("false"))
    assert {r["class"] for r in plain.where("element in (1, 2)").collect()} == {"unclassified"}
