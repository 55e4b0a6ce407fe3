"""Paths from both ends against depth-first search, with budgets and cursors."""

import random

import pytest

from evidentia.operators import paths as P
from evidentia.operators.traversal import BOTH, IN, OUT, Refused

EDGE = "edge_id string, src string, dst string, relation string, confidence int"


def simple(edges, root, target, directions, depth):
    out = []

    def walk(node, visited, path):
        if node == target:
            out.append(path)
            return
        if len(path) == depth:
            return
        for e, a, b, r, c in edges:
            for x, y in ([(a, b)] if directions[r] == OUT else [(b, a)] if directions[r] == IN else [(a, b), (b, a)]):
                if x == node and y not in visited:
                    walk(y, visited | {y}, [*path, e])

    walk(root, {root}, [])
    return sorted(out)


def graph(seed, n=9, m=24):
    rng = random.Random(seed)
    return [(f"e{i:02}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice("pqr"), 0) for i in range(m)]


def listed(found):
    return [list(r.path) for r in found.paths.orderBy("path").collect()]


WAYS = {"p": OUT, "q": IN, "r": BOTH}


@pytest.mark.parametrize("depth", [1, 5])
def test_equals_depth_first(spark, depth):
    edges = graph(depth)
    df = spark.createDataFrame(edges, EDGE)
    expect = simple(edges, "n0", "n3", WAYS, depth)
    got = P.paths(df, "n0", "n3", WAYS, 3, depth=depth, most=256)
    assert listed(got) == expect[:256] and ("paths" in got.truncations) == (len(expect) > 256)
    longer = simple(edges, "n0", "n3", WAYS, depth + 3)
    assert len(longer) == len(expect) or "depth" in got.truncations
    for r in got.paths.collect():
        assert len(r.nodes) == len(set(r.nodes)) == r.length + 1 and r.nodes[0] == "n0" and r.nodes[-1] == "n3"


def test_pages_are_the_whole_in_order(spark, monkeypatch):
    monkeypatch.setattr(P, "FIRST_PREFIXES", 3)
    edges = graph(5)
    df = spark.createDataFrame(edges, EDGE)
    expect = simple(edges, "n0", "n3", WAYS, 5)
    found, after, pages = [], None, 0
    while True:
        page = P.paths(df, "n0", "n3", WAYS, 3, depth=5, most=4, after=after)
        found += listed(page)
        pages += 1
        assert page.replayed > 0 or after is None
        after = page.cursor
        if after is None:
            break
    assert found == expect and pages == -(-len(expect) // 4) and pages > 2


def test_spent_budgets_leave_a_beginning(spark):
    edges = graph(5)
    df = spark.createDataFrame(edges, EDGE)
    expect = simple(edges, "n0", "n3", WAYS, 6)
    for n in (4, 60):
        got = P.paths(df, "n0", "n3", WAYS, 3, depth=6, most=256, expansions=n)
        rows = listed(got)
        assert rows == expect[: len(rows)] and (len(rows) == len(expect) or set(got.truncations) & {"expansions", "paths"})


def test_cursors_are_checked(spark):
    edges = graph(5)
    df = spark.createDataFrame(edges, EDGE)
    ask = lambda after, **more: P.paths(df, "n0", "n3", WAYS, 3, **{"depth": 5, "most": 3, **more}, after=after)
    cursor = ask(None).cursor
    expect = simple(edges, "n0", "n3", WAYS, 5)
    assert listed(ask(cursor)) == expect[3:6]
    for bad in (P.Cursor("other", cursor.after, cursor.integrity), P.Cursor(cursor.query, (*cursor.after, "e00"), cursor.integrity), cursor.after[:-1], ["nothing"]):
        with pytest.raises(Refused, match="cursor_invalid"):
            ask(bad)
    with pytest.raises(Refused, match="cursor_invalid"):
        ask(cursor, depth=4)
    with pytest.raises(Refused, match="cursor_not_reached"):
        P.paths(df, "n0", "n3", WAYS, 3, depth=5, most=3, expansions=2, after=expect[-1])


def test_neither_end_looks_further_than_its_half(spark):
    # a long chain before the root and behind the target is never read
    edges = [(f"a{i:03}", f"x{i}", f"x{i + 1}", "p", 0) for i in range(60)] + [("b", "x30", "x32", "p", 0)]
    got = P.paths(spark.createDataFrame(edges, EDGE), "x30", "x32", {"p": OUT}, 3, depth=4)
    assert listed(got) == [["a030", "a031"], ["b"]]
