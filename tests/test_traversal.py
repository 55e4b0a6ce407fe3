"""Bounded traversals, components and excerpts against plain sequential versions."""

import hashlib
import random

import pytest

from evidentia.operators import graph, load_model, paths, traversal
from evidentia.operators.traversal import BOTH, IN, OUT, Axis, Limits, Refused

EDGE = "edge_id string, src string, dst string, relation string, confidence int"


def random_graph(seed, n=12, m=34):
    rng = random.Random(seed)
    return [(f"e{i:03}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice("pqr"), rng.randrange(4)) for i in range(m)]


def walk(edges, roots, directions, limits, ceiling):
    """The traversal one edge at a time."""
    adjacent = {}
    for e, s, t, r, c in sorted(edges):
        if r in directions and c <= ceiling:
            if directions[r] != IN:
                adjacent.setdefault(s, []).append((e, s, t, r))
            if directions[r] != OUT and not (s == t and directions[r] == BOTH):
                adjacent.setdefault(t, []).append((e, s, t, r))
    nodes, kept, queue, reasons, spent = {r: (0, None) for r in sorted(roots)}, set(), sorted(roots), set(), 0
    used = sum(map(len, roots))
    while queue:
        at = queue.pop(0)
        for e, s, t, r in adjacent.get(at, []):
            if spent == limits.expansions:
                return nodes, kept, reasons | {"expansions"}, spent
            spent += 1
            to, depth = (t if s == at else s), nodes[at][0]
            if e in kept:
                continue
            if to not in nodes and depth == limits.depth:
                reasons.add("depth")
                continue
            if len(kept) == limits.edges:
                return nodes, kept, reasons | {"edges"}, spent - 1
            if to not in nodes and len(nodes) == limits.nodes:
                return nodes, kept, reasons | {"nodes"}, spent - 1
            size = len(e + s + t + r) + (len(to) if to not in nodes else 0)
            if used + size > limits.output_bytes:
                return nodes, kept, reasons | {"output_bytes"}, spent - 1
            used += size
            kept.add(e)
            if to not in nodes:
                nodes[to] = (depth + 1, e)
                queue.append(to)
    return nodes, kept, reasons, spent


@pytest.mark.parametrize("seed", range(6))
def test_subgraph_with_budgets(spark, seed):
    edges = random_graph(seed)
    limits = [Limits(), Limits(depth=1), Limits(depth=2, nodes=5), Limits(edges=4 + seed), Limits(expansions=3 + 2 * seed), Limits(output_bytes=60 + 10 * seed)][(seed + 1) % 6]
    directions = [{"p": OUT, "q": IN}, {"p": BOTH, "q": BOTH, "r": BOTH}, {"p": OUT, "r": BOTH}][seed % 3]
    names = sorted({x for _, s, t, *_ in edges for x in (s, t)})
    got = traversal.subgraph(spark.createDataFrame([(n,) for n in names], "node_id string"), spark.createDataFrame(edges, EDGE), names[:2], directions, limits, 2)
    nodes, kept, reasons, spent = walk(edges, names[:2], directions, limits, 2)
    assert {(r.node_id, r.depth, r.discovery_edge) for r in got.nodes.collect()} == {(n, d, e) for n, (d, e) in nodes.items()}
    assert {r.edge_id for r in got.edges.collect()} == kept
    assert set(got.truncations) == reasons and got.expansions == spent
    assert got.state("complete") == ("truncated" if reasons else "complete")


def test_refused_requests(spark):
    nodes, edges = spark.createDataFrame([("a",)], "node_id string"), spark.createDataFrame([], EDGE)
    for roots, limits, code in ((["b"], Limits(), "root_absent"), (["a", "a"], Limits(), "query_invalid"), ([], Limits(), "query_invalid"), (["a"], Limits(depth=65), "budget_out_of_range")):
        with pytest.raises(Refused) as e:
            traversal.subgraph(nodes, edges, roots, {"p": OUT}, limits)
        assert e.value.code == code
    call = Axis.bind({f"d/{r}": r for recipe in traversal.AXES.values() for r in recipe}, "call")
    with pytest.raises(Refused):
        traversal.along(call, nodes, edges, ["a"], "parents")
    assert traversal.along(call, nodes, edges, ["a"], "forward").nodes.count() == 1


def simple(edges, root, target, depth):
    out = []

    def go(node, seen, path):
        for e, s, t, *_ in sorted(edges):
            if s == node and t not in seen and len(path) < depth:
                if t == target:
                    out.append([*path, e])
                else:
                    go(t, seen | {t}, [*path, e])

    go(root, {root}, [])
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_paths_in_order(spark, seed):
    edges = random_graph(seed, n=7, m=18)
    frame = spark.createDataFrame(edges, EDGE)
    expect = simple(edges, "n0", "n3", 5)
    every = {"p": OUT, "q": OUT, "r": OUT}
    got = paths.paths(frame, "n0", "n3", every, 3, depth=5, most=256)
    assert [list(r.path) for r in got.paths.orderBy("path").collect()] == expect
    some = paths.paths(frame, "n0", "n3", every, 3, depth=5, most=2)
    assert [list(r.path) for r in some.paths.orderBy("path").collect()] == expect[:2] and ("paths" in some.truncations) == (len(expect) > 2)
    if len(expect) > 2:
        after = paths.paths(frame, "n0", "n3", every, 3, depth=5, most=256, after=expect[1])
        assert [list(r.path) for r in after.paths.orderBy("path").collect()] == expect[2:]
    few = paths.paths(frame, "n0", "n3", every, 3, depth=5, most=256, expansions=2)
    found = [list(r.path) for r in few.paths.orderBy("path").collect()]
    assert found == expect[: len(found)] and (len(found) == len(expect) or "expansions" in few.truncations)


@pytest.mark.parametrize("small", [0, 100])
def test_strong_components(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(9)
    for n, m in ((9, 14), (20, 30)):
        edges = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)]
        names = [f"n{i:02}" for i in range(n)]
        reach = {a: {a} for a in names}
        for _ in names:
            for s, t in edges:
                for a in names:
                    if s in reach[a]:
                        reach[a].add(t)
        expect = {(a, min(b for b in names if b in reach[a] and a in reach[b])) for a in names}
        got = graph.strong_components(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(a,) for a in names], "node_id string"))
        assert {tuple(r) for r in got.collect()} == expect
        loops = {s for s, t in edges if s == t}
        sizes = {c: sum(x == c for _, x in expect) for _, c in expect}
        cycles = load_model.inheritance_cycles(spark.createDataFrame(edges, "src string, dst string"))
        assert {tuple(r) for r in cycles.collect()} == {(c, k) for c, k in sizes.items() if k > 1 or c in loops}


def test_excerpts_of_whole_characters(spark):
    texts = ["plain ascii text, long enough to be cut", "äöüßéèêçñ" * 5, "😀" * 9, "日本語のテキスト" * 3, "short", "", None, "a😀b日céd" * 6]
    rows = [(i, t, hashlib.sha256(t.encode()).hexdigest() if t is not None else None) for i, t in enumerate(texts)] + [(99, "text", "other")]
    for start, end in ((10, 30), (0, 5), (3, 3), (7, 8)):
        got = {r.doc_id: (r.excerpt, r.state) for r in load_model.excerpts(spark.createDataFrame(rows, "doc_id long, text string, digest string"), start, end).collect()}
        for i, text in enumerate(texts):
            if text is None:
                assert got[i] == (None, "digest_mismatch")
                continue
            raw = text.encode()
            low, high = start, end
            while low < len(raw) and low < start + 3 and raw[low] & 192 == 128:
                low += 1
            while high < len(raw) and high > end - 3 and raw[high] & 192 == 128:
                high -= 1
            assert got[i] == (raw[low : max(low, high)].decode(), "read" if len(raw) >= end else "out_of_range"), (text, start, end)
        assert got[99] == (None, "digest_mismatch")
