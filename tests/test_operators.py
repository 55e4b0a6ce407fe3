"""Operators against naive versions on small random inputs, and their laws."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import positions, scalars
from evidentia.operators import coverage, graph, load_model, predicates, ranking, storage, paths, traversal
from evidentia.plans import rules
from evidentia.sources import markup, text
from evidentia.streaming import changes

SMALL = [("ab", "a", "b", 0), ("bd", "b", "d", 0), ("ac", "a", "c", 0), ("cd", "c", "d", 1), ("ba", "b", "a", 0), ("ad", "a", "d", 2), ("ax", "a", "x", 3), ("xd", "x", "d", 0)]


def edge_frame(spark, rows):
    return spark.createDataFrame([(e, s, d, "calls", c) for e, s, d, c in rows], "edge_id string, src string, dst string, relation string, confidence int")


@pytest.mark.parametrize(("ceiling", "expect"), [(0, {"ab>bd"}), (1, {"ab>bd", "ac>cd"}), (2, {"ab>bd", "ac>cd", "ad"}), (3, {"ab>bd", "ac>cd", "ad", "ax>xd"})])
def test_simple_paths_by_confidence(spark, ceiling, expect):
    got = paths.paths(edge_frame(spark, SMALL), "a", "d", {"calls": "out"}, ceiling).paths.collect()
    assert {">".join(r.path) for r in got} == expect
    assert [r.path for r in got] == sorted(r.path for r in got)


def test_isolated_and_cursor(spark):
    e = edge_frame(spark, SMALL)
    assert paths.paths(e, "a", "z", {"calls": "out"}).paths.count() == 0
    assert [r.path for r in paths.paths(e, "a", "d", {"calls": "out"}, 3, after=["ac", "cd"]).paths.collect()] == [["ad"], ["ax", "xd"]]


def naive_subgraph(edges, roots, depth):
    place = {r: (r,) for r in roots}
    found = {r: (0, None) for r in roots}
    level = sorted(roots)
    for d in range(1, depth + 1):
        new = {}
        for node in level:
            for e, s, t, _ in edges:
                if s == node and t not in found:
                    key = (*place[node], e)
                    if t not in new or key < new[t]:
                        new[t] = key
        for t, key in new.items():
            found[t], place[t] = (d, key[-1]), key
        level = sorted(new, key=lambda t: new[t])
    return {(n, d, e) for n, (d, e) in found.items()}


@pytest.mark.parametrize("seed", range(4))
def test_subgraph_discovery(spark, seed):
    rng = random.Random(seed)
    edges = [(f"e{i:03}", f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", 0) for i in range(30)]
    roots = spark.createDataFrame([("n0",), ("n7",)], "node_id string")
    got = graph.subgraph(edge_frame(spark, edges), roots, ("calls",), "out", 3).collect()
    assert {tuple(r) for r in got} == naive_subgraph(edges, ["n0", "n7"], 3)


def test_neighbors_count_self_loops_once(spark):
    e = edge_frame(spark, [*SMALL, ("zz", "a", "a", 0)])
    asked = spark.createDataFrame([("a",)], "node_id string")
    got = graph.neighbors(e, asked, ("calls",), "both").collect()
    assert [r.edge_id for r in got].count("zz") == 1 and {r.matched for r in got} == {6}


def test_components_and_order(spark):
    edges = spark.createDataFrame([("a", "b", "required"), ("b", "a", "optional"), ("b", "c", "required"), ("d", "c", "required"), ("e", "e", "required")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "node_id string")
    scc = graph.strong_components(edges, nodes)
    assert {tuple(r) for r in scc.select("node_id", "component").collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e"), ("f", "f")}
    assert [r.component for r in load_model.load_order(edges, scc).orderBy("place").collect()] == ["c", "a", "d", "e", "f"]
    assert {tuple(r) for r in load_model.levels(edges, scc).collect()} == {("c", 0), ("e", 0), ("f", 0), ("a", 1), ("d", 1)}
    assert {tuple(r) for r in load_model.cycle_kinds(edges, scc).collect()} == {("a", "mixed"), ("e", "required")}


FACTS = "fact_id long, kind string, scope_kind string, scope_id long, confidence int, fields map<string, struct<t:string, v:string>>"


def random_facts(spark, seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        fields = {"ordinal": ("integer", str(rng.randrange(8)))}
        if rng.random() < 0.9:
            fields["k"] = (rng.choice(["integer", "string"]), str(rng.randrange(3)))
        rows.append((i, rng.choice("ABC"), "user", rng.randrange(4), rng.randrange(4), fields))
    return rows, spark.createDataFrame(rows, FACTS)


def compiled(clauses, **more):
    return rules.compile_pack({"pack_id": "t", "rules": [{"rule_id": "r", "clauses": clauses, **more}]})


def fact(alias, kind):
    return {"fact": {"alias": alias, "kind": kind}}


SCOPE = {"same_scope": {"left": "a", "right": "b", "scope": "user"}}


@pytest.mark.parametrize("seed", range(3))
def test_rules_against_nested_loops(spark, seed):
    rows, facts = random_facts(spark, seed)
    of = lambda kind: [r for r in rows if r[1] == kind]
    k = lambda r: r[5].get("k")
    order = lambda r: int(r[5]["ordinal"][1])
    keys = lambda pack, cov=None: {r.match_key for r in rules.run_pack(pack, facts, cov or {}).collect()}
    joined = {f"{a[0]}/{b[0]}" for a in of("A") for b in of("B") if a[3] == b[3] and k(a) is not None and k(a) == k(b)}
    assert keys(compiled([fact("a", "A"), fact("b", "B"), SCOPE, {"join": {"left": "a.k", "right": "b.k"}}])) == joined
    before = {f"{a[0]}/{b[0]}" for a in of("A") for b in of("B") if a[3] == b[3] and order(a) < order(b)}
    assert keys(compiled([fact("a", "A"), fact("b", "B"), SCOPE, {"ordered": {"left": "a.ordinal", "right": "b.ordinal", "relation": "before"}}])) == before
    absent = {str(a[0]) for a in of("A") if not any(b[3] == a[3] and k(b) == ("integer", "1") for b in of("B"))}
    inner = [fact("b", "B"), SCOPE, {"field_eq": {"field": "b.k", "literal": ["integer", 1]}}]
    negation = compiled([fact("a", "A"), {"not_exists": {"capability": "c", "clauses": inner}}])
    assert keys(negation, {"c": "complete"}) == absent and keys(negation, {"c": "partial"}) == set()
    either = {str(a[0]) for a in of("A") if any(x[3] == a[3] and k(a) is not None and k(x) == k(a) for x in of("B") + of("C"))}
    branch = lambda alias, kind: [fact(alias, kind), {"same_scope": {"left": "a", "right": alias, "scope": "user"}}, {"join": {"left": "a.k", "right": f"{alias}.k"}}]
    assert keys(compiled([fact("a", "A"), {"any_of": [branch("b", "B"), branch("c", "C")]}])) == either


def test_control_flow_and_types(spark):
    fields = lambda **f: {n: ("string", v) for n, v in f.items()}
    rows = [(1, "A", "user", 1, 0, fields(k="1")), (2, "B", "user", 1, 0, fields(k="1")), (3, "B", "user", 1, 3, fields(k="1")), (9, "control_flow", "user", 1, 0, fields(left="1", right="2", relation="dominates"))]
    facts = spark.createDataFrame(rows, FACTS)
    flow = {"control_flow": {"left": "a", "right": "b", "relation": "dominates"}}
    got = rules.run_pack(compiled([fact("a", "A"), fact("b", "B"), SCOPE, flow]), facts, {}).collect()
    assert [(r.match_key, r.confidence) for r in got] == [("1/2", "proven")]
    assert rules.run_pack(compiled([fact("a", "A"), {"field_eq": {"field": "a.k", "literal": ["integer", 1]}}]), facts, {}).count() == 0
    assert {r.confidence for r in rules.run_pack(compiled([fact("b", "B")], key=["b.k"]), facts, {}).collect()} == {"possible"}


@pytest.mark.parametrize("clauses", [[{"nope": {}}], [fact("a", "A"), {"field_eq": {"field": "z.k", "literal": ["integer", 1]}}], [fact("a", "A"), {"not_exists": {"clauses": []}}], [fact("a", "A"), {"join": {"left": "a", "right": "a.k"}}]])
def test_bad_packs(clauses):
    with pytest.raises((ValueError, KeyError)):
        compiled(clauses)


def test_pack_digest_ignores_member_order():
    a = rules.compile_pack(json.dumps({"pack_id": "p", "rules": [{"rule_id": "r", "clauses": [fact("a", "A")]}]}))
    b = rules.compile_pack(json.dumps({"rules": [{"clauses": [fact("a", "A")], "rule_id": "r"}], "pack_id": "p"}))
    assert a.digest == b.digest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def test_scalars(spark):
    lit = F.lit
    assert [one(spark, scalars.bounded_distance(lit("Read"), lit(x), 2)) for x in ("Reed", "Reads", "Re", "Other")] == [1, 1, 2, None]
    assert one(spark, scalars.ascii_fold(lit("ÀBC"))) == "Àbc"
    assert one(spark, scalars.normal_path(lit("a\\./b//c"))) == "a/b/c" and one(spark, scalars.normal_path(lit("../a"))) is None and one(spark, scalars.normal_path(lit("/a"))) is None
    assert [one(spark, scalars.integer_of(lit(x))) for x in ("0x10", "-7", "9007199254740992", "1.5")] == [16, -7, None, None]
    assert one(spark, scalars.exact_sum(lit("9007199254740991"), lit("1"))) is None
    assert one(spark, scalars.content_digest(lit("a"), lit("bc"))) != one(spark, scalars.content_digest(lit("ab"), lit("c")))
    assert one(spark, scalars.content_digest(lit(None).cast("string"), lit("c"))) != one(spark, scalars.content_digest(lit(""), lit("c")))
    assert one(spark, scalars.has_phrase(lit("An, Apache-license."), "apache LICENSE")) and not one(spark, scalars.has_phrase(lit("apaches license"), "apache license"))
    assert one(spark, scalars.interface_matches(lit("1, x"), 1)) is None
    with pytest.raises(ValueError):
        scalars.prefix_match(lit("a"), "a")


def test_positions():
    t = "a🎉b\r\né\n"
    assert positions.position_of(t, 5) == (0, 3) and positions.position_of(t, 5, "utf-8") == (0, 5) and positions.position_of(t, 2) is None
    assert positions.position_of(t, 7) is None and positions.position_of(t, 8) == (1, 0)
    for o in range(len(t.encode()) + 1):
        if (p := positions.position_of(t, o, "utf-32")) is not None:
            assert positions.offset_of(t, *p, "utf-32") == o


def test_stabbing_against_linear_scan(spark):
    spans = [(i, i * 71 % 257, i * 71 % 257 + 1 + i * 43 % 257) for i in range(257)]
    df = spark.createDataFrame(spans, "span_id long, span_start long, span_end long")
    got = {(r.at, r.span_id) for r in predicates.stabbing(df, spark.range(515).select(F.col("id").alias("at")), 32).collect()}
    assert got == {(o, i) for i, a, b in spans for o in range(515) if a <= o < b}


def test_typed_values_and_orders(spark):
    nil, missing = predicates.typed("nil", None), F.lit(None).cast("struct<t:string,v:string>")
    assert one(spark, predicates.field_eq(nil, nil)) and not one(spark, F.coalesce(predicates.field_eq(missing, nil), F.lit(False)))
    assert not one(spark, predicates.field_eq(predicates.typed("string", "x"), predicates.typed("identifier", "x")))
    assert not one(spark, predicates.ordered(predicates.typed("string", 1), predicates.typed("integer", 2), "before"))
    assert one(spark, predicates.conjunction(F.lit(0), F.lit(None).cast("int"))) == 1 and one(spark, predicates.conjunction(F.lit(2), F.lit(1))) == 2


def test_refusal_and_lookahead(spark):
    df = spark.range(10).toDF("x")
    assert {tuple(r) for r in ranking.refuse_over(df, 9).collect()} == {(None, "refused")}
    assert ranking.refuse_over(df, 10).where("outcome = 'complete'").count() == 10
    assert {r.more for r in ranking.top(df, ["x"], 10).collect()} == {False} and {r.more for r in ranking.top(df, ["x"], 9).collect()} == {True}


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "k string, v string")
    once = coverage.deduplicate(df, "k", ["v"])
    assert {tuple(r) for r in once.collect()} == {("a", "x", False), ("b", "x", True)}
    assert coverage.deduplicate(once, "k", ["v"]).where("conflict").count() == 0


def test_version_store(spark, tmp_path):
    store = storage.VersionStore(spark, f"file://{tmp_path}/store")
    a, b = store.prepare(spark.range(3)), store.prepare(spark.range(5))
    with pytest.raises(ValueError):
        store.activate(a, None)
    assert store.validate(a) == 3 and store.validate(b) == 5
    store.activate(a, None)
    with pytest.raises(ValueError):
        store.activate(b, None)
    store.activate(b, a)
    assert store.read().count() == 5 and store.read(a).count() == 3
    assert store.collect({a}, 5) == ([], False) and store.collect(set(), 5) == ([a], False) and store.versions() == [b]


def test_sources(spark, tmp_path):
    (tmp_path / "x.lua").write_text("one")
    (tmp_path / "y.txt").write_text("two")
    assert [r.text for r in text.inventory(spark, str(tmp_path)).collect()] == ["one"]
    with pytest.raises(ValueError):
        text.inventory(spark, str(tmp_path), most_bytes=1)
    assert text.strict_json('{"a": [1, "x"]}') == {"a": [1, "x"]}
    for bad in ('{"a": 1, "a": 2}', '{"a": 1.5}', '{"a": null}'):
        with pytest.raises(ValueError):
            text.strict_json(bad)
    assert text.literal_rows('{ Name = "A", List = { 1, { X = true }, ref.name } }') == [("Name", "string", "A"), ("List.1", "number", "1"), ("List.2.X", "boolean", "true"), ("List.3", "reference", "ref.name")]
    with pytest.raises(ValueError):
        text.literal_rows("{ f() }")
    rows = markup.elements(spark.createDataFrame([(1, '<Ui><!-- <x> --><Frame name="é"><Size x="1"/></Frame></Ui>')], "id long, t string"), "id", "t").collect()
    assert [(r.tag, r.depth, r.attributes) for r in rows] == [("ui", 0, "{}"), ("frame", 1, '{"name": "\\u00e9"}'), ("size", 2, '{"x": "1"}')]


def test_edit_log_stream_equals_batch(spark, tmp_path):
    steps = [(0, "snapshot", 1, None, "d1"), (1, "change", 2, "d1", "d2"), (2, "change", 2, "d1", "d2"), (3, "change", 4, "d2", "d3"), (4, "change", 3, "d2", "d3"), (5, "snapshot", 7, None, "e")]
    rows = [(doc, seq, kind, v, b, d) for doc in ("x", "y") for seq, kind, v, b, d in steps] + [("z", 0, "change", 2, "a", "b")]
    log = spark.createDataFrame(rows, changes.CHANGE)
    expect = {(r.document, r.seq, r.outcome, r.version) for r in changes.fold_batch(log).collect()}
    assert {o for d, s, o, _ in expect if d == "x" and s in (1, 2, 3, 4)} == {"accepted", "repeated", "resync"} and ("z", 0, "resync", -1) in expect
    log.write.parquet(f"{tmp_path}/log")
    streamed = changes.drain(changes.fold_stream(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")), "edits")
    assert {tuple(r) for r in streamed.collect()} == expect


def test_distributed_ranks(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("string").alias("lane"), (F.col("id") * 37 % 1009).alias("entity_id"))
    got = ranking.ranked(df, "lane", "entity_id", "r").collect()
    for lane in ("true", "false"):
        own = sorted((r for r in got if r.lane == lane), key=lambda r: r.entity_id)
        assert [r.r for r in own] == list(range(1, len(own) + 1))
