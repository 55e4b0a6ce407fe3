"""Contracts that queries over the test tables don't reach: refusals, crashes, empty tables."""

import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from evidentia.operators import cancellation, context, coverage, graph, lint, load_model, predicates, proposals, storage
from evidentia.plans import recognizers
from evidentia.sources import text


def test_a_pointer_that_a_crash_cut_short_counts_as_never_written(spark, tmp_path):
    store = storage.VersionStore(spark, f"file://{tmp_path}/store")
    one = store.prepare(spark.range(3))
    with pytest.raises(ValueError):
        store.activate(one, None)  # not validated
    assert store.validate(one) == 3
    store.activate(one, None)
    with open(f"{tmp_path}/store/current-{2:012d}.json", "w") as f:
        f.write('{"versi')
    assert store.current() == one and store.read().count() == 3
    two = store.prepare(spark.range(5))
    store.validate(two)
    with pytest.raises(ValueError):
        store.activate(two, None)  # current is one
    store.activate(two, one)
    assert store.current() == two and sorted(json.load(open(f"{tmp_path}/store/{n}"))["version"] for n in os.listdir(f"{tmp_path}/store") if n.startswith("current-") and not n.endswith("2.json")) == sorted([one, two])
    assert store.collect({one}, 5) == ([], False) and store.collect(set(), 5) == ([one], False)


def test_two_drivers_can_not_both_move_the_pointer(spark, tmp_path, monkeypatch):
    store = storage.VersionStore(spark, f"file://{tmp_path}/store")
    versions = [store.prepare(spark.range(n)) for n in (1, 2)]
    for v in versions:
        store.validate(v)
    store.activate(versions[0], None)
    other = storage.VersionStore(spark, f"file://{tmp_path}/store")
    monkeypatch.setattr(other, "_pointer", lambda: (0, None))  # it looked before the first moved it
    monkeypatch.setattr(other, "_pointers", lambda: [])
    with pytest.raises(ValueError, match="another driver"):
        other.activate(versions[1], None)
    assert store.current() == versions[0]


@pytest.mark.parametrize("value", ['{"a": 1, "a": 2}', '{"a": 1.5}', '{"a": null}', "{", "[" * 100_000, '"' + "x" * (1 << 20) + '"'])
def test_strict_json_refuses(value):
    state, out = text.json_state(value)
    assert state in ("repeated_key", "float", "null", "invalid", "too_deep", "too_large") and out is None


def test_strict_json_is_canonical():
    assert text.json_state(' {"b": [1, true], "a": "é"} ') == ("ok", '{"a":"é","b":[1,true]}')


def test_shapes_refuse_what_a_kind_does_not_have():
    for wrong in (lambda: predicates.declaration_shape("structure", members=1), lambda: predicates.declaration_shape("unheard"), lambda: predicates.restriction_shape(), lambda: predicates.slot_path("r", [], "call", "allow")):
        with pytest.raises(ValueError):
            wrong()


def test_scopes(spark):
    files = spark.createDataFrame([("a", "lua"), ("b", "xml")], "file_id string, kind string")
    for names in ([], ["a", "a"], ["none"]):
        with pytest.raises(ValueError):
            predicates.in_scope(files, "files", names)
    assert predicates.in_scope(files, "xml_documents").count() == 1


def test_recipes(spark):
    calls = spark.createDataFrame([(1, "f", "hooksecurefunc", "r"), (2, "f", "hooksecurefunc", "r"), (3, "f", "Mixin", "r"), (4, "f", "LibStub", "r"), (5, "f", "LibStub", "r"), (6, "f", "Frame.RegisterUnitEvent", "r"), (7, "f", "Frame.RegisterEvent", "r"), (8, "f", "nobody", "r"), (9, "f", "Mixin", "r")], "call_id long, caller string, callable string, receiver string")
    rows = [(1, 0, "Name"), (1, 1, "handler"), (2, 0, "tbl"), (2, 1, "Name"), (2, 2, "handler"), (3, 0, "t"), (3, 1, "A"), (3, 2, None), (4, 0, "Lib-1.0"), (5, 0, "Lib-1.0"), (5, 1, "x"), (6, 0, "E"), (6, 1, None), (9, 0, "t"), (9, 2, "B")]
    got = {(r.call_id, r.relation, r.target, r.detail, r.state) for r in recognizers.recognize(recognizers.call_facts(calls, spark.createDataFrame(rows, "call_id long, position long, value string"))).collect()}
    assert got == {
        (1, "secure_hooks_function", "Name", "", "derived"), (2, "secure_hooks_function", "Name", "", "derived"), (3, "mixes_in", "A", "", "derived"), (3, "mixes_in", None, None, "inexact_name"),
        (4, "requires_library", "Lib-1.0", "", "derived"), (5, "requires_library", None, None, "inexact_number"), (6, "registers_native_event", "E", "?", "possible"), (7, "registers_native_event", None, None, "missing_argument"),
        (9, "mixes_in", None, None, "incomplete_call"),
    }


def test_lint_on_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    gates = lint.capability_gate(none("file_id string"), none("file_id string, capability string, state string"), ["calls"])
    out = lint.api_exists(none("fact_id long, file_id string, partition string, name string, resolution string, generation int"), gates, none("partition string, name string, kind string"), none("partition string, complete boolean, authority boolean"), 1)
    assert out.count() == 0
    use = lint.unguarded_use(spark.createDataFrame([(1, "s", "n", 1, 5)], "use_id long, scope_id string, name string, value long, place long"), none("scope_id string, name string, value long, place long, dominates boolean"), spark.createDataFrame([("n", True)], "name string, restricted boolean"))
    assert [tuple(r) for r in use.collect()] == [(1, "absent", "finding", None)]


def test_packs_refuse_as_a_whole_and_trace_every_item(spark):
    rows = spark.createDataFrame([("p", "a", 1, True, False, 5), ("p", "a", 2, False, False, 5), ("p", "b", 3, False, True, 50), ("p", "c", 4, False, False, 6), ("q", "a", 1, False, False, 12)], "pack_id string, item_id string, rank long, required boolean, stale boolean, w long")
    got = {(r.pack_id, r.item_id, r.rank): (r.reason, r.outcome) for r in context.pack(rows, 11, F.col("w")).collect()}
    assert got == {("p", "a", 1): ("selected_required", "packed"), ("p", "a", 2): ("omitted_duplicate", "omitted"), ("p", "b", 3): ("omitted_stale", "omitted"), ("p", "c", 4): ("selected_ranked", "packed"), ("q", "a", 1): ("selected_ranked", "refused")}


@pytest.mark.parametrize("seed", range(3))
def test_outputs_that_share_their_inputs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(30)]
    told = {n: rng.randrange(3) for n in names}
    made = [(n, f"b{rng.randrange(6)}", told[n], int(rng.random() < 0.2)) for n in names[:20]]
    used = [(f"b{b}", i, told.get(i), rng.random() < 0.2) for b in range(5) for i in rng.sample([*names[10:], "nobody"], 3)]
    derivations = spark.createDataFrame(made, "output string, basis string, confidence int, missing int")
    inputs = spark.createDataFrame(used, "basis string, input string, confidence int, rebuttal boolean")
    own = spark.createDataFrame(list(told.items()), "assertion string, confidence int")
    apart = derivations.select("output", "basis").join(inputs, "basis").select("output", "input", "rebuttal")
    want = {r.output: r.verdict for r in proposals.validate_derivations(derivations.select("output", "missing"), apart, own).collect()}
    got = proposals.validate_derivations(derivations, inputs, basis="basis")
    assert {r.output: r.verdict for r in got.collect()} == want and got.count() == 20
    without = {o for o, b, c, _ in made if b == "b5" and c > 0}
    needed = {r.output: r.verdict for r in proposals.validate_derivations(derivations, inputs, basis="basis", required=True).collect()}
    assert needed == {**want, **{o: "missing_input" for o in without}}


def test_derivations_of_an_empty_graph_and_a_self_cycle(spark):
    d = lambda rows: spark.createDataFrame(rows, "output string, missing int")
    inputs = spark.createDataFrame([("a", "a", True)], "output string, input string, rebuttal boolean")
    own = spark.createDataFrame([("a", 2), ("b", 1)], "assertion string, confidence int")
    assert {tuple(r) for r in proposals.validate_derivations(d([("a", 0), ("b", 1), ("c", 0)]), inputs, own).collect()} == {("a", "cycle"), ("b", "incomplete_confirmed"), ("c", "missing_input")}
    assert graph.strong_components(inputs.select(F.col("output").alias("src"), F.col("input").alias("dst")).where("false"), spark.createDataFrame([("x",)], "node_id string")).collect()[0]["component"] == "x"


def test_unknown_requests_are_errors(spark):
    with pytest.raises(ValueError):
        proposals.disagreements(spark.range(1), "id", ["id"], "unheard")
    with pytest.raises(ValueError):
        coverage.merge_generations(None, None, "unheard")
    assert set(load_model.ISSUES) and len(coverage.DENIALS) == len(lint.BLOCKERS) == len(load_model.ISSUES) == 11 and len(coverage.FAMILIES) == 19


def test_a_running_step_is_cancelled_and_others_go_on(spark):
    work = cancellation.Cancellation(spark)
    assert work.step(lambda: spark.range(5).count()) == 5

    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    timer = threading.Timer(3, work.cancel)
    timer.start()
    start = time.time()
    with pytest.raises(cancellation.Cancelled):
        work.step(lambda: spark.range(4).mapInPandas(slow, "id long").count())
    assert time.time() - start < 40
    with pytest.raises(cancellation.Cancelled):
        work.step(lambda: spark.range(5).count())
    assert cancellation.Cancellation(spark).step(lambda: spark.range(6).count()) == 6  # its own tag


def test_a_failing_step_is_no_cancelled_one(spark):
    def broken(batches):
        raise ValueError("broken")
        yield

    with pytest.raises(Exception, match="broken") as e:
        cancellation.Cancellation(spark).step(lambda: spark.range(1).mapInPandas(broken, "id long").count())
    assert not isinstance(e.value, cancellation.Cancelled)


def test_topology_problems(spark):
    docs = [(1, '[{"file": "a", "loads": ["a", "z"], "references": [{"name": "n", "kind": "k"}]}, {"file": "a"}, {"loads": ["a"]}]'), (2, "nonsense"), (3, "[]"), (4, None)]
    edges, references, problems = text.topology(spark.createDataFrame(docs, "doc long, text string"), "doc", "text")
    assert {tuple(r) for r in problems.collect()} == {(1, "a", "repeated_file"), (1, None, "missing_file"), (1, "a", "self_load"), (1, "a", "unknown_load"), (2, None, "invalid_document"), (4, None, "invalid_document")}
    assert edges.count() == 2 and references.count() == 1
