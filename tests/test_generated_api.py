"""Import of nested documents with unknown members."""

import json

from evidentia.sources import generated_api as G

GOOD = {
    "schema": "s", "extra": [1], "coverage": {"status": "complete", "negative_authority": True, "entity_counts": {"functions": 2, "events": 0}},
    "systems": [{"name": "S", "more": {"a": 1}, "functions": [
        {"name": "f", "qualified_name": "S.f", "source": {"path": "p", "line_start": 3}, "arguments": [{"name": "x", "type": "number", "odd": None}], "hue": 1.5},
        {"name": "", "qualified_name": "S.g", "source": {"path": "p"}},
    ]}],
}


def rows(spark):
    texts = [(1, json.dumps(GOOD)), (2, "{"), (3, "[1]"), (4, json.dumps({"schema": "t"})), (5, None), (6, json.dumps({"schema": "s"})), (7, json.dumps({**GOOD, "systems": "none"}))]
    return G.read(spark.createDataFrame(texts, "doc long, text string"), "doc", "text", "s")


def test_states_and_facts(spark):
    got = rows(spark)
    assert {r.doc: r.state for r in got.states.collect()} == {1: "invalid_member", 2: "malformed_json", 3: "not_an_object", 4: "wrong_schema", 5: "malformed_json", 6: "imported", 7: "coverage_mismatch"}
    assert [(r.doc, r.system, r.kind, r.qualified_name, r.line_start, r.restricted, r.conflicted) for r in got.facts.collect()] == [(1, "S", "function", "S.f", 3, False, False)]
    assert [(r.owner, r.list, r.position, r.name, r.type) for r in got.records.collect()] == [("S.f", "arguments", 0, "x", "number")]


def test_what_is_not_read_is_told(spark):
    got = sorted((r.doc, r.level, r.place, r.member, r.type) for r in rows(spark).unread.collect())
    assert got == [(1, "document", "", "extra", "ARRAY<BIGINT>"), (1, "member", "0/functions/0", "hue", "DECIMAL(2,1)"), (1, "record", "0/functions/0/arguments/0", "odd", "VOID"), (1, "system", "0", "more", "OBJECT<a: BIGINT>"), (7, "document", "", "extra", "ARRAY<BIGINT>")]


def test_look_up(spark):
    asked = spark.createDataFrame([(1, "function", "S.f"), (1, "function", "S.x"), (1, "event", "S.f"), (6, "function", "S.f"), (7, "function", "S.f")], "doc long, kind string, qualified_name string")
    got = {(r.doc, r.kind, r.qualified_name): r.outcome for r in G.look_up(asked, rows(spark)).collect()}
    assert got == {(1, "function", "S.f"): "found", (1, "function", "S.x"): "authoritative_absence", (1, "event", "S.f"): "authoritative_absence", (6, "function", "S.f"): "unknown", (7, "function", "S.f"): "unknown"}
