"""Manifests tell versions apart by few nodes; foreign packs pass and fail each check."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.operators import foreign_packs as K
from evidentia.operators import manifest as M


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(0, 6000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("w"))


def test_versions_that_differ_in_few_rows(spark, table):
    new = table.where("k <> 17").withColumn("v", F.when(F.col("k").isin(5, 99), "x").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(7001, "new", None)], "k long, v string, w long"))
    a, b = M.build(table, ["k"], depth=3), M.build(new.repartition(5), ["k"], depth=3)
    found = M.compare(a, b)
    assert 1 <= found.leaves.count() <= 4 and found.read <= 2 * (1 + 16 + 4 * 16 + 4 * 16)
    assert {(r.k, r.change) for r in M.changes(table, new, a, found).collect()} == {(17, "removed"), (5, "changed"), (99, "changed"), (7001, "added")}
    assert a.nodes(0).collect()[0]["n"] == 6000


def test_equal_tables_have_equal_roots(spark, table):
    a, b = M.build(table, ["k"], depth=2), M.build(table.repartition(7).select("w", "v", "k"), ["k"], depth=2)
    found = M.compare(a, b)
    assert a.root() == b.root() and found.leaves.count() == 0 and found.read == 2


def test_repeats_nulls_and_empty_tables(spark, table):
    twice = M.build(table.unionByName(table.limit(1)), ["k"], depth=1)
    assert twice.root() != M.build(table, ["k"], depth=1).root()
    nulls = M.build(table.withColumn("w", F.coalesce("w", F.lit(0))), ["k"], depth=1)
    assert nulls.root() != M.build(table, ["k"], depth=1).root()
    for depth in (0, 2):
        empty = M.build(table.where("false"), ["k"], depth=depth)
        assert empty.nodes(0).collect()[0]["n"] == 0
        assert M.compare(empty, M.build(table, ["k"], depth=depth)).leaves.count() == (1 if depth == 0 else 256)
    with pytest.raises(ValueError):
        M.compare(twice, M.build(table, ["k"], depth=2))


def broken():
    items = [K.item("note", {"a": 1}, 2), K.item("note", {"b": "é"}, 3)]
    links = [{"source": items[0]["item_id"], "target": items[1]["item_id"]}]
    good = K.pack("p", 1, 5, items, links)
    change = lambda **more: K.canonical({**json.loads(good), **more})
    renamed = [{**items[0], "payload": {"a": 2}}, items[1]]
    return [
        ("good", good, None, None), ("none", None, 0, "empty"), ("deep", "[" * 200 + "]" * 200, 0, "too_deep"), ("text", "{", 1, "input_not_canonical_json"), ("repeated", good.replace('"budget":5', '"budget":5,"budget":5'), 1, "duplicate_object_key"), ("null", good.replace('"budget":5', '"budget":null'), 1, "null_or_float_forbidden"), ("spaced", good.replace(",", ", ", 1), 1, "input_not_canonical_json"),
        ("shape", change(more=1), 2, "wire_schema_mismatch"), ("schema", change(schema="x"), 2, "wire_schema_mismatch"), ("item", change(items=[{"a": 1}]), 2, "wire_schema_mismatch"), ("profile", change(profile="x"), 3, "unsupported_profile"), ("budget", change(budget=4), 3, "compiled_profile_mismatch"),
        ("payload", change(items=renamed), 4, "digest_identity_mismatch"), ("twice", change(items=[items[0], items[0]]), 4, "digest_identity_mismatch"), ("id", change(pack_id="0"), 4, "semantic_pack_identity_mismatch"),
        ("link", K.pack("p", 1, 5, items, [{"source": "x", "target": items[0]["item_id"]}]), 5, "internal_reference_mismatch"),
        ("unknown", K.pack("q", 1, 5, items, links), 6, "unknown_generation"), ("gone", K.pack("p", 0, 5, items, links), 6, "generation_not_retained"),
    ]


def test_foreign_packs(spark):
    packs = spark.createDataFrame([(n, t) for n, t, _, _ in broken()], "name string, text string")
    generations = spark.createDataFrame([("p", 1, True), ("p", 0, False)], "owner string, generation long, retained boolean")
    got = {}
    for r in K.validate(packs, "name", "text", generations).collect():
        got.setdefault(r.name, {})[r.place] = (r.check, r.state, r.reason)
    for name, _, at, reason in broken():
        checks = [got[name][i + 1] for i in range(8)]
        assert [c for c, _, _ in checks] == list(K.CHECKS)
        want = [K.VALID] * 7 if at is None else [K.VALID] * at + [K.INVALID] + [K.NOT_EVALUATED] * (6 - at)
        assert [s for _, s, _ in checks] == [*want, K.NOT_EVALUATED], name
        assert at is None or checks[at][2] == reason, name
