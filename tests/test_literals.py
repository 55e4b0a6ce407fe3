"""Data literals: malformed texts are rows, deep values are kept apart."""

import pytest

from evidentia.sources import text as T


@pytest.mark.parametrize("text", ["}", "{", "a =", "{ a = }", "{ f() }", "{ [1] = 2 }", "a = = 2", '{ "x }', "}{", "{ a = , }"])
def test_malformed(text):
    with pytest.raises(ValueError):
        T.literal_rows(text)


def test_one_malformed_text_does_not_fail_the_job(spark):
    rows = [(1, "{ a = 1, b = { true, nil } }"), (2, "{ f() }"), (3, None), (4, "{ x = 'y' }")]
    df = spark.createDataFrame(rows, "api long, text string")
    assert {(r.api, r.path) for r in T.data_literals(df, "api", "text").collect()} == {(1, "a"), (1, "b.1"), (1, "b.2")}
    assert {r.api: (r.state, r.n, r.reason is None) for r in T.literal_states(df, "api", "text").collect()} == {1: ("complete", 3, True), 2: ("malformed", 0, False), 3: ("complete", 0, True), 4: ("malformed", 0, False)}


def test_deeper_values_are_other(spark):
    df = spark.createDataFrame([(1, '{ Tables = { { Name = "T", Fields = { { Name = "F", Inner = { Z = 1 } } } } }, Extra = { 5 } }')], "api long, text string")
    got = {(r.section, r.ordinal, r.name, r.member, r.position, r.field, r.value) for r in T.normalized(T.data_literals(df, "api", "text"), "api").collect()}
    assert got == {("table", 1, "T", None, None, "Name", "T"), ("table", 1, "T", "Fields", 1, "Name", "F"), ("other", 1, "T", "Fields", 1, "Inner.Z", "1"), ("other", 1, None, None, None, "1", "5")}
