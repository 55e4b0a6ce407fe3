"""The positional index against plain scans; what a look-up reads."""

import random

import pytest

from evidentia.operators import postings as P


def scan(rows, phrase):
    words = P.tokens(phrase)
    out = []
    for key, text in rows:
        own = P.tokens(text or "")
        out += [(key, i) for i in range(len(own) - len(words) + 1) if words and own[i : i + len(words)] == words]
    return sorted(out, key=str)


def found(index, phrase):
    return sorted([(r.key, r.position) for r in index.phrases({"p": phrase}).collect()], key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c Dé 日本 x1".split()) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    # repeats of one id, null ids, null and empty texts, texts longer than a stretch
    long = " ".join(rng.choice("a b c".split()) for _ in range(3 * P.STRETCH))
    out = [(i % 1400, t) for i, t in enumerate(texts)] + [(None, "a b c"), (7, None), (8, ""), (9, "..."), (4000, long), (4001, "b " * (P.STRETCH + 40))]
    return out


def test_equals_scan(spark, rows):
    index = P.build(spark.createDataFrame(rows, "doc long, body string").repartition(5), "doc", "body", buckets=4)
    for phrase in ("a", "A b", "dé 日本", "c c c", "a b c a b", "b " * 15, "b " * 16, "b " * 17, "b " * 40, "nowhere", "a nowhere", "", "-"):
        assert found(index, phrase) == scan(rows, phrase), phrase
    many = index.phrases({"x": "a b", "y": "c", "z": "b " * 33, "w": ""}).groupBy("name").count().collect()
    assert {r.name: r["count"] for r in many} == {"x": len(scan(rows, "a b")), "y": len(scan(rows, "c")), "z": len(scan(rows, "b " * 33))}


def test_segments_and_merge(spark, rows):
    parts = rows[:500], rows[500:], []
    index = P.PostingIndex(spark, P.new_folder(spark, "postings"), 4)
    for part in parts:
        index.add(spark.createDataFrame(part, "doc long, body string"), "doc", "body")
    before = found(index, "a b")
    assert before == scan(rows, "a b") and found(index, "b " * 20) == scan(rows, "b " * 20)
    assert len(index.merge().segments) == 1 and found(index, "a b") == before
    assert found(index, "b " * 20) == scan(rows, "b " * 20)


def test_a_look_up_reads_its_tokens_only(spark, rows):
    index = P.build(spark.createDataFrame(rows, "doc long, body string"), "doc", "body", buckets=16)
    wanted = index.postings({"x1"})
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(token,x1)" in plan.split("PushedFilters: [")[1].split("]")[0]
    files = {f.rsplit("/", 2)[1] for f in wanted.inputFiles()}
    assert len(files) == 1
    assert {r.token for r in wanted.collect()} == {"x1"}
    assert wanted.agg({"codes": "count"}).collect()


def test_no_posting_is_larger_than_a_block(spark):
    rows = [(i, "a " * (3 * P.STRETCH // 100)) for i in range(2 * P.DOCS + 5)]
    index = P.build(spark.createDataFrame(rows, "doc long, body string").coalesce(1), "doc", "body")
    sizes = index.postings({"a"}).selectExpr("max(size(codes)) AS n", "count(*) AS postings").collect()[0]
    assert sizes.n <= P.DOCS * (P.STRETCH + P.OVERLAP) and sizes.postings == 3
