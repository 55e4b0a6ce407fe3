"""Every operator with nulls, empty and very long texts, repeated rows, empty tables and columns whose names clash with its own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import bpe, decontaminate, ngram_join, pieces, pitman_yor, quality, queries, substrings, toxicity, warc

OWN = "node bid p path payload score y held_out predicted n root home spot group keys marks word offset folded w docs d last x v list cell cells lists copies vector digest refers_to first again archive stretch".split()
LONG = " ".join(f"w{i % 5003}" for i in range(120_000))
ROWS = [(1, "a short text of some words, here"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, "a short text of some words, here"), (6, "a short text of some words, here"), (None, "another text without an id"), (8, "x" * 200_000), (9, "日本語 テキスト 😀 été")]


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    return rows.select("doc_id", "text", "n_chars", *[F.lit(f"own {c}").alias(c) for c in OWN])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def each(documents, labels, items):
    yield "op1", decontaminate.overlaps(documents, items), None
    yield "op2", quality.classify(documents, labels), len(ROWS)
    yield "op4", ngram_join.join(documents), len(ROWS)
    yield "op5", pitman_yor.score(documents), len(ROWS)
    yield "op7", toxicity.classify(documents, labels), len(ROWS)
    yield "op9", substrings.digests(documents), len(ROWS)
    yield "op10", bpe.encode_decode(documents), len(ROWS)
    yield "op13", pieces.encode_decode(documents), len(ROWS)


def test_every_row_is_answered(spark, documents, labels):
    items = spark.createDataFrame([(1, "some words, here"), (2, None)], "item_id long, text string")
    for name, out, n in each(documents, labels, items):
        rows = out.collect()
        assert n is None or len(rows) == n, name
        assert n is None or sorted(map(str, (r.doc_id for r in rows))) == sorted(str(i) for i, _ in ROWS), name
        twins = {tuple(x for k, x in zip(out.columns, r, strict=True) if k != "doc_id") for r in rows if r.doc_id == 6}
        assert name == "op1" or len(twins) == 1, name
    found = decontaminate.overlaps(documents, items).collect()
    assert sorted(r.doc_id for r in found) == [1, 6, 6]


def test_columns_of_any_name_are_carried(spark, documents, labels):
    items = spark.createDataFrame([(1, "nothing that occurs")], "item_id long, text string")
    for out in (ngram_join.distinct_documents(documents), substrings.dedup(documents), decontaminate.clean(documents, items), toxicity.harmless(documents, toxicity.Lexicon({"zzz": 1.0}))):
        assert out.columns == documents.columns
        for r in out.collect():
            assert all(r[c] == f"own {c}" for c in OWN)
    kept = ngram_join.distinct_documents(documents).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "3", "4", "5", "None", "8", "9"])


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(None, text), (None, text), (7, text), (7, text), (9, f"{text} more"), (None, "alone"), (None, None), (4, "alone too, in a way")]
    kept = ngram_join.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted([("7", text), ("None", "alone"), ("None", "None"), ("4", "alone too, in a way")])


def test_empty_tables(spark, documents, labels, tmp_path):
    none = documents.where("false")
    items = spark.createDataFrame([(1, "some words, here")], "item_id long, text string")
    for name, out, _ in each(none, labels, items):
        assert out.count() == 0, name
    assert pitman_yor.score(none).columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    folder = str(tmp_path)
    none.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), "n_chars").write.parquet(f"{folder}/documents.parquet")
    labels.where("false").write.parquet(f"{folder}/labels.parquet")
    items.where("false").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_pipeline_with_odd_rows(spark, documents, labels, tmp_path):
    folder = str(tmp_path)
    given = documents.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), "n_chars")
    given.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "nothing that occurs")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = {str(r.doc_id): r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(rows) == {"1", "2", "3", "4", "5", "None", "8", "9"}
    assert rows["2"].n_tokens == rows["3"].n_tokens == rows["4"].n_tokens == 0 and rows["5"].n_tokens > 120_000


def test_warc_columns_and_repeats(spark, tmp_path):
    page = "<p>" + "y" * 300
    rows = [(1, "u", page), (1, "u", page), (2, None, page), (None, "v", page), (3, "w", None), (4, "x", "z" * 2_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(c).alias(c) for c in OWN])
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(df).collect())
    assert got == sorted([("1", "response", None, 303), ("1", "response", None, 303), ("2", "revisit", 1, 303), ("None", "revisit", 1, 303), ("3", "response", None, 0), ("4", "response", None, 2_000_000)])


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{n}" for n in range(1, len(queries.QUERIES) + 1)]
