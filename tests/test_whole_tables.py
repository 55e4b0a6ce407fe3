"""Whole-table queries cover every row, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from evidentia import catalog
from evidentia.operators import ranking, storage

TEXTS = [(1, "short one\n\n## m\n# c\nfile"), (2, "\n".join(f"Long line {i} of thé text" for i in range(120))), (3, ""), (4, "x " * 900)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("n_chars", F.length("text")).write.parquet(f"{path}/documents.parquet")
    spark.range(1, 1200).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), F.col("id")).alias("p_name")).repartition(7).write.parquet(f"{path}/part.parquet")
    lines = spark.range(0, 6000).select(F.col("id").alias("l_orderkey"), (F.col("id") % 1100 + 1).alias("l_partkey"), F.lit(1).alias("l_linenumber"), F.lit(1).alias("l_suppkey"), F.lit(1.0).alias("l_extendedprice"))
    lines.where("l_partkey > 500 or l_orderkey >= 3000").write.parquet(f"{path}/lineitem.parquet")
    return path


def rows(spark, folder, name):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, folder).collect())


def test_long_texts(spark, folder):
    words = [(d, i, w) for d, t in TEXTS for i, w in enumerate(re.findall(r"[^\W_]+", t.lower()))]
    assert rows(spark, folder, "s18_token_table") == words
    lines = [(d, i, s) for d, t in TEXTS for i, s in enumerate(t.split("\n"))]
    assert rows(spark, folder, "w6_ordinals") == lines
    starts = [(d, i, len("".join(f"{s}\n" for s in t.split("\n")[:i]).encode())) for d, t in TEXTS for i in range(len(t.split("\n")))]
    assert [(d, i, at) for d, i, _, at in rows(spark, folder, "s4_manifest_lines")] == starts


def test_all_ids(spark, folder):
    part, lines = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("part", "lineitem"))
    found = storage.unreferenced(part, "p_partkey", lines.select(F.col("l_partkey").alias("p_partkey")))
    assert sorted(r.p_partkey for r in found.collect()) == list(range(1101, 1200))
    assert len(rows(spark, folder, "d8_load_units")) == spark.read.parquet(f"{folder}/lineitem.parquet").count()
    pages = rows(spark, folder, "k6_page_fixpoint")
    assert pages == [(p, (n := sum(len(f"part {i}") for i in range(10 * p + 1, min(1200, 10 * p + 11)))) + (2 if n + 2 < 100 else 3)) for p in range(120)]


def test_places_over_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking.numbered(spark.range(0, 5000, 1, 6).select((F.col("id") * 7919 % 5003).alias("k")), "k").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.r for r in sorted(got)] == list(range(5000))
