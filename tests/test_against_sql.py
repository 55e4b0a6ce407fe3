"""Queries against their SQL on tables that the test data does not hold."""

import duckdb
from pyspark.sql import functions as F

from evidentia import catalog


def differences(spark, folder, name, **tables):
    """Rows that only the query gives, and rows that only its SQL gives."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    cursor = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    want, got = cursor.fetchall(), [tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, str(folder)).collect()]
    assert len(want) == len(got) > 0
    return set(got) - set(want), set(want) - set(got)


def test_more_than_a_hundred_rows_are_complete(spark, tmp_path):
    part = spark.range(1000).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 3 == 0, "small ring").otherwise("large bolt").alias("p_name"), (F.col("id") % 2 + 1).cast("int").alias("p_size"))
    assert differences(spark, tmp_path, "b1_refusal", part=part) == (set(), set())


def test_charges_above_two_to_the_fortieth(spark, tmp_path):
    i = F.col("id")
    kind = F.when(i % 2 == 0, "signup").otherwise("purchase")
    events = spark.range(1 << 21).select(i.alias("event_id"), F.timestamp_seconds(i).alias("ts"), F.floor(i / 1000).alias("user_id"), kind.alias("event_type"), (i % 90).cast("double").alias("value"), F.concat(F.lit('{"k": '), i % 1000, F.lit("}")).alias("props"))
    assert differences(spark, tmp_path, "b3_rule_budget", events=events) == (set(), set())


def test_titles_cut_within_a_reference(spark, tmp_path):
    titles = ["a &amp; b&amp;", "a &amp; b&amp", "&amp;&amp", "&#233;&frac12;&lt;", "plain"]
    pages = spark.createDataFrame([(n, f"<html><title>{t}</title><svg><title>x &gt;</title></svg></html>") for n, t in enumerate(titles)], "page_id long, html string")
    assert differences(spark, tmp_path, "d16_composed_maps", pages=pages) == (set(), set())
