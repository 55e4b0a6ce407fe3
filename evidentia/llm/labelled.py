"""Labelled rows for the classifiers: which rows may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
PARTS = 32  # of the labelled texts


def crc_part(modulus: int) -> Column:
    """crc32 of doc_id as decimal text, modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % modulus


def pick(labels: DataFrame, label: str, usable: Column, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, y) of the ``most`` usable ids that come first by a hash; an id labelled twice counts as 1 if any row says so."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
        .groupBy("doc_id").agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )


def labelled_texts(documents: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc_id, text, y) of distinct texts; ``picked`` has a fixed number of small rows and is broadcast.

    Of rows with one id the smallest text counts, so there are no more rows than
    picked ids.  Equal texts are one row with the smallest id, 1 if half of them are.
    """
    rows = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), (F.avg("y") >= 0.5).cast("int").alias("y"))
    return rows.select("doc_id", "text", "y").repartition(PARTS, "doc_id")
