"""The corpus pipeline: stages applied in order, each to all that its predecessor kept.

Toxic documents go, then all but the smallest doc_id of each group of near copies
(4-word shingles, Jaccard of at least 85 %), then repeated passages of 13 words or
more within what is left, then documents that hold benchmark items; the last stage
encodes the rest and checks the decoding.  All but the last stage keep the columns
of ``documents``, further ones of any name included.

Cases, for every stage: a null or empty text is a document without words (never toxic,
linked with nothing, nothing taken out, no overlap, no tokens) and stays; a null id or
a null in any other column is carried; texts of any length are read whole; repeated
rows are treated alike, but that the join keeps one of them; an empty table gives an
empty table with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, decontaminate, ngram_join, substrings, toxicity
from evidentia.llm.labelled import crc_part
from evidentia.shared import new_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a lexicon, learnt from those labels that are not held out, scores below 0.5.

    Without labels the lexicon is empty and all stay; equal texts are judged alike.
    """
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", crc_part(5) != 0)
    return toxicity.harmless(docs, lexicon)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, null ids last, of equal ids the first stored."""
    return ngram_join.distinct_documents(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of 13-word windows that also start in a document with a smaller id.

    ``n_chars`` is counted anew; a null text stays null with the n_chars it had.
    """
    return substrings.dedup(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a verified overlap with an item; all of them if there are no items."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, digests and ids of every document, in place of its columns."""
    return bpe.encode_decode(docs, keep_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_join", ngram_join_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: near copies, passages and token ids are not expressible in SQL of bearable length; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet to the shared folder and read again."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
