"""Deltas of a session as a stream: each micro-batch is applied to the snapshot once.

A snapshot is a table (key, digest) in a folder by version; micro-batch n reads version n
and writes version n + 1 with the outcomes of its changes.  What a batch writes depends on
its number and its input alone, so a batch that is run again after a failure writes the
same folders again.  One failed change of a batch leaves the snapshot as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.load_model import update_snapshot

SNAPSHOT = "key string, digest string"
OUTCOMES = "key string, outcome string, batch long"


class Snapshots:
    """Versions of a snapshot in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def begin(self, rows: DataFrame) -> None:
        """The snapshot before the first batch."""
        rows.select("key", "digest").write.mode("overwrite").parquet(self.path(0))

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(SNAPSHOT).parquet(self.path(version))

    def outcomes(self, version: int) -> DataFrame:
        """(key, outcome, batch) of the changes up to a version."""
        parts = [f"{self.folder}/outcomes-{n}" for n in range(version)]
        return self.spark.read.schema(OUTCOMES).parquet(*parts)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """For foreachBatch: version ``batch`` with its changes (key, action, expected, digest) is version ``batch`` + 1; of several changes of a key in a batch all fail."""
        changes = changes.persist()  # read for the outcomes and for the rows
        try:
            several = changes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit("several").alias("twice"))
            marked = changes.join(several, "key", "left").withColumn("action", F.coalesce("twice", "action")).drop("twice")
            told, after = update_snapshot(self.read(batch), marked.where("action <> 'several'"))
            failed = marked.where("action = 'several'").select("key", F.lit("failed").alias("outcome"))
            told = told.unionByName(failed).withColumn("batch", F.lit(batch).cast("long"))
            told.write.mode("overwrite").parquet(f"{self.folder}/outcomes-{batch}")
            kept = after if failed.isEmpty() else self.read(batch)
            kept.select("key", "digest").write.mode("overwrite").parquet(self.path(batch + 1))
        finally:
            changes.unpersist()

    def run(self, changes: DataFrame) -> int:
        """Apply what a stream of changes holds now, from where the last run ended; the version then reached."""
        query = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        done = query.lastProgress
        return -1 if done is None else done["batchId"] + 1
