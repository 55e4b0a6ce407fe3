"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where none is set (a single machine, tests), a temporary folder."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", given)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(given)
    return given


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, deleted with what it holds when the session's driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


ROWS_A_FILE = 250_000  # of few numbers each


def keep(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows, computed once and stored in the shared folder.

    ``rows``: a bound on how many narrow rows there are, if the caller knows one; they
    are then stored in as many files as that takes, not in one for each partition.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle and checkpoint files that nothing refers to any more.

    The cleaner acts when the driver collects its garbage, which a job of a few
    large stages may not do before it ends; the files would pile up until then.
    """
    spark.range(1).collect()  # the session holds on to its last query
    gc.collect()
    spark.sparkContext._jvm.System.gc()
