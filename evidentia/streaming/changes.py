"""Structured Streaming counterparts: an ordered edit log over versioned documents, and event-time windows.

The edit log is the analogue of editing sessions: a change is accepted if it
names the snapshot's version and digest and the version after it; an identical
repetition is harmless; anything else asks for resynchronisation, and nothing is
accepted for that document until a snapshot arrives.  Windows with watermarks
over events are an extension that has no counterpart elsewhere in this engine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.shared import new_folder

CHANGE = "document string, seq long, kind string, version long, base string, digest string"
OUTCOME = "document string, seq long, outcome string, version long"
STATE = "version long, digest string, base string, lost boolean"


def fold(rows: Iterable[tuple], state: tuple | None) -> tuple[list[tuple[int, str, int]], tuple | None]:
    """Outcomes (seq, outcome, version after it) of changes (seq, kind, version, base, digest) in order, and the new state."""
    out = []
    for seq, kind, version, base, digest in rows:
        if kind == "snapshot":
            state = (version, digest, None, False)
            out.append((seq, "snapshot", version))
        elif state is None or state[3]:
            state = state and (*state[:3], True)
            out.append((seq, "resync", state[0] if state else -1))
        elif (version, base, digest) == (state[0], state[2], state[1]):
            out.append((seq, "repeated", state[0]))
        elif version == state[0] + 1 and base == state[1]:
            state = (version, digest, base, False)
            out.append((seq, "accepted", version))
        else:
            state = (*state[:3], True)
            out.append((seq, "resync", state[0]))
    return out, state


def fold_batch(log: DataFrame) -> DataFrame:
    """The log of a table, each document in the order of seq.

    As long as a document isn't lost, a change either repeats the row before it or follows
    on from it, so whether it fits is told by that row alone; from the first that doesn't
    fit up to the next snapshot everything is lost.  Windows over one sort do it, whose
    rows may spill.
    """
    by_seq = Window.partitionBy("document").orderBy("seq")
    upto = by_seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    snap = F.col("kind") == "snapshot"
    rows = log.withColumn("segment", F.count_if(snap).over(upto))
    before = {c: F.lag(c).over(by_seq) for c in ("version", "digest")} | {"base": F.lag(F.when(~snap, F.col("base"))).over(by_seq)}
    repeats = (F.col("version") == before["version"]) & F.col("base").eqNullSafe(before["base"]) & F.col("digest").eqNullSafe(before["digest"])
    follows = (F.col("version") == before["version"] + 1) & F.col("base").eqNullSafe(before["digest"])
    told = F.when(snap, "snapshot").when(repeats, "repeated").when(follows, "accepted")
    rows = rows.withColumn("told", told)
    of_segment = Window.partitionBy("document", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("lost", (F.col("segment") == 0) | (F.count_if(F.col("told").isNull()).over(of_segment) > 0))
    held = F.last(F.when(~F.col("lost"), F.col("version")), ignorenulls=True).over(of_segment)
    version = F.when(F.col("segment") == 0, -1).otherwise(held).cast("long")
    return rows.select("document", "seq", F.when(F.col("lost"), "resync").otherwise(F.col("told")).alias("outcome"), version.alias("version"))


def fold_stream(log: DataFrame) -> DataFrame:
    """The same over a stream, with (version, digest, base, lost) of each document as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("seq")
        held = tuple(state.get) if state.exists else None
        out, held = fold(pdf[["seq", "kind", "version", "base", "digest"]].itertuples(index=False, name=None), held)
        if held is not None:
            state.update((int(held[0]), held[1], held[2], bool(held[3])))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["document", "seq", "outcome", "version"])

    return log.groupBy("document").applyInPandasWithState(run, OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now into a table of the shared folder, and read that."""
    spark: SparkSession = stream.sparkSession
    folder = new_folder(spark, name)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of event types by window; a window leaves when the watermark has passed it."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
        .select(F.unix_timestamp(F.col("w.start")).alias("window_start"), "event_type", "n", "cents")
    )
