"""Progressive packs: rounds of a request under a budget that is carried on, as a stream with state.

A request is served in rounds; each names the round it is, the digest of what it asks
for, and what it will cost in work and bytes.  The state of a request is what has been
spent, so a later micro-batch, or one after a restart, goes on from there.

Outcomes: accepted; repeated (the last round again with the same digest: charged as a
replay, nothing is spent twice); out_of_order (any other round but the next);
budget_exhausted and rounds_exhausted, which close the request; closed from then on.

Rows of one request within a micro-batch are in memory at once; the source's limit on a
micro-batch (files or offsets a trigger) bounds them.

Cases: rounds of a request within a micro-batch are taken by round, digest and cost; a null
request is named ''; null costs are nothing; a table is one micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST_ROUNDS = 16
RECEIPT = "request string, round long, outcome string, work long, bytes long, replayed long"
STATE = "last long, digest string, work long, bytes long, replayed long, closed boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRESH = (0, None, 0, 0, 0, False)


def charge(state: tuple, round_: int, digest: str | None, work: int, bytes_: int, most_work: int, most_bytes: int) -> tuple[str, tuple]:
    """Outcome of a round and the state after it."""
    last, known, spent_work, spent_bytes, replayed, closed = state
    if closed:
        return "closed", state
    if round_ == last and digest == known and last:
        return "repeated", (last, known, spent_work, spent_bytes, replayed + work, False)
    if round_ != last + 1:
        return "out_of_order", state
    if round_ > MOST_ROUNDS:
        return "rounds_exhausted", (*state[:5], True)
    if spent_work + work > most_work or spent_bytes + bytes_ > most_bytes:
        return "budget_exhausted", (*state[:5], True)
    return "accepted", (round_, digest, spent_work + work, spent_bytes + bytes_, replayed, False)


class Rounds(StatefulProcessor):
    """What each request has spent, by request."""

    def __init__(self, most_work: int, most_bytes: int):
        self.most_work, self.most_bytes = most_work, most_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.spent.get()) if self.spent.exists() else FRESH
        state = (int(state[0]), state[1], int(state[2]), int(state[3]), int(state[4]), bool(state[5]))
        pdf = pd.concat(list(rows))  # a request's rounds within one micro-batch
        pdf = pdf.sort_values(["round", "digest", "work", "bytes"])
        out = []
        for round_, digest, work, bytes_ in pdf[["round", "digest", "work", "bytes"]].itertuples(index=False, name=None):
            digest = None if pd.isna(digest) else digest
            outcome, state = charge(state, int(round_), digest, int(work), int(bytes_), self.most_work, self.most_bytes)
            out.append((key[0], int(round_), outcome, state[2], state[3], state[4]))
        self.spent.update(state)
        yield pd.DataFrame(out, columns=["request", "round", "outcome", "work", "bytes", "replayed"])

    def close(self) -> None:
        pass


def rounds(requests: DataFrame, most_work: int, most_bytes: int) -> DataFrame:
    """Receipts (request, round, outcome, and what the request has then spent) of a stream or table of requests (request, round, digest, work, bytes)."""
    nothing = F.lit(0).cast("long")
    rows = requests.select(F.coalesce(F.col("request").cast("string"), F.lit("")).alias("request"), F.coalesce(F.col("round").cast("long"), nothing).alias("round"), F.col("digest").cast("string").alias("digest"), F.coalesce(F.col("work").cast("long"), nothing).alias("work"), F.coalesce(F.col("bytes").cast("long"), nothing).alias("bytes"))
    if requests.isStreaming:
        requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # what state of this kind needs
    return rows.groupBy("request").transformWithStateInPandas(Rounds(most_work, most_bytes), outputStructType=RECEIPT, outputMode="Append", timeMode="None")
