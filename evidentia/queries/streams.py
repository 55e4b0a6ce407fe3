"""Queries that run as streams over the events until all that is there is read (T, an extension)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.registry import Source, query
from evidentia.shared import new_folder
from evidentia.streaming import changes as C
from evidentia.streaming import packs as Packs
from evidentia.streaming.snapshots import Snapshots


def stream(s: Source):
    return s.spark.readStream.schema(s.events.schema).option("pathGlobFilter", "events.parquet").parquet(s.sf_dir)


@query("t1_tumbling_windows", """SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events
    WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""")
def _(s: Source):
    return C.drain(C.tumbling(stream(s)), "windows")


def log(events):
    """Each user's events as a log: signups are snapshots, errors name a wrong version, the rest follow on."""
    return events.select(
        F.col("user_id").cast("string").alias("document"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "snapshot").otherwise("change").alias("kind"),
        F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 99).otherwise(2).cast("long").alias("version"),
        F.lit("d1").alias("base"), F.when(F.col("event_type") == "signup", "d1").otherwise("d2").alias("digest"),
    )


# a snapshot opens a segment of its document; within it the first fitting change is accepted, further ones repeat it, and an unfit one loses it
EDITS = """WITH l AS (SELECT user_id, event_id AS seq, event_type = 'signup' AS snap, event_type = 'error' AS unfit FROM events), s AS (SELECT *, count(*) FILTER (snap) OVER w AS segment FROM l WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
    t AS (SELECT *, count(*) FILTER (unfit) OVER w AS lost, count(*) FILTER (NOT snap AND NOT unfit) OVER w AS fits, min(CASE WHEN unfit THEN seq END) OVER (PARTITION BY user_id, segment) AS broken FROM s WINDOW w AS (PARTITION BY user_id, segment ORDER BY seq))
    SELECT CAST(user_id AS VARCHAR) AS document, seq, CASE WHEN snap THEN 'snapshot' WHEN segment = 0 OR lost > 0 THEN 'resync' WHEN fits = 1 THEN 'accepted' ELSE 'repeated' END AS outcome,
      CAST(CASE WHEN segment = 0 THEN -1 WHEN snap THEN 1 WHEN lost = 0 THEN 2 WHEN EXISTS (SELECT 1 FROM t x WHERE x.user_id = t.user_id AND x.segment = t.segment AND x.seq < t.broken AND NOT x.snap) THEN 2 ELSE 1 END AS BIGINT) AS version FROM t"""


@query("t2_edit_log", EDITS)
def _(s: Source):
    return C.drain(C.fold_stream(log(stream(s))), "edits")


@query("t3_edit_log_batch", EDITS)
def _(s: Source):
    return C.fold_batch(log(s.events))


_COSTS = """WITH c AS (SELECT CAST(scope_id AS VARCHAR) AS request, ordinal AS round, CAST(floor(value) AS BIGINT) AS work, CAST(fact_id % 100 AS BIGINT) AS bytes FROM facts),
    t AS (SELECT *, sum(work) OVER w AS tw, sum(bytes) OVER w AS tb FROM c WINDOW w AS (PARTITION BY request ORDER BY round)), f AS (SELECT *, coalesce(min(CASE WHEN tw > 500 OR tb > 900 OR round > 16 THEN round END) OVER (PARTITION BY request), 1000000) AS first FROM t)"""


@query("t4_progressive_packs", _COSTS + """ SELECT request, round, CASE WHEN round < first THEN 'accepted' WHEN round > first THEN 'closed' WHEN round > 16 THEN 'rounds_exhausted' ELSE 'budget_exhausted' END AS outcome,
    CAST(sum(CASE WHEN round < first THEN work ELSE 0 END) OVER w AS BIGINT) AS work, CAST(sum(CASE WHEN round < first THEN bytes ELSE 0 END) OVER w AS BIGINT) AS bytes FROM f WINDOW w AS (PARTITION BY request ORDER BY round)""", "facts")
def _(s: Source):  # each user's events are the rounds of a request; the stream is stopped after the sixth and started again
    rows = s.facts.select(F.col("scope_id").cast("string").alias("request"), F.col("ordinal").alias("round"), F.col("kind").alias("digest"), F.floor("value").cast("long").alias("work"), (F.col("fact_id") % 100).cast("long").alias("bytes"))
    folder = new_folder(s.spark, "rounds")
    for part in (rows.where("round <= 6"), rows.where("round > 6")):
        part.write.mode("append").parquet(f"{folder}/in")
        receipts = Packs.rounds(s.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), 500, 900)
        receipts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return s.spark.read.schema(Packs.RECEIPT).parquet(f"{folder}/out").drop("replayed")


@query("t5_snapshot_deltas", "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS digest FROM orders WHERE o_orderkey % 10 <> 1 UNION ALL SELECT 'new', 'N'")
def _(s: Source):  # an update of a tenth, a removal of a tenth, a batch that fails, an addition; the stream is started anew for each
    held = Snapshots(s.spark, new_folder(s.spark, "snapshots"))
    key, status = F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus")
    held.begin(s.orders.select(key, status.alias("digest")))
    row = lambda df, action, expected, digest: df.select(key, F.lit(action).alias("action"), expected.cast("string").alias("expected"), F.lit(digest).cast("string").alias("digest"))
    one = s.orders.where("o_orderkey = 2")
    deltas = [row(s.orders.where("o_orderkey % 10 = 0"), "update", status, "X"), row(s.orders.where("o_orderkey % 10 = 1"), "remove", status, None), row(one, "update", F.lit("?"), "Y"), row(one, "add", F.lit(None), "N").withColumn("key", F.lit("new"))]
    source, version = f"{held.folder}/changes", 0
    for n, delta in enumerate(deltas):
        delta.coalesce(1).write.parquet(f"{source}/delta-{n}")
        version = held.run(s.spark.readStream.schema("key string, action string, expected string, digest string").parquet(f"{source}/*"))
    return held.read(version)
