"""Lanes, fusion, pages and budgets over ranked candidates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.shared import keep

RRF_SCALE, RRF_OFFSET, RANK_MAX = 1_000_000, 60, (1 << 32) - 1


def contribution(rank: Column) -> Column:
    """Reciprocal-rank share in integers."""
    return F.floor(F.lit(RRF_SCALE) / (RRF_OFFSET + rank)).cast("long")


def ranked(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """1-based place of each row within its group by ``order``, without gathering a group in one task.

    Rows are range-partitioned by (group, order) and numbered within their
    partition; what earlier partitions hold of the group is added from a table of
    one row for each partition and group.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    local = Window.partitionBy("__p", group).orderBy(order)
    placed = keep(df.repartitionByRange(parts, group, order).withColumn("__p", F.spark_partition_id()).withColumn("__r", F.row_number().over(local)))
    sizes = placed.groupBy(group, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(group, "__p", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.join(offsets, [group, "__p"]).withColumn(name, (F.col("__r") + F.col("__before")).cast("int")).drop("__p", "__r", "__before")


def lane_ranks(signals: DataFrame) -> DataFrame:
    """1-based place of each entity within its lane, by entity id."""
    return ranked(signals.select("lane", "entity_id", "band").distinct(), "lane", "entity_id", "lane_rank")


def fuse(ranked: DataFrame) -> DataFrame:
    """Per entity: best band, best lane rank, summed contributions and the lanes; ordered by (band, rank, RANK_MAX - sum, id) when sorted by `order_key`."""
    out = ranked.groupBy("entity_id").agg(F.min("band").alias("band"), F.min("lane_rank").alias("best_rank"), F.sum(contribution(F.col("lane_rank"))).alias("rr"), F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("lanes"))
    return out.withColumn("rr_key", F.lit(RANK_MAX).cast("long") - F.col("rr"))


ORDER_KEY = ("band", "best_rank", "rr_key", "entity_id")


def admit_first(ranked: DataFrame, lane_order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` entities in scan order (lane order, then rank within the lane), not the best ones."""
    at = F.array_position(F.array(*map(F.lit, lane_order)), F.col("lane"))
    first = ranked.groupBy("entity_id").agg(F.min(F.struct(at.alias("l"), F.col("lane_rank").alias("r"))).alias("seen"))
    kept = first.orderBy("seen", "entity_id").limit(most).select("entity_id")
    return ranked.join(F.broadcast(kept) if most <= 100_000 else kept, "entity_id", "left_semi")


def top(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows with their 1-based place, and whether more follow: one row of lookahead, never a full sort."""
    rows = df.orderBy(*order).limit(k + 1)
    place = F.row_number().over(Window.orderBy(*order))
    more = F.count(F.lit(1)).over(Window.partitionBy()) > k
    return rows.withColumn("place", place).withColumn("more", more).where(F.col("place") <= k)


def refuse_over(df: DataFrame, most: int) -> DataFrame:
    """All rows with outcome complete, or the single row `refused` if there are more than ``most``: an exact set is never cut."""
    probe = df.limit(most + 1).agg(F.count(F.lit(1)).alias("n"))
    rows = df.join(F.broadcast(probe.where(F.col("n") <= most)).select(F.lit("complete").alias("outcome")))
    none = probe.where(F.col("n") > most).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes], F.lit("refused").alias("outcome"))
    return rows.unionByName(none)


def pages(ordered: DataFrame, order: Sequence[str], size: int, most_pages: int, most_bytes: int, weight: Column, bound: int) -> DataFrame:
    """Whole candidates on pages: page number, place on it, and cumulative bytes; delivery ends at the first budget that is used up.

    ``bound`` is the most rows that could be delivered (size * most_pages); only
    those reach the single ordered task.
    """
    head = ordered.orderBy(*order).limit(min(bound, size * most_pages))
    w = Window.orderBy(*order)
    n = F.row_number().over(w) - 1
    placed = head.withColumn("page", F.floor(n / size).cast("long")).withColumn("place", (n % size).cast("long")).withColumn("bytes", F.sum(weight.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where(F.col("bytes") <= most_bytes)


def cumulative_bytes(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column) -> DataFrame:
    """Start and end byte of each row in its group's rendered order."""
    w = Window.partitionBy(*by).orderBy(*order)
    end = F.sum(weight.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("byte_end", end).withColumn("byte_start", F.col("byte_end") - weight.cast("long"))


def expansion_budget(counts: Sequence[Column]) -> Column:
    """What a cross product of fact kinds of these sizes would have charged, prefix by prefix: n1 + n1 n2 + ..."""
    total, product = F.lit(0).cast("decimal(38,0)"), F.lit(1).cast("decimal(38,0)")
    for c in counts:
        product = (product * c.cast("decimal(12,0)")).cast("decimal(38,0)")
        total = (total + product).cast("decimal(38,0)")
    return total


def numbered(df: DataFrame, key: str) -> DataFrame:
    """All rows with their place ``r`` in the order of a unique key: numbers within key ranges plus the ranges' offsets."""
    rows = keep(df.repartitionByRange(key).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    offsets = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    return rows.withColumn("own", own).join(F.broadcast(offsets), "range").withColumn("r", F.col("own") + F.col("offset")).drop("range", "own", "offset")


class Budget(ValueError):
    """A page that a cumulative budget or a foreign cursor refuses; ``code`` says which."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


BUDGETS = ("pages", "candidates", "candidate_bytes", "page_bytes", "manifest_bytes")


class Paging:
    """Pages of one ordered result under budgets that add up over all pages.

    A cursor names the result, the query, the universe, the policy, the next candidate
    and what was delivered so far, and carries a digest of itself; one that was made for
    anything else, or changed, is refused.  Each page after the first replays the
    result's manifest and is charged for it.
    """

    def __init__(self, rows: DataFrame, order: Sequence[str], weight: Column, size: int, limits: dict[str, int], identity: dict[str, str], manifest_bytes: int):
        self.rows, self.order, self.weight, self.size, self.limits, self.identity, self.manifest = rows, order, weight, size, limits, identity, manifest_bytes

    def seal(self, state: dict) -> dict:
        body = {**self.identity, **state}
        return body | {"digest": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}

    def page(self, cursor: dict | None = None) -> tuple[DataFrame, dict | None]:
        """The next page and the cursor for the one after it, None at the end."""
        spent = dict.fromkeys(BUDGETS, 0) | {"next": 0}
        if cursor is not None:
            body = {k: v for k, v in cursor.items() if k != "digest"}
            if cursor != self.seal({k: body.get(k, 0) for k in spent}):
                raise Budget("cursor_mismatch")
            spent = {k: body[k] for k in spent}
            spent["manifest_bytes"] += self.manifest
        spent["pages"] += 1
        head = self.rows.withColumn("__w", self.weight.cast("long")).orderBy(*self.order).limit(spent["next"] + self.size + 1)
        place = F.row_number().over(Window.orderBy(*self.order)) - 1  # over what the limits let through
        found = keep(head.withColumn("place", place.cast("long")).where(F.col("place") >= spent["next"]))
        told = found.where(F.col("place") < spent["next"] + self.size).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__w"), F.lit(0)).alias("w")).collect()[0]
        more = found.count() > told["n"]
        spent["candidates"] += told["n"]
        spent["candidate_bytes"] += told["w"]
        spent["page_bytes"] += told["w"] + 2
        for name in BUDGETS:
            if spent[name] > self.limits.get(name, 1 << 62):
                raise Budget(name)
        page = found.where(F.col("place") < spent["next"] + self.size).drop("__w")
        spent["next"] += told["n"]
        return page, self.seal(spent) if more else None


def witness_budget(counts: Sequence[Column]) -> Column:
    """The second counter of a cross product: each copied row is charged the aliases it binds, its witnesses and its exact proof, three for each bound fact."""
    total, product = F.lit(0).cast("decimal(38,0)"), F.lit(1).cast("decimal(38,0)")
    for k, c in enumerate(counts, 1):
        product = (product * c.cast("decimal(12,0)")).cast("decimal(38,0)")
        total = (total + product * F.lit(3 * k).cast("decimal(6,0)")).cast("decimal(38,0)")
    return total


def next_members(rows: DataFrame, key: str, weight: Column, most: int, most_bytes: int, after: object = None) -> tuple[DataFrame, object, bool]:
    """The next members in the order of a unique key after a cursor, at most ``most`` and no more than ``most_bytes`` (but for one that is larger on its own), the cursor behind them, and whether more follow."""
    rest = rows if after is None else rows.where(F.col(key) > F.lit(after))
    head = rest.withColumn("bytes", weight.cast("long")).orderBy(key).limit(most + 1)
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)  # over at most ``most`` + 1 rows
    placed = keep(head.withColumn("total", F.sum("bytes").over(w)).withColumn("r", F.row_number().over(Window.orderBy(key))))
    chosen = placed.where((F.col("r") <= most) & ((F.col("total") <= most_bytes) | (F.col("r") == 1))).drop("r")
    last = chosen.agg(F.max(key).alias("k"), F.count(F.lit(1)).alias("n")).collect()[0]
    return chosen, last["k"] if last["n"] else after, placed.count() > last["n"]
