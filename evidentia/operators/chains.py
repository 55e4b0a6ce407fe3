"""Chains in which each node names at most one next: where they end, what they add up to, and which are cycles.

Pointers are doubled: after a round every node knows what lies twice as many steps ahead,
so a chain of n nodes takes log2 n rounds of one self-join, whatever its length; there is
no bound on depth.  Chains that end become shorter by a round's steps or drop out; once a
round ends none, what is left can only go round in cycles, as a longer chain would hold a
node that had ended.  Nodes on a cycle are what is still pointed at when a doubling no
longer makes fewer of them, and a cycle is named by its least node.

Cases: a null node takes no part; several rows of one node are an error of the caller's
(the least next counts); a node that names itself is a cycle of one; a next that is no
node ends its chain outside; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.shared import keep

ENDED, OUTSIDE, CYCLE = "ended", "outside", "cycle"


def ends(links: DataFrame) -> DataFrame:
    """(node, state, end, total, steps) of links (node, next, weight): the last node that the chain reaches, the sum of the weights of all its nodes and how many follow the first.

    ended: the last node names no next; outside: the name that no node has is the end, and its weight isn't known; cycle: there is neither.
    """
    nodes = links.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.col("next").isNull().alias("none"), "next", "weight")).alias("l"))
    nodes = nodes.select("node", F.col("l.next").alias("next"), F.coalesce(F.col("l.weight").cast("long"), F.lit(0)).alias("weight"))
    known = nodes.select(F.col("node").alias("next"), F.lit(True).alias("known"))
    # ahead: the node that the pointer shows and has not counted yet
    first = nodes.join(known, "next", "left").select(
        "node",
        F.when(F.col("next").isNull(), ENDED).when(F.col("known").isNull(), OUTSIDE).alias("state"),
        F.when(F.col("next").isNull(), F.col("node")).otherwise(F.col("next")).alias("at"),
        F.col("weight").alias("total"),
        F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"),
    )
    table = keep(first)
    open_ = table.where("state IS NULL").count()
    while open_:
        ahead = table.select(F.col("node").alias("at"), F.col("state").alias("then"), F.col("at").alias("beyond"), F.col("total").alias("more"), F.col("steps").alias("further"))
        moved = table.where("state IS NULL").join(ahead, "at").select("node", F.col("then").alias("state"), F.col("beyond").alias("at"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("further")).alias("steps"))
        table = keep(table.where("state IS NOT NULL").unionByName(moved))
        left = table.where("state IS NULL").count()
        if left == open_:
            break
        open_ = left
    cyclic = F.col("state").isNull()
    return table.select("node", F.coalesce("state", F.lit(CYCLE)).alias("state"), F.when(~cyclic, F.col("at")).alias("end"), F.when(~cyclic, F.col("total")).alias("total"), F.when(~cyclic, F.col("steps")).alias("steps"))


def cycles(links: DataFrame) -> DataFrame:
    """(cycle, members) of links (node, next): the least node of each cycle and the number of nodes on it."""
    on = members(links)
    return on.groupBy("cycle").agg(F.count(F.lit(1)).alias("members"))


def members(links: DataFrame) -> DataFrame:
    """(node, cycle) of every node that lies on a cycle."""
    weighted = links.select("node", "next", F.lit(0).alias("weight"))
    round_ = ends(weighted).where(F.col("state") == CYCLE).select("node")
    hop = keep(weighted.join(round_, "node", "left_semi").groupBy("node").agg(F.min("next").alias("at")))
    images = hop.select("at").distinct().count()
    while True:  # what is 2^k steps ahead of anything
        hop2 = keep(hop.join(hop.select(F.col("node").alias("at"), F.col("at").alias("beyond")), "at").select("node", F.col("beyond").alias("at")))
        fewer = hop2.select("at").distinct().count()
        hop = hop2
        if fewer == images:
            break
        images = fewer
    on = keep(hop.select(F.col("at").alias("node")).distinct())
    step = weighted.join(on, "node", "left_semi").groupBy("node").agg(F.min("next").alias("at"))
    table = keep(step.select("node", "at", F.least("node", "at").alias("least")))
    while True:
        ahead = table.select(F.col("node").alias("at"), F.col("at").alias("beyond"), F.col("least").alias("other"))
        moved = keep(table.join(ahead, "at").select("node", F.col("beyond").alias("at"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("changed")))
        if moved.where("changed").isEmpty():
            return moved.select("node", F.col("least").alias("cycle"))
        table = moved.drop("changed")
