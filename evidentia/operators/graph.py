"""Property-graph operators over nodes(node_id, kind, ...) and edges(edge_id, src, dst, relation, confidence).

Confidence and coverage states are ranks; larger is weaker or worse.  Coverage is
a small table of relations; whatever is read from it is one row for each relation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.shared import keep

COMPLETE, NOT_EVALUATED, PARTIAL, FAILED, TRUNCATED = range(5)
STATES = ("complete", "not_evaluated", "partial", "failed", "truncated")
PROVEN, DERIVED, POSSIBLE, CANDIDATE = range(4)


def state_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATES)), rank.cast("int") + 1)


def fold_states(coverage: DataFrame, relations: Sequence[str]) -> DataFrame:
    """One row: the state of a query over these relations (truncated > partial or failed > not evaluated or missing > complete) and whether its absence is authoritative."""
    mine = coverage.where(F.col("relation").isin(*relations))
    has = lambda *s: F.coalesce(F.bool_or(F.col("state").isin(*s)), F.lit(False))
    missing = F.count_distinct("relation") < len(set(relations))
    state = F.when(has(TRUNCATED), "truncated").when(has(PARTIAL, FAILED), "partial").when(has(NOT_EVALUATED) | missing, "not_evaluated").otherwise("complete")
    return mine.agg(state.alias("state"), ((state == "complete") & F.coalesce(F.bool_and("authority"), F.lit(False))).alias("absence_authoritative"))


def exact(nodes: DataFrame, node_ids: DataFrame) -> DataFrame:
    """found, or not_found_with_partial_coverage: a missing id is never proof of absence."""
    found = node_ids.join(nodes.select("node_id", "kind"), "node_id", "left")
    return found.select("node_id", "kind", F.when(F.col("kind").isNotNull(), "found").otherwise("not_found_with_partial_coverage").alias("outcome"))


def incident(edges: DataFrame, direction: str) -> DataFrame:
    """edge rows with the node they are seen from (at) and the one they lead to (to); a self-loop counts once."""
    out = edges.withColumn("at", F.col("src")).withColumn("to", F.col("dst"))
    back = edges.withColumn("at", F.col("dst")).withColumn("to", F.col("src"))
    if direction == "out":
        return out
    return back if direction == "in" else out.unionByName(back.where("src <> dst"))


def neighbors(edges: DataFrame, queries: DataFrame | Sequence[str], relations: Sequence[str], direction: str = "out", most: int = 10_000, ceiling: int = CANDIDATE) -> DataFrame:
    """Edges at each queried node in edge-id order, at most ``most`` a node, with how many matched: all queries in one pass over the edges.

    Ids that the request itself lists become a filter, which Catalyst takes below whatever
    makes the edges, so that only their rows are aggregated; a table of queries is joined.
    """
    listed = not isinstance(queries, DataFrame)
    seen = incident(edges.where(F.col("relation").isin(*relations)), direction)
    by_query = Window.partitionBy("at").orderBy("edge_id")
    rows = seen.where(F.col("at").isin(*queries)) if listed else seen.join(queries.select(F.col("node_id").alias("at")).distinct(), "at")
    rows = rows.where(F.col("confidence") <= ceiling)
    # counts by partial aggregation, and a rank that Spark limits before the shuffle: a hub's edges don't meet in one task
    kept = rows.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= most)
    matched = rows.groupBy("at").agg(F.count(F.lit(1)).alias("matched"))
    return kept.join(matched, "at").withColumn("truncated", F.col("matched") > most)


def counted_neighbors(edges: DataFrame, ids: Sequence[str], relations: Sequence[str], direction: str = "out", ceiling: int = CANDIDATE, most: int = 10_000, most_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Edges (node_id, edge_id, bytes) at the listed nodes in edge-id order within both budgets, and of each node how many were scanned, matched and omitted, and why: edges, output_bytes or nothing.

    The budgets hold for each node; the first edge that would break one ends its list.
    An edge costs the bytes of its id, ends and relation.
    """
    asked = edges.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "node_id string")
    at = incident(edges, direction).where(F.col("at").isin(*ids)).select(F.col("at").alias("node_id"), "edge_id", "relation", "confidence", F.octet_length(F.concat("edge_id", "src", "dst", "relation")).cast("long").alias("cost"))
    fits = F.col("relation").isin(*relations) & (F.col("confidence") <= ceiling)
    ranked = at.where(fits).withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy("edge_id"))).where(F.col("rank") <= most + 1)
    spent = F.sum("cost").over(Window.partitionBy("node_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))  # over at most ``most`` + 1 rows a node
    kept = ranked.withColumn("bytes", spent).where((F.col("rank") <= most) & (F.col("bytes") <= most_bytes)).select("node_id", "edge_id", "bytes")
    totals = at.groupBy("node_id").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(fits).alias("matched"))
    given = kept.groupBy("node_id").agg(F.count(F.lit(1)).alias("given"))
    rows = asked.join(totals, "node_id", "left").join(given, "node_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    omitted = n("matched") - n("given")
    reason = F.when(omitted == 0, "").when(n("given") == most, "edges").otherwise("output_bytes")
    return kept, rows.select("node_id", n("scanned").alias("scanned"), n("matched").alias("matched"), omitted.alias("omitted"), reason.alias("reason"))


NAMED = 1_000  # nodes of a level that are named in a filter


def subgraph(edges: DataFrame, roots: DataFrame, relations: Sequence[str], direction: str = "out", depth: int = 4) -> DataFrame:
    """(node_id, depth, edge_id): shortest depth from any root, and the edge that discovers the node first.

    Roots are visited in id order, then level by level: the discovering edge of a
    node is the smallest by (place of its parent in the previous level, edge id),
    and a level's places follow that order.  Places are dense ranks of that order
    within the level, so no level is gathered in one task.
    """
    hops = incident(edges.where(F.col("relation").isin(*relations)), direction).select("at", "to", "edge_id")
    kept: DataFrame | None = None  # all of them, once a level is too large to be named
    level = keep(roots.select("node_id").distinct().select("node_id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("edge_id"), F.col("node_id").alias("place")))
    seen = level
    for d in range(1, depth + 1):
        front = [r["node_id"] for r in level.select("node_id").limit(NAMED + 1).collect()]
        if len(front) > NAMED and kept is None:
            kept = keep(hops)
        near = kept if kept is not None else hops.where(F.col("at").isin(*front))  # a filter goes below what makes the edges
        step = level.join(near, level.node_id == near.at).select(F.col("to").alias("node_id"), F.concat_ws("\x01", "place", near.edge_id).alias("place"), near.edge_id.alias("edge_id"))
        fresh = step.join(seen.select("node_id"), "node_id", "left_anti").groupBy("node_id").agg(F.min(F.struct("place", "edge_id")).alias("m"))
        level = keep(fresh.select("node_id", F.lit(d).alias("depth"), F.col("m.edge_id").alias("edge_id"), F.col("m.place").alias("place")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.select("node_id", "depth", "edge_id")


def reachable(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes that (src, dst) edges reach from the roots, roots included, with the shortest depth."""
    seen = level = keep(roots.select("node_id").distinct().withColumn("depth", F.lit(0)))
    pairs = keep(edges.select("src", "dst").distinct())
    d = 0
    while depth is None or d < depth:
        d += 1
        level = keep(level.join(pairs, level.node_id == pairs.src).select(F.col("dst").alias("node_id")).distinct().join(seen.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


SMALL = 100_000  # edges of a graph that one task walks


def walk_components(pairs: pa.Table) -> pa.Table:
    """Components of a small graph by one depth-first walk, without recursion."""
    after: dict = {}
    for u, v in zip(pairs.column("src").to_pylist(), pairs.column("dst").to_pylist(), strict=True):
        after.setdefault(u, []).append(v)
        after.setdefault(v, [])
    number: dict = {}
    low: dict = {}
    open_nodes, component = [], {}
    for start in after:
        if start in number:
            continue
        trail = [(start, iter(after[start]))]
        number[start] = low[start] = len(number)
        open_nodes.append(start)
        while trail:
            node, rest = trail[-1]
            for child in rest:
                if child not in number:
                    number[child] = low[child] = len(number)
                    open_nodes.append(child)
                    trail.append((child, iter(after[child])))
                    break
                if child not in component:
                    low[node] = min(low[node], number[child])
            else:
                trail.pop()
                if trail:
                    low[trail[-1][0]] = min(low[trail[-1][0]], low[node])
                if low[node] == number[node]:
                    own = [open_nodes.pop()]
                    while own[-1] != node:
                        own.append(open_nodes.pop())
                    component |= dict.fromkeys(own, min(own))
    return pa.table({"node_id": list(component), "component": list(component.values())})


def spread_least(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Give each node the least label among its own and those of nodes that reach it, by rounds over the nodes that changed."""
    labels = moved = keep(labels)
    while not moved.isEmpty():
        told = moved.select(F.col("node_id").alias("src"), "label").join(pairs, "src").groupBy(F.col("dst").alias("node_id")).agg(F.min("label").alias("new"))
        both = labels.join(told, "node_id", "left")
        after = keep(both.select("node_id", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("moved")))
        moved, labels = after.where("moved").select("node_id", "label"), after.select("node_id", "label")
    return labels


def strong_components(edges: DataFrame, nodes: DataFrame, small: int | None = None) -> DataFrame:
    """(node_id, component): the smallest node that reaches it and is reached by it.

    By colours, in tables no larger than the edges: nodes without an edge in or out of
    what is left are components of their own and go; each other node takes the least
    node that reaches it as its colour; what reaches a colour's own node within the
    colour is its component and goes as well.  That takes rounds, so up to ``small`` edges
    (SMALL by default) are walked in one task instead.
    """
    pairs = keep(edges.where("src <> dst").select("src", "dst").distinct())
    if pairs.count() <= (SMALL if small is None else small):
        key = pairs.schema["src"].dataType.simpleString()
        found = pairs.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(walk_components, f"node_id {key}, component {key}")
        return nodes.select("node_id").distinct().join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))
    ends = lambda p: (p.select(F.col(c).alias("node_id")) for c in ("src", "dst"))
    live, done = nodes.select("node_id").unionByName(reduce(DataFrame.unionByName, ends(pairs))).distinct(), []

    def among(some: DataFrame) -> DataFrame:
        return keep(pairs.join(some.select(F.col("node_id").alias("src")), "src", "left_semi").join(some.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst"))

    while True:
        core = keep(reduce(DataFrame.intersect, ends(pairs)))
        done.append(keep(live.join(core, "node_id", "left_anti").withColumn("component", F.col("node_id"))))
        if core.isEmpty():
            break
        pairs = among(core)
        colour = spread_least(pairs, core.withColumn("label", F.col("node_id")))
        by = lambda c, name: colour.select(F.col("node_id").alias(c), F.col("label").alias(name))  # noqa: B023, E731
        same = pairs.join(by("src", "a"), "src").join(by("dst", "b"), "dst").where("a = b")
        found = reachable(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node_id = label"))
        found = keep(found.select("node_id").join(colour, "node_id").select("node_id", F.col("label").alias("component")))
        done.append(found)
        live = keep(core.join(found.select("node_id"), "node_id", "left_anti"))
        pairs = among(live)
    return nodes.select("node_id").distinct().join(reduce(DataFrame.unionByName, done), "node_id")


def evidence_union(rows: DataFrame, key: str, attributes: Sequence[str], evidence: str) -> DataFrame:
    """Merge rows of one key: evidence united; ``conflict`` where attributes differ."""
    same = F.count_distinct(F.struct(*attributes))
    return rows.groupBy(key).agg(F.array_sort(F.flatten(F.collect_set(evidence))).alias("all"), *[F.min(a).alias(a) for a in attributes], (same > 1).alias("conflict")).withColumn(evidence, F.array_distinct("all")).drop("all")


def rebind(addresses: DataFrame, partitions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(address, node_id, state) of producer addresses (address, producer, generation, kind, local_key) among published nodes (producer, kind, local_key, node_id) of partitions (producer, generation).

    bound, stale (the producer has another generation now), unknown_producer,
    unpublished (nothing under that key) or ambiguous (several nodes).
    """
    own = nodes.groupBy("producer", "kind", "local_key").agg(F.min("node_id").alias("node"), F.count_distinct("node_id").alias("n"))
    rows = addresses.join(partitions.select("producer", F.col("generation").alias("now")), "producer", "left").join(own, ["producer", "kind", "local_key"], "left")
    state = F.when(F.col("now").isNull(), "unknown_producer").when(F.col("now") != F.col("generation"), "stale").when(F.col("n").isNull(), "unpublished").when(F.col("n") > 1, "ambiguous").otherwise("bound")
    return rows.withColumn("state", state).select("address", F.when(F.col("state") == "bound", F.col("node")).alias("node_id"), "state")


def descriptor_of(fields: Sequence[str]) -> Column:
    """Digest of exactly these fields, each preceded by its length; null is its own value."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.coalesce(F.length(F.col(f).cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]), 256)


def navigate_back(asked: DataFrame, sources: DataFrame, fields: Sequence[str], most: int) -> DataFrame:
    """(descriptor, source_id, place, more): of each distinct descriptor that is asked for (fields) the first ``most`` sources (source_id, fields) with exactly the same one, by id, and whether there are more."""
    wanted = asked.select(descriptor_of(fields).alias("descriptor")).distinct()
    mine = sources.select("source_id", descriptor_of(fields).alias("descriptor")).join(wanted, "descriptor", "left_semi")
    n = mine.groupBy("descriptor").agg((F.count(F.lit(1)) > most).alias("more"))
    first = mine.withColumn("place", F.row_number().over(Window.partitionBy("descriptor").orderBy("source_id"))).where(F.col("place") <= most)  # cut before the shuffle
    return first.join(n, "descriptor").select("descriptor", "source_id", "place", "more")


def same_descriptor(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(descriptor, left_count, right_count): sources that both sides describe by exactly the same fields; overlap is not identity.

    One row for each descriptor and not for each pair, so a common one costs no product;
    who has it is a join with either side on ``descriptor``.
    """
    count = lambda df, name: df.groupBy(descriptor_of(fields).alias("descriptor")).agg(F.count(F.lit(1)).alias(name))
    return count(left, "left_count").join(count(right, "right_count"), "descriptor")


def materialize(accepted_nodes: DataFrame, accepted_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of a snapshot from what producers gave, and what is wrong.

    nodes: node_id, kind, producers, conflict (kinds differ); edges: edge_id, src, dst,
    relation, the best confidence, producers, dangling (an end is no node); problems:
    subject and what: kind_conflict or dangling_source, dangling_target.
    """
    nodes = accepted_nodes.groupBy("node_id").agg(F.min("kind").alias("kind"), F.count_distinct("producer").alias("producers"), (F.count_distinct("kind") > 1).alias("conflict"))
    edges = accepted_edges.groupBy("edge_id", "src", "dst", "relation").agg(F.min("confidence").alias("confidence"), F.count_distinct("producer").alias("producers"))
    end = lambda name: nodes.select(F.col("node_id").alias(name), F.lit(True).alias(f"has_{name}"))
    edges = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    bad = F.array_compact(F.array(F.when(F.col("has_src").isNull(), "dangling_source"), F.when(F.col("has_dst").isNull(), "dangling_target")))
    problems = edges.select(F.col("edge_id").alias("subject"), F.explode(bad).alias("what")).unionByName(nodes.where("conflict").select(F.col("node_id").alias("subject"), F.lit("kind_conflict").alias("what")))
    return nodes, edges.withColumn("dangling", F.col("has_src").isNull() | F.col("has_dst").isNull()).drop("has_src", "has_dst"), problems


def replace_partition(old: DataFrame, new: DataFrame, snapshot: str, partition: str, expected: dict[str, str], current: dict[str, str]) -> tuple[DataFrame | None, str]:
    """Coverage (relation, part_id, state, authority) after a producer's partition is replaced, or none and why: stale_snapshot or stale_partition.

    What the partition reported before and no longer reports is not evaluated, and a
    producer's own word never grants authority over absence.
    """
    if expected.get("snapshot") != current.get("snapshot") or snapshot != current.get("snapshot"):
        return None, "stale_snapshot"
    if expected.get("partition") != current.get("partition"):
        return None, "stale_partition"
    mine = F.col("part_id") == partition
    fresh = new.select("relation", F.lit(partition).alias("part_id"), "state", F.lit(False).alias("authority"))
    gone = old.where(mine).join(new.select("relation"), "relation", "left_anti").select("relation", "part_id", F.lit(NOT_EVALUATED).alias("state"), F.lit(False).alias("authority"))
    return old.where(~mine).select("relation", "part_id", "state", "authority").unionByName(fresh).unionByName(gone), "replaced"


def discovery_paths(found: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """(node_id, path, weakest) of a subgraph's nodes (node_id, depth, discovery_edge): the edge ids from the root, and the weakest confidence on the way, by walking back one edge a round."""
    e = edges.select(F.col("edge_id").alias("discovery_edge"), "src", "dst", "confidence")
    step = keep(found.where("discovery_edge is not null").join(e, "discovery_edge").select("node_id", "depth", "discovery_edge", "confidence", F.when(F.col("dst") == F.col("node_id"), F.col("src")).otherwise(F.col("dst")).alias("parent")))
    level = found.where("depth = 0").select("node_id", F.array().cast("array<string>").alias("path"), F.lit(0).alias("weakest"))
    out = level
    for d in range(1, most + 1):
        level = keep(step.where(F.col("depth") == d).join(level.withColumnRenamed("node_id", "parent"), "parent").select("node_id", F.concat("path", F.array("discovery_edge")).alias("path"), F.greatest("weakest", "confidence").alias("weakest")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def presentation_roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, state): nodes that are no one's child (root), and those on a cycle of links (parent, child), which can't be presented (cycle)."""
    pairs = links.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    size = strong_components(pairs, nodes.select("node_id"))
    ring = size.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cyclic = size.join(ring, "component").select("node_id").unionByName(links.where("parent = child").select(F.col("parent").alias("node_id"))).distinct()
    roots = nodes.select("node_id").join(links.where("parent <> child").select(F.col("child").alias("node_id")), "node_id", "left_anti").join(cyclic, "node_id", "left_anti")
    return roots.withColumn("state", F.lit("root")).unionByName(cyclic.withColumn("state", F.lit("cycle")))
