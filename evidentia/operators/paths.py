"""Simple paths between two nodes from bounded frontiers of both ends, in edge-id order, with cursors.

Suffixes that end in the target are grown backwards for up to half of the depth, as long
as a whole level fits the budget; prefixes from the root are grown for the rest.  Paths
no longer than the prefixes are found by them; longer ones are a prefix and a suffix that
meet in a node and share no other.  So neither end looks further than its levels, and
nothing is asked of the whole graph: a level's frontier filters the edges it may take.

A level of prefixes holds at most ``expansions``, the first in order; from the first
prefix that had to be left out, nothing can be said, so the paths behind it are left out as
well and the result says ``expansions``.  ``depth`` says that longer paths may exist (both
frontiers still went on), ``paths`` that there are more than ``most``.

A cursor names the last path that was returned.  It belongs to its query (both digests
are checked) and must be a path that the query admits.  What lies before it is replayed and charged:
a cursor that can't be reached within the budget is refused.

Cases: null node or edge ids are no edges; parallel edges give paths of their own; a
self-loop is on no path; edges of equal id count as one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.graph import DERIVED
from evidentia.operators.traversal import LISTED, Refused, hops_of, turned
from evidentia.shared import keep

FIRST_PREFIXES = 1_000  # that meet suffixes at once
_ROW = "node string, visited array<string>, path array<string>, weakest int"


def digest(kind: str, *parts: object) -> str:
    return hashlib.sha256(json.dumps([kind, *parts], sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Query:
    """What is asked; its digest names the query in cursors."""

    root: str
    target: str
    directions: Mapping[str, str]
    ceiling: int = DERIVED
    depth: int = 16
    most: int = 64
    expansions: int = 100_000

    def check(self) -> None:
        if self.root == self.target or not self.directions or not (1 <= self.depth <= 64 and 1 <= self.most <= 256 and 1 <= self.expansions <= 1_000_000):
            raise Refused("query_invalid")

    def digest(self) -> str:
        return digest("path-query", self.root, self.target, dict(self.directions), self.ceiling, self.depth, self.most, self.expansions)


@dataclass(frozen=True)
class Cursor:
    query: str
    after: tuple[str, ...]
    integrity: str

    @classmethod
    def of(cls, query: Query, after: Sequence[str]) -> Cursor:
        return cls(query.digest(), tuple(after), digest("path-cursor", query.digest(), list(after)))

    def check(self, query: Query, edges: DataFrame) -> None:
        """The cursor is one of this query, and its path is one that the query admits."""
        if self.query != query.digest() or not 1 <= len(self.after) <= query.depth or self.integrity != digest("path-cursor", self.query, list(self.after)):
            raise Refused("cursor_invalid")
        hops = hops_of(edges.where(F.col("edge_id").isin(*self.after)), query.directions, query.ceiling)
        ways: dict[str, set[tuple[str, str]]] = {}
        for r in hops.select("edge_id", "at", "to").distinct().limit(4 * query.depth).collect():  # two ways of each named edge at most
            ways.setdefault(r["edge_id"], set()).add((r["at"], r["to"]))
        node, seen = query.root, {query.root}
        for edge in self.after:
            node = next((to for at, to in ways.get(edge, ()) if at == node), None) if node != query.target else None
            if node is None or node in seen:
                raise Refused("cursor_invalid")
            seen.add(node)
        if node != query.target:
            raise Refused("cursor_invalid")


@dataclass
class Paths:
    """paths: path (edge ids), nodes, length, weakest, in the order of their edge ids; cursor: behind the last of them, if there are more; replayed: prefixes before the cursor that were charged."""

    paths: DataFrame
    truncations: list[str]
    cursor: Cursor | None = None
    replayed: int = 0


class Frontier:
    """Prefixes from one end, or suffixes to it, level by level."""

    def __init__(self, edges: DataFrame, node: str, directions: Mapping[str, str], ceiling: int, forward: bool):
        self.hops = hops_of(edges, directions if forward else {r: turned(w) for r, w in directions.items()}, ceiling).select("at", "to", "edge_id", "confidence").distinct()
        self.forward = forward
        self.level = edges.sparkSession.createDataFrame([(node, [node], [], 0)], _ROW)

    def step(self, stop: str) -> DataFrame:
        """The next level: rows that did not reach ``stop`` by one edge to a node that they have not visited."""
        front = self.level.where(F.col("node") != stop)
        nodes = [r["node"] for r in front.select("node").distinct().limit(LISTED + 1).collect()]
        near = self.hops.where(F.col("at").isin(*nodes)) if len(nodes) <= LISTED else self.hops  # a filter goes below what makes the edges
        rows = front.join(near, front.node == near.at).where(~F.array_contains("visited", F.col("to")))
        grown = (lambda old, new: F.concat(old, F.array(new))) if self.forward else (lambda old, new: F.concat(F.array(new), old))
        return rows.select(F.col("to").alias("node"), grown("visited", "to").alias("visited"), grown("path", "edge_id").alias("path"), F.greatest("weakest", "confidence").alias("weakest"))


def literal(path: Sequence[str]):
    return F.array(*map(F.lit, path))


def backward(query: Query, edges: DataFrame) -> tuple[DataFrame | None, int, bool]:
    """All suffixes, how many levels of them are whole, and whether the last level could go on."""
    ends, out, levels, more = Frontier(edges, query.target, query.directions, query.ceiling, forward=False), None, 0, True
    while levels < query.depth // 2:
        step = keep(ends.step(query.root).limit(query.expansions + 1))
        n = step.count()
        if n > query.expansions:
            break
        levels += 1
        if not n:
            more = False
            break
        out = step if out is None else out.unionByName(step)
        ends.level = step
    return out, levels, more


def paths(edges: DataFrame, root: str, target: str, directions: Mapping[str, str], ceiling: int = DERIVED, depth: int = 16, most: int = 64, expansions: int = 100_000, after: Sequence[str] | Cursor | None = None) -> Paths:
    """The first ``most`` paths without a repeated node, of those after the cursor (or the path that it would name)."""
    query = Query(root, target, directions, ceiling, depth, most, expansions)
    query.check()
    cursor = Cursor.of(query, after) if after is not None and not isinstance(after, Cursor) else after
    if cursor is not None:
        cursor.check(query, edges)
    behind = list(cursor.after) if cursor is not None else None
    suffixes, whole, suffixes_go_on = backward(query, edges)
    ahead, replayed, done, lost, truncations = Frontier(edges, root, directions, ceiling, forward=True), 0, None, None, set()
    reach = depth - whole  # levels of prefixes; longer paths are met by suffixes
    alive = True
    for d in range(1, reach + 1):
        step = ahead.step(target)
        if behind is not None:
            step = keep(step)
            replayed += step.where(F.col("path") < literal(behind[:d])).limit(expansions + 1).count() + (d <= len(behind))
            if replayed > expansions:
                raise Refused("cursor_not_reached")
            step = step.where(F.col("path") >= literal(behind[:d]))  # prefixes whose paths all come before the cursor go
        room = expansions - replayed
        first = keep(step.orderBy("path").limit(room + 1))
        if first.count() > room:
            over = first.orderBy(F.desc("path")).limit(1).collect()[0]["path"]
            lost = over if lost is None else min(lost, over)
            truncations.add("expansions")
        if lost is not None:
            first = first.where(F.col("path") < literal(lost))
        ahead.level = first
        found = first.where(F.col("node") == target)
        done = found if done is None else done.unionByName(found)
        if first.where(F.col("node") != target).isEmpty():
            alive = False
            break
    within = lambda df: df.where((F.col("path") > literal(behind)) if behind is not None else F.lit(True)).where((F.col("path") < literal(lost)) if lost is not None else F.lit(True))
    done = keep(within(done).orderBy("path").limit(most + 1))
    if alive:
        if suffixes_go_on:
            truncations.add("depth")
        if suffixes is not None:
            done = meet(ahead.level.where(F.col("node") != target), suffixes, done, within, most)
    best = done.orderBy("path").limit(most + 1)
    best = keep(best)
    more = best.count() > most
    if more:
        truncations.add("paths")
        truncations.discard("expansions")  # all that was asked for is there
    chosen = best.orderBy("path").limit(most).select("path", F.col("visited").alias("nodes"), F.size("path").alias("length"), "weakest")
    last = chosen.orderBy(F.desc("path")).limit(1).collect() if more else []
    return Paths(chosen, sorted(truncations), Cursor.of(query, last[0]["path"]) if last else None, replayed)


def meet(prefixes: DataFrame, suffixes: DataFrame, done: DataFrame, within, most: int) -> DataFrame:
    """The first paths of ``done`` and of prefixes with suffixes; prefixes are taken in order, a stretch at a time, until none behind can come before what is there."""
    tails = suffixes.select(F.element_at("visited", 1).alias("node"), F.slice("visited", 2, 1 << 20).alias("rest"), F.col("path").alias("tail"), F.col("weakest").alias("other"))
    start, size = None, FIRST_PREFIXES
    while True:
        left = prefixes if start is None else prefixes.where(F.col("path") > literal(start))
        stretch = keep(left.orderBy("path").limit(size))
        last = stretch.orderBy(F.desc("path")).limit(1).collect()
        if not last:
            return done
        joined = stretch.join(tails, "node").where(~F.arrays_overlap("visited", "rest"))
        joined = joined.select(F.element_at("rest", -1).alias("node"), F.concat("visited", "rest").alias("visited"), F.concat("path", "tail").alias("path"), F.greatest("weakest", "other").alias("weakest"))
        done = keep(within(done.unionByName(joined)).orderBy("path").limit(most + 1))
        start, size = last[0]["path"], 4 * size
        if done.count() > most and done.orderBy(F.desc("path")).limit(1).collect()[0]["path"][: len(start)] <= start:
            return done
