"""Bounded traversals: subgraphs with budgets and named axes; simple paths are in `paths`.

A request's budgets bound what it keeps, so a traversal's state is small however
large the graph: each level joins its frontier with the edges and takes, in the
canonical order (place of the node in the visit, then edge id), no more rows than
there are expansions left.  Only those rows are ordered in one window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.graph import CANDIDATE, DERIVED
from evidentia.shared import keep

OUT, IN, BOTH = "out", "in", "both"
LISTED = 1_000  # nodes of a level that are named in a filter
REASONS = ("depth", "nodes", "edges", "expansions", "output_bytes")


class Refused(ValueError):
    """A request outside the bounded profile; ``code`` says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Limits:
    """Budgets of a subgraph; the ceilings of each are fixed values."""

    depth: int = 4
    nodes: int = 256
    edges: int = 1024
    expansions: int = 100_000
    output_bytes: int = 1_048_576

    def check(self) -> None:
        bounds = {"depth": (0, 64), "nodes": (1, 16_384), "edges": (1, 100_000), "expansions": (1, 1_000_000), "output_bytes": (1, 8_388_608)}
        if any(not low <= getattr(self, name) <= high for name, (low, high) in bounds.items()):
            raise Refused("budget_out_of_range")


@dataclass
class Subgraph:
    """nodes: node_id, depth, discovery_edge; edges: the admitted ones, also between visited nodes."""

    nodes: DataFrame
    edges: DataFrame
    expansions: int
    truncations: list[str] = field(default_factory=list)

    def state(self, folded: str) -> str:
        """The query's state, given what the coverage of its relations folds to."""
        return "truncated" if self.truncations else folded

    def with_reasons(self) -> DataFrame:
        return self.nodes.select("node_id", "depth", "discovery_edge", F.lit(",".join(self.truncations)).alias("truncations"))


def turned(direction: str) -> str:
    return {OUT: IN, IN: OUT, BOTH: BOTH}[direction]


def hops_of(edges: DataFrame, directions: Mapping[str, str], ceiling: int) -> DataFrame:
    """Each admitted edge at the node it may be followed from; the edge itself is not rewritten, a self-loop counts once."""
    way = F.create_map(*[F.lit(x) for pair in directions.items() for x in pair])
    mine = edges.where(F.col("relation").isin(*directions) & (F.col("confidence") <= ceiling)).select("edge_id", "src", "dst", "relation", "confidence", way[F.col("relation")].alias("way"))
    out = mine.where(F.col("way") != IN).withColumn("at", F.col("src")).withColumn("to", F.col("dst"))
    back = mine.where((F.col("way") == IN) | ((F.col("way") == BOTH) & (F.col("src") != F.col("dst")))).withColumn("at", F.col("dst")).withColumn("to", F.col("src"))
    return out.unionByName(back).drop("way")


def size_of(*columns: str) -> Column:
    """Bytes of a row in the output, as text."""
    return sum((F.octet_length(F.col(c).cast("string")) for c in columns), F.lit(0))


def subgraph(nodes: DataFrame, edges: DataFrame, roots: Sequence[str], directions: Mapping[str, str], limits: Limits | None = None, ceiling: int = CANDIDATE) -> Subgraph:
    """Breadth-first from the roots in id order, each node's edges in id order, until a budget is spent.

    ``directions`` gives each admitted relation its own direction.  Edges to nodes that
    are already known count as well; a node beyond the depth is a ``depth`` truncation
    and does not stop the others, every other budget stops the traversal where it is
    reached.  The bytes of a node are those of its id, the bytes of an edge those of its
    id, ends and relation.
    """
    limits = limits or Limits()
    limits.check()
    roots = sorted(roots)
    if not roots or len(set(roots)) < len(roots) or len(roots) > min(64, limits.nodes) or not directions:
        raise Refused("query_invalid")
    spark = edges.sparkSession
    known = nodes.where(F.col("node_id").isin(*roots)).select("node_id").collect()  # at most 64
    if len(known) < len(roots):
        raise Refused("root_absent")
    used = sum(len(r.encode()) for r in roots)
    if used > limits.output_bytes:
        raise Refused("budget_too_small_for_roots")
    level = spark.createDataFrame([(r, 0, None, i) for i, r in enumerate(roots)], "node_id string, depth int, discovery_edge string, place long")
    hops = hops_of(edges, directions, ceiling)
    seen, kept = level, spark.createDataFrame([], "edge_id string, src string, dst string, relation string, confidence int")
    n_nodes, n_edges, left, truncations = len(roots), 0, limits.expansions, set()
    everything = Window.orderBy("place", "edge_id")  # over no more rows than there are expansions left
    for depth in range(limits.depth + 1):
        if not left:  # spent exactly: only a further edge makes it a truncation
            if not level.join(hops, level.node_id == hops.at).isEmpty():
                truncations.add("expansions")
            break
        front = [r["node_id"] for r in level.select("node_id").limit(LISTED + 1).collect()]
        near = hops.where(F.col("at").isin(*front)) if len(front) <= LISTED else hops  # a filter goes below what makes the edges
        step = level.select(F.col("node_id").alias("at"), "place").join(near, "at").orderBy("place", "edge_id").limit(left + 1)
        step = step.join(seen.select(F.col("node_id").alias("to"), F.lit(True).alias("old")), "to", "left").join(kept.select("edge_id", F.lit(True).alias("had")), "edge_id", "left")
        step = step.withColumn("r", F.row_number().over(everything))
        first_edge = F.row_number().over(Window.partitionBy("edge_id").orderBy("r")) == 1
        step = step.withColumn("counts", F.col("had").isNull() & first_edge & (F.col("old").isNotNull() | F.lit(depth < limits.depth)))
        first_node = F.row_number().over(Window.partitionBy("to").orderBy(F.desc("counts"), "r")) == 1
        step = step.withColumn("fresh", F.col("counts") & F.col("old").isNull() & first_node)
        upto = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        size = F.when(F.col("counts"), size_of("edge_id", "src", "dst", "relation")).otherwise(0) + F.when(F.col("fresh"), size_of("to")).otherwise(0)
        step = step.withColumn("edges", F.sum(F.col("counts").cast("int")).over(upto)).withColumn("nodes", F.sum(F.col("fresh").cast("int")).over(upto)).withColumn("bytes", F.sum(size).over(upto))
        reason = (
            F.when(F.col("r") > left, "expansions")
            .when(F.col("counts") & (F.col("edges") > limits.edges - n_edges), "edges")
            .when(F.col("fresh") & (F.col("nodes") > limits.nodes - n_nodes), "nodes")
            .when(F.col("counts") & (F.col("bytes") > limits.output_bytes - used), "output_bytes")
        )
        step = keep(step.withColumn("reason", reason))
        stop = step.where("reason is not null").orderBy("r").limit(1).collect()
        read = step.where(F.col("r") < stop[0]["r"]) if stop else step
        told = read.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("edges"), F.lit(0)).alias("edges"), F.coalesce(F.max("nodes"), F.lit(0)).alias("nodes"), F.coalesce(F.max("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.bool_or(F.col("old").isNull() & F.col("had").isNull() & ~F.col("counts")), F.lit(False)).alias("beyond")).collect()[0]
        if told["beyond"] and depth == limits.depth:
            truncations.add("depth")
        left, n_edges, n_nodes, used = left - told["n"], n_edges + told["edges"], n_nodes + told["nodes"], used + told["bytes"]
        kept = kept.unionByName(read.where("counts").select(*kept.columns))
        level = read.where("fresh").select(F.col("to").alias("node_id"), F.lit(depth + 1).alias("depth"), F.col("edge_id").alias("discovery_edge"), F.col("r").cast("long").alias("place"))
        seen = seen.unionByName(level)
        if stop:
            truncations.add(stop[0]["reason"])
            break
        if not told["nodes"]:
            break
    return Subgraph(seen.drop("place"), kept, limits.expansions - left, [r for r in REASONS if r in truncations])


MULTI_PARENT, NETWORK = "multi_parent", "directed_network"
# fixed values: each axis' relations and the direction that is forward on it; lexical containment has no reviewed recipe
AXES: dict[str, dict[str, str]] = {
    "object": {"parent_of": OUT},
    "ownership": {"owns": OUT},
    "load": {"loads": OUT, "depends_on": IN},
    "inheritance": {"inherits": IN, "mixes_in": IN},
    "registration": {r: OUT for r in ("registers_native_event", "handles_native_event", "bridges_native_event", "emits_custom_signal", "handles_custom_signal", "registers_cvar_callback", "sets_script", "hooks_script", "secure_hooks_function")},
    "lifecycle": {"factory_creates": OUT, "instantiates": OUT},
    "state": {"reads_state": OUT, "writes_state": OUT},
    "call": {"calls": OUT},
}
LOAD_EXTENDED = {"loads": OUT, "depends_on": IN, "loads_before": OUT, "optional_depends_on": IN}
PARENTAL = frozenset({"ownership", "inheritance", "object"})


@dataclass(frozen=True)
class Axis:
    """An axis bound to a registry: definition ids with their stored relation and forward direction."""

    name: str
    shape: str
    relations: tuple[tuple[str, str, str], ...]

    @classmethod
    def bind(cls, registry: Mapping[str, str], name: str) -> Axis:
        """``registry``: definition id -> stored relation.  A relation that the axis needs must have exactly one definition."""
        kinds = list(registry.values())
        recipe = LOAD_EXTENDED if name == "load" and {"loads_before", "optional_depends_on"} & set(kinds) else AXES.get(name)
        if recipe is None or any(kinds.count(r) == 0 for r in recipe):
            raise Refused("axis_unsupported")
        if any(kinds.count(r) > 1 for r in recipe):
            raise Refused("axis_profile_invalid")
        ids = {relation: definition for definition, relation in registry.items()}
        return cls(name, MULTI_PARENT if name in PARENTAL else NETWORK, tuple(sorted((ids[r], r, way) for r, way in recipe.items())))

    def directions(self, traversal: str) -> dict[str, str]:
        """Direction of each stored relation under forward, reverse, both, parents or children."""
        if traversal in ("parents", "children") and self.shape != MULTI_PARENT:
            raise Refused("query_invalid")
        if traversal == "both":
            return {r: BOTH for _, r, _ in self.relations}
        return {r: way if traversal in ("forward", "children") else turned(way) for _, r, way in self.relations}


def axis_definitions(definitions: DataFrame) -> DataFrame:
    """(axis, definition, relation, forward, state) of every axis over a table of definitions (definition, relation).

    An axis is unsupported where one of its relations has no definition (one row without
    one), and its profile is invalid where one has several.  The load axis is the extended
    one where either relation of the extension is defined.
    """
    spark = definitions.sparkSession
    rows = [(axis, r, way, False) for axis, recipe in AXES.items() for r, way in recipe.items()] + [("load", r, way, True) for r, way in LOAD_EXTENDED.items()]
    recipes = spark.createDataFrame(rows, "axis string, relation string, forward string, extended boolean")  # fixed values
    known = definitions.groupBy("relation").agg(F.count_distinct("definition").alias("n"), F.min("definition").alias("definition"))
    extended = known.agg(F.coalesce(F.bool_or(F.col("relation").isin(*sorted(set(LOAD_EXTENDED) - set(AXES["load"])))), F.lit(False)).alias("has"))  # one row
    mine = recipes.join(F.broadcast(extended)).where((F.col("axis") != "load") | (F.col("extended") == F.col("has"))).join(known, "relation", "left")
    per_axis = mine.groupBy("axis").agg(F.when(F.bool_or(F.col("n").isNull()), "axis_unsupported").when(F.bool_or(F.col("n") > 1), "axis_profile_invalid").otherwise("accepted").alias("state"))
    return mine.join(per_axis, "axis").select("axis", F.when(F.col("state") == "accepted", F.col("definition")).alias("definition"), "relation", "forward", "state")


def axis_states(definitions: DataFrame) -> DataFrame:
    """(axis, forward, parents): whether each axis can be followed, and whether one level of parents can be asked for, which takes an axis on which a node may have several."""
    told = axis_definitions(definitions).select("axis", "state").distinct()
    return told.select("axis", F.col("state").alias("forward"), F.when((F.col("state") == "accepted") & ~F.col("axis").isin(*sorted(PARENTAL)), "query_invalid").otherwise(F.col("state")).alias("parents"))


def along(axis: Axis, nodes: DataFrame, edges: DataFrame, roots: Sequence[str], traversal: str, limits: Limits | None = None, ceiling: int = DERIVED) -> Subgraph:
    """The subgraph along an axis; parents and children are one level of an axis on which a node may have several parents."""
    limits = limits or Limits(depth=1 if traversal in ("parents", "children") else Limits.depth)
    if traversal in ("parents", "children") and limits.depth != 1:
        raise Refused("query_invalid")
    return subgraph(nodes, edges, roots, axis.directions(traversal), limits, ceiling)


def by_definition(edges: DataFrame, accepted: DataFrame, definitions: Sequence[str]) -> DataFrame:
    """Edges that some accepted assertion (edge_id, definition) gives under one of these definitions, with those that do: definitions may share a stored relation, which alone does not tell them apart."""
    named = accepted.where(F.col("definition").isin(*definitions)).groupBy("edge_id").agg(F.array_sort(F.collect_set("definition")).alias("definitions"))
    return edges.join(named, "edge_id")
