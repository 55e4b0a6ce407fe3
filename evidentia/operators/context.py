"""Context around roots: maps with explanations, frontiers, skeletons, and packs that say why each item is in or out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.graph import incident


class Refused(ValueError):
    """A request that breaks the contract; ``code`` says how."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def around(nodes: DataFrame, edges: DataFrame, roots: DataFrame, relations: Sequence[str]) -> DataFrame:
    """(root, adjacent, kind, edge_id, relation, confidence, direction): direct neighbours in both directions at every confidence; to be read in the order of (adjacent, edge_id)."""
    seen = incident(edges.where(F.col("relation").isin(*relations)), "both").join(roots.select(F.col("node_id").alias("at")).distinct(), "at", "left_semi")
    kinds = nodes.select(F.col("node_id").alias("to"), "kind")
    direction = F.when(F.col("src") == F.col("dst"), "self").when(F.col("at") == F.col("src"), "out").otherwise("in")
    return seen.join(kinds, "to", "left").select(F.col("at").alias("root"), F.col("to").alias("adjacent"), "kind", "edge_id", "relation", "confidence", direction.alias("direction"))


def explain(edge_ids: DataFrame, supports: DataFrame, coverage: DataFrame, derivations: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(edge_id, section, id, detail): every producer's support of an edge, coverage of its relation by partition, derivations that give it, conflicts it takes part in, and a boundary where nothing supports it."""
    asked = edge_ids.select("edge_id", "relation").distinct()
    row = lambda df, section, i, detail: df.select("edge_id", F.lit(section).alias("section"), F.col(i).cast("string").alias("id"), F.col(detail).cast("string").alias("detail"))
    own = asked.join(supports, "edge_id")
    out = row(own, "support", "producer", "evidence")
    out = out.unionByName(row(asked.join(coverage, "relation"), "coverage", "part_id", "state"))
    out = out.unionByName(row(asked.join(derivations.withColumnRenamed("output", "edge_id"), "edge_id"), "derivation", "rule", "input"))
    out = out.unionByName(row(asked.join(conflicts.withColumnRenamed("subject", "edge_id"), "edge_id"), "conflict", "kind", "participants"))
    bare = asked.join(own.select("edge_id"), "edge_id", "left_anti").withColumn("nothing", F.lit("no_support"))
    return out.unionByName(row(bare, "boundary", "nothing", "relation"))


def expand(edges: DataFrame, frontier: Sequence[str], known: DataFrame, queried: DataFrame, relations: Sequence[str], round_no: int, most_rounds: int = 16, most_roots: int = 32) -> DataFrame:
    """(node_id, edge_id, parent, round): neighbours of a frontier that the caller chose among what earlier rounds gave.

    Refused: too many roots, unsorted or repeated ones, one that no earlier round gave,
    one that was queried before, or a round beyond the last.
    """
    if round_no > most_rounds:
        raise Refused("rounds_exhausted")
    if not frontier or len(frontier) > most_roots:
        raise Refused("frontier_size")
    if list(frontier) != sorted(set(frontier)):
        raise Refused("frontier_order")
    asked = known.sparkSession.createDataFrame([(f,) for f in frontier], "node_id string")
    if not asked.join(known.select("node_id"), "node_id", "left_anti").isEmpty():
        raise Refused("frontier_unknown")
    if not asked.join(queried.select("node_id"), "node_id", "left_semi").isEmpty():
        raise Refused("frontier_queried")
    steps = incident(edges.where(F.col("relation").isin(*relations)), "out").join(F.broadcast(asked.withColumnRenamed("node_id", "at")), "at")  # at most most_roots rows
    fresh = steps.join(known.select(F.col("node_id").alias("to")), "to", "left_anti")
    first = fresh.groupBy(F.col("to").alias("node_id")).agg(F.min(F.struct("edge_id", F.col("at").alias("parent"))).alias("m"))
    return first.select("node_id", F.col("m.edge_id").alias("edge_id"), F.col("m.parent").alias("parent"), F.lit(round_no).alias("round"))


def skeleton(declarations: DataFrame, level: int) -> DataFrame:
    """(owner, line) by position of declarations (owner, position, name, signature, doc, public): level 0 names public ones, level 1 all with signatures, and of each owner how many stay out."""
    shown = F.col("public") if level == 0 else F.lit(True)
    line = F.col("name") if level == 0 else F.concat("name", F.coalesce("signature", F.lit("")))
    rows = declarations.where(shown).select("owner", F.col("position").cast("long").alias("position"), line.alias("line"))
    out = declarations.groupBy("owner").agg(F.sum(F.when(shown, 0).otherwise(1)).alias("n")).where("n > 0")
    return rows.unionByName(out.select("owner", F.lit(None).cast("long").alias("position"), F.concat(F.lit("... "), "n", F.lit(" more")).alias("line")))


def pack(candidates: DataFrame, budget: int, weight: Column, by: str = "pack_id") -> DataFrame:
    """(pack, item_id, place, reason, outcome) of candidates (pack, item_id, rank, required, stale).

    Every candidate is traced with one reason: stale ones are omitted, of one item listed
    twice the better rank counts; the rest is selected.  A pack whose selected items
    outweigh the budget is refused as a whole, never trimmed.
    """
    listed = candidates.withColumn("w", weight.cast("long"))
    best = listed.withColumn("copy", F.row_number().over(Window.partitionBy(by, "item_id").orderBy("rank")))
    reason = F.when(F.col("copy") > 1, "omitted_duplicate").when(F.col("stale"), "omitted_stale").when(F.col("required"), "selected_required").otherwise("selected_ranked")
    traced = best.withColumn("reason", reason)
    chosen = F.col("reason").startswith("selected")
    total = traced.groupBy(by).agg(F.coalesce(F.sum(F.when(chosen, F.col("w"))), F.lit(0)).alias("total"))
    rows = traced.join(total, by)
    return rows.select(by, "item_id", "rank", "reason", F.when(F.col("total") > budget, "refused").when(chosen, "packed").otherwise("omitted").alias("outcome"), "total")


def combined(packs: dict[str, DataFrame]) -> DataFrame:
    """Packs of several universes side by side: an id of one universe never stands for that of another."""
    out = None
    for universe, rows in sorted(packs.items()):
        named = rows.select(F.lit(universe).alias("universe"), "*")
        out = named if out is None else out.unionByName(named)
    return out
