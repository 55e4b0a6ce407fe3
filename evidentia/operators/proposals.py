"""Proposals to a graph: validation against a registry in two phases, derivations, and conflicts between producers.

Every check is a join with a registry or with what was accepted before, and the first
code that holds is given, so a batch of any size is validated in a few joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.graph import POSSIBLE, PROVEN, strong_components
from evidentia.shared import keep, release

ACCEPTED = "accepted"
ENTITY_CODES = ("registry_mismatch", "unknown_entity_kind", "universe_not_allowed", "confidence_not_allowed", "identity_fields_mismatch", "invalid_graph_record", "duplicate_semantic_entity")
RELATION_CODES = ("registry_mismatch", "unknown_relation_kind", "confidence_not_allowed", "endpoint_missing", "endpoint_kind_mismatch", "invalid_graph_record")
CONFLICTS = (
    "exclusive_attribute_disagreement", "relation_multiplicity_violation", "forbidden_cycle", "endpoint_kind_disagreement",
    "cross_scope_generation_conflict", "producer_identity_or_schema_conflict", "evidence_or_source_handle_conflict", "coverage_versus_assertion_conflict",
)


def first_of(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that holds, else null."""
    out = F.when(checks[0][0], checks[0][1])
    for holds, name in checks[1:]:
        out = out.when(holds, name)
    return out


def validate_entities(proposals: DataFrame, kinds: DataFrame, universe: str, registry_digest: str) -> DataFrame:
    """(proposal_id, kind, node_id, outcome) of proposals (proposal_id, kind, key map<string,string>, confidence, registry_digest, evidence array).

    ``kinds``: kind, identity_fields (sorted), universes, worst_confidence.  A node's id
    is its kind and key; of valid proposals of one node the first by proposal id is
    accepted, the others are duplicates.
    """
    rows = proposals.join(kinds, "kind", "left")  # one row for each kind of the registry
    key = F.col("key")
    fields = F.array_sort(F.map_keys(key))
    node = F.concat_ws(":", "kind", F.array_join(F.transform(fields, lambda f: F.concat(f, F.lit("="), key[f])), ";"))
    code = first_of(
        (F.col("registry_digest") != registry_digest, "registry_mismatch"),
        (F.col("identity_fields").isNull(), "unknown_entity_kind"),
        (~F.array_contains("universes", universe), "universe_not_allowed"),
        (F.col("confidence") > F.col("worst_confidence"), "confidence_not_allowed"),
        (fields != F.col("identity_fields"), "identity_fields_mismatch"),
        (F.exists(F.map_values(key), lambda v: v.isNull() | (F.length(v) == 0)) | (F.size("evidence") == 0), "invalid_graph_record"),
    )
    checked = rows.select("proposal_id", "kind", F.when(code.isNull(), node).alias("node_id"), code.alias("code"))
    first = checked.where("code is null").groupBy("node_id").agg(F.min("proposal_id").alias("first"))
    joined = checked.join(first, "node_id", "left")
    outcome = F.when(F.col("code").isNotNull(), F.col("code")).when(F.col("proposal_id") != F.col("first"), "duplicate_semantic_entity").otherwise(ACCEPTED)
    return joined.select("proposal_id", "kind", "node_id", outcome.alias("outcome"))


def validate_relations(proposals: DataFrame, relations: DataFrame, entities: DataFrame, base: DataFrame, registry_digest: str) -> DataFrame:
    """(proposal_id, relation, src, dst, outcome) of proposals (proposal_id, relation, source, target, confidence, registry_digest, evidence array).

    An end is the id of an accepted entity proposal of this batch or a node of the base
    (node_id, kind).  ``relations``: relation, source_kinds, target_kinds, worst_confidence.
    """
    known = entities.where(F.col("outcome") == ACCEPTED).select(F.col("proposal_id").alias("end"), "node_id", "kind")
    known = known.unionByName(base.select(F.col("node_id").alias("end"), "node_id", "kind"))
    end = lambda name: known.select(F.col("end").alias(name), F.col("node_id").alias(f"{name}_id"), F.col("kind").alias(f"{name}_kind"))
    rows = proposals.join(relations, "relation", "left").join(end("source"), "source", "left").join(end("target"), "target", "left")
    code = first_of(
        (F.col("registry_digest") != registry_digest, "registry_mismatch"),
        (F.col("source_kinds").isNull(), "unknown_relation_kind"),
        (F.col("confidence") > F.col("worst_confidence"), "confidence_not_allowed"),
        (F.col("source_id").isNull() | F.col("target_id").isNull(), "endpoint_missing"),
        (~F.array_contains("source_kinds", F.col("source_kind")) | ~F.array_contains("target_kinds", F.col("target_kind")), "endpoint_kind_mismatch"),
        (F.size("evidence") == 0, "invalid_graph_record"),
    )
    return rows.select("proposal_id", "relation", F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.coalesce(code, F.lit(ACCEPTED)).alias("outcome"))


def validate_derivations(derivations: DataFrame, inputs: DataFrame, confidences: DataFrame | None = None, basis: str = "output", required: bool = False) -> DataFrame:
    """(output, verdict) of derivations (output, missing count) with inputs (output, input, rebuttal).

    derived_proven: a derived assertion claims to be proven; missing_input: an input that
    nobody asserted, or with ``required`` none at all; promoted: it claims more than an
    input that is no rebuttal; incomplete_confirmed: something is missing and yet it is not
    merely possible; cycle: it depends on itself, through rebuttals too; else valid.

    ``basis``: a column of both tables; the outputs of one basis share its inputs, which
    are never repeated for each of them.  Without ``confidences`` both tables carry the
    ``confidence`` of what was asserted, null if nobody did.
    """
    if confidences is not None:
        c = confidences.select("assertion", "confidence")
        derivations = derivations.join(c.withColumnRenamed("assertion", "output"), "output", "left")
        inputs = inputs.join(c.withColumnRenamed("assertion", "input"), "input", "left")
    told = inputs.groupBy(basis).agg(F.bool_or(F.col("confidence").isNull()).alias("unknown"), F.max(F.when(~F.col("rebuttal"), F.col("confidence"))).alias("worst"))
    cyclic = cyclic_outputs(derivations, inputs, basis).withColumn("cyclic", F.lit(True))
    rows = derivations.join(told, basis, "left").join(cyclic, "output", "left")
    verdict = first_of(
        (F.col("confidence") == PROVEN, "derived_proven"),
        (F.coalesce("unknown", F.lit(required)) | F.col("confidence").isNull(), "missing_input"),
        (F.col("confidence") < F.col("worst"), "promoted"),
        ((F.col("missing") > 0) & (F.col("confidence") < POSSIBLE), "incomplete_confirmed"),
        (F.col("cyclic"), "cycle"),
    )
    return rows.select("output", F.coalesce(verdict, F.lit("valid")).alias("verdict"))


def cyclic_outputs(derivations: DataFrame, inputs: DataFrame, basis: str) -> DataFrame:
    """(output) of those that depend on themselves.

    Only an input that is an output too can be on a cycle: such inputs are found by a hash
    of 8 bytes first (equal hashes of others leave a few rows more), so that what is
    compared as a whole is small where derivations are shallow.
    """
    made = derivations.select(F.xxhash64("output").alias("hash"))
    used = inputs.select(F.xxhash64("input").alias("hash"), "input", basis)
    both = keep(used.select("hash").join(made, "hash", "left_semi").distinct())
    release(derivations.sparkSession)
    if both.isEmpty():
        return derivations.select("output").where("false")
    pairs = keep(used.join(both, "hash", "left_semi").select(basis, "input"))
    if basis == "output":
        edges = pairs.select(F.col("output").alias("src"), F.col("input").alias("dst"))
    else:  # an output stands before its basis, which is a node of its own
        own = derivations.withColumn("hash", F.xxhash64("output")).join(both, "hash", "left_semi").select("output", basis)
        node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
        edges = own.select(node("o", "output").alias("src"), node("b", basis).alias("dst")).unionByName(pairs.select(node("b", basis).alias("src"), node("o", "input").alias("dst")))
    nodes = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()
    size = strong_components(edges, nodes)
    rings = size.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = size.join(rings, "component").select("node_id").unionByName(edges.where("src = dst").select(F.col("src").alias("node_id"))).distinct()
    if basis != "output":
        found = found.where("node_id like 'o%'").selectExpr("substr(node_id, 2) node_id")
    return found.select(F.col("node_id").cast(derivations.schema["output"].dataType).alias("output"))


def disagreements(rows: DataFrame, subject: str, values: Sequence[str], kind: str) -> DataFrame:
    """(kind, subject, participants) of the subjects about which the rows do not agree."""
    if kind not in CONFLICTS:
        raise ValueError(f"not a kind of conflict: {kind}")
    distinct = rows.groupBy(F.col(subject).cast("string").alias("subject")).agg(F.count_distinct(F.struct(*values)).alias("participants"))
    return distinct.where("participants > 1").select(F.lit(kind).alias("kind"), "subject", "participants")


def forbidden_cycles(edges: DataFrame) -> DataFrame:
    """(kind, subject, participants) of the cycles of a relation that must have none; the subject is the smallest node."""
    nodes = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()
    size = strong_components(edges, nodes).groupBy("component").agg(F.count(F.lit(1)).alias("participants"))
    own = edges.where("src = dst").select(F.col("src").alias("component")).distinct().withColumn("self", F.lit(True))
    rings = size.join(own, "component", "left").where("participants > 1 or self")
    return rings.select(F.lit("forbidden_cycle").alias("kind"), F.col("component").cast("string").alias("subject"), "participants")


def coverage_conflicts(coverage: DataFrame, assertions: DataFrame) -> DataFrame:
    """(kind, subject, participants): relations of which a producer says with authority that there are none, and that others assert."""
    empty = coverage.where("authority and state = 0 and asserted = 0").select("relation", "part_id").distinct()
    held = assertions.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    found = empty.join(held, "relation").groupBy("relation").agg(F.count(F.lit(1)).alias("participants"))
    return found.select(F.lit("coverage_versus_assertion_conflict").alias("kind"), F.col("relation").alias("subject"), "participants")
