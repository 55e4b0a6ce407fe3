"""Coverage and evidence algebra: states as ranks, worst states, authority of absence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPLETE, NOT_APPLICABLE = 0, -1


def worst_by_partition(coverage: DataFrame, relations: DataFrame, partitions: DataFrame, not_evaluated: int = 1) -> DataFrame:
    """Worst state of each relation over every partition; a partition without a record counts as not evaluated. Both lists are registries of bounded size."""
    grid = relations.select("relation").distinct().join(partitions.select("part_id").distinct())
    return grid.join(coverage, ["relation", "part_id"], "left").groupBy("relation").agg(F.max(F.coalesce("state", F.lit(not_evaluated))).alias("state"), F.sum(F.col("state").isNull().cast("long")).alias("missing"))


def summary(records: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Worst applicable status of each key by the given order (best first); all not applicable stays so; ``duplicate`` marks a repeated (partition, producer)."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("status")).cast("int")
    worst = F.max(F.when(F.col("status") != "not_applicable", rank))
    pairs = F.struct("part_id", "producer")
    return records.groupBy(*keys).agg(F.coalesce(F.get(F.array(*map(F.lit, order)), worst - 1), F.lit("not_applicable")).alias("status"), (F.count(F.lit(1)) > F.count_distinct(pairs)).alias("duplicate"))


def availability(status: Column, conflicts: Column, truncated: Column) -> Column:
    """blocked unless complete, free of conflicts and not truncated."""
    return F.when((status == "complete") & (conflicts == 0) & ~truncated, "available").otherwise("blocked")


def denial_reasons(reasons: dict[str, Column]) -> Column:
    """The names of the reasons that hold, sorted; empty means that absence is authoritative."""
    return F.array_sort(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()]), lambda x: x.isNotNull()))


def deduplicate(rows: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """One row a key; ``conflict`` where the same key carries different content."""
    return rows.groupBy(key).agg(*[F.min(c).alias(c) for c in content], (F.count_distinct(F.struct(*content)) > 1).alias("conflict"))


def fingerprint(*digests: Column) -> Column:
    """Digest of component digests, defined only if all are."""
    out = F.sha2(F.concat_ws("|", *digests), 256)
    for d in digests:
        out = F.when(d.isNotNull(), out)
    return out


# fixed values: why a miss is no proof of absence
DENIALS = (
    "profile_unavailable", "reference_generation_unavailable", "generation_mismatch", "partition_partial", "partition_unknown", "partition_failed",
    "unresolved_conflict", "capability_not_evaluated", "candidate_only_evidence", "scope_unknown", "result_truncated",
)


def negative_authority(lookups: DataFrame, records: DataFrame) -> DataFrame:
    """(lookup_id, outcome, reasons) of misses (lookup_id, scope_known, completed, truncated, profile, reference, generation, expected, candidate_only).

    ``records``: coverage (lookup_id, state, conflicts) by partition.  All reasons that
    hold are kept in their order; without any, absence is authoritative unless nothing
    applied at all.
    """
    state = F.col("state")
    told = records.groupBy("lookup_id").agg(
        F.bool_or(state.isin("partial", "truncated")).alias("partial"), F.bool_or(state == "unknown").alias("unknown"), F.bool_or(state == "failed").alias("failed"),
        F.bool_or(state == "not_evaluated").alias("unevaluated"), F.bool_or(state == "truncated").alias("cut"), (F.sum("conflicts") > 0).alias("conflict"), F.bool_and(state == "not_applicable").alias("nothing"),
    )
    rows = lookups.join(told, "lookup_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    holds = {
        "profile_unavailable": F.col("profile").isNull(),
        "reference_generation_unavailable": F.col("reference").isNull(),
        "generation_mismatch": no(F.col("generation") != F.col("expected")),
        "partition_partial": no(F.col("partial")),
        "partition_unknown": no(F.col("unknown")) | F.col("nothing").isNull(),
        "partition_failed": no(F.col("failed")),
        "unresolved_conflict": no(F.col("conflict")),
        "capability_not_evaluated": ~F.col("completed") | no(F.col("unevaluated")),
        "candidate_only_evidence": F.col("candidate_only"),
        "scope_unknown": ~F.col("scope_known"),
        "result_truncated": F.col("truncated") | no(F.col("cut")),
    }
    reasons = F.array_compact(F.array(*[F.when(holds[name], name) for name in DENIALS]))
    outcome = F.when(F.size("reasons") > 0, "not_authoritative").when(F.col("nothing"), "not_applicable").otherwise("authoritative_absent")
    return rows.withColumn("reasons", reasons).select("lookup_id", outcome.alias("outcome"), F.array_join("reasons", ",").alias("reasons"))


MERGE_MODES = ("strict", "extend_missing_optional", "external_union")


def merge_generations(left: DataFrame, right: DataFrame, mode: str) -> DataFrame:
    """(context, outcome, generation, externals) of two contexts' generations (context, generation, externals map<string,string>).

    strict: both must be equal.  extend_missing_optional: a missing generation is taken
    from the other side, externals must be equal.  external_union: generations must be
    equal or missing on both sides, externals are united, and one scope with two values
    is an error.
    """
    if mode not in MERGE_MODES:
        raise ValueError(f"not a mode: {mode}")
    side = lambda df, s: df.select("context", F.col("generation").alias(f"g{s}"), F.col("externals").alias(f"x{s}"))
    rows = side(left, 1).join(side(right, 2), "context")
    one, two = F.col("g1"), F.col("g2")
    entries = lambda c: F.array_sort(F.map_entries(c))
    same_x = entries("x1") == entries("x2")
    clash = F.exists(F.map_keys("x1"), lambda k: F.array_contains(F.map_keys("x2"), k) & (F.col("x1")[k] != F.col("x2")[k]))
    wrong = F.when(one.isNotNull() & two.isNotNull() & (one != two), "generation_mismatch")
    if mode == "extend_missing_optional":
        wrong = wrong.when(~same_x, "merge_mode_violation")
    else:
        wrong = wrong.when(~one.eqNullSafe(two), "merge_mode_violation")
        wrong = wrong.when(clash, "duplicate_external_scope") if mode == "external_union" else wrong.when(~same_x, "merge_mode_violation")
    missing = F.map_filter("x2", lambda k, v: ~F.array_contains(F.map_keys("x1"), k))
    united = F.array_join(F.transform(F.array_sort(F.concat(F.map_entries("x1"), F.map_entries(missing))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    outcome = F.coalesce(wrong, F.lit("merged"))
    ok = outcome == "merged"
    return rows.select("context", outcome.alias("outcome"), F.when(ok, F.coalesce(one, two)).alias("generation"), F.when(ok, united).alias("externals"))


# fixed values: observation families in their order, and the relation each asserts
FAMILIES = {
    "direct_call": "calls", "state_read": "reads_state", "state_write": "writes_state", "native_event_registration": "registers_native_event", "native_event_handler": "handles_native_event",
    "native_event_bridge": "bridges_native_event", "custom_signal_emit": "emits_custom_signal", "custom_signal_handle": "handles_custom_signal", "cvar_callback_registration": "registers_cvar_callback",
    "script_assignment": "sets_script", "script_hook": "hooks_script", "secure_function_hook": "secure_hooks_function", "dependency": "depends_on", "ownership": "owns", "load": "loads",
    "inheritance": "inherits", "mixin": "mixes_in", "factory_creation": "factory_creates", "api_use": "uses_api",
}


def recognized(observations: DataFrame, reported: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Assertions (family, assertion_id, relation), at most ``most`` a family in id order, and coverage (relation, state, blocker) of all families.

    A family of which something is left out, or which reports truncation, is partial
    with that blocker; a family that nobody reported is not evaluated.  Recognizers
    never grant authority over absence.
    """
    spark = observations.sparkSession
    table = F.broadcast(spark.createDataFrame(list(FAMILIES.items()), "family string, relation string"))
    rank = F.row_number().over(Window.partitionBy("family").orderBy("assertion_id"))
    kept = observations.withColumn("r", rank).where(F.col("r") <= most).join(table, "family").select("family", "assertion_id", "relation")
    over = observations.groupBy("family").agg((F.count(F.lit(1)) > most).alias("cut"))
    rows = spark.createDataFrame(list(FAMILIES.items()), "family string, relation string").join(reported, "family", "left").join(over, "family", "left")
    cut = F.coalesce("cut", F.lit(False)) | F.coalesce(F.col("state") == "truncated", F.lit(False))
    state = F.when(F.col("state").isNull(), "not_evaluated").when(F.col("state") == "failed", "failed").when(cut, "partial").otherwise(F.col("state"))
    return kept, rows.select("relation", state.alias("state"), F.when(cut & F.col("state").isNotNull() & (F.col("state") != "failed"), "truncated_output").otherwise("").alias("blocker"))


# fixed values: classes of truncation, the worst last
TRUNCATIONS = ("none", "page_end", "result_cap", "byte_cap", "time_limit", "cancelled")


def merged_truncation(rows: DataFrame, key: str) -> DataFrame:
    """(key, class, kept, omitted, all): the worst class of parts (key, class, kept, omitted) of one result, what is kept and omitted in sum (null where any part doesn't know), and every class that occurs, in their order."""
    rank = F.array_position(F.array(*map(F.lit, TRUNCATIONS)), F.col("class")).cast("int")
    unknown = F.bool_or(F.col("omitted").isNull())
    seen = F.array_sort(F.collect_set(rank))
    names = F.transform(seen, lambda r: F.element_at(F.array(*map(F.lit, TRUNCATIONS)), r))
    return rows.groupBy(key).agg(F.element_at(F.array(*map(F.lit, TRUNCATIONS)), F.max(rank)).alias("class"), F.sum("kept").alias("kept"), F.when(~unknown, F.sum("omitted")).alias("omitted"), F.array_join(F.filter(names, lambda n: n != "none"), ",").alias("all"))


def evidence_rules(evidence: DataFrame, inputs: DataFrame, components: DataFrame) -> DataFrame:
    """(evidence_id, violation) of evidence (evidence_id, provenance, confidence, scope) and what it is derived from (evidence_id, input_id).

    candidate_only: a provenance that may only give candidates claims more;
    derived_needs_inputs, proven_forbids_inputs, probe_scope: a runtime probe outside a
    runtime scope; unknown_input; cycle: by strong components of the derivations
    (node_id, component) or by deriving from itself.
    """
    known = evidence.select(F.col("evidence_id").alias("input_id"), F.lit(True).alias("known"))
    told = inputs.join(known, "input_id", "left").groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("known").isNull()).alias("lost"), F.bool_or(F.col("input_id") == F.col("evidence_id")).alias("own"))
    ring = components.groupBy("component").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    inside = components.join(ring, "component").select(F.col("node_id").alias("evidence_id"), F.lit(True).alias("ring"))
    rows = evidence.join(told, "evidence_id", "left").join(inside, "evidence_id", "left")
    n, conf, source = F.coalesce("n", F.lit(0)), F.col("confidence"), F.col("provenance")
    found = F.array_compact(F.array(
        F.when(source.isin("heuristic", "model") & (conf != "candidate"), "candidate_only"),
        F.when((conf == "derived") & (n == 0), "derived_needs_inputs"),
        F.when((conf == "proven") & (n > 0), "proven_forbids_inputs"),
        F.when((source == "runtime_probe") & (F.col("scope") != "runtime"), "probe_scope"),
        F.when(F.col("lost"), "unknown_input"),
        F.when(F.col("ring") | F.col("own"), "cycle"),
    ))
    return rows.select("evidence_id", F.explode(found).alias("violation"))


def budget_usage(charges: DataFrame, limits: DataFrame) -> DataFrame:
    """(rule, counter, used, limit, state) of charges (rule, counter, amount) against limits (counter, limit): within, reached or exceeded; a counter without charges is used 0 times by every rule."""
    used = charges.groupBy("rule", "counter").agg(F.sum("amount").alias("used"))
    grid = charges.select("rule").distinct().join(F.broadcast(limits))  # limits are a handful of counters
    rows = grid.join(used, ["rule", "counter"], "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
    return rows.select("rule", "counter", "used", "limit", F.when(F.col("used") > F.col("limit"), "exceeded").when(F.col("used") == F.col("limit"), "reached").otherwise("within").alias("state"))


def findings(rows: DataFrame) -> DataFrame:
    """(finding_id, rule, code, subject, place, severity, copies, conflict) of findings (rule, code, subject, place, severity), each once, to be read in the order of (severity, subject, place, rule, finding_id).

    The id is a digest of what makes a finding the same: rule, code, subject and place.
    Copies are counted; where they differ in severity the worst (smallest) stays and the
    finding is marked.
    """
    parts = ("rule", "code", "subject", "place")
    framed = F.concat_ws("|", *[F.concat(F.length(F.col(p).cast("string")).cast("string"), F.lit(":"), F.col(p).cast("string")) for p in parts])
    return rows.withColumn("finding_id", F.sha2(framed, 256)).groupBy("finding_id", *parts).agg(F.min("severity").alias("severity"), F.count(F.lit(1)).alias("copies"), (F.count_distinct("severity") > 1).alias("conflict"))
