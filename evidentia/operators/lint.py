"""Lint rules over references: a finding, a clean claim, or why there is neither.

Absence only counts where the catalogue's partition is complete and its silence has
authority; everything else blocks the rule with the reasons that hold, in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: why a rule gives no verdict
BLOCKERS = (
    "missing_capability", "failed_capability", "partial_coverage", "reference_partition_missing", "reference_conflict", "ambiguous_reference",
    "unsupported_fact_shape", "missing_fact_relation", "missing_restriction_facet", "stale_input", "budget_incomplete",
)
GUARDS = ("absent", "dominating_exact_value", "after_use", "different_value", "non_dominating")


def capability_gate(files: DataFrame, capabilities: DataFrame, required: list[str]) -> DataFrame:
    """(file_id, gate): for each file the blockers of its required capabilities (file_id, capability, state), sorted as BLOCKERS are."""
    spark = files.sparkSession
    need = files.select("file_id").distinct().join(F.broadcast(spark.createDataFrame([(r,) for r in required], "capability string")))
    state = need.join(capabilities, ["file_id", "capability"], "left")
    blocker = F.when(F.col("state").isNull() | (F.col("state") == "not_evaluated"), "missing_capability").when(F.col("state").isin("failed", "cancelled"), "failed_capability").when(F.col("state").isin("partial", "truncated"), "partial_coverage")
    return state.groupBy("file_id").agg(in_order(F.collect_set(blocker)).alias("gate"))


def in_order(found: Column) -> Column:
    return F.filter(F.array(*map(F.lit, BLOCKERS)), lambda b: F.array_contains(found, b))


def api_exists(references: DataFrame, gates: DataFrame, catalogue: DataFrame, partitions: DataFrame, current: int, most: int | None = None) -> DataFrame:
    """(fact_id, outcome, blockers) of references (fact_id, file_id, partition, name, resolution, generation).

    ``catalogue``: partition, name, kind; names with several kinds conflict.
    ``partitions``: partition, complete, authority.  outcome: finding (the name does not
    exist), clean, or not_evaluated; ``most`` references by fact id are evaluated, the
    others are blocked by the budget.
    """
    names = catalogue.groupBy("partition", "name").agg(F.count_distinct("kind").alias("kinds"))
    rows = references.join(gates, "file_id", "left").join(partitions, "partition", "left").join(names, ["partition", "name"], "left")
    over = F.lit(False)
    if most is not None:
        kept = references.select("fact_id").orderBy("fact_id").limit(most).withColumn("within", F.lit(True))
        rows = rows.join(kept, "fact_id", "left")
        over = F.col("within").isNull()
    absent = F.col("kinds").isNull()
    checks = (
        ("reference_partition_missing", F.col("complete").isNull()),
        ("reference_conflict", F.col("kinds") > 1),
        ("ambiguous_reference", F.col("resolution") == "possible"),
        ("unsupported_fact_shape", F.col("resolution") == "dynamic"),
        ("stale_input", F.col("generation") != current),
        ("budget_incomplete", over),
        ("partial_coverage", absent & F.col("complete").isNotNull() & ~(F.col("complete") & F.col("authority"))),
    )
    own = F.array_compact(F.array(*[F.when(holds, name) for name, holds in checks]))
    blockers = in_order(F.concat(F.coalesce("gate", F.array(F.lit("missing_capability"))), own))
    outcome = F.when(F.size("blockers") > 0, "not_evaluated").when(absent, "finding").otherwise("clean")
    return rows.select("fact_id", absent.alias("absent"), "kinds", blockers.alias("blockers")).select("fact_id", outcome.alias("outcome"), F.array_join("blockers", ",").alias("blockers"))


def embedded(references: DataFrame, bodies: DataFrame) -> DataFrame:
    """References of code that is embedded in other files, at the places of those files.

    ``bodies``: body_id, file_id, shift (bytes of the file before the body), length.
    Result: all columns of the references with their file, the byte range in it, and
    ``relation``: mapped, outside_body or missing_fact_relation.
    """
    rows = references.drop("file_id").join(bodies, "body_id", "left")
    relation = F.when(F.col("file_id").isNull(), "missing_fact_relation").when((F.col("start") < 0) | (F.col("end") > F.col("length")) | (F.col("end") < F.col("start")), "outside_body").otherwise("mapped")
    ok = relation == "mapped"
    return rows.withColumn("relation", relation).withColumn("file_start", F.when(ok, F.col("shift") + F.col("start"))).withColumn("file_end", F.when(ok, F.col("shift") + F.col("end"))).drop("shift", "length")


def unguarded_use(uses: DataFrame, guards: DataFrame, facets: DataFrame) -> DataFrame:
    """(use_id, guard, outcome) of uses (use_id, scope_id, name, value, place) of restricted values.

    ``guards``: scope_id, name, value, place, dominates; the best guard of a use counts:
    one that dominates it with the same value, one after it, one of another value, one
    that does not dominate, none.  ``facets``: name, restricted.  outcome: clean,
    finding, or not_evaluated where nothing says whether the name is restricted.  Guards
    are reduced to one row for each scope, name and value before the uses meet them.
    """
    same = guards.groupBy("scope_id", "name", "value").agg(F.min(F.when(F.col("dominates"), F.col("place"))).alias("first_dominating"), F.min("place").alias("first"), F.max("place").alias("last"))
    other = guards.groupBy("scope_id", "name").agg(F.count_distinct("value").alias("values"))
    rows = uses.join(same, ["scope_id", "name", "value"], "left").join(other, ["scope_id", "name"], "left").join(facets, "name", "left")
    guard = (
        F.when(F.col("first_dominating") < F.col("place"), GUARDS[1])
        .when(F.col("first") >= F.col("place"), GUARDS[2])
        .when(F.col("first").isNull() & (F.col("values") > 0), GUARDS[3])
        .when(F.col("first").isNotNull(), GUARDS[4])
        .otherwise(GUARDS[0])
    )
    outcome = F.when(F.col("restricted").isNull(), "not_evaluated").when(~F.col("restricted"), "clean").when(F.col("guard") == GUARDS[1], "clean").otherwise("finding")
    return rows.withColumn("guard", guard).select("use_id", "guard", outcome.alias("outcome"), F.when(F.col("restricted").isNull(), "missing_restriction_facet").alias("blocker"))
