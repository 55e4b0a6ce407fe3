"""Lookup under open and closed worlds, constant resolution and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators import chains


def lookup(keys: DataFrame, records: DataFrame, coverage: DataFrame, conflict: Column) -> DataFrame:
    """conflict, then unknown_partition, found, and by coverage authoritative_absence or unknown, in this order."""
    r = records.withColumn("conflict", conflict).select("part_id", "record_key", "payload", "conflict")
    rows = keys.join(r, ["part_id", "record_key"], "left").join(coverage, "part_id", "left")
    out = F.when(F.col("conflict"), "conflict").when(F.col("complete").isNull(), "unknown_partition").when(F.col("payload").isNotNull(), "found").when(F.col("complete"), "authoritative_absence").otherwise("unknown")
    return rows.select("part_id", "record_key", out.alias("outcome"))


def constants(table: DataFrame) -> DataFrame:
    """(id, state, value) of constants that refer to others (id, ref, own): the sum along the chain, however long; cycle where it comes back, unresolved where it leaves the table."""
    found = chains.ends(table.select(F.col("id").alias("node"), F.col("ref").alias("next"), F.col("own").alias("weight")))
    state = F.when(F.col("state") == chains.ENDED, "resolved").when(F.col("state") == chains.OUTSIDE, "unresolved").otherwise("cycle")
    return found.select(F.col("node").alias("id"), state.alias("state"), F.when(F.col("state") == chains.ENDED, F.col("total")).alias("value"))


def verdict(evaluable: Column, exists: Column) -> Column:
    return F.when(~evaluable, "not_evaluated").when(exists, "clean").otherwise("finding")


def resolve_types(fields: DataFrame, declared: DataFrame) -> DataFrame:
    """(field_id, resolution) of fields (field_id, type_name, shape) among declarations (type_name, blocked).

    unsupported where the shape is none that names a type, unresolved where nobody
    declares it, correction_blocked where a correction of any declaration failed,
    ambiguous where several declare it, else resolved.  Declarations are counted before
    the fields meet them.
    """
    known = declared.groupBy("type_name").agg(F.count(F.lit(1)).alias("n"), F.bool_or("blocked").alias("blocked"))
    state = F.when(~F.col("shape").isin("named", "optional", "list"), "unsupported").when(F.col("n").isNull(), "unresolved").when(F.col("blocked"), "correction_blocked").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return fields.join(known, "type_name", "left").select("field_id", state.alias("resolution"))


def corrected(records: DataFrame, patches: DataFrame) -> DataFrame:
    """(name, source, value, state) of records (name, source, value, parents) under patches (name, guard, value, parent).

    A patch applies where the record's source is the one it was reviewed for; it may
    name a parent only for a record without one.  guard_failed and several_parents keep
    the original value; a name with several patches is a conflict and keeps it too.
    """
    p = patches.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("guard").alias("guard"), F.min("value").alias("patched"), F.min("parent").alias("parent"))
    rows = records.join(p, "name", "left")
    state = F.when(F.col("n").isNull(), "original").when(F.col("n") > 1, "conflict").when(F.col("guard") != F.col("source"), "guard_failed").when(F.col("parent").isNotNull() & (F.col("parents") > 0), "several_parents").otherwise("corrected")
    return rows.withColumn("state", state).select("name", "source", F.when(F.col("state") == "corrected", F.col("patched")).otherwise(F.col("value")).alias("value"), "state")
