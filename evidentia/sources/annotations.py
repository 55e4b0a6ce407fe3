"""Rendering of declarations as annotation stubs, with a map from generated bytes to their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.ranking import cumulative_bytes


def field_line() -> Column:
    return F.concat(F.lit("---@field a"), F.col("position").cast("string"), F.lit(" "), "original_type", F.when(F.col("nilable"), "?").otherwise(""))


def stubs(members: DataFrame) -> DataFrame:
    """One class stub for each API, fields in order."""
    lines = members.withColumn("line", field_line()).groupBy("api").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("f"))
    return lines.select("api", F.concat(F.lit("---@class A"), F.col("api").cast("string"), F.lit("\n"), F.array_join(F.transform("f", lambda x: x["line"]), "\n")).alias("stub"))


def source_map(members: DataFrame) -> DataFrame:
    """Byte range of each field line, line end included, within its stub's fields."""
    return cumulative_bytes(members.withColumn("line", field_line()), ["api"], ["position"], F.octet_length("line") + 1)


def literal(kind: Column, value: Column) -> Column:
    """A value as a literal; null where its kind has none."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(kind == "string", quoted).when(kind.isin("number", "boolean"), value)


def rendered(declarations: DataFrame) -> DataFrame:
    """(kind, name, line, lost) of declarations (kind, name, value_kind, value): events, cvars, enumeration members and constants, each in its own form; what has no literal gives no line and says why."""
    value = literal(F.col("value_kind"), F.col("value"))
    line = (
        F.when(F.col("kind") == "event", F.concat(F.lit('---| "'), "name", F.lit('"')))
        .when(F.col("kind") == "cvar", F.concat(F.lit('---| "'), "name", F.lit('" # '), value))
        .when(F.col("kind") == "enum", F.concat(F.lit("    "), "name", F.lit(" = "), value, F.lit(",")))
        .when(F.col("kind") == "constant", F.concat("name", F.lit(" = "), value))
    )
    known = F.col("kind").isin("event", "cvar", "enum", "constant")
    lost = F.when(~known, "unsupported_kind").when(line.isNull(), "no_literal")
    return declarations.select("kind", "name", line.alias("line"), lost.alias("lost"))


def emission(declarations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rendered lines with their byte range in their kind's file, names in order, and a report of what was lost: kind, reason, count."""
    rows = rendered(declarations)
    kept = cumulative_bytes(rows.where("line is not null"), ["kind"], ["name"], F.octet_length("line") + 1)
    return kept.select("kind", "name", "byte_start", "byte_end"), rows.where("lost is not null").groupBy("kind", "lost").agg(F.count(F.lit(1)).alias("n"))
