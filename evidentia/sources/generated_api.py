"""Import of generated API documents: JSON of which only part is known, read as VARIANT.

A document names its schema and source, what its producer covered, and systems with
functions, events, tables, enumerations, constants and predicates.  Members are read by
path from the parsed value, so a document may hold more than is known here: every member
that no rule reads becomes a row of ``unread`` with its place and type, never silence.
Documents are read one by one; a malformed one is a state, not a failed job.

States of a document: imported, malformed_json, not_an_object, wrong_schema,
invalid_member (some member has no name, qualified name or source path; the others are
imported), coverage_mismatch (the producer counted other numbers than there are).

Cases: a null text is malformed_json; absent and null members are the same; an empty
array has no rows; repeated documents repeat their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.shared import keep

# fixed values: the collections of a system, and the members that are read at each level
COLLECTIONS = {"functions": "function", "events": "event", "tables": "table", "enumerations": "enumeration", "constants": "constant", "predicates": "predicate"}
ROOT = {"schema", "schema_version", "producer", "source", "coverage", "conflicts", "systems"}
SYSTEM = {"name", "namespace", "type", "environment", "documentation", "attributes", "source", *COLLECTIONS}
MEMBER = {"name", "qualified_name", "type", "literal_name", "documentation", "restrictions", "attributes", "arguments", "returns", "payload", "fields", "values", "source"}
RECORD = {"name", "type", "nilable", "position", "source"}
RECORDS = ("arguments", "returns", "payload", "fields", "values")


@dataclass
class Import:
    """facts: doc, system, kind, ordinal, name, qualified_name, type, path, line_start, restricted, conflicted; records: their arguments and the like; coverage; unread; states."""

    facts: DataFrame
    records: DataFrame
    coverage: DataFrame
    unread: DataFrame
    states: DataFrame


def _members(rows: DataFrame, value: str, known: set[str], level: str, place: Column) -> DataFrame:
    """(doc, level, place, member, type) of the members of an object that aren't read."""
    spark = rows.sparkSession
    objects = rows.select("doc", place.cast("string").alias("place"), F.col(value).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    found = spark.sql("SELECT t.doc, t.place, e.key AS member, schema_of_variant(e.value) AS type FROM {t} AS t, LATERAL variant_explode(t.v) AS e", t=objects)
    return found.where(~F.col("member").isin(*known)).select("doc", F.lit(level).alias("level"), "place", "member", "type")


def _get(value: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(value), path, kind)


def read(documents: DataFrame, key: str, text: str, schema: str) -> Import:
    """The content of documents (key, text) of one schema."""
    docs = keep(documents.select(F.col(key).alias("doc"), F.try_parse_json(F.col(text)).alias("v")))
    shape = F.when(F.col("v").isNull(), "malformed_json").when(~F.schema_of_variant("v").startswith("OBJECT"), "not_an_object").when(~F.coalesce(_get("v", "$.schema", "string") == schema, F.lit(False)), "wrong_schema")
    good = docs.where(shape.isNull())
    systems = good.select("doc", F.posexplode(_get("v", "$.systems", "array<variant>")).alias("at", "s"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("collection"), _get("s", f"$.{c}", "array<variant>").alias("members")) for c, k in COLLECTIONS.items()])).alias("c")
    members = keep(systems.select("doc", "at", _get("s", "$.name", "string").alias("system"), each).select("doc", "at", "system", "c.kind", "c.collection", F.posexplode("c.members").alias("ordinal", "m")))
    named = members.select(
        "doc", "at", "system", "kind", "collection", "ordinal", _get("m", "$.name", "string").alias("name"), _get("m", "$.qualified_name", "string").alias("qualified_name"), _get("m", "$.type", "string").alias("type"),
        _get("m", "$.source.path", "string").alias("path"), _get("m", "$.source.line_start", "long").alias("line_start"), _get("m", "$.restrictions", "variant").isNotNull().alias("restricted"),
    )
    valid = (F.length("name") > 0) & (F.length("qualified_name") > 0) & F.col("path").isNotNull()
    valid = F.coalesce(valid, F.lit(False))
    twice = named.where(valid).groupBy("doc", "kind", "qualified_name").agg((F.count(F.lit(1)) > 1).alias("conflicted"))
    facts = named.where(valid).join(twice, ["doc", "kind", "qualified_name"]).select("doc", "system", "kind", "ordinal", "name", "qualified_name", "type", "path", "line_start", "restricted", "conflicted")
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("list"), _get("m", f"$.{c}", "array<variant>").alias("rows")) for c in RECORDS])).alias("l")
    rows = members.select("doc", _get("m", "$.qualified_name", "string").alias("owner"), "kind", "at", "collection", "ordinal", parts).select("doc", "owner", "kind", "at", "collection", "ordinal", "l.list", F.posexplode("l.rows").alias("position", "r"))
    records = rows.select("doc", "kind", "owner", "list", "position", _get("r", "$.name", "string").alias("name"), _get("r", "$.type", "string").alias("type"))
    place = lambda *c: F.concat_ws("/", *c)
    unread = _members(good, "v", ROOT, "document", F.lit("")).unionByName(_members(systems, "s", SYSTEM, "system", F.col("at")))
    unread = unread.unionByName(_members(members, "m", MEMBER, "member", place("at", "collection", "ordinal"))).unionByName(_members(rows, "r", RECORD, "record", place("at", "collection", "ordinal", "list", "position")))
    found = members.groupBy("doc", "collection").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.coalesce(F.length(_get("m", "$.name", "string")) > 0, F.lit(False))).alias("named"))
    declared = good.select("doc", F.col("v").alias("v"), F.explode(F.array(*map(F.lit, COLLECTIONS))).alias("collection"), _get("v", "$.coverage.status", "string").alias("status"), _get("v", "$.coverage.negative_authority", "boolean").alias("authority"))
    counts = F.try_variant_get(F.col("v"), "$.coverage.entity_counts", "map<string,long>")
    coverage = declared.withColumn("declared", F.try_element_at(counts, F.col("collection"))).join(found, ["doc", "collection"], "left")
    n = F.coalesce("found", F.lit(0).cast("long"))
    state = F.when(F.col("status").isNull(), "unknown").when(F.col("declared").isNotNull() & (F.col("declared") != n), "mismatch").otherwise(F.col("status"))
    coverage = keep(coverage.select("doc", "collection", "declared", n.alias("found"), state.alias("state"), (F.coalesce("authority", F.lit(False)) & (state == "complete")).alias("authority")))
    bad = named.where(~valid).select("doc").distinct().withColumn("bad", F.lit(True))
    off = coverage.where("state = 'mismatch'").select("doc").distinct().withColumn("off", F.lit(True))
    states = docs.select("doc", shape.alias("shape")).join(bad, "doc", "left").join(off, "doc", "left")
    states = states.select("doc", F.coalesce("shape", F.when(F.col("bad"), "invalid_member"), F.when(F.col("off"), "coverage_mismatch"), F.lit("imported")).alias("state"))
    return Import(facts, records, coverage, unread, states)


def look_up(asked: DataFrame, imported: Import) -> DataFrame:
    """(doc, kind, qualified_name, outcome) of what is asked for: found, conflicted, authoritative_absence where the collection's coverage is complete and claims it, else unknown."""
    kinds = F.create_map(*[F.lit(x) for c, k in COLLECTIONS.items() for x in (c, k)])
    known = imported.facts.groupBy("doc", "kind", "qualified_name").agg(F.bool_or("conflicted").alias("conflicted"))
    sure = imported.coverage.select("doc", kinds[F.col("collection")].alias("kind"), "authority")
    rows = asked.join(known, ["doc", "kind", "qualified_name"], "left").join(sure, ["doc", "kind"], "left")
    outcome = F.when(F.col("conflicted"), "conflicted").when(F.col("conflicted").isNotNull(), "found").when(F.col("authority"), "authoritative_absence").otherwise("unknown")
    return rows.select("doc", "kind", "qualified_name", outcome.alias("outcome"))
