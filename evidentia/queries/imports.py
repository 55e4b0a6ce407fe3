"""Queries that import nested documents and check packs of others."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import foreign_packs as K
from evidentia.operators import manifest as M
from evidentia.registry import Source, query
from evidentia.sources import generated_api as G

SCHEMA = "api/1"


def api_documents(s: Source):
    """A document for each brand: a system for each type, parts as functions or events; some hold members that nobody knows, brand 1 is cut off, brand 2 names another schema, brand 3 counts wrongly."""
    size, brand = F.col("p_size"), F.col("p_brand")
    source = F.struct(F.concat(F.lit("api/"), "p_type").alias("path"), F.col("p_partkey").alias("line_start"))
    record = F.struct(F.lit("arg").alias("name"), F.col("p_type").alias("type"), F.when(size % 10 == 4, "old").alias("legacy"))
    member = F.struct(F.concat(F.lit("N"), "p_partkey").alias("name"), F.concat(F.lit("A."), (F.col("p_partkey") % 500).cast("string")).alias("qualified_name"), F.col("p_type").alias("type"), F.when(size > 40, F.struct(F.lit(True).alias("combat"))).alias("restrictions"), F.array(record).alias("arguments"), F.when(size % 10 == 3, F.struct(size.alias("x"))).alias("color"), source.alias("source"))
    systems = s.part.groupBy("p_brand", "p_type").agg(F.sort_array(F.collect_list(F.when(size % 2 == 0, member))).alias("functions"), F.sort_array(F.collect_list(F.when(size % 2 == 1, member))).alias("events"))
    system = F.struct(F.col("p_type").alias("name"), "functions", "events", F.when(F.col("p_type") == "PROMO", 1).alias("shade"))
    docs = systems.groupBy("p_brand").agg(F.sort_array(F.collect_list(system)).alias("systems"), F.sum(F.size("functions")).alias("nf"), F.sum(F.size("events")).alias("ne"))
    counts = F.struct((F.col("nf") + F.when(brand == "Brand#3", 1).otherwise(0)).alias("functions"), F.col("ne").alias("events"), F.lit(0).alias("tables"))
    coverage = F.struct(F.when(brand == "Brand#4", "partial").otherwise("complete").alias("status"), F.lit(True).alias("negative_authority"), counts.alias("entity_counts"))
    text = F.to_json(F.struct(F.when(brand == "Brand#2", "other/1").otherwise(SCHEMA).alias("schema"), F.lit(1).alias("schema_version"), coverage.alias("coverage"), "systems"))
    return docs.select("p_brand", F.when(brand == "Brand#1", F.substring(text, 1, 200)).otherwise(text).alias("text"))


def imported(s: Source) -> G.Import:
    return G.read(api_documents(s), "p_brand", "text", SCHEMA)


_GOOD = "part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')"
_ROWS = f"r AS (SELECT p_brand AS doc, p_type, p_partkey AS k, p_size, CASE p_size % 2 WHEN 0 THEN 'function' ELSE 'event' END AS kind, concat('A.', p_partkey % 500) AS qualified_name FROM {_GOOD})"


@query("s10_generated_facts", f"WITH {_ROWS} SELECT doc, p_type AS system, kind, concat('N', k) AS name, qualified_name, CAST(k AS BIGINT) AS line_start, p_size > 40 AS restricted, count(*) OVER (PARTITION BY doc, kind, qualified_name) > 1 AS conflicted FROM r")
def _(s: Source):
    return imported(s).facts.select("doc", "system", "kind", "name", "qualified_name", "line_start", "restricted", "conflicted")


@query("s10_unread_members", f"WITH {_ROWS} SELECT doc, 'member' AS level, 'color' AS member, count(*) AS n FROM r WHERE p_size % 10 = 3 GROUP BY doc UNION ALL SELECT doc, 'record', 'legacy', count(*) FROM r WHERE p_size % 10 = 4 GROUP BY doc UNION ALL SELECT doc, 'system', 'shade', 1 FROM r WHERE p_type = 'PROMO' GROUP BY doc")
def _(s: Source):
    return imported(s).unread.groupBy("doc", "level", "member").agg(F.count(F.lit(1)).alias("n"))


@query("s10_document_states", f"""SELECT doc, state FROM (SELECT DISTINCT p_brand AS doc, CASE p_brand WHEN 'Brand#1' THEN 'malformed_json' WHEN 'Brand#2' THEN 'wrong_schema' WHEN 'Brand#3' THEN 'coverage_mismatch' ELSE 'imported' END AS state FROM part)""")
def _(s: Source):
    return imported(s).states


@query("s10_lookups", f"""WITH {_ROWS}, f AS (SELECT doc, qualified_name, count(*) AS n FROM r WHERE kind = 'function' GROUP BY ALL), a AS (SELECT DISTINCT p_brand AS doc, concat('A.', p_size * 7 % 500) AS qualified_name FROM part)
    SELECT a.doc, 'function' AS kind, a.qualified_name, CASE WHEN f.n > 1 THEN 'conflicted' WHEN f.n = 1 THEN 'found' WHEN a.doc IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') THEN 'unknown' ELSE 'authoritative_absence' END AS outcome FROM a LEFT JOIN f USING (doc, qualified_name)""")
def _(s: Source):
    asked = s.part.select(F.col("p_brand").alias("doc"), F.lit("function").alias("kind"), F.concat(F.lit("A."), (F.col("p_size") * 7 % 500).cast("string")).alias("qualified_name")).distinct()
    return G.look_up(asked, imported(s))


#: what is done to a pack, by p_partkey % 9: which check fails then
_DAMAGE = ("byte_admission", "canonical_bytes", "schema", "compiled_profile", "digest_and_identity", "internal_references", "owner_generation_closure")


@query("c7_foreign_packs", f"""WITH c AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(K.CHECKS))}) AS c(i, name)) SELECT p_partkey AS pack, c.name AS "check", CAST(c.i + 1 AS INTEGER) AS place,
    CASE WHEN c.i = 7 OR c.i > p_partkey % 9 THEN 'not_evaluated' WHEN c.i = p_partkey % 9 THEN 'invalid' ELSE 'valid' END AS state FROM part, c WHERE p_partkey % 9 < 7 UNION ALL SELECT p_partkey, c.name, CAST(c.i + 1 AS INTEGER), CASE WHEN c.i = 7 THEN 'not_evaluated' ELSE 'valid' END FROM part, c WHERE p_partkey % 9 >= 7""")
def _(s: Source):  # a pack for each part, seven of nine damaged so that one check fails
    k = F.col("p_partkey") % 9
    made = K.produced(s.part.select(F.col("p_partkey").alias("pack"), F.when(k == 6, "nobody").otherwise(F.col("p_brand")).alias("owner"), F.lit(1).alias("generation"), F.col("p_type").alias("kind"), F.col("p_name").alias("name")), "pack")
    k, text = F.col("pack") % 9, F.col("text")
    link = F.regexp_replace(text, '"target":"[0-9a-f]+"', '"target":"x"')
    damaged = F.when(k == 0, "").when(k == 1, F.concat(text, F.lit(" "))).when(k == 2, F.regexp_replace(text, "evidentia/pack/1", "other/pack/1")).when(k == 3, F.regexp_replace(text, '"budget":1', '"budget":0')).when(k == 4, F.regexp_replace(text, '"name":"', '"name":"un'))
    # references are part of the pack's identity: the identity of a pack with a broken link is made anew
    packs = made.select("pack", damaged.when(k == 5, K.resealed(link)).otherwise(text).alias("text"))
    generations = s.part.select(F.col("p_brand").alias("owner"), F.lit(1).cast("long").alias("generation"), F.lit(True).alias("retained")).distinct()
    return K.validate(packs, "pack", "text", generations).select("pack", "check", "place", "state")


@query("v8_manifest_differences", """SELECT o_orderkey, CASE WHEN o_orderkey IN (7, 1001) THEN 'changed' ELSE 'removed' END AS change, true AS few FROM orders WHERE o_orderkey IN (7, 1001, 12, 800) UNION ALL SELECT -1, 'added', true""")
def _(s: Source):  # two versions of orders that differ in five rows
    k = F.col("o_orderkey")
    old = s.orders
    new = old.where(~k.isin(12, 800)).withColumn("o_totalprice", F.when(k.isin(7, 1001), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    new = new.unionByName(old.where(k == 12).withColumn("o_orderkey", F.lit(-1).cast(old.schema["o_orderkey"].dataType)))
    a = M.build(old, ["o_orderkey"], depth=3)
    b = M.build(new, ["o_orderkey"], depth=a.depth)
    found = M.compare(a, b)
    few = found.read <= 2 * (1 + 16 + 5 * 16 + 5 * 16)  # nodes read: of 2 * 4,369
    return M.changes(old, new, a, found).select("o_orderkey", "change", F.lit(few).alias("few"))


@query("v8_manifest_nodes", "SELECT substr(sha256(concat('key|', length(CAST(o_orderkey AS VARCHAR)), ':', o_orderkey)), 1, 2) AS prefix, count(*) AS n FROM orders GROUP BY ALL")
def _(s: Source):
    return M.build(s.orders, ["o_orderkey"], depth=3).nodes(2).select("prefix", "n")
