"""Queries of retrieval (X), lookup and findings (L), storage (V), context packs (C), sources (S) and annotations (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.operators import lint as Lint
from evidentia.operators import lookup as L
from evidentia.operators import ranking as R
from evidentia.operators import retrieval as X
from evidentia.operators import storage as V
from evidentia.registry import Source, query
from evidentia.shared import new_folder
from evidentia.sources import annotations as N
from evidentia.sources import markup as Markup
from evidentia.sources import text as T


def count():
    return F.count(F.lit(1))


def parts(s: Source):
    return s.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("label"))


MIXED = X.Request("mixed", entity_id=17, text="small ring", prefix="small", enabled=("identity", "qualified_name", "prefix", "text"), required=("identity",), most=40)
SIGNALS = """SELECT 'identity' AS lane, p_partkey AS entity_id, 0 AS band FROM part WHERE p_partkey = 17 UNION ALL SELECT 'qualified_name', p_partkey, 1 FROM part WHERE p_name = 'small ring'
    UNION ALL SELECT 'prefix', p_partkey, 5 FROM part WHERE starts_with(p_name, 'small') UNION ALL SELECT 'text', p_partkey, 7 FROM part WHERE contains(concat(' ', p_name, ' '), ' small ring ')"""
RANKED = f"SELECT lane, entity_id, band, CAST(row_number() OVER (PARTITION BY lane ORDER BY entity_id) AS INTEGER) AS lane_rank FROM ({SIGNALS})"
FUSED = f"SELECT entity_id, min(band) AS band, min(lane_rank) AS best_rank, CAST(sum(1000000 // (60 + lane_rank)) AS BIGINT) AS rr, string_agg(lane, ',' ORDER BY lane) AS lanes FROM ({RANKED}) GROUP BY entity_id"
ORDERED = f"SELECT *, CAST(row_number() OVER (ORDER BY band, best_rank, 4294967295 - rr, entity_id) AS INTEGER) AS place FROM ({FUSED})"


@query("x1_exact_id", "SELECT p_partkey AS entity_id, p_name AS label FROM part WHERE p_partkey = 42")
def _(s: Source):
    return parts(s).where("entity_id = 42")


@query("x2_exact_label", "SELECT p_partkey AS entity_id, p_name AS label, 'complete' AS outcome FROM part WHERE p_name = 'red widget'")
def _(s: Source):
    return R.refuse_over(parts(s).where("label = 'red widget'"), 1_000_000)


@query("x3_literal_phrase", "SELECT p_partkey AS entity_id FROM part WHERE contains(concat(' ', p_name, ' '), ' ring ')")
def _(s: Source):
    return parts(s).where(S.has_phrase(F.col("label"), "RING")).select("entity_id")


@query("x4_fused_retrieval", f"SELECT entity_id, band, best_rank, rr, lanes, place FROM ({ORDERED}) WHERE place <= 40")
def _(s: Source):
    return X.retrieve(parts(s), MIXED).select("entity_id", "band", "best_rank", "rr", "lanes", "place")


@query("x5_lane_states", f"SELECT l.lane, CASE WHEN coalesce(n, 0) > 40 THEN 'truncated' ELSE 'complete' END AS state, coalesce(n, 0) AS matched FROM (VALUES ('identity'), ('qualified_name'), ('prefix'), ('text')) AS l(lane) LEFT JOIN (SELECT lane, count(*) AS n FROM ({SIGNALS}) GROUP BY lane) USING (lane)")
def _(s: Source):
    return X.lane_states(parts(s), MIXED)


@query("x5_overall_state", "SELECT CASE WHEN (SELECT count(*) FROM part WHERE starts_with(p_name, 'small')) > 40 THEN 'truncated' ELSE 'exact_found' END AS state, 'mixed' AS request UNION ALL SELECT 'exact_found', 'exact' UNION ALL SELECT 'exact_not_found_partial', 'absent' UNION ALL SELECT 'missing_required', 'required'")
def _(s: Source):
    requests = {
        "mixed": MIXED,
        "exact": X.Request("exact", entity_id=17, enabled=("identity",)),
        "absent": X.Request("exact", entity_id=-1, enabled=("identity",)),
        "required": X.Request("prefix", prefix="zz", enabled=("prefix", "text"), required=("text",)),
    }
    out = None
    for name, r in requests.items():
        row = X.overall_state(X.lane_states(parts(s), r), r).withColumn("request", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


LOOKUPS = "(SELECT DISTINCT p_brand AS part_id, 'small ring' AS record_key FROM part UNION SELECT DISTINCT p_brand, 'no such' FROM part UNION SELECT 'Brand#none', 'small ring')"
LOOKUP = f"""SELECT k.part_id, k.record_key, CASE WHEN r.variants > 2 THEN 'conflict' WHEN p.part_id IS NULL THEN 'unknown_partition' WHEN r.payload IS NOT NULL THEN 'found' WHEN p.complete THEN 'authoritative_absence' ELSE 'unknown' END AS outcome
    FROM {LOOKUPS} k LEFT JOIN records r ON r.part_id = k.part_id AND r.record_key = k.record_key LEFT JOIN (SELECT p_brand AS part_id, count(*) > 80 AS complete FROM part GROUP BY p_brand) p ON p.part_id = k.part_id"""


def lookups(s: Source):
    brands = s.part.select(F.col("p_brand").alias("part_id")).distinct()
    keys = brands.withColumn("record_key", F.explode(F.array(F.lit("small ring"), F.lit("no such"))))
    return keys.unionByName(s.spark.createDataFrame([("Brand#none", "small ring")], "part_id string, record_key string"))


@query("l1_reference_lookup", LOOKUP, "records")
def _(s: Source):
    coverage = s.part.groupBy(F.col("p_brand").alias("part_id")).agg((count() > 80).alias("complete"))
    return L.lookup(lookups(s), s.records, coverage, F.col("variants") > 2)


@query("x8_alias_lane", "SELECT p_brand AS target, count(*) FILTER (p_size >= 10) AS resolved, count(*) FILTER (p_size < 10) AS blocked FROM part WHERE p_name = 'small ring' GROUP BY p_brand")
def _(s: Source):
    aliases = s.part.select(F.col("p_name").alias("value"), F.col("p_brand").alias("target"), F.when(F.col("p_size") < 10, "target_missing").otherwise("resolved").alias("state"))
    return X.alias_lane(aliases, "small ring")


@query("x9_similarity_lane", "WITH n AS (SELECT p_partkey, lower(p_name) AS v FROM part) SELECT p_partkey AS entity_id, CAST(levenshtein(v, 'smal ring') AS INTEGER) AS distance FROM n WHERE abs(length(v) - 9) <= 3 AND levenshtein(v, 'smal ring') <= 3")
def _(s: Source):
    docs = s.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("short_name"))
    return X.similar(docs, ["short_name"], "Smal Ring", 3).select("entity_id", "distance")


@query("x10_shape_lane", "SELECT a.api AS entity_id, 7 AS band FROM members a JOIN members b ON a.api = b.api WHERE a.position = 0 AND a.original_type = 'R' AND b.position = 1 AND b.original_type = 'R'", "members")
def _(s: Source):
    from evidentia.operators import predicates as P

    apis = s.members.groupBy("api").agg(F.array_sort(F.collect_list(F.struct("position", "original_type", "nilable"))).alias("fields"))
    shape = P.all_fields(F.col("fields"), [{"position": 0, "original_type": "R"}, {"position": 1, "original_type": "R"}])
    return apis.where(shape).select(F.col("api").alias("entity_id"), F.lit(X.BANDS["shape"]).alias("band"))


@query("x11_documentation_lane", "SELECT doc_id AS entity_id FROM documents WHERE contains(concat(' ', array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' '), ' '), ' under the ')")
def _(s: Source):
    return s.documents.where(S.has_phrase(F.col("text"), "under the")).select(F.col("doc_id").alias("entity_id"))


FEDERATION = f"""SELECT 'live' AS universe, 0 AS priority, CAST(entity_id AS VARCHAR) AS entity_id, band, place AS ordinal FROM ({ORDERED}) WHERE place <= 40
    UNION ALL SELECT 'wiki', 1, CAST(n_nationkey AS VARCHAR), 8, CAST(n_nationkey + 1 AS INTEGER) FROM nation"""


def federation(s: Source):
    wiki = s.nation.select(F.col("n_nationkey").alias("entity_id"), F.lit(7).alias("band"), (F.col("n_nationkey") + 1).alias("place"))
    return X.federate([("live", X.retrieve(parts(s), MIXED)), ("wiki", wiki)], {"wiki": 8})


@query("x14_federation", f"SELECT universe, entity_id, band, CAST(row_number() OVER (ORDER BY band, priority, ordinal, entity_id) AS INTEGER) AS place FROM ({FEDERATION}) ORDER BY place LIMIT 50")
def _(s: Source):
    return R.top(federation(s), X.FEDERATED_ORDER, 50).select("universe", "entity_id", "band", "place")


@query("x15_federated_state", f"SELECT universe, CASE WHEN count(*) >= 40 THEN 'truncated' WHEN min(band) <= 4 THEN 'exact_found' ELSE 'candidate_only' END AS state FROM ({FEDERATION}) GROUP BY universe")
def _(s: Source):
    g = federation(s).groupBy("universe").agg(count().alias("n"), F.min("band").alias("best"))
    no = F.lit(False)
    return g.select("universe", X.federated_state(F.col("n") >= 40, no, no, F.col("best"), no).alias("state"))


@query("x17_shard_projection", "SELECT doc_id AS entity_id, source AS label, sha256(text) AS digest, strlen(text) AS byte_length FROM documents")
def _(s: Source):
    return s.documents.select(F.col("doc_id").alias("entity_id"), F.col("source").alias("label"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("byte_length"))


@query("x18_shard_validation", "SELECT 'missing' AS side, p_partkey FROM part WHERE p_size = 1 UNION ALL SELECT 'extra', p_partkey FROM part WHERE p_size = 50")
def _(s: Source):
    owner, shard = s.part.where("p_size < 50").select("p_partkey"), s.part.where("p_size > 1").select("p_partkey")
    return owner.exceptAll(shard).select(F.lit("missing").alias("side"), "p_partkey").unionByName(shard.exceptAll(owner).select(F.lit("extra").alias("side"), "p_partkey"))


@query("x20_s7_census", "SELECT lang, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(max(strlen(text)) AS BIGINT) AS largest FROM documents GROUP BY lang")
def _(s: Source):
    n = F.octet_length("text").cast("long")
    return s.documents.groupBy("lang").agg(count().alias("files"), F.sum(n).alias("bytes"), F.max(n).alias("largest"))


@query("l2_type_resolution", "SELECT p_partkey AS field_id, CASE WHEN p_brand = 'Brand#1' THEN 'unsupported' WHEN t.n IS NULL THEN 'unresolved' WHEN t.blocked THEN 'correction_blocked' WHEN t.n > 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution FROM part LEFT JOIN (SELECT c_custkey % 1500 AS k, count(*) AS n, bool_or(c_acctbal < 0) AS blocked FROM customer GROUP BY ALL) t ON t.k = p_partkey")
def _(s: Source):
    fields = s.part.select(F.col("p_partkey").alias("field_id"), F.col("p_partkey").alias("type_name"), F.when(F.col("p_brand") == "Brand#1", "function").otherwise("named").alias("shape"))
    return L.resolve_types(fields, s.customer.select((F.col("c_custkey") % 1500).alias("type_name"), (F.col("c_acctbal") < 0).alias("blocked")))


CONSTANTS = """WITH RECURSIVE c AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE (n_nationkey * 5 + 3) % 28 END AS ref, n_nationkey * 10 AS own FROM nation),
    w(id, here, total, depth) AS (SELECT id, id, 0, 0 FROM c UNION ALL SELECT w.id, c.ref, w.total + c.own, w.depth + 1 FROM w JOIN c ON c.id = w.here WHERE w.depth < 48 AND c.ref IS NOT NULL)"""


@query("l3_constants", CONSTANTS + """, last AS (SELECT id, max(depth) AS depth FROM w GROUP BY id) SELECT w.id, CASE WHEN w.depth >= 48 THEN 'cycle' WHEN c.id IS NULL THEN 'unresolved' ELSE 'resolved' END AS state,
    CASE WHEN w.depth < 48 AND c.id IS NOT NULL THEN CAST(w.total + c.own AS BIGINT) END AS value FROM w JOIN last USING (id, depth) LEFT JOIN c ON c.id = w.here""")
def _(s: Source):
    c = s.nation.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 6 != 0, (F.col("n_nationkey") * 5 + 3) % 28).alias("ref"), (F.col("n_nationkey") * 10).cast("long").alias("own"))
    return L.constants(c)


@query("l4_corrections", """SELECT p_partkey AS name, p_brand AS source, CASE WHEN state = 'corrected' THEN 'patched' ELSE p_name END AS value, state FROM (SELECT *, CASE WHEN p_partkey % 10 = 3 AND p_partkey % 3 = 0 THEN 'conflict' WHEN p_partkey % 10 = 3 AND p_brand <> 'Brand#7' THEN 'guard_failed' WHEN p_partkey % 10 = 3 AND p_size > 25 AND p_size % 3 > 0 THEN 'several_parents' WHEN p_partkey % 10 = 3 THEN 'corrected' ELSE 'original' END AS state FROM part)""")
def _(s: Source):
    patch = lambda rows: rows.select(F.col("p_partkey").alias("name"), F.lit("Brand#7").alias("guard"), F.lit("patched").alias("value"), F.when(F.col("p_size") > 25, "Base").alias("parent"))
    reviewed = s.part.where("p_partkey % 10 = 3")
    records = s.part.select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("source"), F.col("p_name").alias("value"), (F.col("p_size") % 3).alias("parents"))
    return L.corrected(records, patch(reviewed).unionByName(patch(reviewed.where("p_partkey % 3 = 0"))))


# orders as references to apis that are named after customers
LOOKUPS = """f AS (SELECT DISTINCT o_custkey % 50 AS file_id FROM orders), need AS (SELECT f.file_id, q.capability, CASE WHEN f.file_id % 8 = 0 AND q.capability = 'refs' THEN NULL WHEN f.file_id % 10 = 1 THEN 'failed' WHEN f.file_id % 9 = 2 AND q.capability = 'calls' THEN 'partial' ELSE 'complete' END AS state FROM f, (VALUES ('calls'), ('refs')) AS q(capability)),
    g AS (SELECT file_id, bool_or(state IS NULL) AS missing, bool_or(state = 'failed') AS failed, bool_or(state = 'partial') AS partial FROM need GROUP BY file_id),
    pt AS (SELECT * FROM (VALUES ('p0', true, true), ('p1', true, true), ('p2', true, true), ('p3', false, true), ('p4', true, false)) AS t(part, complete, authority)),
    cat AS (SELECT c_custkey, CASE WHEN c_custkey % 19 = 0 THEN 2 ELSE 1 END AS kinds FROM customer WHERE c_custkey % 11 <> 0),
    x AS (SELECT o.o_orderkey, g.*, pt.complete, pt.authority, cat.kinds, o.o_orderstatus = 'P' AS possible, o.o_orderkey % 13 = 0 AS dynamic, o.o_orderkey % 17 = 0 AS stale FROM orders o LEFT JOIN g ON g.file_id = o.o_custkey % 50 LEFT JOIN pt ON pt.part = concat('p', o.o_custkey % 6) LEFT JOIN cat ON cat.c_custkey = o.o_custkey),
    v AS (SELECT o_orderkey AS fact_id, kinds IS NULL AS absent, list_filter([CASE WHEN missing THEN 'missing_capability' END, CASE WHEN failed THEN 'failed_capability' END, CASE WHEN partial OR (kinds IS NULL AND complete IS NOT NULL AND NOT (complete AND authority)) THEN 'partial_coverage' END, CASE WHEN complete IS NULL THEN 'reference_partition_missing' END,
      CASE WHEN kinds > 1 THEN 'reference_conflict' END, CASE WHEN possible AND NOT dynamic THEN 'ambiguous_reference' END, CASE WHEN dynamic THEN 'unsupported_fact_shape' END, CASE WHEN stale THEN 'stale_input' END, CASE WHEN {over} THEN 'budget_incomplete' END], lambda b: b IS NOT NULL) AS blockers FROM x)"""
VERDICT = "CASE WHEN len(blockers) > 0 THEN 'not_evaluated' WHEN absent THEN 'finding' ELSE 'clean' END AS outcome"


def api_verdicts(s: Source, most: int | None = None):
    file_id = (F.col("o_custkey") % 50).alias("file_id")
    kind = F.when(F.col("o_orderkey") % 13 == 0, "dynamic").when(F.col("o_orderstatus") == "P", "possible").otherwise("resolved")
    references = s.orders.select(F.col("o_orderkey").alias("fact_id"), file_id, F.concat(F.lit("p"), F.col("o_custkey") % 6).alias("partition"), F.col("o_custkey").alias("name"), kind.alias("resolution"), F.when(F.col("o_orderkey") % 17 == 0, 1).otherwise(2).alias("generation"))
    files = s.orders.select(file_id).distinct()
    state = F.when((F.col("file_id") % 8 == 0) & (F.col("capability") == "refs"), None).when(F.col("file_id") % 10 == 1, "failed").when((F.col("file_id") % 9 == 2) & (F.col("capability") == "calls"), "partial").otherwise("complete")
    capabilities = files.select("file_id", F.explode(F.array(F.lit("calls"), F.lit("refs"))).alias("capability")).withColumn("state", state).where("state is not null")
    catalogue = s.customer.where("c_custkey % 11 <> 0").select(F.concat(F.lit("p"), F.col("c_custkey") % 6).alias("partition"), F.col("c_custkey").alias("name"), F.explode(F.when(F.col("c_custkey") % 19 == 0, F.array(F.lit("function"), F.lit("table"))).otherwise(F.array(F.lit("function")))).alias("kind"))
    partitions = s.spark.createDataFrame([("p0", True, True), ("p1", True, True), ("p2", True, True), ("p3", False, True), ("p4", True, False)], "partition string, complete boolean, authority boolean")
    return Lint.api_exists(references, Lint.capability_gate(files, capabilities, ["calls", "refs"]), catalogue, partitions, 2, most)


@query("l5_api_exists", "WITH " + LOOKUPS.replace("{over}", "false") + f" SELECT fact_id, {VERDICT}, array_to_string(blockers, ',') AS blockers FROM v")
def _(s: Source):
    return api_verdicts(s)


@query("l5_budget", "WITH " + LOOKUPS.replace("{over}", "o_orderkey > (SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 499 LIMIT 1)") + f" SELECT outcome, blockers, count(*) AS n FROM (SELECT {VERDICT}, array_to_string(blockers, ',') AS blockers FROM v) GROUP BY ALL")
def _(s: Source):  # 500 references are evaluated, the others say so
    return api_verdicts(s, 500).groupBy("outcome", "blockers").agg(F.count(F.lit(1)).alias("n"))


@query("l6_embedded_api_exists", """WITH b AS (SELECT page_id, strlen(split_part(html, '<script>', 1)) + 8 AS shift, split_part(split_part(html, '<script>', 2), '</script>', 1) AS body FROM pages WHERE contains(html, '<script>')),
    r AS (SELECT page_id, strlen(split_part(body, 'track(', 1)) AS s, strlen(split_part(body, 'track(', 1)) + CASE WHEN page_id % 10 = 0 THEN 5000 ELSE 5 END AS e, shift, strlen(body) AS n FROM b)
    SELECT page_id AS fact_id, CASE WHEN page_id % 7 = 3 THEN 'missing_fact_relation' WHEN e > n THEN 'outside_body' ELSE 'mapped' END AS relation, CAST(CASE WHEN page_id % 7 <> 3 AND e <= n THEN shift + s END AS BIGINT) AS file_start, CAST(CASE WHEN page_id % 7 <> 3 AND e <= n THEN shift + e END AS BIGINT) AS file_end FROM r""")
def _(s: Source):  # the scripts of pages are the bodies
    body = F.substring_index(F.split("html", "<script>", -1)[1], "</script>", 1)
    cut = s.pages.where(F.contains("html", F.lit("<script>"))).select("page_id", F.octet_length(F.substring_index("html", "<script>", 1)).cast("long").alias("before"), body.alias("body"))
    bodies = cut.where("page_id % 7 <> 3").select(F.col("page_id").alias("body_id"), F.col("page_id").alias("file_id"), (F.col("before") + 8).alias("shift"), F.octet_length("body").cast("long").alias("length"))
    start = F.octet_length(F.substring_index("body", "track(", 1)).cast("long")
    references = cut.select(F.col("page_id").alias("fact_id"), F.col("page_id").alias("body_id"), start.alias("start"), (start + F.when(F.col("page_id") % 10 == 0, 5000).otherwise(5)).alias("end"))
    return Lint.embedded(references, bodies).select("fact_id", "relation", "file_start", "file_end")


@query("l7_unguarded_use", """WITH f AS (SELECT fact_id, scope_id, kind, json_extract_string(props, '$.k') AS name, CAST(floor(value) AS BIGINT) % 3 AS v, ordinal, confidence FROM facts), u AS (SELECT * FROM f WHERE kind = 'purchase'), g AS (SELECT * FROM f WHERE kind IN ('signup', 'view')),
    j AS (SELECT u.fact_id, CAST(u.name AS INTEGER) AS k, (SELECT CASE WHEN min(CASE WHEN g.v = u.v AND g.confidence < 2 THEN g.ordinal END) < u.ordinal THEN 'dominating_exact_value' WHEN min(CASE WHEN g.v = u.v THEN g.ordinal END) >= u.ordinal THEN 'after_use' WHEN count(*) FILTER (g.v = u.v) = 0 AND count(*) > 0 THEN 'different_value' WHEN count(*) FILTER (g.v = u.v) > 0 THEN 'non_dominating' ELSE 'absent' END FROM g WHERE g.scope_id = u.scope_id AND g.name = u.name) AS guard FROM u)
    SELECT fact_id AS use_id, guard, CASE WHEN k % 4 = 3 THEN 'not_evaluated' WHEN k % 4 = 2 THEN 'clean' WHEN guard = 'dominating_exact_value' THEN 'clean' ELSE 'finding' END AS outcome, CASE WHEN k % 4 = 3 THEN 'missing_restriction_facet' END AS blocker FROM j""", "facts")
def _(s: Source):
    f = s.facts.select("fact_id", "scope_id", "kind", F.get_json_object("props", "$.k").alias("name"), (F.floor("value").cast("long") % 3).alias("value"), F.col("ordinal").alias("place"), (F.col("confidence") < 2).alias("dominates"))
    uses = f.where("kind = 'purchase'").withColumnRenamed("fact_id", "use_id")
    k = F.col("name").cast("int") % 4
    facets = f.select("name").distinct().where(k != 3).select("name", (k != 2).alias("restricted"))
    return Lint.unguarded_use(uses.drop("kind", "dominates"), f.where("kind in ('signup', 'view')").drop("kind", "fact_id"), facets)


@query("l11_v8_integrity", "SELECT relation, side, count(*) AS dangling FROM (SELECT relation, 'dst' AS side, dst AS id FROM edges UNION ALL SELECT relation, 'src', src FROM edges) WHERE id NOT IN (SELECT node_id FROM nodes WHERE kind <> 'region') GROUP BY relation, side", "nodes edges")
def _(s: Source):
    ends = s.edges.select("relation", F.explode(F.array(F.struct(F.lit("dst").alias("side"), F.col("dst").alias("id")), F.struct(F.lit("src").alias("side"), F.col("src").alias("id")))).alias("e")).select("relation", "e.side", F.col("e.id").alias("node_id"))
    return ends.join(s.nodes.where("kind <> 'region'"), "node_id", "left_anti").groupBy("relation", "side").agg(count().alias("dangling"))


OBJECTS = "SELECT sha256(concat(p_partkey, ':', p_name)) AS object_id, p_partkey FROM part"


@query("v1_s13_objects", f"SELECT object_id FROM ({OBJECTS}) WHERE p_partkey IN (3, 7)")
def _(s: Source):
    return V.objects(s.part).where("p_partkey in (3, 7)").select("object_id")


@query("v2_operation_replay", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'conflict' WHEN p_partkey % 2 = 0 THEN 'replayed' ELSE 'new' END AS outcome FROM part")
def _(s: Source):
    journal = s.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("operation"), F.concat("p_name", F.lit("")).alias("digest"))
    asked = s.part.select(F.col("p_partkey").alias("operation"), F.when(F.col("p_partkey") % 4 == 0, "other").otherwise(F.col("p_name")).alias("digest"))
    return V.replay(asked, journal).select(F.col("operation").alias("p_partkey"), "outcome")


@query("v4_object_gc", "SELECT p_partkey, more FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r, count(*) OVER () > 50 AS more FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01 00:00:00')) WHERE r <= 50")
def _(s: Source):
    catalog = s.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    leases = s.orders.where("o_orderdate > timestamp'1997-01-01 00:00:00'").select(F.col("o_orderkey").alias("p_partkey"))
    return R.top(V.unreferenced(s.part.select("p_partkey"), "p_partkey", catalog, leases), ["p_partkey"], 50).select("p_partkey", "more")


@query("c6_render_trace", "SELECT conv_id, turn, CAST(sum(strlen(text)) OVER w - strlen(text) AS BIGINT) AS byte_start, CAST(sum(strlen(text)) OVER w AS BIGINT) AS byte_end FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(s: Source):
    return R.cumulative_bytes(s.conversations, ["conv_id"], ["turn"], F.octet_length("text")).select("conv_id", "turn", "byte_start", "byte_end")


@query("c8_excerpt_digest", "SELECT doc_id, CAST(i AS INTEGER) AS line, sha256(l) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)")
def _(s: Source):  # every line of every text is an excerpt
    return s.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).select("doc_id", (F.col("i") + 1).alias("line"), F.sha2("l", 256).alias("digest"))


@query("s4_manifest_lines", """SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, CASE WHEN trim(l) = '' THEN 'blank' WHEN starts_with(l, '##') THEN 'metadata' WHEN starts_with(l, '#') THEN 'comment' ELSE 'file' END AS kind,
    CAST(sum(strlen(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - strlen(l) - 1 AS BIGINT) AS byte_start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)""")
def _(s: Source):
    return T.manifest_lines(s.documents, "doc_id", "text").select("doc_id", "line", "kind", "byte_start")


@query("s2_pinned_read", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'digest_mismatch' ELSE 'ok' END AS state FROM documents")
def _(s: Source):
    pins = s.documents.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("expected"))
    return T.pinned(s.documents, pins, "doc_id", "text")


@query("s1_inventory", "SELECT CAST(strlen(n_name) + 1 AS BIGINT) AS length, sha256(concat(n_name, chr(10))) AS digest FROM nation")
def _(s: Source):  # a file for each nation
    folder = new_folder(s.spark, "inventory")
    s.nation.select("n_name", "n_nationkey").write.partitionBy("n_nationkey").mode("append").text(folder)
    return T.inventory(s.spark, folder, "*.txt").select("length", "digest")


@query("s3_strict_json", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'repeated_key' WHEN event_id % 11 = 0 THEN 'float' WHEN event_id % 13 = 0 THEN 'null' WHEN event_id % 17 = 0 THEN 'invalid' ELSE 'ok' END AS state,
    CASE WHEN event_id % 7 > 0 AND event_id % 11 > 0 AND event_id % 13 > 0 AND event_id % 17 > 0 THEN concat('{"k":', json_extract_string(props, '$.k'), ',"type":"', event_type, '"}') END AS json FROM events""")
def _(s: Source):
    k = F.get_json_object("props", "$.k")
    head, e = F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", "k": '), k), F.col("event_id")
    text = F.when(e % 7 == 0, F.concat(head, F.lit(', "k": 1}'))).when(e % 11 == 0, F.concat(head, F.lit(".5}"))).when(e % 13 == 0, F.concat(head, F.lit(', "n": null}'))).when(e % 17 == 0, head).otherwise(F.concat(head, F.lit("}")))
    return T.strict_documents(s.events.select("event_id", text.alias("text")), "event_id", "text")


@query("s5_xml_elements", "SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs FROM pages WHERE contains(html, '<p>')")
def _(s: Source):
    els = Markup.elements(s.pages, "page_id", "html", html=True)
    return els.where("tag = 'p'").groupBy("page_id").agg(count().alias("paragraphs"))


@query("s8_s9_api_documents", "SELECT l_orderkey AS api, count(*) AS arguments, count(*) FILTER (l_linestatus = 'O') AS nilable FROM lineitem GROUP BY l_orderkey")
def _(s: Source):
    rows = s.members.groupBy("api").agg(F.array_sort(F.collect_list(F.struct("position", "original_type", "nilable"))).alias("args"))
    literal = F.concat(F.lit("{ Name = \"A"), F.col("api").cast("string"), F.lit("\", Arguments = { "), F.array_join(F.transform("args", lambda a: F.concat(F.lit("{ Type = \""), a["original_type"], F.lit("\", Nilable = "), a["nilable"].cast("string"), F.lit(" }"))), ", "), F.lit(" } }"))
    parsed = T.data_literals(rows.select("api", literal.alias("text")), "api", "text")
    return parsed.groupBy("api").agg(F.count_if(F.col("path").rlike(r"^Arguments\.[0-9]+\.Type$")).alias("arguments"), F.count_if(F.col("path").rlike(r"^Arguments\.[0-9]+\.Nilable$") & (F.col("value") == "true")).alias("nilable"))


@query("s10_s11_json_import", "SELECT event_id, event_type AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS target FROM events WHERE value > 50")
def _(s: Source):
    doc = s.events.where("value > 50").select("event_id", F.to_json(F.struct(F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("long").alias("target"))).alias("doc"))
    return doc.select("event_id", F.from_json("doc", "name string, target bigint").alias("d")).select("event_id", "d.name", "d.target")


@query("n1_stubs", "SELECT api, concat('---@class A', api, chr(10), string_agg(concat('---@field a', position, ' ', original_type, CASE WHEN nilable THEN '?' ELSE '' END), chr(10) ORDER BY position)) AS stub FROM members GROUP BY api", "members")
def _(s: Source):
    return N.stubs(s.members)


@query("n2_source_map", "SELECT api, position, CAST(sum(length(concat('---@field a', position, ' ', original_type, CASE WHEN nilable THEN '?' ELSE '' END)) + 1) OVER (PARTITION BY api ORDER BY position) AS BIGINT) AS byte_end FROM members", "members")
def _(s: Source):
    return N.source_map(s.members).select("api", "position", "byte_end")


@query("f16_positions", """SELECT doc_id, unit, CAST(len(string_split(text, chr(10))) - 1 AS BIGINT) AS line, CAST(CASE unit WHEN 'utf-8' THEN strlen(list_last(string_split(text, chr(10)))) WHEN 'utf-32' THEN length(list_last(string_split(text, chr(10)))) ELSE length(list_last(string_split(text, chr(10)))) + len(regexp_extract_all(list_last(string_split(text, chr(10))), '[^\\x{0000}-\\x{FFFF}]')) END AS BIGINT) AS character
    FROM documents, (VALUES ('utf-8'), ('utf-16'), ('utf-32')) AS u(unit)""")
def _(s: Source):  # the end of every whole text, in three units
    from evidentia.functions.positions import positions

    d = s.documents.select("doc_id", "text", F.octet_length("text").cast("long").alias("at"))
    units = [positions(d, "text", "at", unit).select("doc_id", F.lit(unit).alias("unit"), "line", "character") for unit in ("utf-8", "utf-16", "utf-32")]
    return units[0].unionByName(units[1]).unionByName(units[2])


@query("s18_token_table", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w AS token FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w, unnest(generate_series(1, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')))) AS i FROM documents)")
def _(s: Source):
    return s.documents.select("doc_id", F.posexplode(S.word_tokens(F.col("text"))).alias("pos", "token"))


@query("s14_s15_v5_published_version", "SELECT p_partkey, p_name FROM part WHERE p_size > 25")
def _(s: Source):
    store = V.VersionStore(s.spark, new_folder(s.spark, "versions"))
    first = store.prepare(s.part.where("p_size <= 25").select("p_partkey", "p_name"))
    store.validate(first)
    store.activate(first, None)
    second = store.prepare(s.part.where("p_size > 25").select("p_partkey", "p_name"))
    store.validate(second)
    store.activate(second, first)
    store.collect(set(), 10)
    return store.read()


@query("s17_stub_sink", "SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT l_orderkey, count(*) + 1 AS n FROM lineitem GROUP BY l_orderkey)")
def _(s: Source):
    folder = f"{new_folder(s.spark, 'stubs')}/all"
    N.stubs(s.members).select("stub").write.text(folder, lineSep="\n\n")
    back = s.spark.read.text(folder, lineSep="\n\n").where("value <> ''")
    return back.agg(count().alias("files"), F.sum(F.size(F.split("value", "\n"))).cast("long").alias("lines"))


@query("k6_page_fixpoint", "SELECT CAST(page AS BIGINT) AS page, CAST(total AS BIGINT) AS bytes FROM (SELECT page, s + CASE WHEN s + 2 < 100 THEN 2 ELSE 3 END AS total FROM (SELECT r // 10 AS page, sum(length(p_name)) AS s FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part) GROUP BY r // 10))")
def _(s: Source):
    sizes = R.numbered(s.part.select("p_partkey", F.octet_length("p_name").alias("b")), "p_partkey").groupBy(F.floor(F.col("r") / 10).alias("page")).agg(F.sum("b").cast("long").alias("content"))
    fix = F.element_at(F.filter(F.sequence(F.lit(1), F.lit(8)), lambda d: F.length((F.col("content") + d).cast("string")) == d), 1)
    return sizes.select("page", (F.col("content") + fix).alias("bytes"))
