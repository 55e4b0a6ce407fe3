"""Queries of filters and predicates (P) and of scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.operators import predicates as P
from evidentia.registry import Source, query

KINDS = ("click", "view", "purchase", "signup", "error")


def fields(f):
    """Facts with typed fields: k (integer in props), kind (tag) and amount (absent below 5)."""
    k = F.get_json_object("props", "$.k")
    return f.select(
        "fact_id", "kind", "scope_id", "ordinal", "confidence",
        F.struct(F.lit("integer").alias("t"), k.alias("v")).alias("k"),
        F.struct(F.lit("tag").alias("t"), F.col("kind").alias("v")).alias("tag"),
        F.when(F.col("value") >= 5, F.struct(F.lit("string").alias("t"), F.floor("value").cast("string").alias("v"))).alias("amount"),
    )


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query("p1_field_eq", f"SELECT fact_id, kind FROM facts WHERE {K} = 7", "facts")
def _(s: Source):
    f = fields(s.facts)
    return f.where(P.field_eq(f.k, P.typed("integer", 7))).select("fact_id", "kind")


@query("p1_field_eq_missing", "SELECT fact_id FROM facts WHERE value >= 5 AND floor(value) = 20", "facts")
def _(s: Source):
    f = fields(s.facts)
    return f.where(P.field_eq(f.amount, P.typed("string", 20)) & ~P.field_eq(f.amount, P.typed("integer", 20))).select("fact_id")


@query("p2_field_in", f"SELECT fact_id, scope_id FROM facts WHERE {K} IN (3, 5, 8)", "facts")
def _(s: Source):
    f = fields(s.facts)
    return f.where(P.field_in(f.k, [P.typed("integer", x) for x in (3, 5, 8)])).select("fact_id", "scope_id")


@query("p3_same_scope", "SELECT a.fact_id AS left_id, b.fact_id AS right_id FROM facts a JOIN facts b ON a.scope_id = b.scope_id WHERE a.kind = 'signup' AND b.kind = 'purchase'", "facts")
def _(s: Source):
    f = s.facts
    a, b = f.where("kind = 'signup'").alias("a"), f.where("kind = 'purchase'").alias("b")
    user = F.lit("user")
    return a.join(b, P.same_scope(user, F.col("a.scope_id"), user, F.col("b.scope_id"), "user", ("user", "session")) & (F.col("a.scope_id") == F.col("b.scope_id"))).select(F.col("a.fact_id").alias("left_id"), F.col("b.fact_id").alias("right_id"))


@query("p4_ordered_relation", "SELECT a.fact_id AS left_id, b.fact_id AS right_id FROM facts a JOIN facts b ON a.scope_id = b.scope_id AND a.ordinal < b.ordinal WHERE a.kind = 'error' AND b.kind = 'purchase'", "facts")
def _(s: Source):
    f = s.facts.withColumn("o", F.struct(F.lit("integer").alias("t"), F.col("ordinal").cast("string").alias("v")))
    a, b = f.where("kind = 'error'").alias("a"), f.where("kind = 'purchase'").alias("b")
    return a.join(b, (F.col("a.scope_id") == F.col("b.scope_id")) & P.ordered(F.col("a.o"), F.col("b.o"), "before")).select(F.col("a.fact_id").alias("left_id"), F.col("b.fact_id").alias("right_id"))


@query("p5_control_flow_semi", "SELECT fact_id FROM facts a WHERE kind = 'purchase' AND EXISTS (SELECT 1 FROM facts b WHERE b.kind = 'click' AND b.scope_id = a.scope_id AND b.ordinal = a.ordinal - 1)", "facts")
def _(s: Source):
    f = s.facts
    flow = f.where("kind = 'click'").select(F.col("scope_id").alias("s2"), (F.col("ordinal") + 1).alias("o2"))
    return f.where("kind = 'purchase'").join(flow, (F.col("scope_id") == F.col("s2")) & (F.col("ordinal") == F.col("o2")), "left_semi").select("fact_id")


CONDITION = "CASE WHEN c_mktsegment = 'BUILDING' THEN 2 WHEN c_nationkey >= 20 THEN 1 ELSE 0 END"


@query(
    "p7_p8_conditions",
    """SELECT c_custkey, CAST(greatest(CASE WHEN c_nationkey >= 20 THEN 1 WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 ELSE 2 END,
        CASE WHEN c_mktsegment = 'FURNITURE' THEN 2 ELSE 0 END, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS truth FROM customer""",
)
def _(s: Source):
    context = {"segment": None, "game": ["main"], "family": ["building", "machinery"]}
    own = F.when(F.col("c_nationkey") >= 20, P.condition("segment", F.lit("x"), context, ("segment",))).otherwise(P.condition("family", S.ascii_fold(F.col("c_mktsegment")), context, ("family",)))
    other = P.condition("not_game", F.when(F.col("c_mktsegment") == "FURNITURE", "main").otherwise("other"), context, ("game",))
    broken = P.condition("game", F.when(F.col("c_custkey") % 7 == 0, "9bad").otherwise("main"), context, ("game",))
    return s.customer.select("c_custkey", P.conjunction(own, other, broken).alias("truth"))


@query("p9_inline_clauses", "SELECT p_partkey, concat(p_name, '.lua') AS path, CAST(1 AS BIGINT) AS n, p_type AS clause FROM part WHERE p_size > 5 UNION ALL SELECT p_partkey, concat('main/', p_name), 0, '' FROM part WHERE p_size <= 5")
def _(s: Source):
    line = F.when(F.col("p_size") > 5, F.concat("p_name", F.lit(".lua ["), "p_type", F.lit("]"))).otherwise(F.concat(F.lit("[Game]/"), "p_name"))
    text = P.substitute(line, {"Game": "main"})
    plain, clauses = P.inline_clauses(text)
    return s.part.select("p_partkey", plain.alias("path"), F.size(clauses).cast("long").alias("n"), F.array_join(clauses, "|").alias("clause"))


@query("p10_confidence_ceiling", "SELECT relation, count(*) AS n FROM edges WHERE confidence <= 1 GROUP BY relation", "edges")
def _(s: Source):
    return s.edges.where("confidence <= 1").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("p11_relation_filter", "SELECT edge_id, src, dst FROM edges WHERE relation IN ('contains', 'owned_by')", "edges")
def _(s: Source):
    wanted = ["contains", "owned_by"]
    P.require_known(wanted, ("contains", "owned_by", "owns", "uses", "supplied_by"), "relations")
    return s.edges.where(F.col("relation").isin(wanted)).select("edge_id", "src", "dst")


@query("p12_entity_kinds", "SELECT node_id, kind FROM nodes WHERE kind IN ('region', 'supplier')", "nodes")
def _(s: Source):
    wanted = ["region", "supplier"]
    P.require_known(wanted, ("region", "nation", "customer", "supplier", "part", "order"), "entity kinds")
    return s.nodes.where(F.col("kind").isin(wanted)).select("node_id", "kind")


def apis(s: Source):
    """One row an order, its lines as ordered fields."""
    return s.members.groupBy("api").agg(F.array_sort(F.collect_list(F.struct("position", "original_type", "nilable"))).alias("fields"))


@query("p14_field_shape", "SELECT a.api FROM members a JOIN members b ON a.api = b.api WHERE a.position = 0 AND a.original_type = 'N' AND b.position = 2 AND b.nilable", "members")
def _(s: Source):
    shapes = [{"position": 0, "original_type": "N"}, {"position": 2, "nilable": True}]
    return apis(s).where(P.all_fields(F.col("fields"), shapes)).select("api")


@query("p19_enabled_codes", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup')")
def _(s: Source):
    enabled, off = ["error", "signup"], False
    return s.events.where(F.col("event_type").isin(enabled) & F.lit(not off)).select("event_id", "event_type")


@query("p21_namespace_relevance", "SELECT DISTINCT p_name FROM part WHERE split_part(p_name, ' ', 1) IN (SELECT DISTINCT split_part(p_name, ' ', 1) FROM part WHERE p_size = 50)")
def _(s: Source):
    space = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    known = s.part.where("p_size = 50").select(space(F.col("p_name")).alias("ns")).distinct()
    return s.part.select("p_name").distinct().withColumn("ns", space(F.col("p_name"))).join(known, "ns", "left_semi").select("p_name")


@query("p22_span_containment", "SELECT a.span_id AS outer_id, b.span_id AS inner_id FROM spans a JOIN spans b ON a.span_id <> b.span_id AND a.span_start <= b.span_start AND b.span_end <= a.span_end", "spans")
def _(s: Source):
    a, b = s.spans, s.spans.select(F.col("span_id").alias("inner_id"), F.col("span_start").alias("at"), F.col("span_end").alias("inner_end"))
    hit = P.stabbing(a, b, 512)
    return hit.where(P.contained(F.col("at"), F.col("inner_end"), F.col("span_start"), F.col("span_end")) & (F.col("span_id") != F.col("inner_id"))).select(F.col("span_id").alias("outer_id"), "inner_id")


@query("f1_prefix", "SELECT DISTINCT p_name FROM part WHERE starts_with(p_name, 'sm')")
def _(s: Source):
    return s.part.where(S.prefix_match(F.col("p_name"), "sm")).select("p_name").distinct()


NAMES = "SELECT DISTINCT p_name FROM part"


@query("f2_bounded_distance", f"WITH n AS ({NAMES}) SELECT p_name, CASE WHEN abs(length(p_name) - 10) <= 4 AND levenshtein(p_name, 'small ring') <= 4 THEN CAST(levenshtein(p_name, 'small ring') AS INTEGER) END AS distance FROM n")
def _(s: Source):
    return s.part.select("p_name").distinct().select("p_name", S.bounded_distance(F.col("p_name"), F.lit("small ring"), 4).alias("distance"))


@query("f3_ascii_fold", "SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents")
def _(s: Source):
    return s.documents.select("doc_id", S.ascii_fold(F.col("text")).alias("folded"))


@query("f5_binary_equality", "SELECT p_partkey FROM part WHERE p_name = 'small ring'")
def _(s: Source):
    return s.part.where(F.col("p_name") == "small ring").select("p_partkey")


@query("f6_content_digest", "SELECT p_partkey, sha256(concat('part|', length(p_name), ':', p_name, length(p_brand), ':', p_brand)) AS digest FROM part")
def _(s: Source):
    return s.part.select("p_partkey", S.content_digest(F.col("p_name"), F.col("p_brand"), domain="part").alias("digest"))


@query("f8_normal_path", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat('a/', p_name) END AS path FROM part")
def _(s: Source):
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("../"), "p_name")).otherwise(F.concat(F.lit("a\\.//"), "p_name"))
    return s.part.select("p_partkey", S.normal_path(raw).alias("path"))


@query("f9_name_list", "SELECT DISTINCT p_name, len(list_filter(regexp_split_to_array(p_name, '[,\\s]+'), lambda x: x <> '')) AS n FROM part")
def _(s: Source):
    return s.part.select("p_name").distinct().select("p_name", F.size(S.name_list(F.col("p_name"))).cast("long").alias("n"))


@query("f10_interface_list", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size % 10 = 3 END AS compatible FROM part")
def _(s: Source):
    value = F.when(F.col("p_size") % 10 == 0, "110200, x").otherwise(F.concat(F.lit("110200, "), (F.col("p_size") % 10).cast("string")))
    return s.part.select("p_partkey", S.interface_matches(value, 3).alias("compatible"))


@query("f11_atoms", "SELECT c_custkey, regexp_full_match(lower(c_mktsegment), '[a-z][a-z0-9_]*') AS atom, regexp_full_match(c_name, '[a-z]{2}[A-Z]{2}') AS locale FROM customer")
def _(s: Source):
    return s.customer.select("c_custkey", S.is_atom(F.lower("c_mktsegment")).alias("atom"), S.is_locale(F.col("c_name")).alias("locale"))


@query("f12_saved_names", """WITH n AS (SELECT p_partkey, unnest(string_split_regex(concat(p_type, ', ', p_brand, ',  ', p_name), '[,\\s]+')) AS name FROM part)
    SELECT p_partkey, count(*) FILTER (regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*')) AS valid, count(*) FILTER (NOT regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*')) AS malformed FROM n WHERE name <> '' GROUP BY p_partkey""")
def _(s: Source):
    names = S.saved_names(F.concat("p_type", F.lit(", "), "p_brand", F.lit(",  "), "p_name"))
    count = lambda state: F.size(F.filter(names, lambda x: x["state"] == state)).cast("long")
    return s.part.select("p_partkey", count("valid").alias("valid"), count("malformed").alias("malformed"))


@query("f13_name_class", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'dynamic' WHEN p_size < 20 THEN 'unsupported' ELSE 'plain' END AS class FROM part")
def _(s: Source):
    name = F.when(F.col("p_size") < 10, F.concat(F.lit("$parent"), "p_type")).when(F.col("p_size") < 20, F.col("p_brand")).otherwise(F.col("p_type"))
    return s.part.select("p_partkey", S.name_class(name).alias("class"))


@query("f14_f15_exact_integers", "SELECT o_orderkey, CAST(o_orderkey - o_custkey AS BIGINT) AS difference, CAST(CASE WHEN o_custkey % 2 = 0 THEN o_orderkey + 255 END AS BIGINT) AS total FROM orders")
def _(s: Source):
    a, b = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    second = F.when(F.col("o_custkey") % 2 == 0, F.lit("0xFF")).otherwise(F.lit("\"255\""))
    return s.orders.select("o_orderkey", S.exact_sum(a, b, subtract=True).alias("difference"), S.exact_sum(a, second).alias("total"))


@query("f19_union_members", "SELECT p_partkey, CASE WHEN p_type < 'nil' THEN concat(p_type, ',nil') ELSE concat('nil,', p_type) END AS members FROM part")
def _(s: Source):
    return s.part.select("p_partkey", F.array_join(S.union_members(F.concat(F.lit("nil | "), "p_type", F.lit("|nil"))), ",").alias("members"))


@query("f20_identifier_grammar", "SELECT DISTINCT p_name, regexp_full_match(replace(p_name, ' ', '.'), '[a-z][a-z0-9_-]*(\\.[a-z][a-z0-9_-]*)*') AS ok FROM part")
def _(s: Source):
    return s.part.select("p_name").distinct().select("p_name", S.is_identifier(F.replace("p_name", F.lit(" "), F.lit("."))).alias("ok"))


@query("j13_interval_stabbing", "SELECT p.conv_id, p.at, s.span_id FROM (SELECT conv_id, CAST(conv_id * 137 % 40000 AS BIGINT) AS at FROM conversations WHERE turn = 0) p JOIN spans s ON s.span_start <= p.at AND p.at < s.span_end", "spans")
def _(s: Source):
    points = s.conversations.where("turn = 0").select("conv_id", (F.col("conv_id") * 137 % 40000).alias("at"))
    return P.stabbing(s.spans, points, 512).select("conv_id", "at", "span_id")
