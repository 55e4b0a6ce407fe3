"""Queries of the rule matcher (R): packs over the events as facts, and recognizers as packs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.plans import budgets as B
from evidentia.plans import recognizers as N
from evidentia.plans import rules as R
from evidentia.plans import shared as P
from evidentia.plans import structure as Structure
from evidentia.registry import Source, query
from evidentia.sources import markup as Markup

COVERAGE = {"events": "complete", "errors": "partial", "broken": "failed"}


def facts(s: Source):
    """Events as facts of scope user with fields k (integer), ordinal (integer) and amount (string, absent below 5)."""
    f = s.facts
    k = F.get_json_object("props", "$.k")
    field = lambda t, v: F.struct(F.lit(t).alias("t"), v.cast("string").alias("v"))
    fields = F.create_map(F.lit("k"), field("integer", k), F.lit("ordinal"), field("integer", F.col("ordinal")), F.lit("user"), field("reference", F.col("scope_id")), F.lit("amount"), F.when(F.col("value") >= 5, field("string", F.floor("value"))))
    return f.select("fact_id", "kind", F.lit("user").alias("scope_kind"), "scope_id", "confidence", fields.alias("fields"))


def pack(rule_id: str, clauses: list, captures: dict | None = None, key: list | None = None, needs: list | None = None):
    rule = {"rule_id": rule_id, "clauses": clauses, "captures": [{"name": n, "value": v} for n, v in (captures or {}).items()], "key": key or [], "required_capabilities": needs or []}
    return R.compile_pack({"pack_id": "own", "rules": [rule]})


def fact(alias: str, kind: str) -> dict:
    return {"fact": {"alias": alias, "kind": kind}}


def scope(a: str, b: str) -> dict:
    return {"same_scope": {"left": a, "right": b, "scope": "user"}}


def order(a: str, b: str, relation: str = "before") -> dict:
    return {"ordered": {"left": f"{a}.ordinal", "right": f"{b}.ordinal", "relation": relation}}


def join(a: str, b: str) -> dict:
    return {"join": {"left": f"{a}.k", "right": f"{b}.k"}}


def run(s: Source, p, coverage: dict | None = None):
    return R.run_pack(p, facts(s), coverage or COVERAGE)


K = "json_extract_string(props, '$.k')"
F_ = f"f AS (SELECT fact_id, kind, scope_id, confidence, ordinal, {K} AS k, value FROM facts)"
#: confidence and sorted witnesses of a binary match, as the matcher gives them
PAIR = """CASE WHEN a.confidence < 2 AND b.confidence < 2 AND count(*) OVER (PARTITION BY {key}) = 1 THEN 'proven' ELSE 'possible' END AS confidence,
    array_to_string(list_sort(list_distinct([CAST(a.fact_id AS VARCHAR), CAST(b.fact_id AS VARCHAR)])), ',') AS witnesses"""
IDS = "concat(a.fact_id, '/', b.fact_id)"


def pair_sql(rule: str, a: str, b: str, on: str, key: str = IDS, captures: str = "''") -> str:
    return f"WITH {F_} SELECT '{rule}' AS rule_id, {key} AS match_key, {captures} AS captures, {PAIR.format(key=key)} FROM f a JOIN f b ON {on} WHERE a.kind = '{a}' AND b.kind = '{b}'"


@query("r3_join_rule", pair_sql("join", "signup", "purchase", "a.scope_id = b.scope_id AND a.k = b.k", captures="concat('k=', a.k)"), "facts")
def _(s: Source):
    return run(s, pack("join", [fact("a", "signup"), fact("b", "purchase"), scope("a", "b"), join("a", "b")], {"k": "a.k"}))


@query("r3_ordered_rule", pair_sql("ordered", "error", "purchase", "a.scope_id = b.scope_id AND a.ordinal < b.ordinal AND b.k IN ('3', '4')"), "facts")
def _(s: Source):
    return run(s, pack("ordered", [fact("a", "error"), fact("b", "purchase"), {"field_in": {"field": "b.k", "literals": [["integer", 3], ["integer", 4]]}}, scope("a", "b"), order("a", "b")]))


@query("r5_not_exists_rule", f"""WITH {F_} SELECT 'never_bought' AS rule_id, CAST(a.fact_id AS VARCHAR) AS match_key, concat('k=', a.k) AS captures, CAST(a.fact_id AS VARCHAR) AS witnesses,
    CASE WHEN a.confidence < 2 THEN 'proven' ELSE 'possible' END AS confidence FROM f a WHERE a.kind = 'signup' AND NOT EXISTS (SELECT 1 FROM f b WHERE b.kind = 'purchase' AND b.scope_id = a.scope_id AND b.ordinal > a.ordinal)""", "facts")
def _(s: Source):
    return run(s, pack("never_bought", [fact("a", "signup"), {"not_exists": {"capability": "events", "clauses": [fact("b", "purchase"), scope("a", "b"), order("a", "b")]}}], {"k": "a.k"}))


@query("r5_any_of_rule", f"""WITH {F_}, w AS (
      SELECT a.fact_id AS aid, b.fact_id AS wid, a.confidence < 2 AND b.confidence < 2 AS x FROM f a JOIN f b ON a.scope_id = b.scope_id AND a.k = b.k WHERE a.kind = 'click' AND b.kind = 'error'
      UNION ALL SELECT a.fact_id, b.fact_id, a.confidence < 2 AND b.confidence < 2 FROM f a JOIN f b ON a.scope_id = b.scope_id AND a.k = b.k WHERE a.kind = 'click' AND b.kind = 'view')
    SELECT 'either' AS rule_id, CAST(aid AS VARCHAR) AS match_key, '' AS captures, CASE WHEN bool_or(x) AND (SELECT confidence FROM f WHERE fact_id = aid) < 2 THEN 'proven' ELSE 'possible' END AS confidence,
      array_to_string(list_sort(list_distinct(list_append(list(CAST(wid AS VARCHAR)), CAST(aid AS VARCHAR)))), ',') AS witnesses FROM w GROUP BY aid""", "facts")
def _(s: Source):
    return run(s, pack("either", [fact("a", "click"), {"any_of": [[fact("b", "error"), scope("a", "b"), join("a", "b")], [fact("c", "view"), scope("a", "c"), join("a", "c")]]}]))


@query("r5_exists_rule", pair_sql("witnessed", "view", "error", "a.scope_id = b.scope_id AND a.k = b.k AND a.k = '5'"), "facts")
def _(s: Source):
    return run(s, pack("witnessed", [fact("a", "view"), {"field_eq": {"field": "a.k", "literal": ["integer", 5]}}, {"exists": [fact("b", "error"), scope("a", "b"), join("a", "b")]}]))


@query("r5_all_of_rule", f"""WITH {F_} SELECT 'triple' AS rule_id, concat(a.fact_id, '/', b.fact_id, '/', c.fact_id) AS match_key, '' AS captures,
      CASE WHEN a.confidence < 2 AND b.confidence < 2 AND c.confidence < 2 THEN 'proven' ELSE 'possible' END AS confidence, array_to_string(list_sort([CAST(a.fact_id AS VARCHAR), CAST(b.fact_id AS VARCHAR), CAST(c.fact_id AS VARCHAR)]), ',') AS witnesses
    FROM f a JOIN f b ON a.scope_id = b.scope_id AND a.ordinal < b.ordinal JOIN f c ON c.scope_id = b.scope_id AND c.k = b.k WHERE a.kind = 'signup' AND b.kind = 'click' AND c.kind = 'purchase' AND a.k = '7'""", "facts")
def _(s: Source):
    return run(s, pack("triple", [fact("a", "signup"), {"field_eq": {"field": "a.k", "literal": ["integer", 7]}}, {"all_of": [fact("b", "click"), scope("a", "b"), order("a", "b"), fact("c", "purchase"), scope("b", "c"), join("b", "c")]}]))


@query("r4_r3_outcomes", """SELECT * FROM (VALUES ('gated', 'not_evaluated', CAST(0 AS BIGINT)), ('refused_negation', 'not_evaluated', 0), ('unconnected', 'not_evaluated', 0), ('none', 'evaluated_no_match', 0)) AS t(rule_id, outcome, matches)
    UNION ALL SELECT 'partly', 'partial', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'all', 'matched', count(*) FROM events WHERE event_type = 'click'""")
def _(s: Source):
    rules = [
        {"rule_id": "gated", "clauses": [fact("a", "click")], "required_capabilities": ["broken"]},
        {"rule_id": "refused_negation", "clauses": [fact("a", "click"), {"not_exists": {"capability": "errors", "clauses": [fact("b", "error"), scope("a", "b")]}}]},
        {"rule_id": "unconnected", "clauses": [fact("a", "click"), fact("b", "view")]},
        {"rule_id": "none", "clauses": [fact("a", "missing")], "required_capabilities": ["events"]},
        {"rule_id": "partly", "clauses": [fact("a", "error")], "required_capabilities": ["errors"]},
        {"rule_id": "all", "clauses": [fact("a", "click")], "required_capabilities": ["events"]},
    ]
    return R.outcomes(R.compile_pack({"pack_id": "gates", "rules": rules}), facts(s), COVERAGE)


@query("r3_cancelled", "SELECT * FROM (VALUES ('second', 'cancelled', CAST(0 AS BIGINT)), ('third', 'cancelled', 0)) AS t(rule_id, outcome, matches) UNION ALL SELECT 'first', 'matched', count(*) FROM events WHERE event_type = 'click'")
def _(s: Source):  # cancelled after the first rule
    asked = iter([False, True, False])
    rules = [{"rule_id": name, "clauses": [fact("a", "click")]} for name in ("first", "second", "third")]
    return R.outcomes(R.compile_pack({"pack_id": "stopped", "rules": rules}), facts(s), COVERAGE, lambda: next(asked))


@query("r6_r2_ambiguous_keys", f"WITH {F_} SELECT 'keyed' AS rule_id, concat(k, '/', scope_id) AS match_key, '' AS captures, CAST(fact_id AS VARCHAR) AS witnesses, CASE WHEN confidence < 2 AND count(*) OVER (PARTITION BY k, scope_id) = 1 THEN 'proven' ELSE 'possible' END AS confidence FROM f WHERE kind = 'purchase'", "facts")
def _(s: Source):
    return run(s, pack("keyed", [fact("a", "purchase")], key=["a.k", "a"]))


FAMILIES = {"click": "calls", "view": "reads", "purchase": "writes", "signup": "registers"}


PURCHASES = f"""WITH {F_}, m AS (SELECT fact_id, k, scope_id, CASE WHEN value >= 5 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS amount, CASE WHEN confidence < 2 THEN 'derived' ELSE 'possible' END AS c FROM f WHERE kind = 'purchase')"""


def purchases(s: Source):
    rule = {"rule_id": "buys", "clauses": [fact("a", "purchase")], "captures": [{"name": "part", "value": "a.k", "cardinality": "one"}, {"name": "user", "value": "a.user", "cardinality": "one"}, {"name": "amount", "value": "a.amount", "cardinality": "optional"}, {"name": "amounts", "value": "a.amount", "cardinality": "bounded_many"}]}
    return R.compile_pack({"pack_id": "own", "rules": [rule]})


@query("p6_captures", PURCHASES + " SELECT CAST(fact_id AS VARCHAR) AS match_key, concat('part=', k, ';user=', scope_id, ';amount=', coalesce(amount, ''), ';amounts=[', coalesce(amount, ''), ']') AS captures FROM m", "facts")
def _(s: Source):
    return R.run_pack(purchases(s), facts(s), COVERAGE).select("match_key", "captures")


@query("r7_outputs", PURCHASES + " SELECT 'bought' AS output_id, CAST(fact_id AS VARCHAR) AS match_key, concat('item=', k, ';who=', scope_id) AS asserted, c AS confidence FROM m UNION ALL SELECT 'buys', CAST(fact_id AS VARCHAR), concat(scope_id, '>', k), 'possible' FROM m", "facts")
def _(s: Source):
    outputs = [{"output_id": "bought", "entity": "purchase", "key": {"who": "user", "item": "part"}}, {"output_id": "buys", "relation": "buys", "source": "user", "target": "part", "confidence": "possible"}]
    entities, relations = R.assertions(purchases(s), "buys", facts(s), COVERAGE, outputs)
    key = F.concat(F.lit("item="), F.col("key")["item"], F.lit(";who="), F.col("key")["who"])
    return entities.select("output_id", "match_key", key.alias("asserted"), "confidence").unionByName(relations.select("output_id", "match_key", F.concat_ws(">", "source", "target").alias("asserted"), "confidence"))


@query("r7_r9_proposals", PURCHASES + """, b AS (SELECT CAST(c_custkey AS VARCHAR) AS v, concat('customer:', c_custkey) AS n FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), concat('twin:', c_custkey) FROM customer WHERE c_custkey % 7 = 1), src AS (SELECT v, min(n) AS n, count(*) AS k FROM b GROUP BY v)
    SELECT CAST(fact_id AS VARCHAR) AS match_key, CASE WHEN state = 'bound' THEN s END AS src, CASE WHEN state = 'bound' THEN d END AS dst, state FROM (SELECT m.fact_id, src.n AS s, concat('part:', p_partkey) AS d, CASE WHEN src.n IS NULL THEN 'source_unbound' WHEN p_partkey IS NULL THEN 'target_unbound' WHEN src.k > 1 THEN 'ambiguous' ELSE 'bound' END AS state FROM m LEFT JOIN src ON src.v = CAST(m.scope_id AS VARCHAR) LEFT JOIN part ON p_partkey = CAST(m.k AS BIGINT))""", "facts")
def _(s: Source):
    _, relations = R.assertions(purchases(s), "buys", facts(s), COVERAGE, [{"output_id": "buys", "relation": "buys", "source": "user", "target": "part"}])
    end = lambda df, side, k, prefix: df.select(F.lit("buys").alias("relation"), F.lit(side).alias("side"), F.col(k).cast("string").alias("value"), F.concat(F.lit(prefix), k).alias("node_id"))
    customers = s.customer.where("c_custkey % 3 > 0")
    bindings = end(customers, "source", "c_custkey", "customer:").unionByName(end(s.customer.where("c_custkey % 7 = 1"), "source", "c_custkey", "twin:")).unionByName(end(s.part, "target", "p_partkey", "part:"))
    return R.bind_endpoints(relations, bindings).select("match_key", "src", "dst", "state")


# orders as calls, their lines as ordered arguments; every eleventh line is not a literal, every seventh call lacks its first line
CALL = """n AS (SELECT ['Frame.RegisterEvent', 'Frame.RegisterUnitEvent', 'CVarCallbackRegistry.RegisterCallback', 'Frame.SetScript', 'Frame.HookScript', 'hooksecurefunc', 'CreateFrame', 'Mixin', 'CreateFromMixins', 'LibStub', 'LibStub.GetLibrary', 'LibStub.NewLibrary', 'Registry.TriggerEvent', 'Registry.RegisterCallback', 'Addon.Update', 'GetTime', 'print'] AS names),
    calls AS (SELECT o_orderkey AS call_id, concat('function:', o_custkey) AS caller, names[CAST(o_orderkey * 7 % 17 AS INTEGER) + 1] AS callable, concat('frame:', o_custkey % 40) AS receiver FROM orders, n),
    ranked AS (SELECT l_orderkey AS call_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS position, l_partkey, l_suppkey FROM lineitem),
    arguments AS (SELECT call_id, position, CASE WHEN (l_partkey + l_suppkey) % 11 = 0 THEN NULL WHEN position = 1 AND l_partkey % 3 = 0 THEN CAST(l_suppkey AS VARCHAR) ELSE concat('NAME_', l_partkey % 60) END AS value FROM ranked WHERE NOT (call_id % 7 = 0 AND position = 0)),
    listed AS (SELECT c.call_id, c.caller, c.callable, c.receiver, coalesce(list(a.value ORDER BY a.position) FILTER (a.position IS NOT NULL), []) AS args, coalesce(min(a.position), 0) = 0 AS whole FROM calls c LEFT JOIN arguments a USING (call_id) GROUP BY ALL)"""
NAMES = ("Frame.RegisterEvent", "Frame.RegisterUnitEvent", "CVarCallbackRegistry.RegisterCallback", "Frame.SetScript", "Frame.HookScript", "hooksecurefunc", "CreateFrame", "Mixin", "CreateFromMixins", "LibStub", "LibStub.GetLibrary", "LibStub.NewLibrary", "Registry.TriggerEvent", "Registry.RegisterCallback", "Addon.Update", "GetTime", "print")


def calls(s: Source):
    names = F.array(*map(F.lit, NAMES))
    rows = s.orders.select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("function:"), "o_custkey").alias("caller"), names[(F.col("o_orderkey") * 7 % 17).cast("int")].alias("callable"), F.concat(F.lit("frame:"), F.col("o_custkey") % 40).alias("receiver"))
    ranked = s.lineitem.select(F.col("l_orderkey").alias("call_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1).cast("long").alias("position"), "l_partkey", "l_suppkey")
    value = F.when((F.col("l_partkey") + F.col("l_suppkey")) % 11 == 0, None).when((F.col("position") == 1) & (F.col("l_partkey") % 3 == 0), F.col("l_suppkey").cast("string")).otherwise(F.concat(F.lit("NAME_"), F.col("l_partkey") % 60))
    return N.call_facts(rows, ranked.where("not (call_id % 7 = 0 and position = 0)").select("call_id", "position", value.alias("value")))


def recipe_sql(r: N.Recipe) -> str:
    """The recipe in SQL, over listed."""
    key = f"CASE WHEN len(args) > {r.least} THEN args[{r.key + 2}] ELSE args[{r.key + 1}] END" if r.shifted else f"args[{r.key + 1}]"
    targets = f"args[{r.each + 1}:]" if r.each is not None else f"[{key}]"
    rest = f"CASE WHEN len(args) > {r.rest} THEN args[{r.rest + 1}:] END" if r.rest is not None else "CAST(NULL AS VARCHAR[])"
    number = f"TRY_CAST(args[{r.number + 1}] AS INTEGER)" if r.number is not None else "CAST(NULL AS INTEGER)"
    given = f"len(args) > {r.number}" if r.number is not None else "false"
    return f"SELECT call_id, caller, receiver, '{r.relation}' AS relation, unnest(CASE WHEN len(args) >= {r.least} AND len({targets}) > 0 THEN {targets} ELSE [NULL] END) AS target, {rest} AS rest, {number} AS number, {given} AS given, len(args) >= {r.least} AS enough, whole FROM listed WHERE callable = '{r.callable}'"


def recognized_sql(recipes) -> str:
    return f"""WITH {CALL}, raw AS ({" UNION ALL ".join(map(recipe_sql, recipes))}),
    found AS (SELECT *, CASE WHEN NOT whole THEN 'incomplete_call' WHEN NOT enough THEN 'missing_argument' WHEN target IS NULL THEN 'inexact_name' WHEN given AND number IS NULL THEN 'inexact_number' WHEN len(list_filter(rest, lambda x: x IS NULL)) > 0 THEN 'possible' ELSE 'derived' END AS state FROM raw),
    rec AS (SELECT call_id, caller, receiver, relation, CASE WHEN state IN ('derived', 'possible') THEN target END AS target, CASE WHEN state IN ('derived', 'possible') THEN coalesce(array_to_string(list_transform(rest, lambda x: coalesce(x, '?')), ','), '') END AS detail, CASE WHEN state IN ('derived', 'possible') THEN number END AS number, state FROM found)"""


def recognizer(name: str, recipes) -> None:
    @query(name, recognized_sql(recipes) + " SELECT call_id, caller, relation, target, detail, number, state FROM rec")
    def _(s: Source):
        return N.recognize(calls(s), recipes).drop("receiver")


for _name, _recipes in {"r21_event_registration": N.NATIVE_EVENTS, "r24_callbacks": N.CALLBACKS, "r25_script_hooks": N.SCRIPTS, "r27_construction": N.CONSTRUCTION, "r28_mixins": N.MIXINS, "r30_library_use": N.LIBRARIES}.items():
    recognizer(_name, _recipes)


@query("r11_call_facts", f"WITH {CALL} SELECT call_id, caller, callable, len(args) AS n, array_to_string(list_transform(args, lambda x: coalesce(x, '?')), ',') AS arguments, whole FROM listed")
def _(s: Source):
    return calls(s).select("call_id", "caller", "callable", F.size("args").cast("long").alias("n"), F.array_join(F.transform("args", lambda x: F.coalesce(x, F.lit("?"))), ",").alias("arguments"), "whole")


@query("r20_direct_calls", f"""WITH {CALL} SELECT call_id, caller, CASE callable WHEN 'Addon.Update' THEN 'calls' WHEN 'GetTime' THEN 'uses_api' END AS relation, CASE WHEN callable IN ('Addon.Update', 'GetTime') THEN callable END AS target,
    CASE WHEN callable IN ('Addon.Update', 'GetTime') THEN 'derived' WHEN callable = 'print' THEN 'ambiguous' ELSE 'unresolved' END AS state FROM calls""")
def _(s: Source):
    names = lambda *n: s.spark.createDataFrame([(x,) for x in n], "name string")
    return N.direct_calls(calls(s), names("Addon.Update", "print"), names("GetTime", "print"))


@query("r22_event_bridge", recognized_sql(N.NATIVE_EVENTS + N.SCRIPTS[:2]) + """, r AS (SELECT receiver, target, count(*) AS registrations FROM rec WHERE relation = 'registers_native_event' AND target IS NOT NULL GROUP BY ALL), h AS (SELECT receiver, count(*) AS handlers FROM rec WHERE relation <> 'registers_native_event' AND target IS NOT NULL GROUP BY ALL)
    SELECT r.receiver, r.target, r.registrations, coalesce(h.handlers, 0) AS handlers, CASE WHEN h.handlers > 0 THEN 'bridged' ELSE 'no_handler' END AS state FROM r LEFT JOIN h USING (receiver)""")
def _(s: Source):
    c = calls(s)
    return N.bridges(N.recognize(c, N.NATIVE_EVENTS), N.recognize(c, N.SCRIPTS[:2])).drop("proof")


@query("r22_bridge_proofs", recognized_sql(N.NATIVE_EVENTS + N.SCRIPTS[:2]) + """, r AS (SELECT receiver, target, bool_or(state = 'derived') AS sure FROM rec WHERE relation = 'registers_native_event' AND target IS NOT NULL GROUP BY ALL), h AS (SELECT receiver, bool_or(state = 'derived') AS sure FROM rec WHERE relation <> 'registers_native_event' AND target IS NOT NULL GROUP BY ALL)
    SELECT r.receiver, r.target, CASE WHEN h.sure IS NULL THEN NULL WHEN r.sure AND h.sure THEN 'derived' ELSE 'possible' END AS proof FROM r LEFT JOIN h USING (receiver)""")
def _(s: Source):
    c = calls(s)
    return N.bridges(N.recognize(c, N.NATIVE_EVENTS), N.recognize(c, N.SCRIPTS[:2])).select("receiver", "target", "proof")


@query("r23_signal_confirmation", recognized_sql(N.SIGNALS) + """, p AS (SELECT receiver, target, count(DISTINCT call_id) AS n FROM rec WHERE relation = 'emits_custom_signal' AND target IS NOT NULL GROUP BY ALL)
    SELECT q.call_id, q.target, CASE WHEN p.n IS NOT NULL THEN 'confirmed' WHEN q.target IN (SELECT target FROM p) THEN 'receiver_mismatch' WHEN q.receiver IN (SELECT receiver FROM p) THEN 'key_mismatch' ELSE 'no_producer' END AS state, CAST(coalesce(p.n, 0) AS INTEGER) AS producers
    FROM rec q LEFT JOIN p USING (receiver, target) WHERE q.relation = 'handles_custom_signal' AND q.target IS NOT NULL""")
def _(s: Source):
    found = N.recognize(calls(s), N.SIGNALS)
    return N.confirmations(found.where("relation = 'handles_custom_signal'"), found.where("relation = 'emits_custom_signal'"))


@query("r23_incomplete_lookups", recognized_sql(N.SIGNALS) + """, p AS (SELECT receiver, target, count(DISTINCT call_id) AS n FROM rec WHERE relation = 'emits_custom_signal' AND target IS NOT NULL AND call_id % 3 = 0 GROUP BY ALL), o AS (SELECT DISTINCT receiver FROM rec WHERE relation = 'emits_custom_signal' AND target IS NOT NULL AND call_id % 3 <> 0)
    SELECT q.call_id, CASE WHEN p.n IS NOT NULL THEN 'confirmed' WHEN q.receiver IN (SELECT receiver FROM o) THEN 'lookup_incomplete' WHEN q.target IN (SELECT target FROM p) THEN 'receiver_mismatch' WHEN q.receiver IN (SELECT receiver FROM p) THEN 'key_mismatch' ELSE 'no_producer' END AS state FROM rec q LEFT JOIN p USING (receiver, target) WHERE q.relation = 'handles_custom_signal' AND q.target IS NOT NULL""")
def _(s: Source):  # a third of the producers was looked at
    found = N.recognize(calls(s), N.SIGNALS)
    producers = found.where("relation = 'emits_custom_signal' AND target IS NOT NULL")
    return N.confirmations(found.where("relation = 'handles_custom_signal'"), producers.where("call_id % 3 = 0"), producers.where("call_id % 3 <> 0")).select("call_id", "state")


@query("r26_script_handlers", """SELECT page_id AS doc, CAST(count(*) AS BIGINT) AS n, count(DISTINCT t) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '', 'gs'), '<a href="([^"]*)"', 1)) AS h FROM pages), LATERAL (SELECT unnest(regexp_split_to_array(h, '\\s*,\\s*')) AS t) WHERE t <> '' GROUP BY page_id""")
def _(s: Source):  # links of pages stand for the script attributes of an interface file
    found = N.element_relations(Markup.elements(s.pages, "page_id", "html", html=True).withColumnRenamed("page_id", "doc"), {"href": "sets_script"})
    return found.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("targets"))


@query("r29_saved_state", """WITH d AS (SELECT c_mktsegment AS name, count(DISTINCT c_nationkey % 3) AS owners FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY ALL UNION ALL SELECT concat('k', n_nationkey % 6), 1 FROM nation GROUP BY ALL),
    a AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 = 0 THEN 'BUILDING' ELSE concat('k', CAST(json_extract_string(props, '$.k') AS BIGINT) % 9) END AS name FROM events WHERE event_type IN ('view', 'purchase'))
    SELECT a.event_id AS access_id, CASE WHEN d.owners = 1 THEN CASE event_type WHEN 'purchase' THEN 'writes_state' ELSE 'reads_state' END END AS relation, CASE WHEN d.owners = 1 THEN a.name END AS target, CASE WHEN d.owners IS NULL THEN 'undeclared' WHEN d.owners > 1 THEN 'ambiguous' ELSE 'derived' END AS state FROM a LEFT JOIN d USING (name)""")
def _(s: Source):
    declared = s.customer.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("name"), (F.col("c_nationkey") % 3).cast("string").alias("owner"))
    declared = declared.unionByName(s.nation.select(F.concat(F.lit("k"), F.col("n_nationkey") % 6).alias("name"), F.lit("own").alias("owner")))
    name = F.when(F.col("event_id") % 5 == 0, "BUILDING").otherwise(F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("long") % 9))
    accesses = s.events.where("event_type in ('view', 'purchase')").select(F.col("event_id").alias("access_id"), F.col("user_id").alias("caller"), name.alias("name"), F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("access"))
    return N.state_accesses(accesses, declared).select("access_id", "relation", "target", "state")


@query("r31_manifest_facts", """SELECT package, 'package' AS fact, package AS value FROM packages UNION ALL SELECT concat('pkg', s_nationkey), 'file', concat(s_suppkey, ':', s_name) FROM supplier UNION ALL SELECT package, 'dependency', concat(kind, ':', dependency) FROM dependencies
    UNION ALL SELECT package, 'load_on_demand', 'true' FROM packages WHERE on_demand UNION ALL SELECT DISTINCT concat('pkg', c_nationkey), 'saved_variable', concat('Db.', c_mktsegment) FROM customer UNION ALL SELECT DISTINCT concat('pkg', c_nationkey), 'saved_root', 'Db' FROM customer""", "packages dependencies")
def _(s: Source):
    files = s.supplier.select(F.concat(F.lit("pkg"), "s_nationkey").alias("package"), F.col("s_suppkey").alias("position"), F.col("s_name").alias("file"))
    saved = s.customer.select(F.concat(F.lit("pkg"), "c_nationkey").alias("package"), F.concat(F.lit("Db."), "c_mktsegment").alias("name"))
    return N.manifest_facts(s.packages, files, s.dependencies, saved)


@query("r32_templates", "SELECT CAST(p_partkey AS BIGINT) AS doc, 'inherits' AS relation, unnest(string_split(CASE WHEN p_size % 2 = 0 THEN concat(p_brand, ',', p_type) ELSE p_type END, ',')) AS target FROM part UNION ALL SELECT p_partkey, 'parent_of', p_brand FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 'sets_script', concat('on', p_size) FROM part")
def _(s: Source):
    inherits = F.when(F.col("p_size") % 2 == 0, F.concat_ws(", ", "p_brand", "p_type")).otherwise(F.col("p_type"))
    element = F.concat(F.lit('<frame inherits="'), inherits, F.lit('" parent="'), F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(""), F.lit('" onload="on'), F.col("p_size"), F.lit('"/>'))
    found = Markup.elements(s.part.select(F.col("p_partkey").cast("long").alias("doc"), element.alias("html")), "doc", "html")
    return N.element_relations(found, {"inherits": "inherits", "parent": "parent_of", "onload": "sets_script"}).select("doc", "relation", "target")


@query("p5_control_flow_rule", f"""WITH {F_}, g AS (SELECT fact_id, scope_id, ordinal, lead(fact_id) OVER (PARTITION BY scope_id ORDER BY ordinal) AS next FROM facts)
    SELECT 'flows' AS rule_id, concat(a.fact_id, '/', b.fact_id) AS match_key, '' AS captures, array_to_string(list_sort([CAST(a.fact_id AS VARCHAR), CAST(b.fact_id AS VARCHAR)]), ',') AS witnesses, CASE WHEN a.confidence < 2 AND b.confidence < 2 THEN 'proven' ELSE 'possible' END AS confidence
    FROM f a JOIN f b ON a.scope_id = b.scope_id JOIN g ON g.fact_id = a.fact_id AND g.next = b.fact_id WHERE a.kind = 'click' AND b.kind = 'purchase'""", "facts")
def _(s: Source):  # an event dominates the next one of its user
    f = s.facts
    flow = f.select("fact_id", F.lead("fact_id").over(Window.partitionBy("scope_id").orderBy("ordinal")).alias("next")).where("next is not null")
    field = lambda t, v: F.struct(F.lit(t).alias("t"), v.cast("string").alias("v"))
    fields = F.create_map(F.lit("left"), field("reference", F.col("fact_id")), F.lit("right"), field("reference", F.col("next")), F.lit("relation"), field("string", F.lit("dominates")))
    relations = flow.select((-F.col("fact_id")).alias("fact_id"), F.lit("control_flow").alias("kind"), F.lit("user").alias("scope_kind"), F.lit(None).cast(f.schema["scope_id"].dataType).alias("scope_id"), F.lit(0).alias("confidence"), fields.alias("fields"))
    p = pack("flows", [fact("a", "click"), fact("b", "purchase"), scope("a", "b"), {"control_flow": {"left": "a", "right": "b", "relation": "dominates"}}])
    return R.run_pack(p, facts(s).unionByName(relations), COVERAGE)


@query("r8_witness_digest", f"WITH {F_} SELECT a.scope_id, count(*) AS matches, count(DISTINCT b.fact_id) AS witnesses FROM f a JOIN f b ON a.scope_id = b.scope_id AND a.k = b.k WHERE a.kind = 'signup' AND b.kind = 'purchase' GROUP BY a.scope_id", "facts")
def _(s: Source):
    m = run(s, pack("join", [fact("a", "signup"), fact("b", "purchase"), scope("a", "b"), join("a", "b")], {"user": "a.user"}))
    return m.select(F.split("captures", "=")[1].cast("long").alias("scope_id"), F.split("match_key", "/")[1].alias("b")).groupBy("scope_id").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("b").alias("witnesses"))


_SIZES = "n AS (SELECT count(*) FILTER (kind = 'signup') AS a, count(*) FILTER (kind = 'signup' AND confidence < 2) AS x, count(*) FILTER (kind = 'purchase') AS b FROM f)"
_PAIRS = "(SELECT count(*) FROM f a JOIN f b ON a.scope_id = b.scope_id AND a.k = b.k WHERE a.kind = 'signup' AND b.kind = 'purchase')"


@query("b3_rule_budget", f"""WITH {F_}, {_SIZES}, c AS (SELECT a + a * b AS expansions, b * (2 * a + x) AS copies FROM n)
    SELECT rule_id, CASE WHEN rule_id = 'above' THEN 'partial' WHEN {_PAIRS} > 0 THEN 'matched' ELSE 'evaluated_no_match' END AS outcome, CASE WHEN rule_id = 'above' THEN 'matcher.proof-copy.truncated' END AS blocker,
      CAST(expansions AS BIGINT) AS expansions, CAST(copies AS BIGINT) AS copies, CASE WHEN rule_id = 'above' THEN 0 ELSE {_PAIRS} END AS matches FROM c, (VALUES ('below'), ('at'), ('above')) AS r(rule_id)""", "facts")
def _(s: Source):
    f, clauses = facts(s), [fact("a", "signup"), fact("b", "purchase"), scope("a", "b"), join("a", "b")]
    p = R.compile_pack({"pack_id": "bounds", "rules": [{"rule_id": r, "clauses": clauses} for r in ("below", "at", "above")]})
    copies = B.charges(p, f, COVERAGE, B.NO_CAP).agg(F.max("copies")).collect()[0][0]
    return B.run(p, f, COVERAGE, {"below": copies + 1, "at": copies, "above": copies - 1})[1]


@query("b3_bundle_budgets", f"""WITH {F_}, n AS (SELECT scope_id, count(*) FILTER (kind = 'click') AS a, count(*) FILTER (kind = 'click' AND confidence < 2) AS ax, count(*) FILTER (kind = 'view') AS b, count(*) FILTER (kind = 'view' AND confidence < 2) AS bx,
      count(*) FILTER (kind = 'error') AS c FROM f WHERE kind IN ('click', 'view', 'error') GROUP BY scope_id), t AS (SELECT scope_id, a + a * b + a * b * c AS expansions, b * (2 * a + ax) + c * (4 * a * b + 2 * ax * bx) AS copies FROM n),
      m AS (SELECT a.scope_id, count(*) AS matches FROM f a JOIN f b ON a.scope_id = b.scope_id AND a.ordinal < b.ordinal JOIN f c ON c.scope_id = b.scope_id AND b.ordinal < c.ordinal WHERE a.kind = 'click' AND b.kind = 'view' AND c.kind = 'error' GROUP BY a.scope_id)
    SELECT 'chain' AS rule_id, scope_id AS project, CASE WHEN copies > 9000 THEN 'partial' WHEN matches > 0 THEN 'matched' ELSE 'evaluated_no_match' END AS outcome, copies > 9000 AS refused, CASE WHEN copies > 9000 THEN 0 ELSE coalesce(matches, 0) END AS matches FROM t LEFT JOIN m USING (scope_id)""", "facts")
def _(s: Source):  # each user's facts are a bundle
    p = pack("chain", [fact("a", "click"), fact("b", "view"), fact("c", "error"), order("a", "b"), order("b", "c")])
    _, outcomes = B.run(p, facts(s).withColumn("project", F.col("scope_id")), COVERAGE, 9000, "project")
    return outcomes.select("rule_id", "project", "outcome", F.col("blocker").isNotNull().alias("refused"), "matches")


KINDS = ("click", "view", "purchase", "signup", "error")
#: fifty rules over five kinds: kinds that differ, in one scope, with a key in common and one of ten key values
FIFTY = [(f"rule{n:02}", KINDS[n % 5], KINDS[(n + 1) % 5], n // 5) for n in range(50)]


@query("r2_shared_plan", f"WITH {F_} " + " UNION ALL ".join(
    f"SELECT '{r}' AS rule_id, {IDS} AS match_key, concat('k=', a.k) AS captures, {PAIR.format(key=IDS)} FROM f a JOIN f b ON a.scope_id = b.scope_id AND a.k = b.k AND a.k = '{k}' AND a.ordinal < b.ordinal WHERE a.kind = '{x}' AND b.kind = '{y}'" for r, x, y, k in FIFTY), "facts")
def _(s: Source):
    rules = []
    for n, (rule, x, y, k) in enumerate(FIFTY):
        a, b = f"a{n}", f"b{n}"
        within = {"all_of": [{"field_eq": {"field": f"{a}.k", "literal": ["integer", k]}}]}
        rules.append({"rule_id": rule, "clauses": [fact(a, x), fact(b, y), scope(a, b), order(a, b), join(a, b), within], "captures": [{"name": "k", "value": f"{a}.k"}]})
    return P.run_pack(R.compile_pack({"pack_id": "fifty", "rules": rules}), facts(s), COVERAGE)


@query("r31_manifest_texts", """SELECT p_brand AS package, 'file' AS fact, concat('src/', p_name, p_partkey, '.lua') AS value, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS position FROM part UNION ALL SELECT DISTINCT p_brand, 'dependency', concat('Dep', CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS VARCHAR), p_type), CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS INTEGER) FROM (SELECT DISTINCT p_brand, p_type FROM part)
    UNION ALL SELECT DISTINCT p_brand, 'load_on_demand', '1', NULL FROM part WHERE p_brand IN ('Brand#1', 'Brand#3') UNION ALL SELECT DISTINCT p_brand, 'saved_variable', 'Db.profile', 0 FROM part UNION ALL SELECT DISTINCT p_brand, 'saved_variable', 'Db.global', 1 FROM part UNION ALL SELECT DISTINCT p_brand, 'saved_root', 'Db', NULL FROM part UNION ALL SELECT DISTINCT p_brand, 'title', p_brand, NULL FROM part""")
def _(s: Source):  # a manifest text for each brand
    types = s.part.select("p_brand", "p_type").distinct().groupBy("p_brand").agg(F.array_sort(F.collect_list("p_type")).alias("types"))
    files = s.part.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("files"))
    dependencies = F.array_join(F.transform("types", lambda t, i: F.concat(F.lit("Dep"), i.cast("string"), t)), ", ")
    paths = F.array_join(F.transform("files", lambda f: F.concat(F.lit("src\\"), f["p_name"], f["p_partkey"].cast("string"), F.lit(".lua"))), "\n")
    on_demand = F.when(F.col("p_brand").isin("Brand#1", "Brand#3"), "1").otherwise("0")
    text = F.concat(F.lit("## Title: "), "p_brand", F.lit("\n## Required Deps: "), dependencies, F.lit("\n## LoadOnDemand: "), on_demand, F.lit("\n# a comment\n\n## SavedVariables: Db.profile, Db.global\n"), paths)
    return Structure.manifest_facts(types.join(files, "p_brand").select(F.col("p_brand").alias("package"), text.alias("text")), "package", "text").select("package", "fact", "value", "position")


@query("r32_nested_objects", """SELECT p_partkey AS doc, 'parent_of' AS relation, p_brand AS source, concat('O', p_partkey) AS target, 'derived' AS state FROM part UNION ALL SELECT p_partkey, 'inherits', concat('O', p_partkey), p_type, 'derived' FROM part UNION ALL SELECT p_partkey, 'inherits', concat('O', p_partkey), 'Base', 'derived' FROM part
    UNION ALL SELECT p_partkey, 'parent_of', concat('O', p_partkey), concat('O', p_partkey, 'Inner'), 'derived' FROM part UNION ALL SELECT p_partkey, 'parent_of', concat('O', p_partkey, 'Inner'), NULL, 'unnamed_object' FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'sets_script', concat('O', p_partkey, 'Inner'), concat('On', p_size), 'derived' FROM part
    UNION ALL SELECT p_partkey, 'sets_script', concat('O', p_partkey), NULL, 'inline_body' FROM part UNION ALL SELECT p_partkey, 'declares_template', NULL, concat('T', p_partkey), 'derived' FROM part""")
def _(s: Source):  # an interface file for each part: an object in another, handlers by name and inline, a template
    c = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    key, inner = F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, "<Layers><Layer><Texture file='x'/></Layer></Layers>").otherwise("")
    text = c('<Ui><Frame name="O', key, '" parent="', F.col("p_brand"), '" inherits="', F.col("p_type"), ', Base"><Size x="1" y="2"/><Frames><Button name="$parentInner">', inner, '<Scripts><OnClick function="On', F.col("p_size"), '"/></Scripts></Button></Frames><Scripts><OnLoad><![CDATA[ if a < b then f() end ]]></OnLoad></Scripts></Frame><Frame name="T', key, '" virtual="true"/></Ui>')
    return Structure.interface_relations(s.part.select(key.alias("doc"), text.alias("text")), "doc", "text").select("doc", "relation", "source", "target", "state")
