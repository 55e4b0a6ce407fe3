"""Compiler of declarative rule packs (JSON) to DataFrame plans.

A pack holds rules; a rule is a conjunction of clauses over facts:

    {"fact": {"alias": "a", "kind": "click"}}
    {"field_eq": {"field": "a.k", "literal": ["integer", 7]}}
    {"field_in": {"field": "a.k", "literals": [["integer", 7], ["integer", 8]]}}
    {"join": {"left": "a.k", "right": "b.k"}}
    {"same_scope": {"left": "a", "right": "b", "scope": "user"}}
    {"ordered": {"left": "a.ordinal", "right": "b.ordinal", "relation": "before"}}
    {"control_flow": {"left": "a", "right": "b", "relation": "dominates"}}
    {"exists": [clause, ...]}      the aliases bound inside stay in the row
    {"not_exists": {"capability": "...", "clauses": [clause, ...]}}
    {"all_of": [clause, ...]}
    {"any_of": [[clause, ...], ...]}   only aliases that all branches bind stay

Facts are rows (fact_id, kind, scope_kind, scope_id, confidence, fields), where
fields maps names to structs (t, v); the type is part of a value's identity and a
missing field matches nothing.

Planning: within a conjunction filters of one alias go to its scan, and each scan
joins what is already bound by all clauses that connect them, so that Catalyst sees
equi joins and pushes the filters; scans are taken in an order in which every one
connects.  A rule whose facts don't connect is refused, not run as a cross product.
Only fields that clauses or captures name are carried.

Results: one row per match with captures, witnesses and a confidence: proven if
some derivation uses no fact weaker than derived, its coverage is complete and its
key is unique; else possible.  Each rule has an outcome: matched,
evaluated_no_match, partial (a capability is partial or truncated), not_evaluated.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.predicates import ordered, typed

MOST_RULES, MOST_CLAUSES, MOST_DEPTH = 256, 256, 16
SCOPES = ("project", "file", "function", "user", "package", "document")
RANK = {"fact": 0, "field_eq": 1, "field_in": 1, "same_scope": 2, "ordered": 3, "control_flow": 4, "exists": 5, "not_exists": 6, "join": 7, "all_of": 8, "any_of": 8}
POSSIBLE = 2
FLOW_KINDS = ("control_flow", "guard_flow")


def split_field(path: str) -> tuple[str, str]:
    alias, dot, name = path.partition(".")
    if not dot or not alias or not name:
        raise ValueError(f"not alias.field: {path!r}")
    return alias, name


@dataclass
class Pack:
    pack_id: str
    rules: list[dict]
    digest: str = ""
    needed: dict[str, dict[str, set[str]]] = field(default_factory=dict)


def compile_pack(document: str | Mapping) -> Pack:
    """Validate a pack: known clauses, limits, aliases bound before use; its digest is that of its canonical JSON."""
    doc = json.loads(document) if isinstance(document, str) else dict(document)
    if set(doc) - {"pack_id", "rules"}:
        raise ValueError(f"unknown members: {sorted(set(doc) - {'pack_id', 'rules'})}")
    rules = doc["rules"]
    if not 0 < len(rules) <= MOST_RULES or len({r["rule_id"] for r in rules}) < len(rules):
        raise ValueError("a pack has 1 to 256 rules with distinct ids")
    pack = Pack(doc["pack_id"], rules, hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest())
    for rule in rules:
        if set(rule) - {"rule_id", "required_capabilities", "clauses", "captures", "key"}:
            raise ValueError(f"unknown members in rule {rule['rule_id']}")
        needed: dict[str, set[str]] = {}
        bound = check(rule["clauses"], set(), needed, 1)
        for c in rule.get("captures", []):
            alias, name = split_field(c["value"])
            if alias not in bound and c.get("cardinality", "one") == "one":
                raise ValueError(f"capture {c['name']} uses {alias}, which is not bound")
            needed.setdefault(alias, set()).add(name)
        for k in rule.get("key", []):
            if "." in k:
                needed.setdefault(split_field(k)[0], set()).add(split_field(k)[1])
        pack.needed[rule["rule_id"]] = needed
    return pack


def parts(clause: Mapping) -> tuple[str, object]:
    if len(clause) != 1 or (kind := next(iter(clause))) not in RANK:
        raise ValueError(f"not a clause: {clause}")
    return kind, clause[kind]


def check(clauses: Sequence[Mapping], outer: set[str], needed: dict[str, set[str]], depth: int) -> set[str]:
    """Aliases bound after the conjunction; raises if one is used unbound."""
    if depth > MOST_DEPTH or len(clauses) > MOST_CLAUSES:
        raise ValueError("too many or too deeply nested clauses")
    bound = set(outer)
    ranked = sorted(enumerate(map(parts, clauses)), key=lambda x: (RANK[x[1][0]], x[0]))
    for _, (kind, body) in ranked:
        if kind == "fact":
            bound.add(body["alias"])
        elif kind in ("exists", "all_of"):
            bound = check(body, bound, needed, depth + 1)
        elif kind == "any_of":
            bound |= set.intersection(*[check(branch, bound, needed, depth + 1) for branch in body])
        elif kind == "not_exists":
            if not body.get("capability"):
                raise ValueError("not_exists names the capability whose coverage it relies on")
            check(body["clauses"], bound, needed, depth + 1)
    for _, (kind, body) in ranked:
        used = {"field_eq": ["field"], "field_in": ["field"], "join": ["left", "right"], "ordered": ["left", "right"]}.get(kind, [])
        for member in used:
            alias, name = split_field(body[member])
            if alias not in bound:
                raise ValueError(f"{alias} is not bound")
            needed.setdefault(alias, set()).add(name)
        if kind in ("same_scope", "control_flow") and not {body["left"], body["right"]} <= bound:
            raise ValueError(f"{kind} uses an alias that is not bound")
    return bound


class Evaluation:
    """Evaluation of one rule over a table of facts."""

    def __init__(self, facts: DataFrame, coverage: Mapping[str, str], needed: Mapping[str, set[str]], bundle: str | None = None, crossed: bool = False):
        """``bundle``: a column of the facts within whose values alone facts are combined; ``crossed``: facts may go unconnected, as a budget bounds their product."""
        self.facts, self.coverage, self.needed, self.bundle, self.crossed = facts, coverage, needed, bundle, crossed

    def of_kind(self, kind: str) -> DataFrame:
        return self.facts.where(F.col("kind") == kind)

    def scan(self, alias: str, kind: str, filters: Sequence[tuple[str, Mapping]]) -> DataFrame:
        f = self.of_kind(kind)
        for name, body in filters:
            value = F.col("fields")[split_field(body["field"])[1]]
            wanted = [body["literal"]] if name == "field_eq" else body["literals"]
            f = f.where(value.isNotNull() & reduce(Column.__or__, [value == typed(*w) for w in wanted]))
        carried = [F.col("fields")[name].alias(f"{alias}.{name}") for name in sorted(self.needed.get(alias, ()))]
        if self.bundle:
            carried.append(F.col(self.bundle).alias(f"{alias}!b"))
        return f.select(F.col("fact_id").alias(f"{alias}!id"), F.col("scope_kind").alias(f"{alias}!sk"), F.col("scope_id").alias(f"{alias}!s"), (F.col("confidence") < POSSIBLE).alias(f"{alias}!x"), *carried)

    def condition(self, kind: str, body: Mapping) -> Column:
        c = lambda path: F.col(f"`{path}`")
        if kind == "join":
            return c(body["left"]) == c(body["right"])
        if kind == "same_scope":
            if body["scope"] not in SCOPES:
                return F.lit(False)
            return (c(f"{body['left']}!s") == c(f"{body['right']}!s")) & (c(f"{body['left']}!sk") == body["scope"]) & (c(f"{body['right']}!sk") == body["scope"])
        return ordered(c(body["left"]), c(body["right"]), body["relation"])

    def conjunction(self, clauses: Sequence[Mapping], state: DataFrame | None, bound: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
        todo = [parts(c) for c in clauses]
        scans = [b for k, b in todo if k == "fact"]
        links = [(k, b, aliases_of(k, b)) for k, b in todo if k in ("join", "same_scope", "ordered")]
        single = {a: [(k, b) for k, b in todo if k in ("field_eq", "field_in") and split_field(b["field"])[0] == a] for a in {s["alias"] for s in scans} | set(bound)}
        for a in bound:  # filters on what an outer scope bound
            for k, b in single.get(a, []):
                value = F.col(f"`{b['field']}`")
                wanted = [b["literal"]] if k == "field_eq" else b["literals"]
                state = state.where(value.isNotNull() & reduce(Column.__or__, [value == typed(*w) for w in wanted]))
        waiting = [s for s in scans if s["alias"] not in bound]
        used: set[int] = set()
        while waiting:
            if not bound:
                pick = waiting[0]
            else:
                pick = next((s for s in waiting if any(s["alias"] in al and al - {s["alias"]} <= set(bound) and (k == "join" or k == "same_scope") for k, _, al in links)), None)
                if pick is None and not self.crossed:
                    raise Unconnected(waiting[0]["alias"])
                pick = pick or waiting[0]
            waiting.remove(pick)
            rows = self.scan(pick["alias"], pick["kind"], single[pick["alias"]])
            if not bound:
                state = rows
            else:
                mine = [i for i, (_, _, al) in enumerate(links) if i not in used and pick["alias"] in al and al <= {*bound, pick["alias"]}]
                used |= set(mine)
                met = [self.condition(links[i][0], links[i][1]) for i in mine]
                if self.bundle:
                    met.append(F.col(f"`{bound[0]}!b`").eqNullSafe(F.col(f"`{pick['alias']}!b`")))
                state = state.join(rows, reduce(Column.__and__, met)) if met else state.crossJoin(rows)
            bound = (*bound, pick["alias"])
        for i, (k, b, al) in enumerate(links):
            if i not in used and al <= set(bound):
                state = state.where(self.condition(k, b))
        for kind, body in sorted(((k, b) for k, b in todo if k in ("control_flow", "exists", "not_exists", "all_of", "any_of")), key=lambda x: RANK[x[0]]):
            if kind == "control_flow":
                state = self.control_flow(state, body)
            elif kind in ("exists", "all_of"):
                state, bound = self.conjunction(body, state, bound)
            elif kind == "any_of":
                state, bound = self.any_of(body, state, bound)
            else:
                state = self.not_exists(state, body, bound)
        return state, bound

    def control_flow(self, state: DataFrame, body: Mapping) -> DataFrame:
        get = lambda name: F.col("fields")[name]["v"]
        flow = self.facts.where(F.col("kind").isin(*FLOW_KINDS) & (get("relation") == body["relation"])).select(get("left").alias("!l"), get("right").alias("!r"))
        left, right = (F.col(f"`{body[s]}!id`").cast("string") for s in ("left", "right"))
        return state.join(flow, (left == F.col("!l")) & (right == F.col("!r")), "left_semi")

    def not_exists(self, state: DataFrame, body: Mapping, bound: tuple[str, ...]) -> DataFrame:
        if self.coverage.get(body["capability"]) != "complete":
            raise Incomplete(body["capability"])
        inner, _ = self.conjunction(body["clauses"], state, bound)
        keys = [f"{a}!id" for a in bound]
        gone = inner.select(*[F.col(f"`{k}`").alias(f"?{k}") for k in keys]).distinct()
        return state.join(gone, reduce(Column.__and__, [F.col(f"`{k}`") == F.col(f"`?{k}`") for k in keys]), "left_anti")

    def any_of(self, branches: Sequence, state: DataFrame | None, bound: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
        done = [self.conjunction(b, state, bound) for b in branches]
        common = tuple(a for a in done[0][1] if all(a in b for _, b in done))
        if not common:
            raise Unconnected("any_of")
        rows = []
        for df, own in done:
            extra = [a for a in own if a not in common]
            exact = reduce(Column.__and__, [F.col(f"`{a}!x`") for a in own])
            witness = F.array(*[F.col(f"`{a}!id`").cast("string") for a in extra]) if extra else F.array().cast("array<string>")
            old_w = F.col("`!w`") if "!w" in df.columns else F.array().cast("array<string>")
            old_x = F.col("`!x`") if "!x" in df.columns else F.lit(True)
            columns = [c for c in df.columns if c.split("!")[0].split(".")[0] in common]
            rows.append(df.select(*[F.col(f"`{c}`") for c in columns], F.concat(old_w, witness).alias("!w"), (old_x & exact).alias("!x")))
        return self.distinct(reduce(DataFrame.unionByName, rows), common), common

    def distinct(self, state: DataFrame, bound: tuple[str, ...]) -> DataFrame:
        """One row for each binding of the visible aliases: witnesses united, exact if any derivation is.

        Only needed where aliases are dropped: scans and joins of facts with unique ids give each binding once.
        """
        keys = [f"{a}!id" for a in bound]
        rest = [c for c in state.columns if c not in keys and c not in ("!w", "!x")]
        values = [F.first(F.col(f"`{c}`")).alias(c) for c in rest]
        if "!w" in state.columns:
            values += [F.array_sort(F.array_distinct(F.flatten(F.collect_set("`!w`")))).alias("!w"), F.bool_or("`!x`").alias("!x")]
        return state.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*values) if values else state.distinct()


class Unconnected(ValueError):
    pass


class Incomplete(ValueError):
    pass


def aliases_of(kind: str, body: Mapping) -> set[str]:
    if kind == "same_scope":
        return {body["left"], body["right"]}
    return {split_field(body["left"])[0], split_field(body["right"])[0]}


MATCH = "rule_id string, match_key string, captures string, witnesses string, confidence string"


def gate(rule: Mapping, coverage: Mapping[str, str]) -> str:
    """evaluate, partial or not_evaluated, before anything is read."""
    states = [coverage.get(c) for c in rule.get("required_capabilities", [])]
    if any(s is None or s in ("failed", "cancelled", "not_evaluated") for s in states):
        return "not_evaluated"
    return "partial" if any(s in ("partial", "truncated") for s in states) else "evaluate"


def captured(c: Mapping, rows: DataFrame) -> Column:
    """Text of a capture: of cardinality one, an error where there is no value; bounded_many, a list of it; else empty where there is none."""
    value = F.col(f"`{c['value']}`")["v"] if c["value"] in rows.columns else F.lit(None).cast("string")
    if c.get("cardinality") == "one":
        return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"required capture {c['name']} is unavailable")).cast("string"))
    if c.get("cardinality") == "bounded_many":
        return F.concat(F.lit("["), F.coalesce(value, F.lit("")), F.lit("]"))
    return F.coalesce(value, F.lit(""))


def matches(pack: Pack, rule: Mapping, facts: DataFrame, coverage: Mapping[str, str], evaluation: Evaluation | None = None) -> DataFrame | None:
    """Matches of a rule, with captured map<string,string>; None if it can't be evaluated."""
    state = gate(rule, coverage)
    if state == "not_evaluated":
        return None
    try:
        ev = evaluation or Evaluation(facts, coverage, pack.needed[rule["rule_id"]])
        rows, bound = ev.conjunction(rule["clauses"], None, ())
    except (Unconnected, Incomplete):
        return None
    return finished(rule, rows, bound, state, ev.bundle)


def finished(rule: Mapping, rows: DataFrame, bound: Sequence[str], state: str, bundle: str | None = None) -> DataFrame:
    """Matches of a rule from the rows of its clauses: keys, captures, witnesses and confidence."""
    pairs = [x for c in rule.get("captures", []) for x in (F.lit(c["name"]), captured(c, rows))]
    values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    key = F.concat_ws("/", *[F.coalesce(F.col(f"`{k}`")["v"] if "." in k else F.col(f"`{k}!s`").cast("string"), F.lit("")) for k in rule["key"]]) if rule.get("key") else F.concat_ws("/", *[F.col(f"`{a}!id`").cast("string") for a in bound])
    exact = reduce(Column.__and__, [F.col(f"`{a}!x`") for a in bound])
    exact = exact & F.col("`!x`") if "!x" in rows.columns else exact
    own = F.array(*[F.col(f"`{a}!id`").cast("string") for a in bound])
    witness = F.array_sort(F.array_distinct(F.concat(own, F.col("`!w`")))) if "!w" in rows.columns else F.array_sort(F.array_distinct(own))
    own_bundle = [F.col(f"`{bound[0]}!b`").alias(bundle)] if bundle else []
    named = rows.select(*own_bundle, F.lit(rule["rule_id"]).alias("rule_id"), key.alias("match_key"), values.alias("captured"), F.array_join(witness, ",").alias("witnesses"), exact.alias("exact"))
    proven = F.col("exact") & F.lit(state == "evaluate")
    if rule.get("key"):  # a key of its own may be shared; the ids of all bound facts can't be
        by = [bundle, "match_key"] if bundle else ["match_key"]
        shared = named.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by, F.lit(True).alias("shared"))
        named = named.join(shared, by, "left")
        proven = proven & F.col("shared").isNull()
    return named.select(*([bundle] if bundle else []), "rule_id", "match_key", "captured", "witnesses", F.when(proven, "proven").otherwise("possible").alias("confidence"))


def run_rule(pack: Pack, rule: Mapping, facts: DataFrame, coverage: Mapping[str, str]) -> DataFrame | None:
    """Matches of a rule with their captures as text; None if it can't be evaluated."""
    found = matches(pack, rule, facts, coverage)
    return None if found is None else as_text(rule, found)


def as_text(rule: Mapping, found: DataFrame) -> DataFrame:
    text = [F.concat(F.lit(c["name"] + "="), F.col("captured")[c["name"]]) for c in rule.get("captures", [])]
    head = [c for c in found.columns if c not in ("rule_id", "match_key", "captured", "witnesses", "confidence")]  # the bundle, if there is one
    return found.select(*head, "rule_id", "match_key", F.concat_ws(";", *text).alias("captures"), "witnesses", "confidence")


def assertions(pack: Pack, rule_id: str, facts: DataFrame, coverage: Mapping[str, str], outputs: Sequence[Mapping]) -> tuple[DataFrame, DataFrame]:
    """What a rule's matches assert: entities (output_id, match_key, kind, key, confidence) and relations (output_id, match_key, relation, source, target, confidence).

    An entity output names its kind and which captures its key is made of; a relation
    output names its kind and the captures of its ends.  An assertion claims no more
    than its match: derived becomes possible where the match is.
    """
    rule = next(r for r in pack.rules if r["rule_id"] == rule_id)
    names = {c["name"] for c in rule.get("captures", [])}
    found = matches(pack, rule, facts, coverage)
    spark = facts.sparkSession
    entities = spark.createDataFrame([], "output_id string, match_key string, kind string, key map<string,string>, confidence string")
    relations = spark.createDataFrame([], "output_id string, match_key string, relation string, source string, target string, confidence string")
    for o in outputs:
        used = set(o["key"].values()) if "key" in o else {o["source"], o["target"]}
        if used - names:
            raise ValueError(f"output {o['output_id']} uses what is not captured: {sorted(used - names)}")
        if found is None:
            continue
        value = lambda name: F.col("captured")[name]
        claim = F.when((F.col("confidence") == "proven") & F.lit(o.get("confidence", "derived") == "derived"), "derived").otherwise("possible")
        head = (F.lit(o["output_id"]).alias("output_id"), "match_key")
        if "key" in o:
            key = F.create_map(*[x for f, c in sorted(o["key"].items()) for x in (F.lit(f), value(c))])
            entities = entities.unionByName(found.select(*head, F.lit(o["entity"]).alias("kind"), key.alias("key"), claim.alias("confidence")))
        else:
            relations = relations.unionByName(found.select(*head, F.lit(o["relation"]).alias("relation"), value(o["source"]).alias("source"), value(o["target"]).alias("target"), claim.alias("confidence")))
    return entities, relations


def bind_endpoints(relations: DataFrame, bindings: DataFrame) -> DataFrame:
    """Relations with the nodes that their ends are bound to by (relation, side, value, node_id): columns src, dst and state, which is bound, source_unbound, target_unbound, or ambiguous where a value is bound to several nodes.  Nothing is looked up by name."""
    told = bindings.groupBy("relation", "side", "value").agg(F.min("node_id").alias("node"), F.count_distinct("node_id").alias("n"))
    end = lambda side, name: told.where(F.col("side") == side).select("relation", F.col("value").alias(side), F.col("node").alias(name), F.col("n").alias(f"n_{side}"))
    rows = relations.join(end("source", "src"), ["relation", "source"], "left").join(end("target", "dst"), ["relation", "target"], "left")
    state = F.when(F.col("src").isNull(), "source_unbound").when(F.col("dst").isNull(), "target_unbound").when((F.col("n_source") > 1) | (F.col("n_target") > 1), "ambiguous").otherwise("bound")
    ok = state == "bound"
    return rows.withColumn("state", state).withColumn("src", F.when(ok, F.col("src"))).withColumn("dst", F.when(ok, F.col("dst"))).drop("n_source", "n_target")


def run_pack(pack: Pack, facts: DataFrame, coverage: Mapping[str, str]) -> DataFrame:
    """All matches of all rules that can be evaluated."""
    done = [m for r in pack.rules if (m := run_rule(pack, r, facts, coverage)) is not None]
    return reduce(DataFrame.unionByName, done) if done else facts.sparkSession.createDataFrame([], MATCH)


def outcomes(pack: Pack, facts: DataFrame, coverage: Mapping[str, str], cancelled: Callable[[], bool] = lambda: False) -> DataFrame:
    """(rule_id, outcome, matches) of every rule; ``cancelled`` is asked before each, and from then on rules are cancelled."""
    rows, stopped = [], False
    for r in pack.rules:
        stopped = stopped or cancelled()
        if stopped:
            rows.append(facts.sparkSession.createDataFrame([(r["rule_id"], "cancelled", 0)], "rule_id string, outcome string, matches long"))
            continue
        matches = run_rule(pack, r, facts, coverage)
        if matches is None:
            rows.append(facts.sparkSession.createDataFrame([(r["rule_id"], "not_evaluated", 0)], "rule_id string, outcome string, matches long"))
            continue
        partial = F.lit(gate(r, coverage) == "partial")
        n = F.count(F.lit(1))
        rows.append(matches.agg(n.alias("matches")).select(F.lit(r["rule_id"]).alias("rule_id"), F.when(partial, "partial").when(F.col("matches") > 0, "matched").otherwise("evaluated_no_match").alias("outcome"), "matches"))
    return reduce(DataFrame.unionByName, rows)
