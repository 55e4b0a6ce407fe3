"""One plan for all rules of a pack: clauses that rules have in common are run once.

The facts of a rule's outermost conjunction, with the filters on each and the clauses that
connect it to those before, are steps.  Steps of all rules are merged into a prefix tree
in which aliases are numbered as they are bound, so rules whose steps begin alike share
the rows of that beginning whatever they call them.  The facts of each kind that any rule
names are read once, with only the fields that some rule uses, and kept; a beginning
from which several rules go on is kept as well.  Results are those of `rules.run_pack`.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.plans import rules as R
from evidentia.plans.budgets import kinds_of
from evidentia.shared import keep


@dataclass
class Step:
    """A node of the prefix tree: one more fact, bound as its depth."""

    kind: str
    filters: list[tuple[str, dict]]
    links: list[tuple[str, dict]]
    fields: set[str] = field(default_factory=set)
    next: dict[str, Step] = field(default_factory=dict)
    rules: list[tuple[dict, list[str], list[dict]]] = field(default_factory=list)  # rule, its aliases in order, what is left to do


class KeptFacts(R.Evaluation):
    """An evaluation whose facts of a kind come from what was kept of it."""

    kinds: Mapping[str, DataFrame]

    def of_kind(self, kind: str) -> DataFrame:
        return self.kinds[kind]


def steps_of(rule: Mapping) -> tuple[list[tuple[str, str, list, list]], list[dict]]:
    """(alias, kind, filters, links) of the outermost facts in the order in which they are joined, and the other clauses; raises Unconnected."""
    todo = [R.parts(c) for c in rule["clauses"]]
    waiting, links = [b for k, b in todo if k == "fact"], [(k, b, R.aliases_of(k, b)) for k, b in todo if k in ("join", "same_scope", "ordered")]
    if len({b["alias"] for b in waiting}) < len(waiting) or not waiting:
        return [], rule["clauses"]
    bound, out, used = [], [], set()
    while waiting:
        pick = waiting[0] if not bound else next((s for s in waiting if any(s["alias"] in al and al - {s["alias"]} <= set(bound) and k in ("join", "same_scope") for k, _, al in links)), None)
        if pick is None:
            raise R.Unconnected(waiting[0]["alias"])
        waiting.remove(pick)
        alias = pick["alias"]
        filters = [(k, b) for k, b in todo if k in ("field_eq", "field_in") and R.split_field(b["field"])[0] == alias]
        mine = [i for i, (_, _, al) in enumerate(links) if i not in used and alias in al and al <= {*bound, alias}]
        used |= set(mine)
        bound.append(alias)
        out.append((alias, pick["kind"], filters, [links[i][:2] for i in mine]))
    taken = [b for _, _, filters, own in out for _, b in (*filters, *own)]
    rest = [{k: b} for k, b in todo if k != "fact" and not any(b is t for t in taken)]
    return out, rest


def numbered(body: Mapping, place: Mapping[str, str]) -> dict:
    """A clause with the places of its aliases in their stead."""
    out = {}
    for name, value in body.items():
        if name in ("left", "right", "field") and isinstance(value, str):
            alias, dot, rest = value.partition(".")
            value = place[alias] + dot + rest
        out[name] = value
    return out


class SharedPlan:
    """The merged steps of a pack."""

    def __init__(self, pack: R.Pack):
        self.pack, self.roots, self.alone = pack, {}, []
        self.kinds: dict[str, set[str]] = {}
        for rule in pack.rules:
            for kind in kinds_of(rule["clauses"]):
                self.kinds.setdefault(kind, set())
            self._fields(rule["clauses"], pack.needed[rule["rule_id"]])
            try:
                steps, rest = steps_of(rule)
            except R.Unconnected:
                continue  # can't be evaluated
            if not steps:
                self.alone.append(rule)
                continue
            place, level, node = {}, self.roots, None
            for alias, kind, filters, links in steps:
                place[alias] = f"${len(place)}"
                own = [(k, numbered(b, place)) for k, b in filters], [(k, numbered(b, place)) for k, b in links]
                key = json.dumps([kind, *[sorted(json.dumps(x, sort_keys=True) for x in part) for part in own]])
                node = level.setdefault(key, Step(kind, *own))
                node.fields |= pack.needed[rule["rule_id"]].get(alias, set())
                level = node.next
            node.rules.append((rule, list(place), rest))

    def _fields(self, clauses, needed: Mapping[str, set[str]]) -> None:
        for kind, body in map(R.parts, clauses):
            if kind == "fact":
                self.kinds[body["kind"]] |= needed.get(body["alias"], set())
            elif kind == "any_of":
                for branch in body:
                    self._fields(branch, needed)
            elif kind in ("exists", "all_of", "not_exists"):
                self._fields(body["clauses"] if kind == "not_exists" else body, needed)

    def shape(self) -> dict[str, int]:
        """How many kinds are read, and how many joins are run instead of how many rule by rule."""
        nodes, own = [0], [0]

        def walk(level: Mapping[str, Step], depth: int) -> None:
            for node in level.values():
                nodes[0] += depth > 0
                own[0] += depth * len(node.rules)
                walk(node.next, depth + 1)

        walk(self.roots, 0)
        return {"kinds": len(self.kinds), "joins": nodes[0], "joins_rule_by_rule": own[0]}

    def run(self, facts: DataFrame, coverage: Mapping[str, str]) -> DataFrame:
        """All matches of all rules that can be evaluated."""
        kinds = {}
        for kind, names in sorted(self.kinds.items()):
            fields = F.create_map(*[x for n in sorted(names) for x in (F.lit(n), F.col("fields")[n])]) if names else F.lit(None).cast(facts.schema["fields"].dataType)
            kinds[kind] = keep(facts.where(F.col("kind") == kind).select("fact_id", "kind", "scope_kind", "scope_id", "confidence", fields.alias("fields")))
        flow = facts.where(F.col("kind").isin(*R.FLOW_KINDS)) if self._flows(self.pack.rules) else facts
        out: list[DataFrame] = []

        def evaluation(needed: Mapping[str, set[str]]) -> KeptFacts:
            ev = KeptFacts(flow, coverage, needed)
            ev.kinds = kinds
            return ev

        def walk(level: Mapping[str, Step], state: DataFrame | None, depth: int, fields: dict[str, set[str]]) -> None:
            for node in level.values():
                own = f"${depth}"
                ev = evaluation({own: node.fields})
                rows = ev.scan(own, node.kind, node.filters)
                if state is not None:
                    rows = state.join(rows, reduce(Column.__and__, [ev.condition(k, b) for k, b in node.links]))
                live = [r for r in node.rules if R.gate(r[0], coverage) != "not_evaluated"]
                if depth and len(node.next) + len(live) > 1:
                    rows = keep(rows)
                for rule, aliases, rest in live:
                    if (done := self._finish(rule, aliases, rest, rows, evaluation, coverage)) is not None:
                        out.append(done)
                walk(node.next, rows, depth + 1, {**fields, own: node.fields})

        walk(self.roots, None, 0, {})
        for rule in self.alone:
            if R.gate(rule, coverage) != "not_evaluated" and (found := R.matches(self.pack, rule, facts, coverage, evaluation(self.pack.needed[rule["rule_id"]]))) is not None:
                out.append(R.as_text(rule, found))
        return reduce(DataFrame.unionByName, out) if out else facts.sparkSession.createDataFrame([], R.MATCH)

    def _finish(self, rule, aliases, rest, rows, evaluation, coverage) -> DataFrame | None:
        needed = self.pack.needed[rule["rule_id"]]
        columns = []
        for n, alias in enumerate(aliases):
            names = [f"!{x}" for x in ("id", "sk", "s", "x")] + [f".{f}" for f in sorted(needed.get(alias, ()))]
            columns += [F.col(f"`${n}{x}`").alias(f"{alias}{x}") for x in names]
        try:
            state, bound = evaluation(needed).conjunction(rest, rows.select(*columns), tuple(aliases))
        except (R.Unconnected, R.Incomplete):
            return None
        return R.as_text(rule, R.finished(rule, state, bound, R.gate(rule, coverage)))

    def _flows(self, rules) -> bool:
        return "control_flow" in json.dumps([r["clauses"] for r in rules])


def run_pack(pack: R.Pack, facts: DataFrame, coverage: Mapping[str, str]) -> DataFrame:
    """All matches of a pack from one shared plan."""
    return SharedPlan(pack).run(facts, coverage)
