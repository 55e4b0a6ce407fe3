"""Budgets against a plain interpreter of clauses, shared plans against rule by rule."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.plans import budgets, shared
from evidentia.plans import rules as R

FACTS = "fact_id long, kind string, scope_kind string, scope_id long, confidence int, fields map<string,struct<t:string,v:string>>"


def random_facts(seed, n=60, kinds="ABC"):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        fields = {"ordinal": ("integer", str(rng.randrange(8)))}
        if rng.random() < 0.9:
            fields["k"] = (rng.choice(["integer", "string"]), str(rng.randrange(3)))
        out.append((i, rng.choice(kinds), "user", rng.randrange(4), rng.randrange(4), fields))
    return out


def fact(alias, kind):
    return {"fact": {"alias": alias, "kind": kind}}


def scope(a, b):
    return {"same_scope": {"left": a, "right": b, "scope": "user"}}


def join(a, b):
    return {"join": {"left": f"{a}.k", "right": f"{b}.k"}}


def before(a, b):
    return {"ordered": {"left": f"{a}.ordinal", "right": f"{b}.ordinal", "relation": "before"}}


def eq(a, n):
    return {"field_eq": {"field": f"{a}.k", "literal": ["integer", n]}}


def pack(*rules):
    return R.compile_pack({"pack_id": "t", "rules": [{"rule_id": n, "clauses": c, **m} for n, c, *m_ in rules for m in [m_[0] if m_ else {}]]})


class Tripped(Exception):
    pass


class Plain:
    """Clauses one after the other over all combinations, each copied row charged."""

    def __init__(self, facts, cap):
        self.facts, self.cap, self.expansions, self.copies = facts, cap, 0, 0

    def copy(self, row):
        self.copies += 2 * len(row) + (len(row) if all(f[4] < 2 for f in row.values()) else 0)
        if self.copies > self.cap:
            raise Tripped(budgets.COPY)

    def run(self, clauses, rows):
        for kind, body in sorted(map(R.parts, clauses), key=lambda x: R.RANK[x[0]]):
            rows = self.clause(kind, body, rows)
        return rows

    def clause(self, kind, body, rows):
        if kind == "fact":
            out = []
            for row in rows:
                for f in self.facts:
                    if f[1] == body["kind"]:
                        self.expansions += 1
                        if self.expansions > self.cap:
                            raise Tripped(budgets.EXPANSION)
                        self.copy(row)
                        out.append({**row, body["alias"]: f})
            return out
        value = lambda row, path: row[path.split(".")[0]][5].get(path.split(".")[1])
        if kind == "join":
            return [r for r in rows if value(r, body["left"]) is not None and value(r, body["left"]) == value(r, body["right"])]
        if kind == "field_eq":
            return [r for r in rows if value(r, body["field"]) == ("integer", str(body["literal"][1]))]
        if kind == "same_scope":
            return [r for r in rows if r[body["left"]][3] == r[body["right"]][3]]
        if kind == "ordered":
            return [r for r in rows if int(value(r, body["left"])[1]) < int(value(r, body["right"])[1])]
        if kind == "not_exists":
            out = []
            for r in rows:
                self.copy(r)
                if not self.run(body["clauses"], [r]):
                    out.append(r)
            return out
        if kind == "any_of":
            out = []
            for branch in body:
                for r in rows:
                    self.copy(r)
                out += [{a: f for a, f in x.items() if a in rows[0]} for x in self.run(branch, rows)] if rows else []
            return out
        return self.run(body, rows)


RULES = [
    ("one", [fact("a", "A")]),
    ("two", [fact("a", "A"), fact("b", "B"), scope("a", "b"), join("a", "b")]),
    ("three", [fact("a", "A"), fact("b", "B"), fact("c", "C"), scope("a", "b"), scope("b", "c"), before("a", "b")]),
    ("apart", [fact("a", "A"), fact("b", "B")]),
    ("exists", [fact("a", "A"), eq("a", 1), {"exists": [fact("b", "B"), scope("a", "b"), join("a", "b")]}]),
    ("never", [fact("a", "A"), fact("b", "B"), scope("a", "b"), {"not_exists": {"capability": "all", "clauses": [fact("c", "C"), scope("a", "c"), before("a", "c")]}}]),
    ("either", [fact("a", "A"), eq("a", 0), {"any_of": [[fact("b", "B"), scope("a", "b"), join("a", "b")], [fact("c", "C"), scope("a", "c"), join("a", "c")]]}]),
    ("none", [fact("a", "A"), fact("z", "Z"), scope("a", "z")]),
]


@pytest.mark.parametrize("cap", [25, 420, 6000])
def test_budget_equals_plain_interpreter(spark, cap):
    facts = random_facts(cap, 45)
    done = pack(*RULES)
    found, outcomes = budgets.run(done, spark.createDataFrame(facts, FACTS), {"all": "complete"}, cap)
    got = {r.rule_id: r for r in outcomes.collect()}
    counts = {r.rule_id: r["count"] for r in found.groupBy("rule_id").count().collect()}
    for name, clauses in RULES:
        plain = Plain(facts, cap)
        try:
            plain.run(clauses, [{}])
        except Tripped as trip:
            assert got[name].outcome == "partial" and got[name].blocker is not None and got[name].matches == 0, (name, trip)
            continue
        assert got[name].blocker is None, (name, got[name], plain.expansions, plain.copies)
        assert (got[name].expansions, got[name].copies) == (plain.expansions, plain.copies) or got[name].expansions >= plain.expansions, name
        assert got[name].matches == counts.get(name, 0)


def test_exact_counters_below_at_and_above(spark):
    facts = [(i, "A" if i < 5 else "B", "user", 0, 0, {"k": ("integer", "1")}) for i in range(12)]
    df = spark.createDataFrame(facts, FACTS)
    two = ("two", [fact("a", "A"), fact("b", "B"), scope("a", "b")])
    rows = {cap: budgets.run(pack(two), df, {}, cap)[1].collect()[0] for cap in (200, 105, 104, 4)}
    assert (rows[200].expansions, rows[200].copies, rows[200].blocker, rows[200].matches) == (40, 105, None, 35)
    assert rows[105].blocker is None and rows[104].blocker == budgets.COPY and rows[4].blocker == budgets.EXPANSION
    assert rows[4].outcome == rows[104].outcome == "partial" and rows[104].matches == 0


def test_a_refused_rule_is_not_planned(spark):
    df = spark.createDataFrame(random_facts(3), FACTS)
    found, _ = budgets.run(pack(RULES[0], RULES[1]), df, {}, 100)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    found, _ = budgets.run(pack(RULES[0], RULES[1]), df, {}, 10**6)
    assert "Join" in found._jdf.queryExecution().optimizedPlan().toString()


def test_bundles_are_charged_apart(spark):
    facts = random_facts(5, 120)
    df = spark.createDataFrame([(*f, f[0] % 5 if f[0] % 7 else None) for f in facts], FACTS + ", project long")
    cap = 400
    found, outcomes = budgets.run(pack(*RULES), df, {"all": "complete"}, cap, "project")
    got = {(r.rule_id, r.project): r for r in outcomes.collect()}
    counts = {(r.rule_id, r.project): r["count"] for r in found.groupBy("rule_id", "project").count().collect()}
    states = set()
    for project in (None, 0, 1, 2, 3, 4):
        own = [f for f in facts if (f[0] % 5 if f[0] % 7 else None) == project]
        for name, clauses in RULES:
            plain = Plain(own, cap)
            try:
                rows = len({tuple(sorted((a, f[0]) for a, f in r.items())) for r in plain.run(clauses, [{}])})
            except Tripped:
                rows = 0
                assert got[name, project].blocker is not None, (name, project)
            else:
                assert got[name, project].blocker is None
            states.add(got[name, project].outcome)
            assert got[name, project].matches == counts.get((name, project), 0) == rows, (name, project)
    assert states == {"matched", "partial", "evaluated_no_match"}


def test_coverage_comes_before_the_budget(spark):
    df = spark.createDataFrame(random_facts(3), FACTS)
    rules = pack(("gated", [fact("a", "A")], {"required_capabilities": ["broken"]}), ("negated", RULES[5][1]), ("partly", RULES[0][1], {"required_capabilities": ["some"]}))
    got = {r.rule_id: r for r in budgets.run(rules, df, {"some": "partial", "broken": "failed", "all": "truncated"}, 10**6)[1].collect()}
    assert [got[n].outcome for n in ("gated", "negated", "partly")] == ["not_evaluated", "not_evaluated", "partial"] and got["partly"].blocker is None


def test_no_facts(spark):
    df = spark.createDataFrame([], FACTS)
    assert {r.outcome for r in budgets.run(pack(*RULES[:3]), df, {})[1].collect()} == {"evaluated_no_match"}
    assert budgets.run(pack(*RULES[:3]), df.withColumn("project", F.lit(1)), {}, bundle="project")[1].count() == 0


def many_rules():
    out = []
    for n in range(50):
        a, b, c = f"a{n}", f"b{n}", f"c{n}"  # other names for the same steps
        kind = n % 5
        clauses = [fact(a, "A"), fact(b, "B"), scope(a, b)] if kind < 4 else [fact(a, "C"), eq(a, n % 3)]
        if kind == 1:
            clauses += [join(a, b), {"field_in": {"field": f"{b}.k", "literals": [["integer", n % 3], ["integer", 2]]}}]
        if kind == 2:
            clauses += [fact(c, "C"), scope(b, c), before(a, b)]
        if kind == 3:
            clauses += [before(a, b), {"not_exists": {"capability": "all", "clauses": [fact(c, "C"), scope(a, c), before(b, c)]}}]
        captures = [{"name": "k", "value": f"{a}.k", "cardinality": "optional"}] if n % 2 else []
        out.append((f"r{n:02}", clauses, {"captures": captures, **({"key": [f"{a}.k", a]} if n % 3 == 0 else {})}))
    return [*out, ("either", RULES[6][1]), ("apart", RULES[3][1]), ("gated", RULES[0][1], {"required_capabilities": ["broken"]})]


def test_shared_plan_equals_rule_by_rule(spark, tmp_path):
    spark.createDataFrame(random_facts(11, 90), FACTS).write.parquet(str(tmp_path / "facts"))
    facts, rules = spark.read.parquet(str(tmp_path / "facts")), pack(*many_rules())
    coverage = {"all": "complete", "broken": "failed"}
    got, want = shared.run_pack(rules, facts, coverage), R.run_pack(rules, facts, coverage)
    rows = lambda df: sorted(map(tuple, df.select("rule_id", "match_key", "captures", "witnesses", "confidence").collect()))
    assert rows(got) == rows(want) and got.count() > 100
    shape = shared.SharedPlan(rules).shape()
    assert shape["kinds"] == 3 and shape["joins"] <= 12 < shape["joins_rule_by_rule"]


def test_kinds_are_scanned_once(spark, tmp_path):
    spark.createDataFrame(random_facts(12, 90), FACTS).write.parquet(str(tmp_path / "facts"))
    facts, rules = spark.read.parquet(str(tmp_path / "facts")), pack(*many_rules()[:50])
    scans = []
    original = shared.keep

    def keep(df):
        scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet"))
        return original(df)

    shared.keep = keep
    try:
        out = shared.run_pack(rules, facts, {"all": "complete"})
    finally:
        shared.keep = original
    assert sum(scans) == 3 and "FileScan parquet" not in out._jdf.queryExecution().executedPlan().toString()
