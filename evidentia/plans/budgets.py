"""Budgets of the matcher: what a rule would be charged is computed from counts, before any join.

A rule is charged as if its clauses ran one after the other over all combinations of
facts: the facts of a conjunction first, in the order in which they stand, so that kinds
of sizes n1, n2, n3 are charged n1 + n1 n2 + n1 n2 n3 expansions.  A second counter takes,
for each row that is copied, its bound aliases, its witnesses and the facts of its exact
proof (2 k for a row of k facts, 3 k if all of them are exact).  A rule that would go over
its cap with either is partial, has no matches, and is not run; which counter trips first
is the blocker.

Both counters of the outermost facts follow from one count of facts by kind and
exactness.  What stands inside ``exists``, ``not_exists``, ``all_of`` and ``any_of`` starts
from the rows that passed the clauses before it.  Where even the product of the facts
leaves the rule under its cap, nothing has to be counted; where the outermost facts alone
go over it, nothing is run; else those rows, no more than the cap, are counted.  Deeper
clauses are charged for all combinations of the facts around them.

With ``bundle``, a column of the facts, each of its values is a bundle of its own: facts
are combined within it alone, and rules are charged, refused and reported by bundle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.plans import rules as R
from evidentia.shared import keep

MOST_EXPANSIONS = 1_000_000
NO_CAP = (1 << 63) - 2  # one above it is the largest long, in which the counters are returned
EXPANSION, COPY = "matcher.join-expansion.truncated", "matcher.proof-copy.truncated"
NESTED = ("exists", "not_exists", "all_of", "any_of")
_WIDE = "decimal(38,0)"


def number(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast(_WIDE)


class Meter:
    """Both counters as columns over counts of facts, held at one above the cap."""

    def __init__(self, cap: int, sizes: Mapping[str, tuple[Column, Column]]):
        self.cap, self.sizes = cap, sizes
        self.expansions, self.copies = number(0), number(0)
        self.blocker = F.lit(None).cast("string")

    def held(self, x: Column) -> Column:
        return F.least(x, number(self.cap + 1)).cast(_WIDE)

    def charge(self, expansions: Column, copies: Column, dearest: int) -> None:
        """One step; ``dearest``: copies that one expansion of it costs at most."""
        left, free = number(self.cap) - self.expansions, number(self.cap) - self.copies
        first = F.when(left * dearest <= free, EXPANSION).otherwise(COPY) if dearest else F.lit(EXPANSION)
        over_e, over_c = self.expansions + expansions > self.cap, self.copies + copies > self.cap
        self.blocker = F.coalesce(self.blocker, F.when(over_e & over_c, first).when(over_e, EXPANSION).when(over_c, COPY))
        self.expansions, self.copies = self.held(self.expansions + expansions), self.held(self.copies + copies)

    def copied(self, rows: Column, exact: Column, bound: int) -> None:
        if bound:
            self.charge(number(0), self.held(rows * (2 * bound) + exact * bound), 0)

    def facts(self, kinds: Sequence[str], rows: Column, exact: Column, bound: int) -> tuple[Column, Column, int]:
        for kind in kinds:
            n, e = self.sizes[kind]
            self.charge(self.held(rows * n), self.held(n * self.held(rows * (2 * bound) + exact * bound)), 3 * bound)
            rows, exact, bound = self.held(rows * n), self.held(exact * e), bound + 1
        return rows, exact, bound

    def clause(self, kind: str, body, rows: Column, exact: Column, bound: int) -> tuple[Column, Column, int]:
        """A clause that holds clauses, for all combinations of the facts in it."""
        if kind == "any_of":
            for branch in body:
                self.copied(rows, exact, bound)
                self.conjunction(branch, rows, exact, bound)
            return rows, exact, bound
        if kind == "not_exists":
            self.copied(rows, exact, bound)
            self.conjunction(body["clauses"], rows, exact, bound)
            return rows, exact, bound
        return self.conjunction(body, rows, exact, bound)

    def conjunction(self, clauses: Sequence[Mapping], rows: Column, exact: Column, bound: int) -> tuple[Column, Column, int]:
        todo = [R.parts(c) for c in clauses]
        rows, exact, bound = self.facts([b["kind"] for k, b in todo if k == "fact"], rows, exact, bound)
        for kind, body in sorted((x for x in todo if x[0] in NESTED), key=lambda x: R.RANK[x[0]]):
            rows, exact, bound = self.clause(kind, body, rows, exact, bound)
        return rows, exact, bound


def kinds_of(clauses: Sequence[Mapping]) -> set[str]:
    out: set[str] = set()
    for kind, body in map(R.parts, clauses):
        if kind == "fact":
            out.add(body["kind"])
        elif kind == "any_of":
            out |= set().union(*map(kinds_of, body))
        elif kind in NESTED:
            out |= kinds_of(body["clauses"] if kind == "not_exists" else body)
    return out


def counted(facts: DataFrame, kinds: Sequence[str], bundle: str) -> DataFrame:
    """(bundle, n0, e0, n1, e1, ...): facts, and exact facts, of each kind in each bundle, from one aggregation."""
    of = [F.col("kind") == k for k in kinds]
    exact = F.col("confidence") < R.POSSIBLE
    values = [x for i, k in enumerate(of) for x in (F.count_if(k).alias(f"n{i}"), F.count_if(k & exact).alias(f"e{i}"))]
    return facts.where(F.col("kind").isin(*kinds)).groupBy(bundle).agg(*values)


def charges(pack: R.Pack, facts: DataFrame, coverage: Mapping[str, str], caps: int | Mapping[str, int] = MOST_EXPANSIONS, bundle: str | None = None) -> DataFrame:
    """(rule_id, bundle, expansions, copies, blocker) of each rule and bundle; a counter that goes over the cap reads one above it (with NO_CAP both are whole), no blocker means that the rule may run.

    Without ``bundle`` all facts are one, named 0.
    """
    facts = facts if bundle else facts.withColumn("bundle", F.lit(0))
    by = bundle or "bundle"
    kinds = sorted(set().union(*[kinds_of(r["clauses"]) for r in pack.rules]))
    counts = keep(counted(facts, kinds, by))
    if not bundle and counts.isEmpty():  # no facts at all are a bundle too
        counts = facts.sparkSession.range(1).select(F.lit(0).alias(by), *[F.lit(0).cast("long").alias(c) for i in range(len(kinds)) for c in (f"n{i}", f"e{i}")])
    sizes = {k: (number(F.col(f"n{i}")), number(F.col(f"e{i}"))) for i, k in enumerate(kinds)}
    out = []
    for rule in pack.rules:
        cap = caps if isinstance(caps, int) else caps.get(rule["rule_id"], MOST_EXPANSIONS)
        out.append(_charged(pack, rule, facts, coverage, cap, by, counts, sizes).select(F.lit(rule["rule_id"]).alias("rule_id"), by, "expansions", "copies", "blocker"))
    return reduce(DataFrame.unionByName, out)


def _charged(pack: R.Pack, rule: Mapping, facts: DataFrame, coverage: Mapping[str, str], cap: int, by: str, counts: DataFrame, sizes: Mapping) -> DataFrame:
    todo = [R.parts(c) for c in rule["clauses"]]
    nested = sorted((x for x in todo if x[0] in NESTED), key=lambda x: R.RANK[x[0]])
    kinds = [b["kind"] for k, b in todo if k == "fact"]
    whole = Meter(cap, sizes)
    whole.conjunction(rule["clauses"], number(1), number(1), 0)
    result = lambda m: [m.expansions.cast("long").alias("expansions"), m.copies.cast("long").alias("copies"), m.blocker.alias("blocker")]
    if not nested:
        return counts.select(by, *result(whole))
    certain = Meter(cap, sizes)
    certain.facts(kinds, number(1), number(1), 0)
    # bundles that only the rows before a nested clause decide
    open_ = keep(counts.where(certain.blocker.isNull() & whole.blocker.isNotNull()))
    decided = counts.where(certain.blocker.isNotNull() | whole.blocker.isNull())
    done = decided.select(by, *[F.when(whole.blocker.isNull(), a).otherwise(b).alias(name) for name, a, b in zip(("expansions", "copies", "blocker"), result(whole), result(certain), strict=True)])
    if open_.isEmpty():
        return done
    inside = facts.join(open_.select(F.col(by).alias("!open")), F.col(by).eqNullSafe(F.col("!open")), "left_semi")
    rows_of, known = [], open_
    for i, (kind, _) in enumerate(nested):
        rank = R.RANK[kind]
        # exists is reached before the equality of fields is asked for, any_of and all_of after it
        before = [{k: b} for k, b in todo if R.RANK[k] < rank] + [{k: b} for k, b in nested[:i] if R.RANK[k] == rank]
        state, bound = R.Evaluation(inside, coverage, pack.needed[rule["rule_id"]], by, crossed=True).conjunction(before, None, ())
        exact = reduce(Column.__and__, [F.col(f"`{a}!x`") for a in bound])
        n = state.groupBy(F.col(f"`{bound[0]}!b`").alias("!at")).agg(F.count(F.lit(1)).alias(f"r{i}"), F.count_if(exact).alias(f"x{i}"))
        known = known.join(n, F.col(by).eqNullSafe(F.col("!at")), "left").drop("!at")
        rows_of.append((number(F.coalesce(F.col(f"r{i}"), F.lit(0))), number(F.coalesce(F.col(f"x{i}"), F.lit(0)))))
    met = Meter(cap, sizes)
    _, _, bound_n = met.facts(kinds, number(1), number(1), 0)
    for (kind, body), (rows, exact) in zip(nested, rows_of, strict=True):
        _, _, bound_n = met.clause(kind, body, rows, exact, bound_n)
    return done.unionByName(known.select(by, *result(met)))


def run(pack: R.Pack, facts: DataFrame, coverage: Mapping[str, str], caps: int | Mapping[str, int] = MOST_EXPANSIONS, bundle: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches of the rules within their budget, and (rule_id, [bundle,] outcome, blocker, expansions, copies, matches) of every rule.

    Facts within a budget need not be connected: their product is bounded.  Without
    ``bundle`` a refused rule has no part in the plan of the matches; with it, the facts
    of refused bundles are left out before any join.
    """
    spark = facts.sparkSession
    charged = keep(charges(pack, facts, coverage, caps, bundle))
    refused = set() if bundle else {r.rule_id for r in charged.where("blocker IS NOT NULL").collect()}  # one row a rule
    found, rows = [], []
    for rule in pack.rules:
        own = charged.where(F.col("rule_id") == rule["rule_id"])
        by = [bundle] if bundle else []
        state = R.gate(rule, coverage)
        matches = None
        if state != "not_evaluated" and rule["rule_id"] not in refused:
            allowed = facts
            if bundle:
                allowed = facts.join(own.where("blocker IS NULL").select(F.col(bundle).alias("!may")), F.col(bundle).eqNullSafe(F.col("!may")), "left_semi")
            ev = R.Evaluation(allowed, coverage, pack.needed[rule["rule_id"]], bundle, crossed=True)
            matches = R.matches(pack, rule, allowed, coverage, ev)
        blocked = matches is None and rule["rule_id"] not in refused  # by coverage
        n = None
        if matches is not None:
            found.append(R.as_text(rule, matches))
            n = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("matches")) if by else matches.agg(F.count(F.lit(1)).alias("matches"))
            n = n.withColumnRenamed(bundle, "!n") if by else n.withColumn("!n", F.lit(0))
        on = F.col(bundle).eqNullSafe(F.col("!n")) if by else F.col("bundle") == F.col("!n")
        joined = own.join(n, on, "left") if n is not None else own.withColumn("matches", F.lit(None).cast("long"))
        some = F.coalesce(F.col("matches"), F.lit(0))
        outcome = F.lit("not_evaluated") if blocked else F.when(F.col("blocker").isNotNull() | F.lit(state == "partial"), "partial").when(some > 0, "matched").otherwise("evaluated_no_match")
        blocker = F.lit("coverage.incomplete") if blocked else F.col("blocker")
        rows.append(joined.select("rule_id", *by, outcome.alias("outcome"), blocker.alias("blocker"), "expansions", "copies", some.alias("matches")))
    empty = spark.createDataFrame([], R.MATCH) if not bundle else None
    done = reduce(DataFrame.unionByName, found) if found else empty if empty is not None else facts.where("false").select(bundle, *[F.lit(None).cast("string").alias(c.split()[0]) for c in R.MATCH.split(", ")])
    return done, reduce(DataFrame.unionByName, rows)
