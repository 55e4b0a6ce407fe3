"""Dependency resolution, ordering and reachability of packages; linking and change detection."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators import chains
from evidentia.operators.graph import reachable, strong_components
from evidentia.shared import keep


def resolve(dependencies: DataFrame, packages: DataFrame) -> DataFrame:
    """Each dependency's resolution: missing, self, on_demand, optional or resolved, the first that holds."""
    p = packages.select(F.col("package").alias("dependency"), "on_demand")
    state = F.when(F.col("on_demand").isNull(), "missing").when(F.col("package") == F.col("dependency"), "self").when(F.col("on_demand") & (F.col("kind") == "required"), "on_demand").when(F.col("kind") == "optional", "optional").otherwise("resolved")
    return dependencies.join(p, "dependency", "left").select("package", "dependency", "kind", state.alias("resolution"))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges between different components, each once."""
    c = components.select("node_id", "component")
    both = edges.join(c.select(F.col("node_id").alias("src"), F.col("component").alias("s")), "src").join(c.select(F.col("node_id").alias("dst"), F.col("component").alias("d")), "dst")
    return both.where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def levels(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, level): the longest path of dependencies below it, 0 for those without any."""
    e = keep(condensed(edges, components))
    level = keep(components.select("component").distinct().withColumn("level", F.lit(0)))
    while True:
        higher = e.join(level, e.dst == level.component).groupBy("src").agg((F.max("level") + 1).alias("up"))
        now = keep(level.join(higher.withColumnRenamed("src", "component"), "component", "left").select("component", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")))
        if now.join(level, ["component", "level"], "left_anti").isEmpty():
            return now
        level = now


def load_order(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, place): dependencies first, ties by the smallest name.

    The tie rule makes the order sequential, so it is computed in one task, on the
    condensed graph: one row for each component of a dependency graph, not data.
    """
    e = condensed(edges, components).select(F.col("src").alias("component"), F.col("dst").alias("needs"))
    rows = components.select("component").distinct().join(e, "component", "left").withColumn("one", F.lit(0))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        waits: dict[str, set[str]] = {c: set() for c in pdf.component}
        for c, n in zip(pdf.component, pdf.needs, strict=True):
            if isinstance(n, str):
                waits[c].add(n)
        users: dict[str, list[str]] = {c: [] for c in waits}
        for c, ns in waits.items():
            for n in ns:
                users[n].append(c)
        ready = [c for c, ns in waits.items() if not ns]
        heapq.heapify(ready)
        out = []
        while ready:
            c = heapq.heappop(ready)
            out.append(c)
            for u in users[c]:
                waits[u].discard(c)
                if not waits[u]:
                    heapq.heappush(ready, u)
        return pd.DataFrame({"component": out, "place": range(len(out))})

    return rows.groupBy("one").applyInPandas(order, "component string, place int")


def cycle_kinds(edges: DataFrame, components: DataFrame) -> DataFrame:
    """required, optional or mixed by the edges within each component."""
    c = components.select("node_id", "component")
    within = edges.join(c.withColumnRenamed("node_id", "src"), "src").join(c.select(F.col("node_id").alias("dst"), F.col("component").alias("other")), "dst").where("component = other")
    r, o = F.bool_and(F.col("kind") == "required"), F.bool_and(F.col("kind") == "optional")
    return within.groupBy("component").agg(F.when(r, "required").when(o, "optional").otherwise("mixed").alias("cycle"))


def reachability(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """reachable by required edges from selected packages, conditional by any, else unreachable."""
    roots = packages.where("selected").select(F.col("package").alias("node_id"))
    sure = reachable(edges.where("kind = 'required'"), roots).select(F.col("node_id").alias("package"), F.lit(True).alias("sure"))
    maybe = reachable(edges, roots).select(F.col("node_id").alias("package"), F.lit(True).alias("maybe"))
    joined = packages.select("package").join(sure, "package", "left").join(maybe, "package", "left")
    return joined.select("package", F.when(F.col("sure"), "reachable").when(F.col("maybe"), "conditional").otherwise("unreachable").alias("reach"))


def load_phase(selected: Column, on_demand: Column) -> Column:
    return F.when(selected & ~on_demand, "startup").when(on_demand, "on_demand").otherwise("dependency")


def link(references: DataFrame, declared: DataFrame) -> DataFrame:
    """Each reference's resolution and where its declarations stand: before, after, self, mixed or unknown."""
    n, first, last, own = F.col("n"), F.col("first"), F.col("last"), F.col("p_partkey")
    place = F.when(n.isNull(), "unknown").when(last < own, "before").when(first > own, "after").when((first == own) & (last == own), "self").otherwise("mixed")
    return references.join(declared, "p_name", "left").select("p_partkey", F.when(n.isNull(), "missing").when(n > 1, "ambiguous").otherwise("unique").alias("resolution"), place.alias("place"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed, updated or unchanged by key."""
    both = old.withColumnRenamed("v", "o").withColumn("had", F.lit(True)).join(new.withColumnRenamed("v", "w").withColumn("has", F.lit(True)), "k", "full")
    return both.select("k", F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("w")), "unchanged").otherwise("updated").alias("change"))


def excerpts(documents: DataFrame, start: int, end: int) -> DataFrame:
    """(doc_id, excerpt, state) of bytes [start, end) of each (doc_id, text, digest), shrunk to whole characters.

    digest_mismatch: the text is not the one that the digest was taken of, so nothing
    is read; out_of_range: it ends before ``end``, what there is is read.
    """
    raw = F.encode("text", "utf-8")
    # the first byte of a character is not of the form 10xxxxxx
    follows = lambda at: F.conv(F.hex(F.substring(raw, at + 1, 1)), 16, 10).cast("int").bitwiseAND(192) == 128
    low = F.lit(start) + sum((F.when(reduce(Column.__and__, [follows(start + k) for k in range(j + 1)]), 1).otherwise(0) for j in range(3)), F.lit(0))
    high = F.lit(end) - sum((F.when(reduce(Column.__and__, [follows(end - k) for k in range(j + 1)]), 1).otherwise(0) for j in range(3)), F.lit(0))
    part = F.decode(raw.substr(low + 1, F.greatest(high - low, F.lit(0))), "utf-8")
    fits, same = F.octet_length("text") >= end, F.sha2("text", 256) == F.col("digest")
    state = F.when(F.col("text").isNull() | ~same, "digest_mismatch").when(~fits, "out_of_range").otherwise("read")
    return documents.select("doc_id", F.when(F.col("text").isNotNull() & same, part).alias("excerpt"), state.alias("state"))


def inheritance_cycles(edges: DataFrame) -> DataFrame:
    """(cycle, members): the smallest element of each cycle of parents or inherits, and how many are on it; one that inherits itself is a cycle of one."""
    nodes = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()
    size = strong_components(edges, nodes).groupBy(F.col("component").alias("cycle")).agg(F.count(F.lit(1)).alias("members"))
    own = edges.where("src = dst").select(F.col("src").alias("cycle")).distinct().withColumn("self", F.lit(True))
    return size.join(own, "cycle", "left").where("members > 1 or self").select("cycle", "members")


# fixed values: kinds of issues of package loading; the first two and the fourth block a complete load
ISSUES = (
    "missing_required_dependency", "missing_optional_dependency", "dependency_condition_unresolved", "invalid_dependency_name", "duplicate_dependency", "self_dependency",
    "required_dependency_cycle", "optional_dependency_cycle", "mixed_dependency_cycle", "conflicting_load_on_demand", "package_file_closure_partial",
)


def issues(declared: DataFrame, packages: DataFrame, components: DataFrame) -> DataFrame:
    """(issue, package, dependency) of declarations (package, dependency, kind, condition) among packages (package, on_demand, on_demand_again, closure_complete).

    ``condition``: true, false or null (unresolved).  ``components``: (node_id, component) of the resolved graph.
    """
    row = lambda df, issue, dependency="dependency": df.select(F.lit(issue).alias("issue"), "package", (F.col(dependency) if dependency else F.lit(None).cast("string")).alias("dependency"))
    known = packages.select(F.col("package").alias("dependency"), F.lit(True).alias("known"))
    valid = F.col("dependency").rlike("^[A-Za-z][A-Za-z0-9_-]*$")
    d = declared.withColumn("valid", valid).join(known, "dependency", "left")
    absent = d.where("valid and known is null")
    own = components.select("node_id", "component")
    inside = declared.join(own.select(F.col("node_id").alias("package"), "component"), "package").join(own.select(F.col("node_id").alias("dependency"), F.col("component").alias("other")), "dependency").where("component = other and package <> dependency")
    kinds = inside.groupBy("component").agg(F.bool_and(F.col("kind") == "required").alias("r"), F.bool_and(F.col("kind") == "optional").alias("o")).withColumnRenamed("component", "package")
    twice = declared.groupBy("package", "dependency").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = [
        row(absent.where("kind = 'required'"), ISSUES[0]),
        row(absent.where("kind = 'optional'"), ISSUES[1]),
        row(d.where("valid and known and condition is null"), ISSUES[2]),
        row(d.where("not valid"), ISSUES[3]),
        row(twice, ISSUES[4]),
        row(d.where("package = dependency"), ISSUES[5]),
        row(kinds.where("r"), ISSUES[6], None),
        row(kinds.where("o"), ISSUES[7], None),
        row(kinds.where("not r and not o"), ISSUES[8], None),
        row(packages.where("on_demand <> on_demand_again"), ISSUES[9], None),
        row(packages.where("not closure_complete"), ISSUES[10], None),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


COMPONENTS = ("source", "signature", "shape", "neighborhood", "load_role")


def fingerprints(entities: DataFrame, members: DataFrame, edges: DataFrame, roles: DataFrame) -> DataFrame:
    """(entity, source, signature, shape, neighborhood, load_role, composite): digests of an entity's text, its members' types in order, their optionality, its edges, its role, and of all five if none is missing.

    ``members``: entity, position, type, optional; ``edges``: entity, relation, other; ``roles``: entity, role.
    """
    digest = lambda c: F.sha2(c, 256)
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", c.alias("x")))), lambda m: m["x"]), ",")
    m = members.groupBy("entity").agg(digest(in_order(F.col("type"))).alias("signature"), digest(in_order(F.when(F.col("optional"), "?").otherwise("!"))).alias("shape"))
    e = edges.groupBy("entity").agg(digest(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "relation", "other"))), ",")).alias("neighborhood"))
    r = roles.where(F.col("role").isNotNull()).groupBy("entity").agg(digest(F.array_join(F.array_sort(F.collect_set("role")), ",")).alias("load_role"))
    rows = entities.select("entity", digest(F.col("text")).alias("source")).join(m, "entity", "left").join(e, "entity", "left").join(r, "entity", "left")
    composite = F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in COMPONENTS]), digest(F.concat_ws("|", *COMPONENTS)))
    return rows.select("entity", *COMPONENTS, composite.alias("composite"))


RESOLUTIONS = ("dynamic_name", "unsupported_name", "invalid_source", "ambiguous_name", "not_in_captured_scope", "invalid_target", "unique_local_declaration")


def link_references(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """(reference_id, resolution, place, issues) of references (reference_id, name, place, source_valid) to declarations (declaration_id, name, place, valid).

    place: target_before_source, target_after_source, self_reference, repeated_load (the
    target's file is loaded several times, ``loads`` > 1) or unrecorded (no place known);
    only a unique target has one.  Not in the captured scope is no proof of absence.
    issues: what about it deserves a note, in a fixed order.
    """
    d = declarations.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("at"), F.min("loads").alias("loads"), F.bool_and("valid").alias("target_valid"))
    name = F.col("name")
    rows = references.join(d, "name", "left")
    resolution = (
        F.when(name.contains("$"), "dynamic_name").when(~name.rlike("^[A-Za-z_][A-Za-z0-9_ ]*$"), "unsupported_name").when(~F.col("source_valid"), "invalid_source")
        .when(F.col("n").isNull(), "not_in_captured_scope").when(F.col("n") > 1, "ambiguous_name").when(~F.col("target_valid"), "invalid_target").otherwise("unique_local_declaration")
    )
    rows = rows.withColumn("resolution", resolution)
    own = F.col("at")
    place = F.when(own.isNull() | F.col("place").isNull(), "unrecorded").when(F.col("loads") > 1, "repeated_load").when(own == F.col("place"), "self_reference").when(own < F.col("place"), "target_before_source").otherwise("target_after_source")
    rows = rows.withColumn("order", F.when(F.col("resolution") == "unique_local_declaration", place))
    note = F.array_compact(F.array(
        F.when(F.col("resolution") == "ambiguous_name", "ambiguous_reference"), F.when(F.col("resolution") == "not_in_captured_scope", "not_in_captured_scope"),
        F.when(F.col("resolution") == "dynamic_name", "dynamic_reference"), F.when(F.col("resolution") == "unsupported_name", "unsupported_reference"),
        F.when(F.col("resolution") == "invalid_source", "invalid_source"), F.when(F.col("resolution") == "invalid_target", "invalid_target"),
        F.when(F.col("order") == "target_after_source", "target_after_source"), F.when(F.col("order") == "repeated_load", "repeated_load"), F.when(F.col("order") == "unrecorded", "unrecorded_load"),
    ))
    return rows.select("reference_id", "resolution", F.col("order").alias("place"), F.array_join(note, ",").alias("issues"))


def update_snapshot(old: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a set of changes (key, action, expected, digest) makes of a snapshot (key, digest): the outcome of each, and the snapshot after it.

    add needs an absent key, update and remove one that holds ``expected``; an update to
    the digest that is there is a no-op.  One failed change and the previous snapshot
    stays as it is.
    """
    rows = changes.join(old.select("key", F.col("digest").alias("held")), "key", "left")
    fits = F.when(F.col("action") == "add", F.col("held").isNull()).otherwise(F.coalesce(F.col("held") == F.col("expected"), F.lit(False)))
    outcome = F.when(~fits, "failed").when((F.col("action") == "update") & (F.col("held") == F.col("digest")), "no_op").otherwise(F.col("action"))
    told = rows.withColumn("outcome", outcome)
    failed = told.agg(F.count_if(F.col("outcome") == "failed").alias("any"))  # one row
    after = old.join(told.select("key", "outcome", F.col("digest").alias("new")), "key", "full").join(F.broadcast(failed))
    kept = after.select("key", F.when(F.col("any") > 0, F.col("digest")).when(F.col("outcome").isin("add", "update"), F.col("new")).when(F.col("outcome") == "remove", None).otherwise(F.col("digest")).alias("digest"))
    return told.select("key", "outcome"), kept.where(F.col("digest").isNotNull())


def classify(elements: DataFrame, types: DataFrame, classes: DataFrame) -> DataFrame:
    """(element, class, via) of elements (element, type): the class of its type or of the nearest type that it extends (type, base); via is that type.

    unclassified where the chain ends without one, unknown_type where it leaves the
    schema, cyclic_type where it comes back; chains may be of any length.
    """
    chain = types.join(classes.select("type", "class"), "type", "left")
    # a type with a class ends every chain that reaches it
    found = chains.ends(chain.select(F.col("type").alias("node"), F.when(F.col("class").isNull(), F.col("base")).alias("next"), F.lit(0).alias("weight")))
    found = found.join(classes.select(F.col("type").alias("end"), "class"), "end", "left").select(F.col("node").alias("type"), "state", "end", "class")
    known = F.when(F.col("state") == chains.ENDED, F.coalesce("class", F.lit("unclassified"))).when(F.col("state") == chains.CYCLE, "cyclic_type").otherwise("unknown_type")
    via = F.when((F.col("state") == chains.ENDED) & F.col("class").isNotNull(), F.col("end"))
    return elements.select("element", "type").join(found, "type", "left").select("element", known.alias("class"), via.alias("via"))
