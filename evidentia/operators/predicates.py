"""Filters and three-valued predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INCLUDED, UNRESOLVED, EXCLUDED = 0, 1, 2


def typed(kind: str, value: object) -> Column:
    """A typed literal; the type is part of its identity."""
    return F.struct(F.lit(kind).alias("t"), F.lit(None if value is None else str(value)).alias("v"))


def field_eq(field: Column, literal: Column) -> Column:
    """Equal type and value; a missing field (null struct) never matches, a typed nil equals a typed nil."""
    return field.isNotNull() & (field == literal)


def field_in(field: Column, literals: Sequence[Column]) -> Column:
    out = F.lit(False)
    for x in literals:
        out = out | field_eq(field, x)
    return out


def same_scope(a_kind: Column, a_id: Column, b_kind: Column, b_id: Column, kind: str, known: Sequence[str]) -> Column:
    """Both facts have this kind of scope and the same scope id; an unknown kind is false."""
    if kind not in known:
        return F.lit(False)
    return (a_kind == kind) & (b_kind == kind) & (a_id == b_id)


def ordered(a: Column, b: Column, relation: str) -> Column:
    """before, after or equal of integer fields (structs t, v); any other type is false."""
    integers = (a["t"] == "integer") & (b["t"] == "integer")
    x, y = a["v"].try_cast("long"), b["v"].try_cast("long")
    return F.coalesce(integers & {"before": x < y, "after": x > y, "equal": x == y}[relation], F.lit(False))


def conjunction(*truths: Column) -> Column:
    """Excluded beats unresolved beats included; null counts as unresolved."""
    return F.greatest(*[F.coalesce(t, F.lit(UNRESOLVED)) for t in truths]) if len(truths) > 1 else F.coalesce(truths[0], F.lit(UNRESOLVED))


def condition(kind: str, value: Column, context: Mapping[str, Sequence[str] | None], known: Sequence[str]) -> Column:
    """Truth of `kind value[, value ...]` in a context: values are alternatives, a kind `not_x` inverts x, an unknown context or malformed value is unresolved."""
    inverted, base = kind.startswith("not_"), kind.removeprefix("not_")
    values = F.filter(F.split(value, r"\s*,\s*"), lambda s: s != "")
    malformed = value.isNull() | (F.size(values) == 0) | F.exists(values, lambda s: ~s.rlike("^[a-z][a-z0-9_]*$"))
    if base not in known or context.get(base) is None:
        return F.lit(UNRESOLVED)
    hit = F.arrays_overlap(values, F.array(*map(F.lit, context[base]))) if context[base] else F.lit(False)
    return F.when(malformed, UNRESOLVED).when(hit != F.lit(inverted), INCLUDED).otherwise(EXCLUDED)


def inline_clauses(line: Column) -> tuple[Column, Column]:
    """A manifest line without its `[clause]` parts, and the clauses in order."""
    return F.trim(F.regexp_replace(line, r"\s*\[[^\[\]]*\]", "")), F.regexp_extract_all(line, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))


def substitute(path: Column, variables: Mapping[str, str]) -> Column:
    """Replace path variables written `[Name]`."""
    for name, value in variables.items():
        path = F.replace(path, F.lit(f"[{name}]"), F.lit(value))
    return path


def field_shape(fields: Column, position: int, original_type: str | None = None, nilable: bool | None = None) -> Column:
    """The field at a 0-based position exists and has this type and nilability."""
    at = F.get(fields, F.lit(position))
    out = at.isNotNull()
    if original_type is not None:
        out = out & (at["original_type"] == original_type)
    if nilable is not None:
        out = out & at["nilable"].eqNullSafe(F.lit(nilable))
    return F.coalesce(out, F.lit(False))


def all_fields(fields: Column, shapes: Sequence[dict]) -> Column:
    """Every shape holds; two shapes at one position, or more than 128, are an invalid request."""
    positions = [s["position"] for s in shapes]
    if len(set(positions)) < len(positions) or len(shapes) > 128:
        raise ValueError("field shapes have distinct positions, at most 128")
    out = F.lit(True)
    for s in shapes:
        out = out & field_shape(fields, **s)
    return out


def require_known(values: Sequence[str], known: Sequence[str], what: str) -> None:
    """A request that names something unregistered, or anything twice, is an error and not an empty result."""
    if len(set(values)) < len(values) or set(values) - set(known):
        raise ValueError(f"unknown or repeated {what}: {sorted(values)}")


def contained(inner_start: Column, inner_end: Column, start: Column, end: Column) -> Column:
    return (start <= inner_start) & (inner_end <= end)


def stabbing(spans: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """Spans [span_start, span_end) over each offset: an equi join on buckets of ``width``, then the range test."""
    wide = spans.where("span_start < span_end").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("span_start") / width), F.floor((F.col("span_end") - 1) / width))))
    at = points.withColumn("bucket", F.floor(F.col("at") / width))
    return at.join(wide, "bucket").where("span_start <= at and at < span_end").drop("bucket")


DECLARATIONS = {"structure": {"fields"}, "callback": {"arguments", "returns"}, "enumeration": {"members", "member"}, "constants": {"members", "member"}, "script_object": set()}


def declaration_shape(kind: str, **wanted: int | str) -> Column:
    """Declarations (kind, fields, arguments, returns, members arrays) of a kind with these counts, or with a ``member`` of that name; a selector that the kind doesn't have is an error."""
    if kind not in DECLARATIONS or set(wanted) - DECLARATIONS[kind]:
        raise ValueError(f"no such shape of {kind}: {sorted(wanted)}")
    out = F.col("kind") == kind
    for name, value in wanted.items():
        out = out & (F.array_contains("members", value) if name == "member" else F.size(F.coalesce(name, F.array())) == value)
    return out


BINDINGS = ("exact", "unresolved", "conflicted")


def restriction_shape(kind: str | None = None, scope: str | None = None, facet: str | None = None, state: str | None = None, subject: str | None = None, binding: str | None = None) -> Column:
    """Restrictions (kind, scope, facets array<struct<id,state>>, subject, digest, conflicted) with all that is given; facet and state may be those of different facets; nothing given is an error."""
    checks = []
    for column, value in (("kind", kind), ("scope", scope), ("subject", subject)):
        if value is not None:
            checks.append(F.col(column).eqNullSafe(F.lit(value)))
    for member, value in (("id", facet), ("state", state)):
        if value is not None:
            checks.append(F.coalesce(F.exists("facets", lambda f: f[member] == value), F.lit(False)))  # noqa: B023
    if binding is not None:
        known = F.col("digest").isNotNull()
        checks.append({"exact": known & ~F.col("conflicted"), "unresolved": ~known & ~F.col("conflicted"), "conflicted": F.col("conflicted")}[binding])
    if not checks:
        raise ValueError("a restriction shape names at least one facet of it")
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def slot_path(root: str, keys: Sequence[tuple[str, object]], access: str, aliases: str) -> Column:
    """Accesses (root, keys array<struct<t,v>>, complete, access, alias) of exactly this path; an incomplete path never matches, an aliased one only if ``aliases`` allows it."""
    if access not in ("read", "write", "any") or aliases not in ("allow", "block"):
        raise ValueError("access is read, write or any; aliases allow or block")
    wanted = F.array(*[typed(t, v) for t, v in keys]) if keys else F.array().cast("array<struct<t:string,v:string>>")
    out = (F.col("root") == root) & F.col("complete") & (F.col("keys") == wanted)
    if access != "any":
        out = out & (F.col("access") == access)
    return out & (F.lit(aliases == "allow") | ~F.col("alias"))


def in_scope(files: DataFrame, scope: str, names: Sequence[str] = ()) -> DataFrame:
    """Files (file_id, kind) of a rule's scope: all, files (these ids, each known and named once), or xml_documents."""
    if scope == "all":
        return files
    if scope == "xml_documents":
        return files.where(F.col("kind") == "xml")
    if scope != "files" or not names or len(set(names)) < len(names):
        raise ValueError("a scope of files names them once each")
    asked = files.sparkSession.createDataFrame([(n,) for n in names], "file_id string")
    if not asked.join(files.select("file_id"), "file_id", "left_anti").isEmpty():
        raise ValueError("the scope names a file that is not there")
    return files.join(asked, "file_id", "left_semi")


def record_filter(records: DataFrame, kinds: Sequence[str], supported: Sequence[str], lanes: Sequence[str], namespace: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Records (kind, namespace) of these kinds and, if given, exactly this namespace ("" is the global one), and each lane's state: one kind that the records don't support makes every lane miss the capability, and no record passes."""
    if set(kinds) - set(supported):
        return records.where(F.lit(False)), dict.fromkeys(lanes, "missing_filter_capability")
    out = records.where(F.col("kind").isin(*kinds))
    if namespace is not None:
        out = out.where(F.coalesce("namespace", F.lit("")) == namespace)
    return out, dict.fromkeys(lanes, "evaluated")


def payload_shape(fields: Column, count: int | None = None, shapes: Sequence[dict] = ()) -> Column:
    """An event's payload has so many fields and all of these shapes; asking for nothing is an error."""
    if count is None and not shapes:
        raise ValueError("a payload shape asks for a count or a field")
    out = all_fields(fields, shapes) if shapes else F.lit(True)
    return out if count is None else out & (F.size(F.coalesce(fields, F.array())) == count)
