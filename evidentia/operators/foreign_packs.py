"""Validation of packs that another producer made: eight checks in order, each valid, invalid or not evaluated.

A pack is canonical JSON: its schema and profile, the budget it was made under, the
generation of the data that owns it, items with identities, and references between them.
Every identity is recomputed from canonical bytes; references are to items of the pack;
the owner's generation is looked up among those that are known here.  A check that fails
leaves those behind it not evaluated, but for authority, which no foreign pack is given:
it is never evaluated.

Each text is checked on its own in Arrow batches; what needs a table (generations) is
joined behind.  Cases: a null text is one of no bytes; repeated packs repeat their rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.sources.text import strict_json

# fixed values: the checks in order, and the states
CHECKS = ("byte_admission", "canonical_bytes", "schema", "compiled_profile", "digest_and_identity", "internal_references", "owner_generation_closure", "source_or_runtime_authority")
VALID, INVALID, NOT_EVALUATED = "valid", "invalid", "not_evaluated"
SCHEMA, PROFILE = "evidentia/pack/1", "evidentia/structural-pack/1"
MEMBERS = {"schema": str, "profile": str, "pack_id": str, "owner": str, "generation": int, "budget": int, "items": list, "references": list}
ITEM = {"item_id": str, "kind": str, "payload": dict, "weight": int}
REFERENCE = {"source": str, "target": str}
MOST_BYTES, MOST_DEPTH = 8 << 20, 128


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def identity(kind: str, value: object) -> str:
    return hashlib.sha256(f"{kind}|{canonical(value)}".encode()).hexdigest()


def item(kind: str, payload: dict, weight: int) -> dict:
    """An item with the identity of its content."""
    return {"item_id": identity("item", [kind, payload]), "kind": kind, "payload": payload, "weight": weight}


def pack(owner: str, generation: int, budget: int, items: list[dict], references: list[dict]) -> str:
    """A pack as canonical text, with the identity of all that it holds."""
    body = {"schema": SCHEMA, "profile": PROFILE, "owner": owner, "generation": generation, "budget": budget, "items": items, "references": references}
    return canonical({**body, "pack_id": identity("pack", body)})


def _shaped(value: object, members: dict[str, type]) -> bool:
    return isinstance(value, dict) and value.keys() == members.keys() and all(type(value[k]) is t for k, t in members.items())


def _depth(text: str) -> int:
    deepest = depth = 0
    quoted = escaped = False
    for c in text:
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif c in "]}":
            depth -= 1
    return deepest


def closure(text: str | None, most_bytes: int = MOST_BYTES) -> tuple[list[str], str | None, str | None, int | None]:
    """States of the checks up to internal references, why one failed, and the owner and generation that are still to be looked up."""
    text, states = text or "", [NOT_EVALUATED] * len(CHECKS)

    def fails(check: str, reason: str) -> tuple:
        states[CHECKS.index(check)] = INVALID
        return states, reason, None, None

    if not text or len(text.encode()) > most_bytes or _depth(text) > MOST_DEPTH:
        return fails("byte_admission", "empty" if not text else "input_too_large" if len(text.encode()) > most_bytes else "too_deep")
    states[0] = VALID
    try:
        value = strict_json(text, most_bytes)
    except ValueError as e:
        why = str(e).split(" ")[0]
        return fails("canonical_bytes", {"repeated": "duplicate_object_key", "null": "null_or_float_forbidden", "float": "null_or_float_forbidden"}.get(why, "input_not_canonical_json"))
    if canonical(value) != text:
        return fails("canonical_bytes", "input_not_canonical_json")
    states[1] = VALID
    if not _shaped(value, MEMBERS) or value["schema"] != SCHEMA:
        return fails("schema", "wire_schema_mismatch")
    if not all(_shaped(i, ITEM) for i in value["items"]) or not all(_shaped(r, REFERENCE) for r in value["references"]):
        return fails("schema", "wire_schema_mismatch")
    states[2] = VALID
    if value["profile"] != PROFILE:
        return fails("compiled_profile", "unsupported_profile")
    if any(i["weight"] < 0 for i in value["items"]) or sum(i["weight"] for i in value["items"]) > value["budget"]:
        return fails("compiled_profile", "compiled_profile_mismatch")
    states[3] = VALID
    ids = [i["item_id"] for i in value["items"]]
    if any(i["item_id"] != identity("item", [i["kind"], i["payload"]]) for i in value["items"]) or len(set(ids)) < len(ids):
        return fails("digest_and_identity", "digest_identity_mismatch")
    if value["pack_id"] != identity("pack", {k: v for k, v in value.items() if k != "pack_id"}):
        return fails("digest_and_identity", "semantic_pack_identity_mismatch")
    states[4] = VALID
    known = set(ids)
    if any(r["source"] not in known or r["target"] not in known for r in value["references"]):
        return fails("internal_references", "internal_reference_mismatch")
    states[5] = VALID
    return states, None, value["owner"], value["generation"]


def produced(rows: DataFrame, key: str) -> DataFrame:
    """(key, text): a pack of one item for each row (key, owner, generation, kind, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for owner, generation, kind, name in zip(*[batch.column(i).to_pylist() for i in range(1, 5)], strict=True):
                one = item(kind, {"name": name}, 1)
                made.append(pack(owner, generation, 1, [one], [{"source": one["item_id"], "target": one["item_id"]}]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [key, "text"])

    return rows.select(key, "owner", F.col("generation").cast("long"), "kind", "name").mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, text string")


def resealed(text: Column) -> Column:
    """A canonical pack whose own identity is recomputed: its members but for ``pack_id``, which stands in the order of names."""
    bare = F.regexp_replace(text, '"pack_id":"[0-9a-f]+",', "")
    own = F.sha2(F.concat(F.lit("pack|"), bare), 256)
    return F.regexp_replace(text, '"pack_id":"[0-9a-f]+"', F.concat(F.lit('"pack_id":"'), own, F.lit('"')))


def validate(packs: DataFrame, key: str, text: str, generations: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, check, place, state, reason) of every check of every pack (key, text), given the published generations (owner, generation, retained)."""
    names = [key, "states", "reason", "owner", "generation"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [closure(t, most_bytes) for t in batch.column(1).to_pylist()]
            columns = list(zip(*told, strict=True)) if told else [[]] * 4
            types = [pa.list_(pa.string()), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    checked = packs.select(key, text).mapInArrow(run, f"`{key}` {dict(packs.dtypes)[key]}, states array<string>, reason string, owner string, generation long")
    published = generations.groupBy("owner", "generation").agg(F.bool_or("retained").alias("retained"))
    rows = checked.join(published, ["owner", "generation"], "left")
    open_ = F.col("owner").isNotNull()
    owner = F.when(open_, F.when(F.col("retained"), VALID).otherwise(INVALID)).otherwise(F.element_at("states", 7))
    reason = F.coalesce("reason", F.when(open_ & F.col("retained").isNull(), "unknown_generation").when(open_ & ~F.col("retained"), "generation_not_retained"))
    states = F.transform(F.array(*map(F.lit, CHECKS)), lambda c, i: F.struct(c.alias("check"), (i + 1).alias("place"), F.when(i == 6, owner).otherwise(F.get("states", i)).alias("state")))
    return rows.select(key, F.explode(states).alias("c"), reason.alias("why")).select(key, "c.check", "c.place", "c.state", F.when(F.col("c.state") == INVALID, F.col("why")).alias("reason"))
