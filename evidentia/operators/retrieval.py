"""Ranked retrieval: lanes, lane states, authority bands, fusion, federation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.operators import ranking as R

#: authority bands; a smaller one is stronger
BANDS = {"identity": 0, "qualified_name": 1, "short_name": 2, "alias": 3, "namespace": 4, "prefix": 5, "text": 7, "shape": 7, "similarity": 8, "graph": 9}
MISSING_SUBJECT_BAND = 10
CLASSES = {"exact": ("identity", "qualified_name"), "prefix": ("prefix",), "literal": ("text",), "mixed": ("identity", "qualified_name", "prefix", "text")}
FEDERATED = ("truncated", "lane_unavailable", "conflict_blocked", "exact_found", "candidate_only", "exact_not_found_partial", "none")


@dataclass(frozen=True)
class Request:
    query_class: str
    entity_id: int | None = None
    text: str | None = None
    prefix: str | None = None
    enabled: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    most: int = 10_000

    def __post_init__(self) -> None:
        if self.query_class not in CLASSES:
            raise ValueError(f"unknown query class {self.query_class}")
        if len(set(self.enabled)) < len(self.enabled) or not set(self.required) <= set(self.enabled):
            raise ValueError("lanes are unique and required ones are enabled")

    def condition(self, lane: str, entity: Column, label: Column) -> Column | None:
        """What a lane matches; None if the request gives it nothing to match."""
        if lane == "identity" and self.entity_id is not None:
            return entity == self.entity_id
        if lane == "qualified_name" and self.text is not None:
            return label == self.text
        if lane == "prefix" and self.prefix is not None:
            return S.prefix_match(label, self.prefix)
        if lane == "text" and self.text is not None:
            return S.has_phrase(label, self.text)
        return None

    def lanes(self) -> dict[str, str]:
        """State of each lane before anything is read: run, excluded or unsupported_query_class."""
        return {lane: "excluded" if lane not in self.enabled else "run" if lane in CLASSES[self.query_class] else "unsupported_query_class" for lane in BANDS if lane in {"identity", "qualified_name", "prefix", "text"}}


def signals(documents: DataFrame, request: Request) -> DataFrame:
    """(lane, entity_id, band) of every match, from one scan of documents(entity_id, label)."""
    hits = []
    for lane, state in request.lanes().items():
        cond = request.condition(lane, F.col("entity_id"), F.col("label")) if state == "run" else None
        if cond is not None:
            hits.append(F.when(cond, F.struct(F.lit(lane).alias("lane"), F.lit(BANDS[lane]).alias("band"))))
    if not hits:
        return documents.limit(0).select(F.lit("").alias("lane"), "entity_id", F.lit(0).alias("band"))
    found = documents.select("entity_id", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
    return found.select("h.lane", "entity_id", "h.band")


def retrieve(documents: DataFrame, request: Request) -> DataFrame:
    """Fused candidates in rank order with their place, at most ``most``."""
    fused = R.fuse(R.lane_ranks(signals(documents, request)))
    return R.top(fused, R.ORDER_KEY, request.most)


def lane_states(documents: DataFrame, request: Request) -> DataFrame:
    """(lane, state, matched) of each lane: complete, truncated, excluded, or unsupported_query_class."""
    spark = documents.sparkSession
    planned = spark.createDataFrame(list(request.lanes().items()), "lane string, planned string")
    n = signals(documents, request).groupBy("lane").agg(F.count(F.lit(1)).alias("matched"))
    state = F.when(F.col("planned") != "run", F.col("planned")).when(F.col("matched") > request.most, "truncated").otherwise("complete")
    return planned.join(n, "lane", "left").withColumn("matched", F.coalesce("matched", F.lit(0).cast("long"))).select("lane", state.alias("state"), "matched")


def overall_state(states: DataFrame, request: Request) -> DataFrame:
    """One row: missing required lane > truncated > exact found > candidates > exact not found (partial) > none."""
    required = F.col("lane").isin(*request.required) if request.required else F.lit(False)
    lacking = F.bool_or(required & ~F.col("state").isin("complete", "truncated"))
    exact = F.sum(F.when(F.col("lane").isin("identity", "qualified_name"), F.col("matched")).otherwise(0)) > 0
    asked = F.bool_or(F.col("lane").isin("identity", "qualified_name") & (F.col("state") == "complete"))
    state = F.when(lacking, "missing_required").when(F.bool_or(F.col("state") == "truncated"), "truncated").when(exact, "exact_found").when(F.sum("matched") > 0, "candidates").when(asked, "exact_not_found_partial").otherwise("none")
    return states.agg(state.alias("state"))


def federate(components: Sequence[tuple[str, DataFrame]], caps: dict[str, int] | None = None) -> DataFrame:
    """Fuse candidate lists of several universes (entity_id, band, place): rank by (effective band, universe priority, place); one name in two universes stays two candidates."""
    out = None
    for priority, (universe, df) in enumerate(components):
        band = F.greatest(F.col("band"), F.lit((caps or {}).get(universe, 0)))
        part = df.select(F.lit(universe).alias("universe"), F.lit(priority).alias("priority"), F.col("entity_id").cast("string").alias("entity_id"), band.alias("band"), F.col("place").alias("ordinal"), R.contribution(F.col("place")).alias("rr"))
        out = part if out is None else out.unionByName(part)
    return out


FEDERATED_ORDER = ("band", "priority", "ordinal", "entity_id")


def federated_state(truncated: Column, unavailable: Column, conflict: Column, best_band: Column, exact_asked: Column) -> Column:
    """The first that holds in the order of FEDERATED."""
    return F.when(truncated, FEDERATED[0]).when(unavailable, FEDERATED[1]).when(conflict, FEDERATED[2]).when(best_band <= 4, FEDERATED[3]).when(best_band.isNotNull(), FEDERATED[4]).when(exact_asked, FEDERATED[5]).otherwise(FEDERATED[6])


def alias_lane(aliases: DataFrame, text: str) -> DataFrame:
    """Targets of resolved aliases with this value, and how many were unresolved or in conflict."""
    mine = aliases.where(F.col("value") == text)
    return mine.groupBy("target").agg(F.count_if(F.col("state") == "resolved").alias("resolved"), F.count_if(F.col("state") != "resolved").alias("blocked"))


def similar(documents: DataFrame, fields: Sequence[str], text: str, k: int) -> DataFrame:
    """Nearest field of each entity within k edits of the ASCII-folded text: (entity_id, distance, field)."""
    near = [F.struct(S.bounded_distance(S.ascii_fold(F.col(f)), S.ascii_fold(F.lit(text)), k).alias("distance"), F.col(f).alias("value"), F.lit(i).alias("field")) for i, f in enumerate(fields)]
    best = F.array_min(F.filter(F.array(*near), lambda x: x["distance"].isNotNull()))
    return documents.select("entity_id", best.alias("b")).where("b is not null").select("entity_id", "b.distance", F.col("b.value").alias("value"), F.col("b.field").alias("field"))


def band(matches: dict[str, Column], subject_missing: Column | None = None) -> Column:
    """The strongest band among the kinds of match that hold (names of BANDS); null if none does.  A restriction whose subject is missing is never stronger than MISSING_SUBJECT_BAND unless its identity was asked for."""
    out = F.least(*[F.when(holds, BANDS[kind]) for kind, holds in matches.items()], F.lit(None).cast("int"))
    if subject_missing is not None:
        out = F.when(subject_missing & (out != BANDS["identity"]), F.greatest(out, F.lit(MISSING_SUBJECT_BAND))).otherwise(out)
    return out


#: relations that an entity's relatives are found by, for each profile
PROFILES = {"ownership": ("owns", "owned_by"), "structure": ("contains",), "use": ("uses", "supplied_by"), "all": ("owns", "owned_by", "contains", "uses", "supplied_by")}


def entities(nodes: DataFrame, edges: DataFrame, ids: Sequence[str] = (), owner: str | None = None, literal: str | None = None, profile: str | None = None, most: int = 10_000) -> DataFrame:
    """(node_id, band) of entities by id (band 0), owner key (1), label tokens (7), and those one relation of the profile away from these (9), the strongest band of each, at most ``most`` by (band, node_id)."""
    checks = {}
    if ids:
        checks["identity"] = F.col("node_id").isin(*ids)
    if owner is not None:
        checks["qualified_name"] = F.col("owner_key") == owner
    if literal is not None:
        checks["text"] = S.has_phrase(F.col("label"), literal)
    if not checks:
        raise ValueError("nothing to look for")
    direct = nodes.select("node_id", band(checks).alias("band")).where(F.col("band").isNotNull())
    if profile is not None:
        own = edges.where(F.col("relation").isin(*PROFILES[profile]))
        step = own.select("src", "dst").unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        related = step.join(direct.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node_id"), F.lit(BANDS["graph"]).alias("band")).distinct()
        direct = direct.unionByName(related).groupBy("node_id").agg(F.min("band").alias("band"))
    return direct.orderBy("band", "node_id").limit(most)


def observations(facts: DataFrame, kinds: Sequence[str], fact_id: int | None = None, name: str | None = None, member: tuple[str, str] | None = None, slot: Column | None = None, prefix: str | None = None, literal: str | None = None, similar: tuple[str, int] | None = None, most: int = 100) -> DataFrame:
    """(fact_id, kind, lane, band): the best ``most`` observations (fact_id, kind, name, receiver, member, text) of these kinds, each by its strongest lane.

    Lanes: exact fact, name, receiver.member, slot path, name prefix, literal phrase,
    name within an edit distance.
    """
    lanes = {}
    if fact_id is not None:
        lanes["fact"] = (F.col("fact_id") == fact_id, 0)
    if name is not None:
        lanes["name"] = (F.col("name") == name, 1)
    if member is not None:
        lanes["member"] = ((F.col("receiver") == member[0]) & (F.col("member") == member[1]), 1)
    if slot is not None:
        lanes["slot"] = (slot, 2)
    if prefix is not None:
        lanes["prefix"] = (S.prefix_match(F.col("name"), prefix), 5)
    if literal is not None:
        lanes["literal"] = (S.has_phrase(F.col("text"), literal), 7)
    if similar is not None:
        lanes["similar"] = (F.coalesce(S.bounded_distance(F.col("name"), F.lit(similar[0]), similar[1]).isNotNull(), F.lit(False)), 8)
    if not lanes:
        raise ValueError("nothing to look for")
    hit = F.coalesce(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(lane).alias("lane"), F.lit(b).alias("band"))) for lane, (holds, b) in lanes.items()])
    found = facts.where(F.col("kind").isin(*kinds)).select("fact_id", "kind", hit.alias("hit")).where(F.col("hit").isNotNull())
    return found.select("fact_id", "kind", "hit.lane", "hit.band").orderBy("band", "fact_id").limit(most)


def shards(files: DataFrame, entities: DataFrame, reference: DataFrame, observations: DataFrame) -> DataFrame:
    """(shard, entity_id, label, digest) of a snapshot's five shards: files by their text, file sets by the digests of their members (``member_of``), entities, reference records and observations by kind and label.

    A shard holds what its lanes read and nothing else; it is stale as soon as a digest
    differs from that of the snapshot.
    """
    digest = F.sha2("text", 256)
    own = lambda df, shard: df.select(F.lit(shard).alias("shard"), F.col("entity_id").cast("string").alias("entity_id"), "label", F.sha2(F.concat_ws("|", "kind", "label"), 256).alias("digest"))
    by_file = files.select(F.lit("files").alias("shard"), F.col("entity_id").cast("string").alias("entity_id"), "label", digest.alias("digest"))
    sets = files.groupBy("member_of").agg(F.count(F.lit(1)).cast("string").alias("label"), F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ","), 256).alias("digest"))
    out = by_file.unionByName(sets.select(F.lit("file_set").alias("shard"), F.col("member_of").cast("string").alias("entity_id"), "label", "digest"))
    return out.unionByName(own(entities, "entities")).unionByName(own(reference, "reference")).unionByName(own(observations, "observations"))


#: lanes of a reference lookup in their order, the selector each needs, and its band
REFERENCE_LANES = {
    "exact_identity": ("entity_key", 0), "exact_canonical_name": ("name", 1), "namespace_member": ("namespace", 4), "identifier_prefix": ("prefix", 5),
    "literal_text": ("literal", 7), "structured_shape": ("shape", 7), "exact_explicit_alias": ("alias", 3), "identifier_similarity": ("similar", 8),
}


def reference(records: DataFrame, selectors: dict, enabled: Sequence[str], aliases: DataFrame | None = None, kinds: Sequence[str] = (), supported: Sequence[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """Hits (lane, record_key, band) among records (record_key, name, namespace, kind, text, conflict), and the state of each lane.

    States: excluded_by_request, missing_filter_capability (a kind is asked for that the
    records don't support: then of every enabled lane), no_selector, unavailable (aliases
    of which there is no table), evaluated.  A hit on a record whose sources conflict is
    none: it is reported under lane conflict, band 10, so that it can't pass for an
    answer, nor its absence for one.
    """
    from evidentia.operators.predicates import record_filter

    kept, gate = record_filter(records, kinds, supported or kinds, enabled) if kinds else (records, {})
    states, hits = {}, []
    s, name = selectors, F.col("name")
    for lane, (selector, strength) in REFERENCE_LANES.items():
        if lane not in enabled:
            states[lane] = "excluded_by_request"
        elif gate.get(lane) == "missing_filter_capability":
            states[lane] = "missing_filter_capability"
        elif s.get(selector) is None:
            states[lane] = "no_selector"
        elif lane == "exact_explicit_alias" and aliases is None:
            states[lane] = "unavailable"
        else:
            states[lane] = "evaluated"
            rows = kept
            if lane == "exact_explicit_alias":
                rows = kept.join(aliases.where(F.col("alias") == s["alias"]).select("record_key").distinct(), "record_key", "left_semi")
                holds = F.lit(True)
            else:
                holds = {
                    "exact_identity": lambda: F.col("record_key") == s["entity_key"],
                    "exact_canonical_name": lambda: name == s["name"],
                    "namespace_member": lambda: F.col("namespace") == s["namespace"],
                    "identifier_prefix": lambda: S.prefix_match(name, s["prefix"]),
                    "literal_text": lambda: S.has_phrase(F.col("text"), s["literal"]),
                    "structured_shape": lambda: s["shape"],
                    "identifier_similarity": lambda: F.coalesce(S.bounded_distance(name, F.lit(s["similar"]), 4).isNotNull(), F.lit(False)),
                }[lane]()
            hits.append(rows.where(F.coalesce(holds, F.lit(False))).select(F.when(F.col("conflict"), "conflict").otherwise(lane).alias("lane"), "record_key", F.when(F.col("conflict"), MISSING_SUBJECT_BAND).otherwise(strength).alias("band")))
    if not hits:
        return records.select(F.lit("").alias("lane"), "record_key", F.lit(0).alias("band")).where(F.lit(False)), states
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.distinct(), states
