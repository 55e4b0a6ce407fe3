"""Recognizers as recipes over structured facts: calls with ordered arguments, elements with attributes, state accesses.

A recipe names the callables it reviews and which arguments mean what; it never looks
at source text.  ``recognize`` reads each call once, joins the recipes by callable, and
gives one row for each relation that a call asserts, or one row that says why it
asserts none: a callable that nobody reviewed asserts nothing at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DERIVED, POSSIBLE = "derived", "possible"


@dataclass(frozen=True)
class Recipe:
    """Calls of ``callable`` relate their caller to argument ``key`` (counted from 0).

    ``rest``: the first of the ordered arguments that belong to the key, as a detail.
    ``each``: instead of one key, every argument from this one on is a target.
    ``least``: how many arguments there must be; ``shifted``: with more than ``least``
    the key stands one place further (a leading table).  ``number``: an argument that
    is an exact integer or absent, the key's own number.
    """

    callable: str
    relation: str
    key: int = 0
    rest: int | None = None
    each: int | None = None
    least: int = 1
    shifted: bool = False
    number: int | None = None


# fixed values: reviewed callables, what they assert, and the places of their arguments
NATIVE_EVENTS = (Recipe("Frame.RegisterEvent", "registers_native_event"), Recipe("Frame.RegisterUnitEvent", "registers_native_event", rest=1, least=2))
CALLBACKS = (Recipe("CVarCallbackRegistry.RegisterCallback", "registers_cvar_callback", rest=1, least=2),)
SCRIPTS = (Recipe("Frame.SetScript", "sets_script", rest=1, least=2), Recipe("Frame.HookScript", "hooks_script", rest=1, least=2), Recipe("hooksecurefunc", "secure_hooks_function", least=2, shifted=True))
CONSTRUCTION = (Recipe("CreateFrame", "instantiates", rest=1),)
MIXINS = (Recipe("Mixin", "mixes_in", each=1, least=2), Recipe("CreateFromMixins", "mixes_in", each=0))
LIBRARIES = (Recipe("LibStub", "requires_library", number=1), Recipe("LibStub.GetLibrary", "requires_library", number=1), Recipe("LibStub.NewLibrary", "declares_library", number=1, least=2))
SIGNALS = (Recipe("Registry.TriggerEvent", "emits_custom_signal", rest=1), Recipe("Registry.RegisterCallback", "handles_custom_signal", rest=1, least=2))
EVERY = (*NATIVE_EVENTS, *CALLBACKS, *SCRIPTS, *CONSTRUCTION, *MIXINS, *LIBRARIES, *SIGNALS)


def call_facts(calls: DataFrame, arguments: DataFrame) -> DataFrame:
    """Calls (call_id, caller, callable, receiver) with ``args``, their arguments (call_id, position, value) in order.

    A null value is an argument that is not a literal.  Calls without arguments keep an
    empty list; a gap in the positions is an argument that nobody reported, so the call
    is left out of what can be said for certain (``whole`` is false).
    """
    listed = arguments.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("a"))
    joined = calls.join(listed, "call_id", "left")
    a = F.coalesce("a", F.array().cast("array<struct<position:bigint,value:string>>"))
    whole = F.forall(F.sequence(F.lit(0), F.size(a) - 1), lambda i: a[i]["position"] == i)
    return joined.select("call_id", "caller", "callable", "receiver", F.transform(a, lambda x: x["value"]).alias("args"), ((F.size(a) == 0) | whole).alias("whole"))


def _argument(args: Column, at: Column) -> Column:
    return F.when(F.size(args) > at, F.element_at(args, (at + 1).cast("int")))


def recognize(calls: DataFrame, recipes: Sequence[Recipe] = EVERY) -> DataFrame:
    """(call_id, caller, receiver, relation, target, detail, number, state) for each relation of each reviewed call.

    state: derived; possible where a detail is not a literal; else why there is no
    relation: missing_argument, inexact_name, inexact_number or incomplete_call.
    """
    spark = calls.sparkSession
    rows = [(r.callable, r.relation, r.key, -1 if r.rest is None else r.rest, -1 if r.each is None else r.each, r.least, r.shifted, -1 if r.number is None else r.number) for r in recipes]
    table = spark.createDataFrame(rows, "callable string, relation string, key int, rest int, each int, least int, shifted boolean, numbered int")
    found = calls.join(F.broadcast(table), "callable")  # one row for each recipe
    args, n = F.col("args"), F.size("args")
    key = F.col("key") + F.when(F.col("shifted") & (n > F.col("least")), 1).otherwise(0)
    targets = F.when(F.col("each") >= 0, F.slice(args, F.col("each") + 1, F.greatest(n - F.col("each"), F.lit(0)))).otherwise(F.array(_argument(args, key)))
    enough = n >= F.col("least")
    targets = F.when(enough & (F.size(targets) > 0), targets).otherwise(F.array(F.lit(None).cast("string")))
    rest = F.when((F.col("rest") >= 0) & (n > F.col("rest")), F.slice(args, F.col("rest") + 1, n - F.col("rest")))
    number = F.when(F.col("numbered") >= 0, _argument(args, F.col("numbered")))
    found = found.withColumn("enough", enough).withColumn("rest", rest).withColumn("given", (F.col("numbered") >= 0) & (n > F.col("numbered"))).withColumn("number", number.try_cast("int")).withColumn("target", F.explode(targets))
    detail = F.array_join(F.transform("rest", lambda x: F.coalesce(x, F.lit("?"))), ",")
    vague = F.coalesce(F.exists("rest", lambda x: x.isNull()), F.lit(False))
    state = (
        F.when(~F.col("whole"), "incomplete_call")
        .when(~F.col("enough"), "missing_argument")
        .when(F.col("target").isNull(), "inexact_name")
        .when(F.col("given") & F.col("number").isNull(), "inexact_number")
        .when(vague, POSSIBLE)
        .otherwise(DERIVED)
    )
    out = found.withColumn("state", state)
    sure = F.col("state").isin(DERIVED, POSSIBLE)
    return out.select("call_id", "caller", "receiver", "relation", F.when(sure, F.col("target")).alias("target"), F.when(sure, F.coalesce(detail, F.lit(""))).alias("detail"), F.when(sure, F.col("number")).alias("number"), "state")


def direct_calls(calls: DataFrame, functions: DataFrame, apis: DataFrame) -> DataFrame:
    """(call_id, caller, relation, target, state): a call of a known function calls it, of a known api uses it; of both it is ambiguous, of neither unresolved."""
    f = functions.select(F.col("name").alias("callable"), F.lit(True).alias("f")).distinct()
    a = apis.select(F.col("name").alias("callable"), F.lit(True).alias("a")).distinct()
    both = calls.join(f, "callable", "left").join(a, "callable", "left")
    state = F.when(F.col("f") & F.col("a"), "ambiguous").when(F.col("f"), DERIVED).when(F.col("a"), DERIVED).otherwise("unresolved")
    relation = F.when(F.col("f") & F.col("a"), None).when(F.col("f"), "calls").when(F.col("a"), "uses_api")
    return both.select("call_id", "caller", relation.alias("relation"), F.when(relation.isNotNull(), F.col("callable")).alias("target"), state.alias("state"))


def bridges(registrations: DataFrame, handlers: DataFrame) -> DataFrame:
    """(receiver, target, registrations, handlers, state, proof): a receiver's registration of an event and its own handlers meet.

    proof: derived where some registration and some handler are derived themselves, else
    possible; none without a bridge.  Both sides are counted before they are joined, so a
    common event is no product of its calls.
    """
    sure = F.count_if(F.col("state") == DERIVED)
    r = registrations.where(F.col("target").isNotNull()).groupBy("receiver", "target").agg(F.count(F.lit(1)).alias("registrations"), (sure > 0).alias("r_sure"))
    h = handlers.where(F.col("target").isNotNull()).groupBy("receiver").agg(F.count(F.lit(1)).alias("handlers"), (sure > 0).alias("h_sure"))
    joined = r.join(h, "receiver", "left")
    bridged = F.col("handlers") > 0
    proof = F.when(bridged, F.when(F.col("r_sure") & F.col("h_sure"), DERIVED).otherwise(POSSIBLE))
    return joined.select("receiver", "target", "registrations", F.coalesce("handlers", F.lit(0)).alias("handlers"), F.when(bridged, "bridged").otherwise("no_handler").alias("state"), proof.alias("proof"))


def confirmations(subscriptions: DataFrame, producers: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """(call_id, target, state, producers): confirmed by producers of the same receiver and key, else lookup_incomplete where not all producers of the receiver were looked at (``incomplete``: receiver), else receiver_mismatch, key_mismatch or no_producer."""
    p = producers.where(F.col("target").isNotNull())
    same = p.groupBy("receiver", "target").agg(F.array_sort(F.collect_set("call_id")).alias("ids"))
    keys, receivers = p.select("target").distinct().withColumn("key_known", F.lit(True)), p.select("receiver").distinct().withColumn("receiver_known", F.lit(True))
    joined = subscriptions.where(F.col("target").isNotNull()).join(same, ["receiver", "target"], "left").join(keys, "target", "left").join(receivers, "receiver", "left")
    joined = joined.join(incomplete.select("receiver").distinct().withColumn("open", F.lit(True)), "receiver", "left") if incomplete is not None else joined.withColumn("open", F.lit(None).cast("boolean"))
    state = F.when(F.col("ids").isNotNull(), "confirmed").when(F.col("open"), "lookup_incomplete").when(F.col("key_known"), "receiver_mismatch").when(F.col("receiver_known"), "key_mismatch").otherwise("no_producer")
    return joined.select("call_id", "target", state.alias("state"), F.coalesce(F.size("ids"), F.lit(0)).alias("producers"))


def state_accesses(accesses: DataFrame, declared: DataFrame) -> DataFrame:
    """(access_id, caller, relation, target, state): reads and writes of declared saved names; of others undeclared, of a name declared twice ambiguous."""
    d = declared.groupBy("name").agg(F.count_distinct("owner").alias("owners"))
    joined = accesses.join(d, "name", "left")
    state = F.when(F.col("owners").isNull(), "undeclared").when(F.col("owners") > 1, "ambiguous").otherwise(DERIVED)
    relation = F.when(state == DERIVED, F.when(F.col("access") == "write", "writes_state").otherwise("reads_state"))
    return joined.select("access_id", "caller", relation.alias("relation"), F.when(state == DERIVED, F.col("name")).alias("target"), state.alias("state"))


def manifest_facts(packages: DataFrame, files: DataFrame, dependencies: DataFrame, saved: DataFrame) -> DataFrame:
    """(package, fact, value): package, file with its place, dependency, load_on_demand, saved_variable, and saved_root for the first name of each."""
    row = lambda df, fact, value: df.select("package", F.lit(fact).alias("fact"), value.cast("string").alias("value"))
    out = row(packages, "package", F.col("package")).unionByName(row(files, "file", F.concat_ws(":", "position", "file")))
    out = out.unionByName(row(dependencies, "dependency", F.concat_ws(":", "kind", "dependency"))).unionByName(row(packages.where("on_demand"), "load_on_demand", F.lit("true")))
    names = saved.select("package", F.split("name", "[.]")[0].alias("root"), "name")
    return out.unionByName(row(names.distinct(), "saved_variable", F.col("name"))).unionByName(row(names.select("package", "root").distinct(), "saved_root", F.col("root")))


def element_relations(elements: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """(doc, ordinal, tag, relation, target): attributes of elements (doc, ordinal, tag, attributes as JSON) that assert a relation; a list of names gives one row each."""
    parts = [
        elements.select("doc", "ordinal", "tag", F.lit(relation).alias("relation"), F.explode(F.split(F.get_json_object("attributes", f"$.{name}"), r"\s*,\s*")).alias("target"))
        for name, relation in attributes.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.length("target") > 0)
