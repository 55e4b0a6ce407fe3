"""Names within a few edits of each of many queries, from an index of segments.

A name is cut into k + 1 segments of almost equal length.  At most k edits leave one
segment whole, so a query within k edits of the name holds that segment, shifted by no
more than the edits before it and after it allow.  Names are indexed by (length, which
segment, its text); a query asks for the few substrings that such a segment can be, for
every length within k of its own.  What meets is compared with the banded distance.  So
names and queries meet by equality only and no name is compared that shares nothing.

Names of k characters or fewer have empty segments; they meet queries by length, of which
nearly all are within k edits of them.

Cases: null names and queries take no part; names of over 132 characters and queries of
over 128 are not compared (the query's state is too_long); equal names are compared once
and answer for each of their entities; ties keep all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.shared import keep

LONGEST_QUERY, LONGEST_NAME, MOST_EDITS = 128, 132, 4  # fixed values
STATES = ("complete", "exhausted", "too_long")


def _segment(length: Column, i: Column, k: int) -> tuple[Column, Column]:
    """Begin (from 0) and size of segment i of a name of this length; later segments take what is left over."""
    base, longer = F.floor(length / (k + 1)), length % (k + 1)
    from_longer = F.greatest(i - (k + 1 - longer), F.lit(0))
    size = base + F.when(i >= k + 1 - longer, 1).otherwise(0)
    return (i * base + from_longer).cast("int"), size.cast("int")


def _keys_of_names(name: Column, k: int) -> Column:
    length = F.length(name)

    def key(i: Column) -> Column:
        begin, size = _segment(length, i, k)
        return F.struct(length.alias("len"), i.alias("seg"), F.substr(name, begin + 1, size).alias("part"))

    short = F.array(F.struct(length.alias("len"), F.lit(-1).alias("seg"), F.lit("").alias("part")))
    return F.when(length <= k, short).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k)), key))


def _keys_of_queries(query: Column, k: int) -> Column:
    own = F.length(query)

    def of_length(length: Column) -> Column:
        longer = own - length

        def of_segment(i: Column) -> Column:
            begin, size = _segment(length, i, k)
            first = F.greatest(begin - F.floor((k - longer) / 2).cast("int"), F.lit(0))
            last = F.least(begin + F.floor((k + longer) / 2).cast("int"), own - size)
            places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda p: F.struct(length.alias("len"), i.alias("seg"), F.substr(query, p + 1, size).alias("part")))

        short = F.array(F.struct(length.alias("len"), F.lit(-1).alias("seg"), F.lit("").alias("part")))
        return F.when(length <= k, short).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k)), of_segment)))

    lengths = F.sequence(F.greatest(own - k, F.lit(0)), F.least(own + k, F.lit(LONGEST_NAME)))
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def index(names: DataFrame, name: str, k: int) -> DataFrame:
    """(len, seg, part, name) of each distinct name; may be written and used for further tables of queries."""
    rows = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull() & (F.length("name") <= LONGEST_NAME)).distinct()
    return rows.select("name", F.explode(_keys_of_names(F.col("name"), k)).alias("key")).select("key.*", "name")


def matches(queries: DataFrame, indexed: DataFrame, k: int, cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query, name, distance) of all names within k edits of each distinct ``query``, and (query, state) of every query.

    ``cells``: what comparisons of one query may cost together, each its length times the
    width of the band; a query over it is exhausted, and none of its names are returned.
    """
    if not 0 <= k <= MOST_EDITS:
        raise ValueError("the bound is 0 to 4")
    asked = queries.select("query").where(F.col("query").isNotNull()).distinct()
    fine = asked.where(F.length("query") <= LONGEST_QUERY)
    keys = fine.select("query", F.explode(_keys_of_queries(F.col("query"), k)).alias("key")).select("key.*", "query")
    met = keys.join(indexed, ["len", "seg", "part"]).select("query", "name")
    state = asked.select("query", F.when(F.length("query") > LONGEST_QUERY, "too_long").otherwise("complete").alias("state"))
    if cells is not None:
        met = keep(met.distinct())
        spent = met.groupBy("query").agg((F.count(F.lit(1)) * F.first(F.length("query")) * (2 * k + 1)).alias("cells"))
        over = keep(spent.where(F.col("cells") > cells).select("query"))
        met = met.join(over, "query", "left_anti")
        state = state.join(over.withColumn("over", F.lit(True)), "query", "left").select("query", F.when(F.col("over"), "exhausted").otherwise(F.col("state")).alias("state"))
    near = met.select("query", "name", S.bounded_distance(F.col("query"), F.col("name"), k).alias("distance")).where("distance IS NOT NULL")
    return near.distinct(), state


def lane(documents: DataFrame, fields: list[str], queries: DataFrame, k: int, cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, entity_id, distance, value, field): of each entity the field nearest to each query (query_id, text) after ASCII folding, and (query_id, state).

    ``fields`` are columns of the documents (entity_id, ...) in the order that decides ties.
    """
    named = None
    for place, f in enumerate(fields):
        part = documents.select("entity_id", F.col(f).alias("value"), F.lit(place).alias("field"), S.ascii_fold(F.col(f)).alias("name"))
        named = part if named is None else named.unionByName(part)
    asked = queries.select("query_id", S.ascii_fold(F.col("text")).alias("query"))
    near, states = matches(asked, index(named, "name", k), k, cells)
    hit = near.join(named.where("name IS NOT NULL"), "name").groupBy("query", "entity_id").agg(F.min(F.struct("distance", "field", "value")).alias("b"))
    found = asked.join(hit, "query").select("query_id", "entity_id", "b.distance", "b.value", "b.field")
    return found, asked.join(states, "query", "left").select("query_id", F.coalesce("state", F.lit("no_query")).alias("state"))
