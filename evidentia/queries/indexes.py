"""Queries that build an index or a manifest over whole tables and look things up in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.operators import chains as C
from evidentia.operators import lookup as L
from evidentia.operators import postings as P
from evidentia.operators import similarity as M
from evidentia.registry import Source, query

PHRASES = {"one": "Under", "two": "the, and", "three": "the the the", "four": "is is is is", "none": "under under of never"}
_WORDS = "SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents"


def _phrase_sql(name: str, phrase: str) -> str:
    words = P.tokens(phrase)
    holds = " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(words))
    return f"SELECT '{name}' AS name, doc_id AS entity_id, CAST(i - 1 AS INTEGER) AS position FROM d WHERE {holds}"


@query("s18_phrase_index", f"WITH d AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM ({_WORDS})) {' UNION ALL '.join(_phrase_sql(*p) for p in PHRASES.items())}")
def _(s: Source):
    index = P.build(s.documents, "doc_id", "text")
    return index.phrases(PHRASES).withColumnRenamed("key", "entity_id")


@query("x3_indexed_labels", "SELECT p_partkey AS entity_id FROM part WHERE contains(concat(' ', p_name, ' '), ' small ring ')")
def _(s: Source):
    half = s.part.where("p_size > 25"), s.part.where("p_size <= 25 OR p_size IS NULL")
    index = P.build(half[0], "p_partkey", "p_name").add(half[1], "p_partkey", "p_name")
    return index.phrases({"label": "Small ring"}).select(F.col("key").alias("entity_id")).distinct()


@query("x11_indexed_documentation", "SELECT doc_id AS entity_id FROM documents WHERE contains(concat(' ', array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' '), ' '), ' under the ')")
def _(s: Source):
    return P.build(s.documents, "doc_id", "text").phrases({"lane": "under the"}).select(F.col("key").alias("entity_id")).distinct()


_MISSPELT = "CASE p_partkey % 3 WHEN 0 THEN concat(substr(p_name, 1, 3), substr(p_name, 5)) WHEN 1 THEN concat('x', p_name) ELSE concat(substr(p_name, 2, 1), substr(p_name, 1, 1), upper(substr(p_name, 3))) END"


@query("x9_similar_for_many", f"""WITH q AS (SELECT p_partkey AS query_id, lower({_MISSPELT}) AS text FROM part), u AS (SELECT DISTINCT text FROM q), n AS (SELECT DISTINCT p_name AS name FROM part),
    near AS (SELECT text, name, levenshtein(text, name) AS distance FROM u, n WHERE abs(length(text) - length(name)) <= 2 AND levenshtein(text, name) <= 2)
    SELECT query_id, name, CAST(distance AS INTEGER) AS distance FROM q JOIN near USING (text)""")
def _(s: Source):
    asked = s.part.select(F.col("p_partkey").alias("query_id"), S.ascii_fold(F.expr(_MISSPELT)).alias("query"))
    found, _ = M.matches(asked, M.index(s.part, "p_name", 2), 2)
    return asked.join(found, "query").select("query_id", "name", "distance")


@query("x9_similar_outcomes", """WITH q AS (SELECT DISTINCT concat(n_name, 'x') AS text FROM nation UNION SELECT repeat('z', 129)) SELECT text AS query, CASE WHEN length(text) > 128 THEN 'too_long' ELSE 'complete' END AS state FROM q""")
def _(s: Source):
    asked = s.nation.select(F.concat("n_name", F.lit("x")).alias("query")).unionByName(s.spark.range(1).select(F.repeat(F.lit("z"), F.lit(129)).alias("query")))
    return M.matches(asked, M.index(s.part, "p_name", 4), 4, cells=1 << 40)[1]


#: a cycle of three with a way into it, then chains of 1,000
_CHAIN = "CASE WHEN o_orderkey < 3 THEN (o_orderkey + 1) % 3 WHEN o_orderkey = 3 THEN 0 WHEN o_orderkey % 1000 = 999 THEN NULL ELSE o_orderkey + 1 END"


@query("l3_long_chains", f"""WITH RECURSIVE c AS (SELECT o_orderkey AS id, {_CHAIN} AS ref, o_custkey AS own FROM orders), w(id, here, total) AS (SELECT id, id, CAST(0 AS BIGINT) FROM c WHERE id > 3 UNION ALL SELECT w.id, c.ref, w.total + c.own FROM w JOIN c ON c.id = w.here WHERE c.ref IS NOT NULL)
    SELECT id, 'cycle' AS state, CAST(NULL AS BIGINT) AS value FROM c WHERE id <= 3 UNION ALL SELECT w.id, CASE WHEN c.id IS NULL THEN 'unresolved' ELSE 'resolved' END, CAST(w.total + c.own AS BIGINT) FROM w LEFT JOIN c ON c.id = w.here WHERE c.ref IS NULL""")
def _(s: Source):
    return L.constants(s.orders.select(F.col("o_orderkey").alias("id"), F.expr(_CHAIN).alias("ref"), F.col("o_custkey").cast("long").alias("own")))


@query("d11_chain_cycles", """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey * 5 % 89 + 1 AS b FROM part), w(root, here, depth) AS (SELECT a, b, 1 FROM e UNION ALL SELECT w.root, e.b, w.depth + 1 FROM w JOIN e ON e.a = w.here WHERE w.here <> w.root AND w.depth < 100),
    on_cycle AS (SELECT root, max(depth) AS n, min(here) AS least FROM w WHERE root IN (SELECT x.root FROM w x WHERE x.here = x.root) GROUP BY root) SELECT least AS cycle, count(*) AS members FROM on_cycle GROUP BY least""")
def _(s: Source):  # every element inherits from one other: cycles by doubling
    return C.cycles(s.part.select(F.col("p_partkey").alias("node"), (F.col("p_partkey") * 5 % 89 + 1).alias("next"))).select("cycle", "members")
