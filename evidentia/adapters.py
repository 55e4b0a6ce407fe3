"""Generic entity, edge, fact, document and coverage tables over the relational test tables.

Each adapter is one SQL text that Spark and DuckDB both read, with input tables in
braces; `frame` builds the DataFrame and `with_sql` the same table as a CTE.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RELATIONS = ("contains", "owned_by", "owns", "uses", "supplied_by")
CONFIDENCES = ("proven", "derived", "possible", "candidate")

_FLAG = "max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END)"

SQL = {
    "nodes": """
        SELECT concat('region:', r_regionkey) AS node_id, 'region' AS kind, r_name AS label, 'world' AS owner_key FROM {region}
        UNION ALL SELECT concat('nation:', n_nationkey), 'nation', n_name, concat('region:', n_regionkey) FROM {nation}
        UNION ALL SELECT concat('customer:', c_custkey), 'customer', c_name, concat('nation:', c_nationkey) FROM {customer}
        UNION ALL SELECT concat('supplier:', s_suppkey), 'supplier', s_name, concat('nation:', s_nationkey) FROM {supplier}
        UNION ALL SELECT concat('part:', p_partkey), 'part', p_name, p_brand FROM {part}
        UNION ALL SELECT concat('order:', o_orderkey), 'order', o_orderpriority, concat('customer:', o_custkey) FROM {orders}""",
    "edges": f"""
        SELECT concat(relation, ':', src, ':', dst) AS edge_id, src, dst, relation, CAST(confidence AS INTEGER) AS confidence FROM (
            SELECT 'contains' AS relation, concat('nation:', n_nationkey) AS src, concat('region:', n_regionkey) AS dst, 0 AS confidence FROM {{nation}}
            UNION ALL SELECT 'owned_by', concat('customer:', c_custkey), concat('nation:', c_nationkey), 0 FROM {{customer}}
            UNION ALL SELECT 'owned_by', concat('supplier:', s_suppkey), concat('nation:', s_nationkey), 0 FROM {{supplier}}
            UNION ALL SELECT 'owns', concat('customer:', o_custkey), concat('order:', o_orderkey), 0 FROM {{orders}}
            UNION ALL SELECT 'uses', concat('order:', l_orderkey), concat('part:', l_partkey), {_FLAG} FROM {{lineitem}} GROUP BY l_orderkey, l_partkey
            UNION ALL SELECT 'supplied_by', concat('part:', l_partkey), concat('supplier:', l_suppkey), {_FLAG} FROM {{lineitem}} GROUP BY l_partkey, l_suppkey
        ) AS e""",
    # relation, producer partition, state (0 complete, 1 not evaluated, 2 partial, 3 failed, 4 truncated), whether absence is authoritative:
    # what the rows of each producer say, counted
    "coverage": """
        SELECT 'contains' AS relation, concat('p', n_regionkey % 2) AS part_id, CASE WHEN count(*) = count(n_name) THEN 0 ELSE 2 END AS state, true AS authority FROM {nation} GROUP BY n_regionkey % 2
        UNION ALL SELECT 'owned_by', concat('p', c_nationkey % 2), CASE WHEN count(*) = count(c_name) THEN 0 ELSE 2 END, min(c_acctbal) > 0 FROM {customer} GROUP BY c_nationkey % 2
        UNION ALL SELECT 'owns', concat('p', o_custkey % 2), CASE WHEN count(*) = count(o_orderstatus) THEN 0 ELSE 2 END, true FROM {orders} GROUP BY o_custkey % 2
        UNION ALL SELECT 'uses', concat('p', l_orderkey % 2), CASE WHEN l_orderkey % 2 = 1 AND count(CASE WHEN l_linestatus = 'O' THEN 1 END) > 0 THEN 2 ELSE 0 END, l_orderkey % 2 = 0 FROM {lineitem} GROUP BY l_orderkey % 2
        UNION ALL SELECT 'supplied_by', 'p0', CASE WHEN max(l_suppkey) > 5 THEN 4 ELSE 0 END, false FROM {lineitem}""",
    "facts": """
        SELECT event_id AS fact_id, event_type AS kind, user_id AS scope_id, value, props,
               CAST(CASE WHEN value < 10 THEN 2 WHEN value < 40 THEN 1 ELSE 0 END AS INTEGER) AS confidence,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS ordinal FROM {events}""",
    "packages": """SELECT concat('pkg', n_nationkey) AS package, n_nationkey % 5 = 0 AS selected, n_nationkey % 4 = 1 AS on_demand FROM {nation}""",
    "dependencies": """
        SELECT DISTINCT package, dependency, kind FROM (
            SELECT concat('pkg', n_nationkey) AS package, concat('pkg', (n_nationkey * 7 + 3) % 25) AS dependency, 'required' AS kind FROM {nation}
            UNION ALL SELECT concat('pkg', n_nationkey), concat('pkg', (n_nationkey * 5 + 1) % 29), 'optional' FROM {nation} WHERE n_nationkey % 3 <> 0
        ) AS d""",
    "records": """
        SELECT p_brand AS part_id, p_name AS record_key, min(p_partkey) AS payload, count(DISTINCT p_type) AS variants FROM {part} GROUP BY p_brand, p_name""",
    "spans": """
        SELECT doc_id AS span_id, CAST(doc_id * 50 AS BIGINT) AS span_start, CAST(doc_id * 50 + n_chars % 400 + 1 AS BIGINT) AS span_end FROM {documents}""",
    "members": """
        SELECT l_orderkey AS api, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS position,
               l_returnflag AS original_type, l_linestatus = 'O' AS nilable FROM {lineitem}""",
}


def tables_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter as a DataFrame."""
    text = SQL[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(text)})


def with_sql(*names: str) -> str:
    """The adapters as the CTEs of a DuckDB query: `WITH nodes AS (...), ...`."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', SQL[n])})" for n in names) + " "
