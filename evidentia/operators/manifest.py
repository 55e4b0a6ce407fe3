"""Logical manifests: a digest tree over a table's rows, by which two versions are told apart without reading them.

A row belongs to a leaf by the first hexadecimal digits of the SHA-256 of its key, as many
digits as the tree is deep; a node above holds what shares one digit less, so a node has
sixteen children at most.  The digest of a leaf is made of sums over the digests of its
rows, so it needs no order, counts repeated rows, and is put together from partial sums wherever rows
lie; the digest of a node is that of its children in order.  Manifests are Parquet by
level; a comparison reads the root of both and then only children of nodes that differ.

Cases: rows of equal key share a leaf; null values are their own value; an empty table
has a root without children.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.scalars import content_digest
from evidentia.shared import keep, new_folder

FANOUT_DIGITS = 1
LEAF_ROWS = 4_096  # wanted in a leaf
DEEPEST = 12
LISTED = 4_096  # differing nodes of a level that are named in a filter
_PIECES, _PIECE = 4, 15  # 60 bits each of a digest's 256


def leaf_of(keys: list[str], depth: int) -> Column:
    return F.substring(content_digest(*[F.col(k) for k in keys], domain="key"), 1, depth)


def row_digest(columns: list[str]) -> Column:
    return content_digest(*[F.col(c) for c in sorted(columns)], domain="row")


@dataclass
class Manifest:
    """Digest tree of a version: its folder, depth and keys."""

    spark: SparkSession
    folder: str
    depth: int
    keys: list[str]

    def nodes(self, level: int) -> DataFrame:
        """(prefix, parent, n, digest) of one level."""
        return self.spark.read.schema("prefix string, parent string, n long, digest string, level int").parquet(f"{self.folder}/nodes").where(F.col("level") == level).drop("level")

    def root(self) -> str:
        return self.nodes(0).collect()[0]["digest"]


def depth_for(n: int) -> int:
    """Digits so that a leaf holds about LEAF_ROWS rows."""
    depth = 0
    while depth < DEEPEST and n > LEAF_ROWS * 16**depth:
        depth += 1
    return depth


def build(df: DataFrame, keys: list[str], depth: int | None = None, folder: str | None = None) -> Manifest:
    """The manifest of a table's rows; versions that are to be compared share a depth."""
    spark = df.sparkSession
    depth = depth_for(df.count()) if depth is None else depth
    folder = folder or new_folder(spark, "manifest")
    digest = row_digest(df.columns)
    pieces = [F.conv(F.substring(digest, 1 + i * _PIECE, _PIECE), 16, 10).cast("decimal(38,0)") for i in range(_PIECES)]
    rows = df.select(leaf_of(keys, depth).alias("prefix"), *[p.alias(f"p{i}") for i, p in enumerate(pieces)])
    sums = [F.pmod(F.sum(f"p{i}"), F.lit(1 << 60).cast("decimal(38,0)")).cast("string").alias(f"p{i}") for i in range(_PIECES)]
    leaves = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), *sums)
    level = keep(leaves.select("prefix", "n", F.sha2(F.concat_ws("|", F.lit("leaf"), F.col("n").cast("string"), *[f"p{i}" for i in range(_PIECES)]), 256).alias("digest")))
    parts = []
    for d in range(depth, -1, -1):
        if d == 0 and depth == 0 and level.isEmpty():
            level = spark.createDataFrame([("", 0, "")], "prefix string, n long, digest string")
        parts.append(level.select("prefix", F.substring("prefix", 1, max(0, d - FANOUT_DIGITS)).alias("parent"), "n", "digest", F.lit(d).alias("level")))
        if d:
            children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda c: F.concat(c["prefix"], F.lit(":"), c["digest"])), ",")  # sixteen at most
            up = level.withColumn("up", F.substring("prefix", 1, d - 1)).groupBy("up").agg(F.sum("n").alias("n"), F.sha2(F.concat(F.lit("node|"), children), 256).alias("digest"))
            level = keep(up.select(F.col("up").alias("prefix"), "n", "digest"))
            if d == 1 and level.isEmpty():
                level = spark.createDataFrame([("", 0, "")], "prefix string, n long, digest string")
    tree = reduce(DataFrame.unionByName, parts)
    tree.repartitionByRange("level", "prefix").sortWithinPartitions("level", "prefix").write.partitionBy("level").parquet(f"{folder}/nodes")
    return Manifest(spark, folder, depth, list(keys))


@dataclass
class Difference:
    """leaves: the prefixes of leaves that differ; read: nodes of both manifests that were read."""

    leaves: DataFrame
    read: int


def compare(old: Manifest, new: Manifest) -> Difference:
    """Leaves in which two versions differ, by descending only into nodes that do."""
    if (old.depth, old.keys) != (new.depth, new.keys):
        raise ValueError("manifests of different depth or keys can't be compared")
    spark, read = old.spark, 0
    differing: DataFrame | None = None
    for level in range(old.depth + 1):
        a, b = old.nodes(level), new.nodes(level)
        if differing is not None:
            named = [r["prefix"] for r in differing.select("prefix").limit(LISTED + 1).collect()]
            if not named:
                return Difference(spark.createDataFrame([], "prefix string"), read)
            if len(named) <= LISTED:  # reaches the files
                a, b = (x.where(F.col("parent").isin(*named)) for x in (a, b))
            else:
                a, b = (x.join(differing.select(F.col("prefix").alias("parent")), "parent", "left_semi") for x in (a, b))
        both = keep(a.select("prefix", F.col("digest").alias("a")).join(b.select("prefix", F.col("digest").alias("b")), "prefix", "full"))
        told = both.agg(F.count("a").alias("a"), F.count("b").alias("b")).collect()[0]
        read += told["a"] + told["b"]
        differing = both.where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix")
    return Difference(differing, read)


def changes(old: DataFrame, new: DataFrame, manifest: Manifest, difference: Difference) -> DataFrame:
    """(keys, change) of the rows in leaves that differ: added, removed or changed, by unique keys."""
    keys, depth = manifest.keys, manifest.depth
    leaves = difference.leaves.select(F.col("prefix").alias("!leaf"))
    own = lambda df, name: df.join(leaves, leaf_of(keys, depth) == F.col("!leaf"), "left_semi").select(*keys, row_digest(df.columns).alias(name))
    met = own(old, "a").join(own(new, "b"), keys, "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return met.select(*keys, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
