"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.shared import keep


def _least(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(value).alias("m"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b), the root being the component's smallest node.

    Each half round joins the links with one minimum per node, so a node with very
    many links is an ordinary skewed join key and nothing is gathered in one task.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    n = links.count()
    edges = keep(links.distinct(), n)
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, "u", "v").select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _least(large, "u", "v")
        paired = large.join(least, "u")
        small = paired.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = keep(small, 2 * n)  # a star for each link and each smallest node
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
        if seen == now:
            break
        seen, n = now, now["n"]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
