"""Connected components by alternating star operations, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("dst", "src")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("src"), F.col("m").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    return joined.union(least.select(F.col("u").alias("src"), F.col("m").alias("dst"))).filter("src <> dst").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (src, dst; long): root is the component's smallest node.

    Each round runs the two star operations and writes the links to the shared folder; rounds end when the links stay
    as they are, as many as the logarithm of the longest path or so. No node's links are gathered in one row.
    """
    edges = stored(links.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)))
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(roots)
