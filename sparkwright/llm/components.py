"""Connected components of a link table by alternating star contractions.

Each round is two shuffled aggregations and joins over the links; a node with very many links is pre-aggregated on the
map side and its join is one that AQE splits. The links of each round are written under the shared folder.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm import common


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has a link; links: columns a, b."""
    edges = common.written(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    # done when every node has one edge to a smaller one and none of those has an edge to a smaller one itself
    while not stars(edges):
        # every node's larger neighbours go to its smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(least, "u").select("v", F.col("low").alias("u"))
        # every node and its smaller neighbours go to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v")
        small = small.select(F.col("u").alias("v"), F.col("low").alias("u")).unionByName(small.select("v", F.col("low").alias("u")))
        edges = common.written(small.where("v <> u").distinct(), "links")
    roots = edges.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)


def stars(edges: DataFrame) -> bool:
    """Whether the edges (v, u) are stars: one edge for each v, and no u that is a v."""
    ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("u").alias("x"), F.lit(0).alias("up")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.where("ups > 1 OR ups = 1 AND least = 0").limit(1).count() == 0
