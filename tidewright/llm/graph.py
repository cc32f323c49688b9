"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import write_table
from tidewright.sources.scratch import forget


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of *links* (a, b) is connected to; nodes without a link are left out.

    Alternates the large-star and small-star steps; both keep the components, and a fixed point is a star per
    component. Each round is cut off by a table in the shared folder. Rounds grow with the logarithm of the longest path, and each
    brings the links nearer to the fixed point, so they end.
    """
    edges, path = write_table(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select("v", F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u <> v")
        after, new_path = write_table(small.unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "links")
        same = after.groupBy("v").count().filter("count > 1").isEmpty() and after.join(after.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()
        forget(path)
        edges, path = after, new_path
        if same:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
