"""Connected components of a table of links."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``node, root`` of all nodes in ``edges`` (a, b) but the roots themselves, by alternating large and small stars.

    ``keep`` writes a table to the shared folder and reads it again. A stored table on the small side of each join lets Spark
    split a hot key of the large side."""
    edges, before = edges.where("a <> b").select("a", "b"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large.where("a <> b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = keep(down.groupBy("a").agg(F.min("b").alias("m")))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = keep(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
