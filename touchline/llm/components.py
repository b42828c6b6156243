"""Connected components of a distributed edge list, by alternating large and small stars.

Every round is two joins' worth of shuffles over the edges with map-side
aggregation; a node of very many edges is dealt over tasks (``join_counted``).
Nothing is collected but counts. Each round is written to the shared folder, so
a lost executor costs one round at most; the round before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from touchline.llm._arrow import discard, join_counted, written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the least node of its component) for every node of ``edges`` (a, b: long)."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "components")
    while True:
        # large star: every larger neighbour of a node is tied to the node's least neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        larger = both.where("b > a")
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).select("a", F.least("a", "m").alias("m"), "n").where("n > 0")
        large = written(join_counted(larger, least, ["a"], F.col("b"), "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "components")
        # small star: a node and its smaller neighbours are tied to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, least, ["a"], F.col("b"), "inner").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = written(small, "components")
        discard(now, large)
        # a star forest no longer changes: each node has one edge, to a node without any
        more = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() or after.select("b").distinct().join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        now = after
        if not more:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
