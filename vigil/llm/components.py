"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregation (combined on the map side) and a join back on the
vertex, which AQE splits when a vertex has very many edges.  Each round is
written to the shared checkpoint folder; only two numbers per round (count and
checksum of the edges) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.base import drop_table, write_table


def _star(edges: DataFrame) -> DataFrame:
    """For (u, v) rows: every v beside the smallest vertex around u, u itself included."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").withColumn("m", F.least("u", "least"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of ``edges`` (u, v): root is the smallest vertex reachable."""
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = write_table(both, "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
        turned = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(turned).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u > v always holds here
        small = _star(large)
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        last, now = now, write_table(small, "edges")
        drop_table(last)
