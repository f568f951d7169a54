"""Connected components of large graphs by alternating star operations.

Edges point from the larger to the smaller node. Each round first lets every
edge jump to the smallest parent of its target, then ties all parents of a node
to the smallest one. Rounds grow with the logarithm of the longest path; each is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.storage import store


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (smallest node of its component) for all nodes of ``u, v`` edges but the roots."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    current = store(down, "edges")
    while not _only_stars(current):
        parents = current.groupBy("u").agg(F.min("v").alias("m"))
        jumped = (
            current.join(parents.withColumnsRenamed({"u": "v"}), "v", "left")
            .select("u", F.coalesce("m", "v").alias("v"))
            .distinct()
        )
        least = jumped.groupBy("u").agg(F.min("v").alias("m"))
        tied = jumped.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = store(tied.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return current.withColumnsRenamed({"u": "node", "v": "root"})


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent or none, and no parent has one."""
    below = edges.select(F.col("u").alias("node"), F.lit(1).alias("parents"), F.lit(0).alias("children"))
    above = edges.select(F.col("v").alias("node"), F.lit(0).alias("parents"), F.lit(1).alias("children"))
    roles = below.union(above).groupBy("node").agg(F.sum("parents").alias("p"), F.max("children").alias("c"))
    return roles.where("p > 1 OR (p = 1 AND c = 1)").isEmpty()
