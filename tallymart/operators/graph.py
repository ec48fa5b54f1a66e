"""Connected components of edge tables, by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staged import Staging


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge; root is the least node that it reaches. Edges with a null are left out.

    Each round every node takes the least label around it and then the label's own; chains shrink by a factor a round. Labels live in tables, so that the plan doesn't grow.
    """
    staging, links = Staging(edges.sparkSession, "components"), Staging(edges.sparkSession, "links")
    one = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    both = links.put(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    now = staging.put(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("root"), F.lit(True).alias("moved")))
    while now.where("moved").limit(1).count():
        around = both.join(now.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        low = staging.put(now.join(around, "node").select("node", "root", F.least("root", "near").alias("low")))
        ahead = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        now = staging.put(low.join(ahead, "low").select("node", F.col("lower").alias("root"), (F.col("lower") < F.col("root")).alias("moved")))
    return now.select("node", "root")
