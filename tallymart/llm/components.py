"""Connected components of an edge table, by alternating star contractions.

Each round connects the larger neighbours of every node to its least neighbour (large star) and then the node and its smaller
neighbours to the least of them (small star), until the edges stay the same: then every node points at the least of its component.
The rounds are logarithmic in practice. A node that very many edges share is one key of the joins; their small sides are tables, not
aggregates, so that adaptive execution can split the rows of such a key over tasks. Edges live in tables of the shared folder; nothing but their count and checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge between two different nodes; root is the least node it reaches.

    Loops and edges with a null are left out, repeated edges count once, and no edge gives no rows.
    """
    spark = edges.sparkSession
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y"), x.alias("_a"), y.alias("_b")).where("_a != _b").select("x", "y").distinct()
    state, path, passed = None, None, []
    while True:
        new = scratch(spark, "edges")
        now.write.parquet(new)
        for done in [path, *(x.scratch_path for x in passed)]:
            if done:
                remove(spark, done)
        path, passed = new, []
        now = spark.read.schema("x long, y long").parquet(path)
        seen = tuple(now.agg(F.count("*"), F.sum((F.xxhash64("x", "y") % 1_000_000_007).cast("decimal(38,0)"))).first())
        if seen == state or not seen[0]:
            out = now.select(F.col("x").alias("node"), F.col("y").alias("root"))
            out.scratch_path = path
            return out
        state = seen
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m")), "least")
        large = written(both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(), "large")
        low = written(large.groupBy("x").agg(F.min("y").alias("m")), "low")
        down = large.join(low, "x").where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = down.unionByName(low.select("x", F.col("m").alias("y"))).distinct()
        passed = [least, large, low]
