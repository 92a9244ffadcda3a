"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges are stars
    around the least nodes. Each step is one partial aggregation and one join on the node; the
    join may be split by AQE where a node has very many edges. Each round is written to the
    shared folder. Null ends and loops are ignored; an empty graph gives no rows.
    """
    e = durable(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        # Large-star: from u to each larger neighbour, towards the least of u and its neighbours.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small-star: towards the least smaller neighbour.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        new = durable(small, "edges")
        # Stars are reached when each node has one parent and no parent has a parent.
        counts = new.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(new.select("v", F.lit(0), F.lit(1)))
        counts = counts.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        e = new
        if counts.where("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
