"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node it hangs together with) of every node of an edge.

    Alternates two steps until nothing changes: every node links its larger neighbours, then its smaller
    ones, to the smallest of them. Both shuffle at most as many rows as there are edges; the number of rounds
    grows with the logarithm of the longest path. Edges with a null end and those of a node with itself link
    nothing; a node that has only such edges is a component of its own unless it is null. No edges, no rows.
    """
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b))).where("node is not null").distinct()
    now = stage(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("lo") < F.col("hi"))).distinct(), "edges")
    mark = None
    while True:
        ends = now.selectExpr("hi as u", "lo as v").union(now.selectExpr("lo as u", "hi as v"))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ends.join(least, "u").where("v > u and v <> m").selectExpr("m as lo", "v as hi").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.col("m"), F.explode(F.array("lo", "hi")).alias("hi")).where("m < hi").selectExpr("m as lo", "hi").distinct()
        now = stage(small, "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
        if new == mark:
            break
        mark = new
    return nodes.join(now.selectExpr("hi as node", "lo"), "node", "left").select("node", F.coalesce("lo", "node").alias("component"))
