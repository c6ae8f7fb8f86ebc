"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import discard, materialize


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node that has a link.

    Rounds of contraction: every node goes to the least of itself and its neighbours, links become links
    between these, and links within one are done. The number of nodes with links shrinks by half or more, and
    the least node of a component stays to the end. Nodes then follow the rounds' tables to their root.
    """
    edges = links.select(F.col(left).alias("x"), F.col(right).alias("y")).where("x <> y")
    edges = materialize(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    steps: list[DataFrame] = []
    while True:
        parents = materialize(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("p")), "parents")
        steps.append(parents)
        from_x = parents.select("x", F.col("p").alias("px"))
        from_y = parents.select(F.col("x").alias("y"), F.col("p").alias("py"))
        before, edges = edges, materialize(edges.join(from_x, "x").join(from_y, "y").where("px <> py").select(F.col("px").alias("x"), F.col("py").alias("y")).distinct(), "edges")
        discard(before)
        if not edges.limit(1).count():
            break
    out = steps[0].select(F.col("x").alias("node"), F.col("p").alias("root"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("x").alias("root"), F.col("p").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    out = materialize(out, "roots")
    discard(edges, *steps)
    return out
