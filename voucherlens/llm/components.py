"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens.staging import Stage


def connected_components(links: DataFrame, stage: Stage) -> DataFrame:
    """``node``, ``root``: the smallest node reachable, for every node in links ``a``, ``b``.

    Each round hooks every root to its smallest neighbour, follows the pointers to their ends
    and contracts the links, so the rounds grow with the logarithm of the longest path. All
    steps are joins and combined aggregates on staged tables; nothing is gathered by component.
    Links may repeat and may join a node with itself.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = stage(ends.withColumn("root", F.col("node")), "roots")
    live = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                 .where("a <> b").distinct(), "links")
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stage(both.groupBy("a").agg(F.min("b").alias("m"))
                     .select(F.col("a").alias("r"), F.least("a", "m").alias("to")), "hooks")
        while True:
            nxt = step.select(F.col("r").alias("to"), F.col("to").alias("then"))
            step = stage(step.join(nxt, "to", "left")
                         .select("r", F.coalesce("then", "to").alias("to"),
                                 (F.coalesce("then", "to") != F.col("to")).alias("moved")),
                         "pointers")
            if step.where("moved").isEmpty():
                break
            step = step.drop("moved")
        step = step.select("r", "to")
        roots = stage(roots.join(step, F.col("root") == F.col("r"), "left")
                      .select("node", F.coalesce("to", "root").alias("root")), "roots")
        live = stage(live.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b")
                     .where("x <> y")
                     .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                     .distinct(), "links")
    return roots
