"""Connected classes of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import staged


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of the links ``a, b``; the root is the smallest node.

    Every round each node takes the smallest root among its neighbours', then the
    root of that root, so chains shorten by half. Rounds end when no root moves.
    Each round is a written table; hubs are joined on tables that adaptive
    execution can split, and the minimum is combined before the shuffle.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = staged(both.toDF("node", "peer"), "edges")
    roots = staged(
        both.groupBy("node").agg(F.least("node", F.min("peer")).alias("root")), "roots"
    )
    while True:
        peers = roots.select(F.col("node").alias("peer"), F.col("root").alias("seen"))
        near = both.join(peers, "peer").groupBy("node").agg(F.min("seen").alias("seen"))
        hop = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = (
            roots.join(staged(near, "near"), "node")
            .withColumn("before", F.col("root"))
            .withColumn("root", F.least("root", "seen"))
            .select("node", "before", "root")
        )
        step = staged(
            step.join(hop, "root", "left").select(
                "node", "before", F.least("root", F.coalesce("up", "root")).alias("root")
            ),
            "step",
        )
        roots = step.select("node", "root")
        if step.where("before <> root").isEmpty():
            return roots
