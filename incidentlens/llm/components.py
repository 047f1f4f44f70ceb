"""Connected components of an edge table, by hooking every node to its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, ws) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node of edges (``u``, ``v``).

    A round hooks each node to its smallest smaller neighbour, follows the hooks four steps up, and
    contracts the edges to where that leads. Labels only ever fall and edges between equal labels go, so
    the rounds end, and as every node with a smaller neighbour moves, they are few. Each ends in written
    tables. A node with very many edges only meets aggregations that combine before the shuffle, and
    joins that adaptive execution splits.
    """
    small = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    left = ws.save(edges.select(*small).filter("u <> v").distinct(), "edges")
    nodes = left.df.select(F.col("u").alias("node")).union(left.df.select("v")).distinct()
    labels = ws.write(nodes.withColumn("root", F.col("node")), "labels")
    while left.rows:
        hooks = ws.write(left.df.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("up")), "hooks")
        up = ws.write(_twice(_twice(hooks)), "hooks")
        labels = ws.write(
            labels.withColumnRenamed("root", "at")
            .join(up.withColumnRenamed("node", "at"), "at", "left")
            .select("node", F.coalesce("up", "at").alias("root")),
            "labels",
        )
        ends = left.df
        for side in ("u", "v"):
            ends = ends.join(up.select(F.col("node").alias(side), F.col("up").alias(f"up_{side}")), side, "left")
        u, v = F.coalesce("up_u", "u"), F.coalesce("up_v", "v")
        left = ws.save(
            ends.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).filter("u <> v").distinct(), "edges"
        )
    return labels


def _twice(hooks: DataFrame) -> DataFrame:
    """Each node's hook followed by the hook of where it leads, if there is one."""
    above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
    return hooks.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
