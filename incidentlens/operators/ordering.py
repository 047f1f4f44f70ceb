"""Row order as one BIGINT, without pulling rows into a single partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace

# monotonically_increasing_id puts the partition number above this many bits.
POSITION_BITS = 33


def with_rank(df: DataFrame, *order: str) -> DataFrame:
    """Add ``rank``, increasing (with gaps) in the given order.

    The sort is range-partitioned: partition number and position inside it form the rank. Save
    the result before using it twice, so that all readers see the same ranks.
    """
    return df.orderBy(*order).withColumn("rank", F.monotonically_increasing_id())


def with_position(df: DataFrame, ws: Workspace, *order: str) -> DataFrame:
    """Add ``position``: 0, 1, 2, ... in the given order, without gaps.

    Only the row counts of the partitions, one row each, are added up in one place.
    """
    ranked = ws.write(
        with_rank(df, *order).selectExpr("*", f"shiftright(rank, {POSITION_BITS}) AS part"),
        "ranked",
    )
    counts = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ws.write(
        counts.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))).select(
            "part", "start"
        ),
        "part-starts",
    )
    within = (1 << POSITION_BITS) - 1
    return ranked.join(starts, "part").selectExpr(
        *df.columns, f"start + (rank & {within}L) AS position"
    )
