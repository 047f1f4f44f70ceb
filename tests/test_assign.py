"""Both plans of crediting: suppressors broadcast by cell, and joined by cell."""

from __future__ import annotations

import model
import pytest

from incidentlens import MatchRule, Sizes
from incidentlens.operators import assign, grid

BROADCAST, JOINED = Sizes(), Sizes(broadcast_bytes=0)


def tables(spark, rows, mileage):
    """All rows as points, and the rows a greedy pass over the first half keeps."""
    half = rows[: len(rows) // 2]
    owner = model.greedy(half, mileage)
    kept = [r for r in half if owner[r[0]] == r[0]]
    points, anchors = (
        grid.to_points(spark.createDataFrame(part, model.SCHEMA), MatchRule(mileage), "row_id") for part in (rows, kept)
    )
    return points, anchors, kept


@pytest.mark.parametrize("mileage", [0.0, 1e-5, 0.4, 30_000.0])
def test_both_plans_credit_alike(spark, mileage):
    rows = model.random_rows(400, seed=31, hot=130)
    rows += [(1000 + i, *rows[i][1:]) for i in range(20)]
    points, anchors, kept = tables(spark, rows, mileage)
    first = {r[0]: next((k[0] for k in kept if model.matches(k, r, mileage)), None) for r in rows}
    nearest = {
        r[0]: min(((model.miles(k, r), k[0]) for k in kept if model.matches(k, r, mileage)), default=(0, None))[1] for r in rows
    }
    for sizes in (BROADCAST, JOINED):
        for find, want in ((assign.assign_first, first), (assign.assign_nearest, nearest)):
            found = find(points, anchors, MatchRule(mileage), sizes=sizes)
            assert found.columns == [*points.columns, "owner_id"]
            assert {r.row_id: r.owner_id for r in found.collect()} == want


def test_plans(spark):
    points, anchors, _ = tables(spark, model.random_rows(100, seed=32), 0.4)

    def plan(sizes):
        found = assign.assign_first(points, anchors, MatchRule(0.4), sizes=sizes)
        return found._jdf.queryExecution().sparkPlan().toString()

    assert "BroadcastHashJoin" in plan(BROADCAST) and "SortMergeJoin" not in plan(BROADCAST)
    assert "SortMergeJoin" in plan(JOINED)
    # The large side reaches the broadcast join without an exchange of its own.
    physical = assign.assign_first(points, anchors, MatchRule(0.4))._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1  # of the suppressors, to list them by cell
    # An estimate above the limit is enough to go back to the join.
    assert grid.anchor_bytes(anchors, MatchRule(0.4)) > 8 * grid.ANCHOR_BYTES
    assert "SortMergeJoin" in plan(Sizes(broadcast_bytes=8 * grid.ANCHOR_BYTES))
