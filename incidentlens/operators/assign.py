"""Crediting incidents to suppressors.

Suppressors do not match one another, so only a handful can match one incident: the join
output stays linear in the incidents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bearing_difference, haversine_miles
from ..rule import MatchRule
from ..sizes import Sizes
from .grid import anchor_bytes, anchors_by_cell, match_condition, match_join, near_condition


def miles_to(anchor: str) -> str:
    return haversine_miles(f"{anchor}lat", f"{anchor}lon", "lat", "lon")


MILES_APART = miles_to("a_")


def _assign(
    points: DataFrame,
    kept: DataFrame,
    rule: MatchRule,
    crowded: DataFrame | None,
    sizes: Sizes,
    order: Callable[[str], list[str]],
) -> DataFrame:
    """``owner_id`` of the lowest matching suppressor by ``order``: expressions, given a prefix for its columns."""
    if sizes.broadcast_bytes and anchor_bytes(kept, rule) <= sizes.broadcast_bytes:
        return _assign_in_place(points, kept, rule, order)
    joined = match_join(points, kept, rule, "left", crowded)
    # Grouping starts with the join keys: after a shuffled join no further exchange is needed.
    where = [*rule.keys, "cell", *(["salt"] if crowded is not None else []), "rank"]
    carried = [f"first({c}) AS {c}" for c in points.columns if c not in where]
    best = f"min_by(a_row_id, struct({', '.join(order('a_'))})) AS owner_id"
    made = [F.expr(sql) for sql in (*carried, best)]
    return joined.groupBy(*where).agg(*made).select(*points.columns, "owner_id")


def _assign_in_place(
    points: DataFrame, kept: DataFrame, rule: MatchRule, order: Callable[[str], list[str]]
) -> DataFrame:
    """The same without a shuffle: every row finds its cell's suppressors in a broadcast table."""
    cells = F.broadcast(anchors_by_cell(kept, rule))
    joined = points.join(cells, [*rule.keys, "cell"], "left")
    matching = f"filter(anchors, a -> {match_condition(rule, '', 'a.')})"
    ranked = ", ".join([*order("a."), "a.row_id AS owner"])
    return joined.selectExpr(
        *points.columns, f"array_min(transform({matching}, a -> struct({ranked}))).owner AS owner_id"
    )


def assign_first(
    points: DataFrame,
    kept: DataFrame,
    rule: MatchRule,
    crowded: DataFrame | None = None,
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """Add ``owner_id``: row_id of the lowest-ranked matching suppressor, NULL without one.

    A suppressor among the points owns itself. Few suppressors (counted first) are broadcast, so
    that the points stay where they are; many are joined by cell.
    """
    return _assign(points, kept, rule, crowded, sizes, lambda a: [f"{a}rank"])


def assign_nearest(
    points: DataFrame,
    kept: DataFrame,
    rule: MatchRule,
    crowded: DataFrame | None = None,
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """Like :func:`assign_first`, but the closest suppressor wins, then the lower-ranked one."""
    return _assign(points, kept, rule, crowded, sizes, lambda a: [miles_to(a), f"{a}rank"])


def unmatched(assigned: DataFrame) -> DataFrame:
    """Incidents that no suppressor stands for."""
    return assigned.filter("owner_id IS NULL").drop("owner_id")


def match_pairs(
    points: DataFrame, kept: DataFrame, rule: MatchRule, crowded: DataFrame | None = None
) -> DataFrame:
    """Every (incident, suppressor) match with its distance, an incident with itself left out."""
    pairs = match_join(points, kept, rule, "inner", crowded, extra="row_id <> a_row_id")
    return pairs.selectExpr("row_id", "a_row_id AS suppressor_id", f"{MILES_APART} AS miles")


def near_pairs(
    points: DataFrame, kept: DataFrame, rule: MatchRule, crowded: DataFrame | None = None
) -> DataFrame:
    """(incident, suppressor) pairs on one road within the radius, whatever their headings.

    ``turn`` is the angle between the headings.
    """
    pairs = match_join(
        points,
        kept,
        rule,
        "inner",
        crowded,
        extra="row_id <> a_row_id",
        condition=near_condition(rule),
    )
    turn = bearing_difference("a_bearing", "bearing")
    return pairs.selectExpr(
        "row_id", "a_row_id AS suppressor_id", f"{MILES_APART} AS miles", f"{turn} AS turn"
    )
