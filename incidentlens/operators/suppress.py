"""Greedy suppression: walk the rows in rank order, keep a row unless a kept one matches it.

The survivors are the lexicographically first maximal independent set of the match graph. They
are found in rounds that settle many rows at once (Blelloch, Fineman, Shun, SPAA 2012): a row
that no undecided lower-ranked row matches is kept, and whatever it matches is dropped.

The match graph itself is never built, as a crowded place would make it quadratic. Any two rows
of one spot match, so only the lowest-ranked row of a spot, its head, can be kept next. A round
compares rows with heads only: linear in the rows, whatever their density.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rule import MatchRule
from ..sizes import Sizes
from ..workspace import Workspace
from .grid import GEOMETRY, match_condition, match_join, spot_columns
from .sweep import tile_sweep

def spot_heads(points: DataFrame, rule: MatchRule, *carry: str) -> DataFrame:
    """The lowest-ranked row of every spot; partial aggregation leaves one row per spot and task."""
    picked = [f"min_by({c}, rank) AS {c}" for c in ("row_id", *GEOMETRY, "cell", *carry)]
    spot = spot_columns(rule)[len(rule.keys) :]
    by = [*rule.keys, *[F.expr(f"{sql} AS spot_{i}") for i, sql in enumerate(spot)]]
    spots = points.groupBy(*by).agg(*[F.expr(sql) for sql in ("min(rank) AS rank", *picked)])
    return spots.select("rank", "row_id", *rule.keys, *GEOMETRY, "cell", *carry)


def head_edges(
    points: DataFrame, rule: MatchRule, crowded: DataFrame | None = None
) -> DataFrame:
    """Each spot head (``src_id``) with the higher-ranked rows it matches (``dst_id``)."""
    heads = spot_heads(points, rule)
    pairs = match_join(points, heads, rule, "inner", crowded, extra="rank > a_rank")
    return pairs.selectExpr("a_row_id AS src_id", "row_id AS dst_id")


def _rows_in_order(*more: str) -> str:
    fields = ["rank", "row_id", *GEOMETRY, "cell", *more]
    return f"array_sort(collect_list(struct({', '.join(fields)}))) AS rows"


def ordered_fold(points: DataFrame, rule: MatchRule) -> DataFrame:
    """Greedy suppression read literally: fold each key group's rows in rank order.

    A group becomes one array, so its size must be known to be small.
    """
    kept = f"""aggregate(rows, filter(rows, p -> false), (kept, p) ->
        IF(exists(kept, k -> {match_condition(rule, "p.", "k.")}), kept, concat(kept, array(p))))"""
    groups = points.groupBy(*rule.keys).agg(F.expr(_rows_in_order()))
    return groups.selectExpr(*rule.keys, f"inline({kept})").select(
        "rank", "row_id", *rule.keys, *GEOMETRY, "cell"
    )


def group_sizes(rows: DataFrame, rule: MatchRule) -> tuple[int, int]:
    """Rows in all, and in the largest key group; counts are combined before they are shuffled."""
    groups = rows.groupBy(*rule.keys).agg(F.count(F.lit(1)).alias("held"))
    found = groups.agg(F.sum("held").alias("all"), F.max("held").alias("most")).first()
    return found["all"] or 0, found["most"] or 0


def plain_round(
    undecided: DataFrame, rule: MatchRule, ws: Workspace, crowded: DataFrame | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Spot heads that no undecided lower row matches, with the columns ``carry``."""
    heads = ws.write(spot_heads(undecided, rule, *carry), "heads")
    lower = match_join(undecided, heads, rule, "inner", crowded, extra="rank < a_rank")
    blocked = lower.selectExpr("a_rank AS rank").distinct()
    return heads.join(blocked, "rank", "left_anti")


def first_round_survivors(
    points: DataFrame, rule: MatchRule, ws: Workspace, crowded: DataFrame | None = None
) -> DataFrame:
    """``row_id`` of the rows that no lower-ranked row matches: what the first round keeps."""
    return plain_round(points, rule, ws, crowded).select("row_id")


def greedy_survivors(
    points: DataFrame,
    rule: MatchRule,
    ws: Workspace,
    crowded: DataFrame | None = None,
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """Rows that survive greedy suppression in ``rank`` order, with their geometry.

    Rounds go on while any road has many undecided rows; they come to an end, as a plain round
    settles at least the lowest undecided rank of every road. Where plain rounds are slow, the
    order runs along the roads, and sweeps over tiles take over until they get stuck. What is
    then left is small per road and settled by one fold, all roads side by side.
    """
    columns = ["rank", "row_id", *rule.keys, *GEOMETRY, "cell"]
    undecided, kept_rounds = points.select(*columns), []
    if not rule.can_match:
        return undecided
    left, most = group_sizes(undecided, rule)
    sweep, path = False, None
    while not sizes.foldable(left, most):
        if sweep:
            # Neighbouring sweeps cut the tiles at different places.
            found = tile_sweep(undecided, rule, ws, sizes, shifted=len(kept_rounds) % 2 == 1)
        else:
            found = plain_round(undecided, rule, ws, crowded)
        kept = ws.save(found.select(*columns), "kept")
        if sweep and not kept.rows:
            sweep = False  # a plain round always settles something
            continue
        kept_rounds.append(kept.df)
        rest = match_join(undecided, kept.df, rule, "left_anti", crowded)
        used, undecided = path, ws.write(rest.select(*columns), "undecided")
        path = ws.last
        if used:
            ws.remove(used)
        before = left
        left, most = group_sizes(undecided, rule)
        if left == before and not sweep:
            raise ValueError("ranks must be unique and keys not NULL")
        sweep = left <= before * sizes.stuck_share if sweep else left > before * sizes.slow_share
    if most:
        kept_rounds.append(ws.write(ordered_fold(undecided, rule), "kept"))
    return reduce(DataFrame.unionByName, kept_rounds) if kept_rounds else undecided
