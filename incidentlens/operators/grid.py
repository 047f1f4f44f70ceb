"""Distance joins as equi-joins on grid cells.

Incidents are placed on the unit sphere and cut into cubes. Two sizes are in use:

* ``cell``: wide cells (twice the search radius). One side of a join, always the thinned-out
  one, is copied into every cell its search radius touches (8 at most, about 6 on average);
  the other side is never copied, so each matching pair meets exactly once.
* ``spot``: narrow cells times a heading sector, small enough that any two incidents of one
  spot match. At most one incident per spot can survive, which bounds the thinned-out side
  per cell however many incidents pile up in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    EARTH_RADIUS_MILES,
    bearing_difference,
    double,
    fold_case,
    haversine_miles,
    is_finite,
    unit_vector,
)
from ..rule import MatchRule
from ..sizes import Sizes
from ..workspace import Workspace

# Relative allowance for rounding when a cell is sized or a chord is compared.
MARGIN = 1e-6
# Smallest side for which three axes of 21 bits each are packed in one BIGINT (some 13 m).
MIN_PACKED_SIDE = 2e-6
AXIS_SHIFT = 1 << 20
AXIS_SIZE = 1 << 21
# Below this chord (about 6 cm) rounding could spoil a spot; equal coordinates are used instead.
MIN_SPOT_CHORD = 1e-8

# At most this many cells are listed for splitting, so the list is safe to broadcast.
MAX_SPLIT_CELLS = 100_000

GEOMETRY = ("lat", "lon", "bearing", "x", "y", "z")

# An anchor in a cell's array, and its share of a hash table.
ANCHOR_BYTES = 160


def reach(rule: MatchRule) -> float:
    """Chord that no matching pair exceeds."""
    return max(rule.chord * (1 + MARGIN), 1e-9)


def cell_side(rule: MatchRule) -> float:
    return 2 * reach(rule)


def cell_number(cx: str, cy: str, cz: str, side: float) -> str:
    """One BIGINT per cell; of the smallest cells several may share a number."""
    if side < MIN_PACKED_SIDE:
        return f"xxhash64({cx}, {cy}, {cz})"
    high = f"(({cx} + {AXIS_SHIFT}L) * {AXIS_SIZE}L + {cy} + {AXIS_SHIFT}L)"
    return f"{high} * {AXIS_SIZE}L + {cz} + {AXIS_SHIFT}L"


def cell_at(side: float) -> str:
    """Number of the cell that holds a point."""
    return cell_number(*[f"floor({axis} / {double(side)})" for axis in "xyz"], side)


def reached_cells(df: DataFrame, rule: MatchRule, side: float, prefix: str = "") -> DataFrame:
    """One row per cell of the given side that can hold a match; cell indexes in cx, cy, cz."""
    far, flat = reach(rule), double(reach(rule) ** 2 / 2 + 1e-12)
    for axis in "xyz":
        at = f"{prefix}{axis}"
        # Extent of the spherical cap along this axis.
        tilt = f"sqrt(greatest(0D, 1 - {at} * {at}))"
        half = f"({double(far)} * ({tilt} + {double(MARGIN)}) + {flat})"
        low, high = (f"floor(({at} {sign} {half}) / {double(side)})" for sign in "-+")
        df = df.selectExpr("*", f"explode(sequence({low}, {high})) AS c{axis}")
    return df


def comparable(incidents: DataFrame, rule: MatchRule) -> str:
    """Condition for rows that can match anything, themselves included."""
    types = dict(incidents.dtypes)
    present = [f"{k} IS NOT NULL" for k in rule.extra_keys if types[k] != "string"]
    terms = [is_finite("lat", "lon"), "bearing IS NOT NULL", *present]
    return f"coalesce({' AND '.join(terms)}, false)"


def to_points(incidents: DataFrame, rule: MatchRule, rank: str, *carry: str) -> DataFrame:
    """Narrow table for the joins: rank, row_id, keys, geometry and the wide cell.

    Rows without finite coordinates, heading or key match nothing and are left out. Strings among
    the keys are folded, so that case does not count.
    """
    types = dict(incidents.dtypes)
    extra = [
        f"{fold_case(k) if types[k] == 'string' else k} AS {k}" for k in rule.extra_keys
    ]
    vector = [f"{sql} AS {axis}" for axis, sql in unit_vector("lat", "lon").items()]
    narrow = incidents.filter(comparable(incidents, rule)).selectExpr(
        f"{rank} AS rank",
        "row_id",
        f"{fold_case('partial_location')} AS loc_key",
        *extra,
        "lat",
        "lon",
        "int(bearing) AS bearing",
        *vector,
        *carry,
    )
    return narrow.selectExpr("*", f"{cell_at(cell_side(rule))} AS cell")


def spot_columns(rule: MatchRule) -> list[str]:
    """Grouping expressions such that all incidents of one group match one another."""
    if rule.bearing_limit > 180:
        sector = "0"
    else:
        sector = f"floor(pmod(bearing, 360) / {int(rule.bearing_limit)})"
    # A quarter of the sphere at most: rounding can hide a match only between opposite points.
    chord = min(rule.chord, math.sqrt(2.0))
    if chord < MIN_SPOT_CHORD:
        place = ["lat", "lon"]
    else:
        side = double(chord * (1 - MARGIN) / math.sqrt(3.0))
        place = [f"floor({axis} / {side})" for axis in "xyz"]
    return [*rule.keys, *place, sector]


def spread(anchors: DataFrame, rule: MatchRule) -> DataFrame:
    """Copy each anchor into every wide cell that can hold one of its matches.

    All columns get the prefix ``a_``.
    """
    side = cell_side(rule)
    named = anchors.selectExpr([f"{c} AS a_{c}" for c in anchors.columns if c != "cell"])
    out = reached_cells(named, rule, side, "a_")
    # The indexes tell cells apart that share a number.
    kept = named.columns if side >= MIN_PACKED_SIDE else out.columns
    return out.selectExpr(*kept, f"{cell_number('cx', 'cy', 'cz', side)} AS a_cell")


def anchor_bytes(anchors: DataFrame, rule: MatchRule) -> int:
    """What ``anchors_by_cell`` takes at most when broadcast: every anchor counted in 8 cells."""
    keys = " + ".join(f"octet_length(CAST({k} AS STRING))" for k in rule.keys)
    found = anchors.selectExpr("count(1) AS held", f"coalesce(sum({keys}), 0L) AS keys").first()
    return 8 * (ANCHOR_BYTES * found["held"] + found["keys"])


def anchors_by_cell(anchors: DataFrame, rule: MatchRule) -> DataFrame:
    """One row per wide cell with the array of all anchors that a row of it can match.

    Cells that share a number share a row, which only adds anchors too far away to match.
    """
    copies = spread(anchors, rule)
    fields = ", ".join(f"a_{c} AS {c}" for c in ("rank", "row_id", *GEOMETRY))
    by = [F.col(f"a_{k}").alias(k) for k in (*rule.keys, "cell")]
    return copies.groupBy(*by).agg(F.expr(f"collect_list(struct({fields})) AS anchors"))


def near_condition(rule: MatchRule, point: str = "", anchor: str = "a_") -> str:
    """Distance of a point to an anchor, a cheap test first; arguments are prefixes.

    The cheap test takes latitudes, which no distance falls short of, so that joins need not shuffle vectors.
    """
    degrees = math.degrees(rule.radius_miles / EARTH_RADIUS_MILES) * (1 + MARGIN) + 1e-9
    miles = haversine_miles(f"{anchor}lat", f"{anchor}lon", f"{point}lat", f"{point}lon")
    # Latitudes beyond the poles go on down the other side.
    odd = f"greatest(abs({point}lat), abs({anchor}lat)) > 90"
    return (
        f"(abs({point}lat - {anchor}lat) <= {double(degrees)} OR {odd})"
        f" AND {miles} <= {double(rule.radius_miles)}"
    )


def match_condition(rule: MatchRule, point: str = "", anchor: str = "a_") -> str:
    """Heading and distance of a point against an anchor, cheapest test first."""
    turn = bearing_difference(f"{anchor}bearing", f"{point}bearing")
    return f"{turn} < {int(rule.bearing_limit)} AND {near_condition(rule, point, anchor)}"


def crowded_cells(
    points: DataFrame, rule: MatchRule, rows: int, ws: Workspace, sizes: Sizes = Sizes()
) -> DataFrame | None:
    """Cells to split over several tasks, with the number of ways; None if there can be none.

    A listed cell holds more than ``rows / MAX_SPLIT_CELLS`` rows, so the list stays below
    ``MAX_SPLIT_CELLS`` entries for any input.
    """
    limit = max(sizes.split_rows, rows // MAX_SPLIT_CELLS)
    if rows <= limit:
        return None
    counts = points.groupBy(*rule.keys, "cell").agg(F.count(F.lit(1)).alias("held"))
    listed = counts.filter(f"held > {limit}").selectExpr(
        *rule.keys, "cell", f"int(ceil(held / {limit})) AS ways"
    )
    saved = ws.save(listed, "crowded-cells")
    return saved.df if saved.rows else None


def match_join(
    points: DataFrame,
    anchors: DataFrame,
    rule: MatchRule,
    how: str,
    crowded: DataFrame | None = None,
    extra: str | None = None,
    condition: str | None = None,
) -> DataFrame:
    """Join points with the anchors they match; anchor columns carry the prefix ``a_``.

    Points are the streamed side and are not copied; ``anchors`` must be thinned out (bounded
    per cell). Rows of a crowded cell are dealt over several salts and its anchors copied to
    each of them.
    """
    left, right = points, spread(anchors, rule)
    on = [f"{k} = a_{k}" for k in (*rule.keys, "cell")]
    side = cell_side(rule)
    if side < MIN_PACKED_SIDE:
        on += [f"floor({axis} / {double(side)}) = c{axis}" for axis in "xyz"]
    if crowded is not None:
        cells = F.broadcast(crowded)
        left = left.join(cells, [*rule.keys, "cell"], "left").selectExpr(
            *points.columns, "coalesce(int(pmod(xxhash64(rank), ways)), 0) AS salt"
        )
        renamed = cells.selectExpr([f"{c} AS a_{c}" for c in crowded.columns])
        right = right.join(renamed, [f"a_{k}" for k in (*rule.keys, "cell")], "left")
        right = right.selectExpr(
            *[c for c in right.columns if c != "a_ways"],
            "explode(sequence(0, coalesce(a_ways, 1) - 1)) AS a_salt",
        )
        on.append("salt = a_salt")
    if extra is not None:
        on.append(extra)
    on.append(condition or match_condition(rule))
    # A merge join whatever the estimates say: they do not see that anchors are copied, so that
    # an automatic broadcast could be far larger than Spark's threshold.
    return left.join(right.hint("merge"), F.expr(" AND ".join(on)), how)
