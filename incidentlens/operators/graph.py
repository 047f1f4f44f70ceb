"""The full match graph in compressed form: blocks of incidents that match one another as a whole.

A *box* is a cube of places times a range of headings, on one road; halving both gives the boxes of the next
level. Two boxes either match wholly (every row of one matches every row of the other), not at all, or in part.
What matches wholly is one row, a *block*, however many rows the boxes hold; what matches in part is taken to
the next level, or listed row by row once one of the two boxes holds few rows. Where rows pile up in one place
the matches are quadratic in the rows, while blocks and listed edges are bounded by the number of headings.
Over a crowd spread evenly the border between what matches and what does not has to be spelt out; it
grows with some power of 5/3 of the rows, which is slower than the matches, but not linear.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import double
from ..rule import MatchRule
from ..workspace import Workspace
from .grid import cell_side, match_condition

# Boxes with at most this many rows are compared row by row.
FEW_ROWS = 16
# Widest range of headings; a quarter of the circle keeps the difference of two ranges below half a circle.
WIDEST_TURN = 60
# Cubes are halved this often at most; what then still matches in part is listed.
MAX_LEVELS = 40


@dataclass(frozen=True)
class MatchGraph:
    """``blocks``: (keys, level, box, other) that match wholly, both ways and with themselves.

    ``edges``: (row_id, other_id) of single matches, both ways. ``members``: (row_id, keys, level, box, n)
    of all levels in use; n is the number of rows in the box.
    """

    blocks: DataFrame
    edges: DataFrame
    members: DataFrame
    rule: MatchRule

    def degrees(self) -> DataFrame:
        """``(row_id, degree)``: how many other incidents each one matches."""
        on = [*self.rule.keys, "level", "box"]
        sizes = self.members.groupBy(*on).agg(F.first("n").alias("n")).withColumnsRenamed({"box": "other"})
        met = self.blocks.join(sizes, [*self.rule.keys, "level", "other"])
        by_box = met.groupBy(*on).agg(F.sum("n").alias("degree"))
        whole = self.members.join(by_box, on).select("row_id", "degree")
        single = self.edges.groupBy("row_id").agg(F.count(F.lit(1)).alias("degree"))
        # Every row is in a box that matches itself, or listed with itself.
        total = whole.unionByName(single).groupBy("row_id").agg(F.sum("degree").alias("degree"))
        return total.selectExpr("row_id", "degree - 1 AS degree")


def _box(rule: MatchRule, level: int) -> str:
    """Number of the box that holds a row."""
    side, turn = cell_side(rule) / 2**level, WIDEST_TURN / 2**level
    places = ", ".join(f"floor({axis} / {double(side)})" for axis in "xyz")
    return f"xxhash64({level}, {places}, floor(pmod(bearing, 360) / {double(turn)}))"


def _boxes(points: DataFrame, rule: MatchRule, level: int) -> DataFrame:
    """Extent and rows of every box of a level, with the box above it."""
    ends = [f"{f}({c}) AS {f}_{c}" for c in ("x", "y", "z", "lat", "lon", "turn") for f in ("min", "max")]
    rows = points.selectExpr("*", "pmod(bearing, 360) AS turn", f"{_box(rule, level)} AS box", f"{_box(rule, level - 1) if level else '0L'} AS above")
    return rows.groupBy(*rule.keys, "box").agg(F.first("above").alias("above"), F.count(F.lit(1)).alias("n"), *map(F.expr, ends))


def _relation(rule: MatchRule) -> str:
    """SQL: 'whole', 'none' or 'part' for boxes with column prefixes ``a_`` and ``b_``."""
    slack = rule.chord * 1e-9 + 1e-14
    near = [f"greatest(a_min_{c} - b_max_{c}, b_min_{c} - a_max_{c}, 0D)" for c in "xyz"]
    far = [f"greatest(a_max_{c} - b_min_{c}, b_max_{c} - a_min_{c})" for c in "xyz"]
    low, high = "(b_min_turn - a_max_turn)", "(b_max_turn - a_min_turn)"

    def apart(turn: str) -> str:
        return f"least(pmod({turn}, 360), 360 - pmod({turn}, 360))"

    # On a range of differences the angle is least at whole circles and largest at half ones, else at its ends.
    least = f"IF(floor({high} / 360D) * 360 >= {low}, 0, least({apart(low)}, {apart(high)}))"
    most = f"IF(floor(({high} - 180) / 360D) * 360 + 180 >= {low}, 180, greatest({apart(low)}, {apart(high)}))"
    square = " + ".join
    single = " AND ".join(f"{p}_min_{c} = {p}_max_{c}" for p in "ab" for c in ("lat", "lon", "turn"))
    exact = match_condition(rule, "b_", "a_")
    for p in "ab":
        for c in ("lat", "lon", "x", "y", "z"):
            exact = exact.replace(f"{p}_{c}", f"{p}_min_{c}")
        exact = exact.replace(f"{p}_bearing", f"{p}_min_turn")
    reach, sure = rule.chord + slack, max(rule.chord - slack, 0.0)
    return f"""CASE WHEN {single} THEN IF({exact}, 'whole', 'none')
        WHEN {square(f"{d} * {d}" for d in near)} > {double(reach * reach)} OR {least} >= {int(rule.bearing_limit)} THEN 'none'
        WHEN {square(f"{d} * {d}" for d in far)} <= {double(sure * sure)} AND {most} < {int(rule.bearing_limit)} THEN 'whole'
        ELSE 'part' END"""


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.selectExpr([f"{c} AS {prefix}_{c}" for c in df.columns])


def match_graph(points: DataFrame, rule: MatchRule, ws: Workspace) -> MatchGraph:
    """Blocks and edges of all matches among ``points`` (as ``to_points`` makes them)."""
    keys, side = rule.keys, cell_side(rule)
    places = [f"floor({c} / {double(side)}) AS c{c}" for c in "xyz"]
    same = [F.expr(f"a_{k} = b_{k}") for k in keys]
    blocks, edges, members, pairs = [], [], [], None
    for level in range(MAX_LEVELS + 1):
        boxes = ws.write(_boxes(points, rule, level), "boxes")
        left, right = _prefixed(boxes, "a"), _prefixed(boxes, "b")
        if level == 0:
            # Boxes of neighbouring cubes; every box lies in one cube of places. Matching goes both ways: of two
            # boxes one order is looked at, and written, so that half of the neighbours will do.
            for c in "xyz":
                left = left.selectExpr("*", f"explode(sequence(floor(a_min_{c} / {double(side)}) - 1, floor(a_min_{c} / {double(side)}) + 1)) AS c{c}")
            at, own = "struct(cx, cy, cz)", ", ".join(f"floor(a_min_{c} / {double(side)}) AS c{c}" for c in "xyz")
            left = left.selectExpr("*", f"{at} > struct({own}) AS ahead").filter(f"{at} >= struct({own})")
            right = right.selectExpr("*", *[p.replace(f"floor({c}", f"floor(b_min_{c}") for p, c in zip(places, "xyz")])
            met = left.join(right, [F.expr(f"a_{k} = b_{k}") for k in keys] + [left[f"c{c}"] == right[f"c{c}"] for c in "xyz"])
        else:
            met = pairs.join(left, [pairs[f"p_{k}"] == left[f"a_{k}"] for k in keys] + [pairs["p_box"] == left["a_above"]])
            met = met.join(right, [*same, met["p_other"] == right["b_above"]])
        met = met.filter("a_box <= b_box OR " + ("p_box <> p_other" if level else "ahead"))
        met = met.selectExpr(*[f"a_{k} AS {k}" for k in keys], "a_box AS box", "b_box AS other", "least(a_n, b_n) AS few", f"{_relation(rule)} AS relation")
        found = ws.write(met.filter("relation <> 'none'"), "related")
        here = points.selectExpr("row_id", *keys, f"{_box(rule, level)} AS box")
        whole = found.filter("relation = 'whole'").selectExpr(*keys, f"{level} AS level", "box", "other")
        blocks.append(_both_ways(whole, "box", "other", "box <> other"))
        members.append(here.join(boxes.select(*keys, "box", "n"), [*keys, "box"]).selectExpr("row_id", *keys, f"{level} AS level", "box", "n"))
        last = level == MAX_LEVELS
        listed = found.filter("relation = 'part'" if last else f"relation = 'part' AND few <= {FEW_ROWS}")
        single = ws.write(_listed(listed, points, rule, level), "edges")
        edges.append(_both_ways(single, "row_id", "other_id", "mirrored").drop("mirrored"))
        rest = ws.save(found.filter(f"relation = 'part' AND few > {FEW_ROWS}").selectExpr(*keys, "box", "other"), "part")
        if last or not rest.rows:
            break
        pairs = _prefixed(rest.df, "p")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return MatchGraph(union(blocks), union(edges), union(members), rule)


def _both_ways(pairs: DataFrame, one: str, other: str, of: str) -> DataFrame:
    """The pairs, and those that ``of`` holds for the other way round, too."""
    turned = pairs.filter(of).withColumnsRenamed({one: "was_one"}).withColumnsRenamed({other: one}).withColumnsRenamed({"was_one": other})
    return pairs.unionByName(turned)


def _listed(pairs: DataFrame, points: DataFrame, rule: MatchRule, level: int) -> DataFrame:
    """(row_id, other_id, mirrored) of the matches between the rows of two boxes, in one order each.

    ``mirrored``: whether the match the other way round is to be added.
    """
    columns = ["row_id", *rule.keys, "lat", "lon", "bearing"]
    rows = points.selectExpr(*columns, f"{_box(rule, level)} AS box")
    met = pairs.select(*rule.keys, "box", "other").join(rows, [*rule.keys, "box"])
    others = rows.selectExpr(*[f"{c} AS a_{c}" for c in (*columns, "box")])
    once = "(box <> other OR row_id <= a_row_id)"
    on = " AND ".join([*[f"{k} = a_{k}" for k in rule.keys], "other = a_box", once, match_condition(rule)])
    found = met.join(others, F.expr(on))
    return found.selectExpr("row_id", "a_row_id AS other_id", "box <> other OR row_id <> a_row_id AS mirrored")
