"""Greedy suppression of whole tiles in rank order, streamed.

A tile is a block of wide cells of one key group. Its rows pass by in rank order; what is remembered
is bounded by the tile's area, not by its rows: the rows kept so far, by narrow cell, and the narrow
cells that hold an *open* row, one that cannot be decided here. A row is open when another tile may
still decide it (a lower row lies in a neighbouring cell of another tile), when it is near a cell with
an open row, or when it is too close to the matching distance to tell in another arithmetic than
Spark's own. Leaving more rows open than necessary is always right; they wait for the next round.

Decisions are taken one by one, but each settles all rows of its neighbourhood at once, so that there
are never more turns than kept rows and open cells.

A tile with more than ``Sizes.tile_rows`` rows, however narrow, is cut into ranges of ranks of about that many
rows, or into ``Sizes.sweep_passes`` ranges where there would be more. One pass after the other takes the next range of every such tile, and starts from what the passes
before have left: the tile's kept rows and open cells, a small table. All other tiles run in the first pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import double
from ..rule import MatchRule
from ..sizes import Sizes
from ..workers import ship
from ..workspace import Workspace
from .grid import GEOMETRY, cell_number, cell_side, reach

# Wide cells per side of a tile, widest first; the first width whose largest tile is small enough
# is taken, else the last.
TILE_WIDTHS = (256, 64, 16, 4)
# Kinds of rows that a pass reads, in this order: a neighbouring cell's lowest rank, what was kept and which
# cells were left open by the passes before, and rows to decide.
LOWEST, KEPT, OPEN, ROW = range(4)
_AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


class TileFold:
    """Decides a tile's rows, given lot by lot in rank order."""

    def __init__(self, rule: MatchRule, lows: dict[tuple[int, int, int], int]):
        """``lows``: per wide cell the lowest rank in neighbouring cells of other tiles."""
        self.lows, self.wide, self.narrow = lows, cell_side(rule), reach(rule)
        slack = rule.chord * 1e-9 + 1e-14
        self.surely, self.hardly = max(rule.chord - slack, 0.0) ** 2, (rule.chord + slack) ** 2
        self.limit = rule.bearing_limit
        by_sector = self.limit <= 120 and 360 % int(self.limit) == 0
        self.sectors = 360 // int(self.limit) if by_sector else 1
        self.kept: dict[tuple[int, int, int], list[tuple[float, float, float, int]]] = {}
        self.open: set[tuple[tuple[int, int, int], int]] = set()
        self.handed: set[tuple[tuple[int, int, int], int]] = set()  # open cells handed over to this fold

    def restore_kept(self, places: np.ndarray, bearing: np.ndarray) -> None:
        """Rows that were kept of lower ranks."""
        cells = map(tuple, np.floor(places / self.narrow).astype(np.int64).tolist())
        for cell, place, turn in zip(cells, places.tolist(), bearing.tolist()):
            self.kept.setdefault(cell, []).append((*place, int(turn)))

    def restore_open(self, cells: list[tuple[int, int, int]], sectors: list[int]) -> None:
        self.open.update(zip(cells, sectors))
        self.handed.update(zip(cells, sectors))

    def decide(self, rank: np.ndarray, places: np.ndarray, bearing: np.ndarray) -> list[int]:
        """Positions of the rows that are kept."""
        n = len(rank)
        cells = list(map(tuple, np.floor(places / self.narrow).astype(np.int64).tolist()))
        sector = np.mod(bearing, 360) // (360 // self.sectors)
        rows_of: dict[tuple[int, int, int], list[int]] = {}
        for i, cell in enumerate(cells):
            rows_of.setdefault(cell, []).append(i)
        rows_in = {cell: np.array(rows) for cell, rows in rows_of.items()}
        active, blocked = np.ones(n, bool), np.zeros(n, bool)
        if self.lows:
            wide = map(tuple, np.floor(places / self.wide).astype(np.int64).tolist())
            low = np.array([self.lows.get(cell, np.iinfo(np.int64).max) for cell in wide])
            blocked |= low < rank

        def strike(rows: np.ndarray, kept: np.ndarray) -> None:
            """Drop the rows that a kept row matches; those too close to call are left open."""
            gap = places[rows][:, None, :] - kept[None, :, :3]
            far = np.einsum("rki,rki->rk", gap, gap)
            turn = np.mod(bearing[rows][:, None] - kept[None, :, 3].astype(np.int64), 360)
            ahead = np.minimum(turn, 360 - turn) < self.limit
            active[rows[(ahead & (far <= self.surely)).any(axis=1)]] = False
            blocked[rows[(ahead & (far < self.hardly)).any(axis=1)]] = True

        def near(cell: tuple[int, int, int]) -> Iterator[tuple[int, int, int]]:
            x, y, z = cell
            return ((x + i, y + j, z + k) for i, j, k in _AROUND)

        def beside(of: int) -> set[int]:
            return {(of + d) % self.sectors for d in (-1, 0, 1)}

        for cell, rows in rows_in.items():
            earlier = [k for c in near(cell) for k in self.kept.get(c, ())]
            if earlier:
                strike(rows, np.array(earlier))
            for s in np.unique(sector[rows]).tolist():
                if any((c, t) in self.open for c in near(cell) for t in beside(s)):
                    blocked[rows[sector[rows] == s]] = True
                if (cell, s) in self.open:
                    active[rows[sector[rows] == s]] = False

        out = []
        for i in range(n):
            if not active[i]:
                continue
            cell, s = cells[i], int(sector[i])
            if blocked[i]:
                if (cell, s) not in self.open:
                    self.open.add((cell, s))
                    wanted = list(beside(s))
                    for c in near(cell):
                        rows = rows_in.get(c)
                        if rows is not None:
                            blocked[rows[np.isin(sector[rows], wanted)]] = True
                rows = rows_in[cell]
                active[rows[sector[rows] == s]] = False
                continue
            out.append(i)
            mine = (*places[i].tolist(), int(bearing[i]))
            self.kept.setdefault(cell, []).append(mine)
            active[i] = False
            for c in near(cell):
                rows = rows_in.get(c)
                if rows is not None:
                    rows = rows[(rows > i) & active[rows]]
                    if len(rows):
                        strike(rows, np.array([mine]))
        return out


def tile_sweep(
    undecided: DataFrame,
    rule: MatchRule,
    ws: Workspace,
    sizes: Sizes = Sizes(),
    shifted: bool = False,
) -> DataFrame:
    """Rows that their tile alone can tell to survive, however long the chain they depend on.

    ``shifted`` cuts the tiles at other places than otherwise.
    """
    side = cell_side(rule)
    axes = ", ".join(f"floor({axis} / {double(side)}) AS c{axis}" for axis in "xyz")
    placed = undecided.selectExpr("*", *axes.split(", "))
    index = ["cx", "cy", "cz"]
    cells = ws.write(
        placed.groupBy(*rule.keys, *index).agg(
            F.count(F.lit(1)).alias("held"), F.min("rank").alias("lowest")
        ),
        "cells",
    )

    def tile(width: int, prefix: str = "c") -> str:
        shift = width // 2 if shifted else 0
        blocks = [f"floor(({prefix}{axis} + {shift}) / {width})" for axis in "xyz"]
        return cell_number(*blocks, side)

    for width in TILE_WIDTHS:
        tiles = cells.selectExpr(*rule.keys, f"{tile(width)} AS tile", "held")
        most = tiles.groupBy(*rule.keys, "tile").agg(F.sum("held").alias("held")).agg(F.max("held"))
        if (most.first()[0] or 0) <= sizes.tile_rows:
            break
    # Each cell tells its lowest rank to the neighbouring cells of other tiles.
    told = cells
    for axis in "xyz":
        told = told.selectExpr("*", f"explode(sequence(c{axis} - 1, c{axis} + 1)) AS n{axis}")
    told = (
        told.selectExpr(*rule.keys, "nx", "ny", "nz", f"{tile(width)} AS own", f"{tile(width, 'n')} AS tile", "lowest")
        .filter("own <> tile")
        .groupBy(*rule.keys, "tile", "nx", "ny", "nz")
        .agg(F.min("lowest").alias("lowest"))
        .join(cells.selectExpr(*rule.keys, "cx AS nx", "cy AS ny", "cz AS nz"), [*rule.keys, "nx", "ny", "nz"], "left_semi")
    )
    columns = ["rank", "row_id", *rule.keys, *GEOMETRY, "cell"]
    rows = placed.selectExpr(*columns, f"{tile(width)} AS tile", f"{ROW} AS kind", *[f"bigint({c}) AS {c}" for c in index])
    types = dict(undecided.dtypes)
    absent = [f"CAST(NULL AS {types[c]}) AS {c}" for c in ("row_id", *GEOMETRY, "cell")]
    controls = told.selectExpr(
        "lowest AS rank", *rule.keys, *absent, "tile", f"{LOWEST} AS kind", *[f"bigint(n{a}) AS c{a}" for a in "xyz"]
    ).select(*rows.columns)
    largest = most.first()[0] or 0
    if largest <= sizes.tile_rows:
        return _pass(rows.unionByName(controls), rule).filter(f"kind = {KEPT}").select(*columns)
    hot, ranges = rank_ranges(rows, rule, ws, largest, sizes)
    by = [*rule.keys, "tile"]
    part = "coalesce(size(filter(cuts, c -> c < rank)), 0) AS part"
    # Written, as every pass reads its own part.
    ranged = ws.write(rows.join(F.broadcast(hot), by, "left").selectExpr(*rows.columns, part), "ranges")
    passes = []
    for number in range(ranges):
        now = ranged.filter(f"part = {number}").select(*rows.columns).unionByName(controls)
        if passes:
            now = reduce(DataFrame.unionByName, passes).unionByName(now)
            now = now.join(F.broadcast(hot.select(*by)), by, "left_semi").select(*rows.columns)
        passes.append(ws.write(_pass(now, rule, hand_over=True), "pass"))
    return reduce(DataFrame.unionByName, passes).filter(f"kind = {KEPT}").select(*columns)


def rank_ranges(
    rows: DataFrame, rule: MatchRule, ws: Workspace, largest: int, sizes: Sizes
) -> tuple[DataFrame, int]:
    """Tiles of more than ``tile_rows`` rows with ``cuts``, the ranks between their ranges, and the number of these.

    A range holds ``tile_rows`` rows at most, up to half a percent, or the share of a tile that ``sweep_passes``
    passes leave. There are fewer such tiles than
    rows / tile_rows, so that the table is safe to broadcast.
    """
    ranges = min(-(-largest // sizes.tile_rows), sizes.sweep_passes)
    shares = ", ".join(f"{k / ranges!r}D" for k in range(1, ranges))
    cuts = f"percentile_approx(rank, array({shares}), {max(10_000, 200 * ranges)}) AS cuts"
    counted = rows.groupBy(*rule.keys, "tile").agg(F.count(F.lit(1)).alias("held"), F.expr(cuts))
    return ws.write(counted.filter(f"held > {sizes.tile_rows}").drop("held"), "hot-tiles"), ranges


def _pass(dealt: DataFrame, rule: MatchRule, hand_over: bool = False) -> DataFrame:
    """Rows of kind KEPT and, to be handed over, of kind OPEN (a narrow cell, the sector as bearing) of every tile."""
    keys = [*rule.keys, "tile"]
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, "kind", "rank")
    arrow = to_arrow_schema(dealt.schema)

    def places_of(part: pa.RecordBatch) -> np.ndarray:
        return np.stack([part.column(axis).to_numpy() for axis in "xyz"], axis=1)

    def headings(part: pa.RecordBatch) -> np.ndarray:
        return part.column("bearing").to_numpy().astype(np.int64)

    def cells(part: pa.RecordBatch) -> list[tuple[int, int, int]]:
        return list(zip(*(part.column(f"c{axis}").to_pylist() for axis in "xyz")))

    def opened(named: tuple, fold: TileFold) -> Iterator[pa.RecordBatch]:
        found = sorted(fold.open - fold.handed)
        if hand_over and found:
            of = dict(zip(keys, named))
            columns = {f.name: [of.get(f.name)] * len(found) for f in arrow}
            columns |= {f"c{axis}": [cell[i] for cell, _ in found] for i, axis in enumerate("xyz")}
            columns |= {"rank": [0] * len(found), "kind": [OPEN] * len(found), "bearing": [sector for _, sector in found]}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fold = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            named = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            kinds = batch.column("kind").to_numpy()
            cuts = [i for i in range(1, len(named)) if named[i] != named[i - 1] or kinds[i] != kinds[i - 1]]
            for start, end in zip([0, *cuts], [*cuts, len(named)]):
                if named[start] != current:
                    if fold is not None:
                        yield from opened(current, fold)
                    current, fold = named[start], TileFold(rule, {})
                part, kind = batch.slice(start, end - start), kinds[start]
                ranks = part.column("rank").to_numpy()
                if kind == LOWEST:
                    fold.lows.update(zip(cells(part), ranks.tolist()))
                elif kind == KEPT:
                    fold.restore_kept(places_of(part), headings(part))
                elif kind == OPEN:
                    fold.restore_open(cells(part), part.column("bearing").to_pylist())
                else:
                    kept = fold.decide(ranks, places_of(part), headings(part))
                    if kept:
                        taken = part.take(pa.array(kept))
                        columns = {name: taken.column(name) for name in taken.schema.names}
                        columns["kind"] = pa.array([KEPT] * len(kept))
                        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)
        if fold is not None:
            yield from opened(current, fold)

    ship(dealt.sparkSession)
    return ordered.mapInArrow(run, dealt.schema)
