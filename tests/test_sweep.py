"""The streamed fold of a tile against the plain sequential walk, without Spark."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest

from incidentlens import MatchRule
from incidentlens.operators.sweep import TileFold


def points(lat, lon):
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def walk(places, bearing, rule):
    kept = []
    for i in range(len(places)):
        for k in kept:
            turn = (bearing[i] - bearing[k]) % 360
            if math.dist(places[i], places[k]) <= rule.chord and min(turn, 360 - turn) < rule.bearing_limit:
                break
        else:
            kept.append(i)
    return kept


def fold(places, bearing, rule, lot, lows=None):
    state, kept = TileFold(rule, lows or {}), []
    for start in range(0, len(places), lot):
        end = min(start + lot, len(places))
        found = state.decide(np.arange(start, end), places[start:end], bearing[start:end])
        kept += [start + i for i in found]
    return kept


@pytest.mark.parametrize("limit", [1, 45, 60, 100, 181])
@pytest.mark.parametrize("lot", [7, 1000])
def test_whole_tile_is_settled(limit, lot):
    rng = np.random.default_rng(limit)
    rule = MatchRule(0.5, bearing_limit=limit)
    places = points(52 + rng.integers(0, 400, 600) * 1e-4, 1 + rng.integers(0, 30, 600) * 1e-4)
    bearing = rng.integers(-90, 720, 600)
    assert fold(places, bearing, rule, lot) == walk(places, bearing, rule)


@pytest.mark.parametrize("limit", [45, 60])
def test_hand_over_between_ranges(limit):
    """A fold that starts from another's kept rows and open cells goes on as the other would."""
    rng = np.random.default_rng(limit)
    rule = MatchRule(0.5, bearing_limit=limit)
    places = points(52 + rng.integers(0, 400, 900) * 1e-4, 1 + rng.integers(0, 30, 900) * 1e-4)
    bearing = rng.integers(0, 360, 900)
    wide = np.floor(places / TileFold(rule, {}).wide).astype(np.int64)
    lows = {tuple(cell): 300 for cell in wide[::7].tolist()}
    want = fold(places, bearing, rule, 100, lows)
    kept, open_cells = [], set()
    for start in range(0, 900, 300):
        state = TileFold(rule, lows)
        state.restore_kept(places[kept], bearing[kept])
        state.restore_open([c for c, _ in open_cells], [s for _, s in open_cells])
        found = state.decide(np.arange(start, start + 300), places[start : start + 300], bearing[start : start + 300])
        kept += [start + i for i in found]
        open_cells |= state.open
    assert kept == want


def test_rows_that_others_may_decide_stay_open():
    rng = np.random.default_rng(5)
    rule = MatchRule(0.5)
    places, bearing = points(52 + rng.random(800) * 0.3, 1 + rng.random(800) * 0.003), rng.integers(0, 360, 800)
    wide = np.floor(places / TileFold(rule, {}).wide).astype(np.int64)
    around = {tuple(cell): 20 for cell in wide[places[:, 2] < np.median(places[:, 2])].tolist()}
    kept = fold(places, bearing, rule, 100, around)
    sure = set(walk(places, bearing, rule))
    assert set(kept) < sure and kept  # never a wrong one, and fewer than all


def test_long_road_in_order_takes_linear_time():
    rule = MatchRule(0.5)
    seconds = []
    for n in (20_000, 80_000):
        lat, bearing = 52 + np.arange(n) * (0.58 / n), np.arange(n) * 31 % 360
        places = points(lat, np.full(n, 1.0))
        started = time.process_time()
        kept = fold(places, bearing, rule, 10_000)
        seconds.append(time.process_time() - started)
        assert 100 < len(kept) < 3000
    assert seconds[1] < 12 * seconds[0]


def test_passes_over_a_full_tile_are_few(spark, ws, monkeypatch):
    """A tile with fifty times the rows of a range takes no more passes than allowed."""
    import model

    from incidentlens import Sizes, Workspace
    from incidentlens.operators.grid import to_points
    from incidentlens.operators.sweep import tile_sweep

    rule = MatchRule(0.3)
    rows = model.random_rows(1000, seed=51, roads=1, hot=900)
    made = ws.write(to_points(spark.createDataFrame(rows, model.SCHEMA), rule, "row_id"), "points")
    whole = {r.row_id for r in tile_sweep(made, rule, ws).collect()}
    passes, write = [], Workspace.write

    def counting(self, df, name):
        passes.append(name)
        return write(self, df, name)

    monkeypatch.setattr(Workspace, "write", counting)
    sizes = Sizes(tile_rows=20)
    kept = {r.row_id for r in tile_sweep(made, rule, ws, sizes).collect()}
    assert kept and kept <= whole
    assert 1 < passes.count("pass") <= 8
