"""Greedy suppression against the sequential walk, by rounds and by the closing fold."""

from __future__ import annotations

import math

import model
import pytest

from incidentlens import MatchRule, Sizes, dedupe_points
from incidentlens.operators import sweep

ROUNDS_ONLY = Sizes(fold_rows=0, fold_work=0)
SPLIT = Sizes(fold_rows=0, fold_work=0, split_rows=20)


def owners(spark, rows, mileage, sizes=ROUNDS_ONLY, rule=None):
    df = spark.createDataFrame(rows, model.SCHEMA).repartition(3)
    run = dedupe_points(df, mileage, rule=rule, sizes=sizes)
    out = {r.row_id: r.owner_id for r in run.owners.collect()}
    fit = {r.row_id: r.fitness for r in run.suppressors.collect()}
    assert run.check().first().conserved
    return out, fit


@pytest.mark.parametrize("sizes", [ROUNDS_ONLY, Sizes(), SPLIT], ids=["rounds", "fold", "split"])
def test_random_rows(spark, sizes):
    rows = model.random_rows(300, seed=1)
    want = model.greedy(rows, 0.5)
    got, fit = owners(spark, rows, 0.5, sizes)
    assert got == want
    assert fit == model.fitness(want)


@pytest.mark.parametrize("mileage", [0.0, 1e-5, 0.002, 0.02, 5.0, 30_000.0])
def test_radius_from_zero_to_the_whole_earth(spark, mileage):
    rows = model.random_rows(120, seed=2, hot=40)
    rows += [(r[0] + 1000, *r[1:]) for r in rows[:20]]
    rows += [(2000, 89.9999, 0.0, 10, "pole"), (2001, 89.9999, 180.0, 20, "pole")]
    rows += [(2002, 0.0, 179.999, 10, "line"), (2003, 0.0, -179.999, 20, "line")]
    rows = sorted(rows)
    got, _ = owners(spark, rows, mileage)
    assert got == model.greedy(rows, mileage)


def test_no_survivors_match_and_all_dropped_do(spark):
    rows = model.random_rows(200, seed=3, roads=1)
    by_id = {r[0]: r for r in rows}
    got, fit = owners(spark, rows, 0.5)
    kept = [by_id[i] for i in fit]
    assert not any(model.matches(p, q, 0.5) for p in kept for q in kept if p is not q)
    assert all(model.matches(by_id[o], by_id[i], 0.5) for i, o in got.items())


def test_third_of_all_rows_in_one_place(spark):
    """One spot holds a third of the rows; its cell is split and the result stays the same."""
    rows = model.random_rows(450, seed=4, hot=150)
    want = model.greedy(rows, 0.3)
    assert owners(spark, rows, 0.3, SPLIT)[0] == want


def test_long_chain_in_row_order(spark):
    """Every row depends on the one before it."""
    rows = [(i, 52.0 + i * 0.002, -1.0, 0, "A1") for i in range(40)]
    got, _ = owners(spark, rows, 0.4, Sizes(fold_rows=30, fold_work=0))
    assert got == model.greedy(rows, 0.4)


def test_sweeps_follow_a_chain_through_tiles(spark):
    """Rows in order along a road of several tiles: sweeps need one turn per tile, not per spot."""
    rows = [(i, 52.0 + i * 0.0005, -1.0, 0, "A1") for i in range(150)]
    rows += [(1000 + i, 52.0 + (149 - i) * 0.0005, -1.0, 0, "B2") for i in range(150)]
    df = spark.createDataFrame(rows, model.SCHEMA)
    run = dedupe_points(df, 0.1, sizes=Sizes(fold_rows=10, fold_work=0, slow_share=0.0))
    assert {r.row_id: r.owner_id for r in run.owners.collect()} == model.greedy(rows, 0.1)


@pytest.mark.parametrize("tile_rows", [20, 60])
def test_sweeps_on_random_rows(spark, tile_rows):
    rows = model.random_rows(300, seed=6, roads=2, span=0.2, hot=60)
    want = model.greedy(rows, 0.6)
    sizes = Sizes(fold_rows=0, fold_work=0, tile_rows=tile_rows, slow_share=0.0)
    assert owners(spark, rows, 0.6, sizes)[0] == want


def test_hot_tile_is_swept_in_ranges(spark, monkeypatch):
    """Two thirds of the rows in one tile: no task is given more than a range of them."""
    rows = model.random_rows(300, seed=8, roads=2, span=0.2, hot=200)
    seen, one_pass = [], sweep._pass

    def counting(dealt, rule, hand_over=False):
        given = dealt.filter(f"kind = {sweep.ROW}").groupBy(*rule.keys, "tile").count()
        seen.append(given.agg({"count": "max"}).first()[0] or 0)
        return one_pass(dealt, rule, hand_over)

    monkeypatch.setattr(sweep, "_pass", counting)
    sizes = Sizes(fold_rows=0, fold_work=0, tile_rows=8, slow_share=0.0)
    assert owners(spark, rows, 0.6, sizes)[0] == model.greedy(rows, 0.6)
    assert len(seen) > 4 and max(seen) <= 9


def test_heading_limit_and_extra_key(spark):
    rows = model.random_rows(150, seed=5, roads=1, span=0.01)
    rule = MatchRule(0.5, bearing_limit=200)
    assert owners(spark, rows, 0.5, rule=rule)[0] == model.greedy(rows, 0.5, limit=200)
    rule = MatchRule(0.5, bearing_limit=7)
    assert owners(spark, rows, 0.5, rule=rule)[0] == model.greedy(rows, 0.5, limit=7)
    tagged = spark.createDataFrame(
        [(*r, "Mon" if r[0] % 2 else "mON" if r[0] % 4 else "Tue") for r in rows],
        model.SCHEMA + ", weekday STRING",
    )
    run = dedupe_points(tagged, 0.5, rule=MatchRule(0.5, extra_keys=("weekday",)))
    want = {}
    for odd in ({1, 2, 3}, {0}):
        want |= model.greedy([r for r in rows if r[0] % 4 in odd], 0.5)
    assert {r.row_id: r.owner_id for r in run.owners.collect()} == want


CASES = {
    "bearing 59": ([(0, 1.0, 1.0, 0, "a"), (1, 1.0, 1.0, 59, "a")], 1),
    "bearing 60": ([(0, 1.0, 1.0, 0, "a"), (1, 1.0, 1.0, 60, "a")], 2),
    "bearing wraps": ([(0, 1.0, 1.0, 350, "a"), (1, 1.0, 1.0, 10, "a")], 1),
    "road case": ([(0, 1.0, 1.0, 0, "A1 North"), (1, 1.0, 1.0, 0, "a1 NORTH")], 1),
    "blank roads": ([(0, 1.0, 1.0, 0, ""), (1, 1.0, 1.0, 0, "")], 1),
    "other road": ([(0, 1.0, 1.0, 0, "a"), (1, 1.0, 1.0, 0, "b")], 2),
    "inside radius": ([(0, 0.0, 0.0, 0, "a"), (1, 0.00361, 0.0, 0, "a")], 1),
    "outside radius": ([(0, 0.0, 0.0, 0, "a"), (1, 0.00363, 0.0, 0, "a")], 2),
    "duplicates": ([(i, 1.0, 1.0, 0, "a") for i in range(5)], 1),
    "chain": ([(i, i * 0.003, 0.0, 0, "a") for i in range(3)], 2),
    "not a number": ([(0, math.nan, 1.0, 0, "a"), (1, 1.0, 1.0, 0, "a")], 2),
    "infinite": ([(0, math.inf, 1.0, 0, "a"), (1, math.inf, 1.0, 0, "a")], 2),
}


def test_hand_made_cases(spark):
    """All cases in one run, each on roads of its own."""
    rows, want = [], {}
    for number, (name, (case, survivors)) in enumerate(CASES.items()):
        for row in case:
            road = row[4] if name == "blank roads" else f"{row[4]} / {number}"
            rows.append((number * 100 + row[0], *row[1:4], road))
        want[name] = survivors
    df = spark.createDataFrame(rows, model.SCHEMA)
    run = dedupe_points(df, 0.5, sizes=ROUNDS_ONLY)
    kept = [r.row_id // 100 for r in run.suppressors.collect()]
    assert {name: kept.count(i) for i, name in enumerate(CASES)} == want
    assert run.check().first().conserved


def test_missing_values_match_nothing(spark):
    rows = [
        (0, None, 1.0, 0, "a", 1),
        (1, 1.0, 1.0, None, "a", 1),
        (2, 1.0, 1.0, 0, "a", None),
        (3, 1.0, 1.0, 0, None, 1),
        (4, 1.0, 1.0, 0, "", 1),
    ]
    df = spark.createDataFrame(rows, model.SCHEMA + ", lane INT")
    run = dedupe_points(df, 0.5, rule=MatchRule(0.5, extra_keys=("lane",)), sizes=ROUNDS_ONLY)
    fit = {r.row_id: r.fitness for r in run.suppressors.collect()}
    assert fit == {0: 0, 1: 0, 2: 0, 3: 1}
    assert run.check().first().conserved


def test_negative_mileage_and_empty_table(spark):
    rows = [(0, 1.0, 1.0, 0, "a"), (1, 1.0, 1.0, 0, "a")]
    got, fit = owners(spark, rows, -1.0)
    assert got == {0: 0, 1: 1} and fit == {0: 0, 1: 0}
    empty = dedupe_points(spark.createDataFrame([], model.SCHEMA), 0.5)
    assert empty.spots().count() == 0 and empty.check().first().conserved
