from __future__ import annotations

import model
import pytest

from incidentlens import MatchRule, Sizes, hotspots, hotspots_chunked
from incidentlens.operators.chunks import even_chunks
from incidentlens.operators.grid import to_points
from incidentlens.operators.ordering import with_position
from incidentlens.operators.sampling import (
    draw_sample,
    find_cut,
    sample_size,
    without_sample,
)
from incidentlens.operators.suppress import head_edges

SMALL = Sizes(split_rows=30, fold_rows=0, fold_work=0, sort_rows=5)


@pytest.fixture(scope="module")
def rows():
    return model.random_rows(400, seed=11, hot=130)


@pytest.fixture(scope="module")
def incidents(spark, rows):
    return spark.createDataFrame(rows, model.SCHEMA).cache()


@pytest.mark.parametrize("pct", [0, 10, 100])
@pytest.mark.parametrize("sizes", [SMALL, Sizes()], ids=["small", "default"])
def test_exact_equals_one_greedy_pass(incidents, rows, pct, sizes):
    run = hotspots(incidents.repartition(5), pct, 0.4, seed=7, sizes=sizes)
    sample, rest = model.sample_first(rows, pct, 7)
    want = model.greedy(sample + rest, 0.4)
    assert {r.row_id: r.owner_id for r in run.owners.collect()} == want
    fit = model.fitness(want)
    assert {r.row_id: r.fitness for r in run.suppressors.collect()} == fit
    spots = {i: f for i, f in fit.items() if f}
    assert {r.row_id: r.fitness for r in run.spots().collect()} == spots
    summary = run.summary().first()
    assert (summary.candidates, summary.final) == (len(fit), len(spots))
    assert summary.strong == sum(f > 10 for f in fit.values())
    assert run.check().first().conserved
    run.workspace.close()


@pytest.mark.parametrize("pct", [0, 10])
@pytest.mark.parametrize("sizes", [SMALL, Sizes()], ids=["small", "default"])
def test_chunked_equals_chunk_by_chunk_merge(incidents, rows, pct, sizes):
    df = incidents.withColumn("part", even_chunks(len(rows), 5))
    run = hotspots_chunked(df, pct, 0.4, seed=7, chunk_col="part", sizes=sizes)
    want = model.chunked(rows, lambda r: r[0] * 5 // len(rows), pct, 7, 0.4)
    assert {r.row_id: r.fitness for r in run.suppressors.collect()} == want
    assert run.check().first().conserved


def test_one_absorption_per_chunk_and_fitness_transfer(spark):
    """A row absorbs the first of two matches in the next chunk and takes over its fitness."""
    rows = [
        (0, 0.0, 0.0, 0, "a"),
        (1, 0.003, 0.0, 0, "a"),
        (2, 0.003, 0.0, 0, "a"),
        (3, 0.003, 0.0, 0, "a"),
        (4, -0.003, 0.0, 0, "a"),
    ]
    df = spark.createDataFrame([(*r, int(r[0] > 0)) for r in rows], model.SCHEMA + ", c INT")
    run = hotspots_chunked(df, 0, 0.5, chunk_col="c")
    assert {r.row_id: r.fitness for r in run.suppressors.collect()} == {0: 3, 4: 0}


def test_first_match_by_default_nearest_on_request(spark):
    """Three rows, all sampled in turn by pct=100: order is by digest, so look at all options."""
    base = [(0, 0.0, 0.0, 0, "a"), (1, 0.005, 0.0, 0, "a"), (2, 0.003, 0.0, 0, "a")]
    df = spark.createDataFrame(base, model.SCHEMA)
    first = hotspots(df, 0, 0.5).owners.filter("row_id = 2").first()
    nearest = hotspots(df, 0, 0.5, nearest=True).owners.filter("row_id = 2").first()
    assert (first.owner_id, nearest.owner_id) == (0, 1)


@pytest.mark.parametrize("sort_rows", [1, 10_000])
@pytest.mark.parametrize("pct", [0, 1, 33, 100])
def test_sample_is_exact_and_reproducible(incidents, rows, pct, sort_rows):
    cut = find_cut(
        incidents, len(rows), sample_size(len(rows), pct), 3, Sizes(sort_rows=sort_rows)
    )
    sample, rest = model.sample_first(rows, pct, 3)
    drawn = [r.row_id for r in draw_sample(incidents, cut).orderBy("digest", "row_id").collect()]
    assert drawn == [r[0] for r in sample]
    assert {r.row_id for r in without_sample(incidents, cut).collect()} == {r[0] for r in rest}


def test_sample_size_is_rounded_down():
    assert sample_size(1009, 10) == 100
    with pytest.raises(ValueError):
        sample_size(10, 101)


def test_positions_have_no_gaps(incidents, rows, ws):
    got = with_position(incidents.select("row_id", "bearing"), ws, "bearing", "row_id").collect()
    want = sorted((r[3], r[0]) for r in rows)
    assert {r.row_id: r.position for r in got} == {i: n for n, (_, i) in enumerate(want)}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_neither_cross_joins_nor_python(incidents):
    points = to_points(incidents, MatchRule(0.5), "row_id")
    text = plan_of(head_edges(points, MatchRule(0.5)))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Python" not in text and "Pandas" not in text
