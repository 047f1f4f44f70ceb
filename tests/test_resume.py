"""Runs that are taken up again, and how long their tables live."""

from __future__ import annotations

import os

import model
import pytest

from incidentlens import Workspace, hotspots
from incidentlens.plans import selection


def tables(ws):
    return {name for name in os.listdir(ws.path.removeprefix("file:")) if not name.startswith(".")}


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    rows = model.random_rows(300, seed=51, hot=90)
    path = str(tmp_path / "input")
    spark.createDataFrame(rows, model.SCHEMA).write.parquet(path)
    sample, rest = model.sample_first(rows, 10, 7)
    want = model.greedy(sample + rest, 0.4)
    survivors, calls = selection.greedy_survivors, []

    def stopping(*args):
        calls.append(1)
        if len(calls) == 2:  # the rest, after the sample
            raise RuntimeError("stopped")
        return survivors(*args)

    def run(**more):
        ws = Workspace(spark, str(tmp_path / "work"), name="job")
        return hotspots(spark.read.parquet(path), **({"pct": 10, "mileage": 0.4, "seed": 7} | more), workspace=ws)

    monkeypatch.setattr(selection, "greedy_survivors", stopping)
    with pytest.raises(RuntimeError):
        run()
    monkeypatch.setattr(selection, "greedy_survivors", survivors)
    # Neither the input nor the stages before are read or made again.
    made, step = [], Workspace.step

    def counting(self, name, identity, make):
        return step(self, name, identity, lambda ws: made.append(name) or make(ws))

    monkeypatch.setattr(Workspace, "step", counting)
    done = run()
    assert {r.row_id: r.owner_id for r in done.owners.collect()} == want
    assert made == ["late", "late-owned", "suppressors"]
    made.clear()
    assert run().owners.count() == 300 and not made
    other = run(seed=8)  # other parameters make other tables
    assert made == ["sample-kept", "owned", "late", "late-owned", "suppressors"]
    sample, rest = model.sample_first(rows, 10, 8)
    assert {r.row_id: r.owner_id for r in other.owners.collect()} == model.greedy(sample + rest, 0.4)
    spark.createDataFrame(rows[:200], model.SCHEMA).write.mode("overwrite").parquet(path)
    assert run(seed=8).owners.count() == 200  # and so does another input


def test_only_results_are_kept(spark):
    """When a run has ended, nothing but the results of its steps is left, and closing leaves nothing."""
    rows = spark.createDataFrame(model.random_rows(200, seed=52), model.SCHEMA)
    done = hotspots(rows, 10, 0.4)
    kept = {"step-incidents", "step-sample-kept", "step-owned", "step-late", "step-late-owned", "step-suppressors"}
    found = tables(done.workspace)
    assert kept <= found and all(not os.listdir(os.path.join(done.workspace.path.removeprefix("file:"), n)) for n in found - kept)
    done.workspace.close()
    assert not os.path.exists(done.workspace.path.removeprefix("file:"))
