"""The compressed match graph against all pairs."""

from __future__ import annotations

import random

import model
import pytest

from incidentlens import MatchRule
from incidentlens.operators.graph import match_graph
from incidentlens.operators.grid import to_points


def graph_of(spark, rows, rule, ws):
    return match_graph(ws.write(to_points(spark.createDataFrame(rows, model.SCHEMA), rule, "row_id"), "points"), rule, ws)


@pytest.mark.parametrize("mileage,limit", [(0.3, 60), (0.3, 100), (0.0, 7), (30_000.0, 181)])
def test_degrees_and_edges(spark, ws, mileage, limit):
    rows = model.random_rows(260, seed=41, roads=2, hot=110)
    rows += [(1000 + i, *rows[5][1:]) for i in range(30)] + [(2000, 89.9999, 0.0, 350, "pole"), (2001, 89.9999, 180.0, 5, "pole")]
    graph = graph_of(spark, rows, MatchRule(mileage, bearing_limit=limit), ws)
    want = {r[0]: sum(model.matches(r, q, mileage, limit) for q in rows) - 1 for r in rows}
    assert {r.row_id: r.degree for r in graph.degrees().collect()} == want


def test_blocks_spell_out_every_match_once(spark, ws):
    rows = model.random_rows(200, seed=42, roads=1, hot=120)
    rule = MatchRule(0.3)
    graph = graph_of(spark, rows, rule, ws)
    named = graph.members.select("loc_key", "level", "box", "row_id")
    spelt = graph.blocks.join(named, ["loc_key", "level", "box"]).join(
        named.withColumnsRenamed({"box": "other", "row_id": "other_id"}), ["loc_key", "level", "other"]
    )
    pairs = [tuple(r) for r in spelt.select("row_id", "other_id").unionByName(graph.edges).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(p[0], q[0]) for p in rows for q in rows if model.matches(p, q, 0.3)}


def test_size_where_rows_pile_up(spark, ws):
    """Ten times the rows within a few yards: a hundred times the matches, but hardly more blocks and edges."""
    rng, sizes = random.Random(5), {}
    for n in (400, 4000):
        rows = [(i, 52 + rng.random() * 2e-5, 1 + rng.random() * 2e-5, i * 31 % 360, "r") for i in range(n)]
        graph = graph_of(spark, rows, MatchRule(0.3), ws)
        matches = graph.degrees().agg({"degree": "sum"}).first()[0]
        sizes[n] = matches, graph.blocks.count() + graph.edges.count()
    assert sizes[4000][0] > 80 * sizes[400][0] and sizes[4000][1] < 10 * sizes[400][1]
    assert sizes[4000][1] < 0.05 * sizes[4000][0]


def test_matches_are_written_in_one_order(spark, ws, monkeypatch):
    """Rows that share ids and places count as often as they come."""
    rows = model.random_rows(200, seed=43, roads=1, hot=60)
    rows += [(7, *rows[3][1:]), (7, *rows[90][1:]), rows[11]]
    written, write = [], type(ws).write

    def counting(self, df, name):
        table = write(self, df, name)
        if name == "edges":
            written.append(table.count())
        return table

    monkeypatch.setattr(type(ws), "write", counting)
    rule = MatchRule(0.3)
    graph = graph_of(spark, rows, rule, ws)
    want = {}
    for r in rows:
        want[r[0]] = want.get(r[0], 0) + sum(model.matches(r, q, 0.3) for q in rows)
    assert {r.row_id: r.degree for r in graph.degrees().collect()} == {k: n - 1 for k, n in want.items()}
    assert sum(written) <= 0.6 * graph.edges.count()
