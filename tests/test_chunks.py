"""The merge of chunks by acting sources, against the plain merge and by what it writes."""

from __future__ import annotations

import model
import pytest

from incidentlens import MatchRule, Sizes, Workspace
from incidentlens.operators import chunks
from incidentlens.operators.grid import to_points
from incidentlens.plans.selection import thin_chunks

ROUNDS = Sizes(fold_rows=0, fold_work=0)
BOTH = Sizes(fold_rows=12, fold_work=0)  # rounds first, a fold with settled sources at the end
SPLIT = Sizes(fold_rows=0, fold_work=0, split_rows=20)
RULE = MatchRule(0.4)


def local_survivors(spark, rows, number, ws, sizes=Sizes()):
    df = spark.createDataFrame(rows, model.SCHEMA).withColumn("chunk_id", chunks.even_chunks(len(rows), number))
    points = ws.save(to_points(df, RULE, "row_id", "chunk_id"), "points")
    return thin_chunks(points, RULE, ws, sizes)


@pytest.mark.parametrize("number", [3, 40])
def test_merge_equals_pair_by_pair(spark, ws, number):
    """A third of the rows in one place, and as many survivors there as there are chunks."""
    rows = model.random_rows(500, seed=21, roads=2, hot=170)
    local = local_survivors(spark, rows, number, ws)
    want = model.chunked(rows, lambda r: r[0] * number // len(rows), 0, 7, 0.4)
    for sizes in (Sizes(), ROUNDS, BOTH, SPLIT):
        merged = chunks.merge_chunks(local, RULE, ws, sizes=sizes)
        assert {r.row_id: r.fitness for r in merged.collect()} == want


@pytest.mark.parametrize("sizes", [Sizes(), ROUNDS], ids=["fold", "rounds"])
def test_rows_written_do_not_grow_with_matches(spark, ws, monkeypatch, sizes):
    """Matches between chunks are many times the survivors; what is written stays in proportion to these."""
    rows = model.random_rows(1500, seed=22, roads=2, hot=500)
    local = local_survivors(spark, rows, 300, ws)
    matches = chunks.chunk_edges(local.df, RULE).count()
    written, write = [], Workspace.write

    def counting(self, df, name):
        table = write(self, df, name)
        written.append(table.count())
        return table

    monkeypatch.setattr(Workspace, "write", counting)
    chunks.absorptions(local.df, RULE, ws, sizes=sizes)
    assert matches > 5 * local.rows and sum(written) <= (4 if sizes is ROUNDS else 2) * local.rows


def test_a_row_waits_for_the_undecided_row_before_its_source(spark, ws):
    """Chunk 0: a; chunk 1: b near a, and c; chunk 2: d near b and c. a takes b, so that c takes d."""
    rows = [(0, 0.0, 0.0, 0, "r"), (1, 0.002, 0.0, 0, "r"), (2, 0.006, 0.0, 0, "r"), (3, 0.004, 0.0, 0, "r")]
    df = spark.createDataFrame([(*r, c) for r, c in zip(rows, (0, 1, 1, 2))], model.SCHEMA + ", chunk_id BIGINT")
    points = ws.save(to_points(df, RULE, "row_id", "chunk_id"), "points")
    local = thin_chunks(points, RULE, ws)
    for sizes in (Sizes(), ROUNDS):
        merged = chunks.merge_chunks(local, RULE, ws, sizes=sizes)
        assert {r.row_id: r.fitness for r in merged.collect()} == {0: 1, 2: 1}


def test_sources_without_open_rows_are_joined_no_more(spark, ws, monkeypatch):
    """A hundred lonely sources, settled at once, and a chain over chunks that takes a round for two rows."""
    lonely = [(i, 10.0 + i, 0.0, 0, "r", 0) for i in range(100)]
    chain = [(100 + i, 0.002 * i, 0.0, 0, "r", i) for i in range(12)]
    df = spark.createDataFrame(lonely + chain, model.SCHEMA + ", chunk_id BIGINT")
    points = ws.save(to_points(df, RULE, "row_id", "chunk_id"), "points")
    local = thin_chunks(points, RULE, ws)
    joined, match_join = [], chunks.match_join

    def counting(points, anchors, *more, **named):
        joined.append(anchors.count())
        return match_join(points, anchors, *more, **named)

    monkeypatch.setattr(chunks, "match_join", counting)
    merged = chunks.merge_chunks(local, RULE, ws, sizes=ROUNDS)
    left = {r.row_id: r.fitness for r in merged.collect() if r.row_id >= 100}
    assert local.rows == 112 and left == {100 + 2 * i: 1 for i in range(6)}
    assert sum(joined) <= 2 * local.rows
