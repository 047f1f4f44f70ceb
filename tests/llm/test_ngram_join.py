"""The second order, blocks and families of the n-gram join, and what they write."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from tests.llm import brute

from incidentlens.llm import ngram_join, tables
from incidentlens.workspace import Workspace


def edited(rng, words, share):
    return [f"{rng.randrange(10**6)}x" if rng.random() < share else w for w in words]


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("calm,block", [(1, 8), (2, 3)])
def test_groups_around_the_bound(spark, monkeypatch, calm, block):
    """With small sizes everything goes through the second order, families and blocks."""
    monkeypatch.setattr(ngram_join, "CALM", calm)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(calm)
    texts = []
    for share in (0.01, 0.015, 0.02, 0.025, 0.03, 0.04):
        base = [f"w{rng.randrange(400)}" for _ in range(100)]
        texts += [" ".join(edited(rng, base, share)[: rng.randrange(85, 101)]) for _ in range(14)]
    line = " ".join(f"shared{i}" for i in range(30))
    texts += [f"{line} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 60))) for _ in range(20)]
    rows = list(enumerate(texts))
    rows += [(2, texts[50]), (2, texts[50]), (300, texts[1]), (None, texts[2]), (301, None), (302, "two words"), (303, "two words")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(ngram_join.similar_components(df)) == Counter(brute.components(rows))


@pytest.mark.parametrize("marks", [1 << 26, 1 << 4])
def test_large_tables_are_not_broadcast(spark, monkeypatch, marks):
    """With a bitmap instead, and with one that is too small to tell much, the results are the same."""
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(tables, "MARKS", marks)
    rng = random.Random(marks)
    ids = list(range(-40, 200, 3))
    df = spark.createDataFrame([(i, f"t{i}") for i in range(-100, 300)] + [(None, "null"), (5, "again")], "doc bigint, text string")
    few = spark.createDataFrame([(i, -i) for i in ids], "doc bigint, other bigint")
    for how in ("inner", "left_semi", "left_anti"):
        got = tables.narrow_join(df, few, len(ids), 32, "doc", how)
        want = df.join(few, "doc", how)
        assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    base = [f"w{rng.randrange(400)}" for _ in range(100)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.03])))) for i in range(40)] + [(3, "other words"), (None, "x"), (90, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(ngram_join.similar_components(df)) == Counter(brute.components(rows))


def test_shuffles_grow_with_the_input(spark, monkeypatch):
    """No text is dealt out but for comparisons, and once for each, whether tables are small enough to be broadcast or not."""
    dealt = []
    map_rows = ngram_join.map_rows
    monkeypatch.setattr(ngram_join, "map_rows", lambda df, *more: (dealt.append(df), map_rows(df, *more))[1])
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(100)]
    rows = [(i, " ".join(edited(rng, base, 0.01))) for i in range(30)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ngram_join.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in dealt if "side" in df.columns]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plans and all("SortMergeJoin" not in plan and plan.count("REPARTITION_BY_COL") == 1 for plan in plans)


def test_templates_write_rows_in_proportion(spark, monkeypatch):
    """Texts that share a template without being linked: twice as many write some twice as many rows."""
    written = {}
    for n in (100, 200):
        rng = random.Random(n)
        base = [f"w{i}" for i in range(200)]
        texts = [(i, " ".join(edited(rng, base, 0.045))) for i in range(n)]
        rows, write = [0], Workspace.write
        monkeypatch.setattr(Workspace, "write", lambda self, df, name: (t := write(self, df, name), rows.__setitem__(0, rows[0] + t.count()))[0])
        df = ngram_join.similar_components(spark.createDataFrame(texts, "doc_id bigint, text string"))
        assert df.filter("doc_id = component_id").count() > n / 2
        monkeypatch.setattr(Workspace, "write", write)
        written[n] = rows[0]
    assert written[200] < 2.6 * written[100]


@pytest.mark.parametrize("room", [64 << 20, 5_000])
def test_walk(monkeypatch, room):
    monkeypatch.setattr(ngram_join, "WALK_BYTES", room)
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(1 << 40, 400, replace=False)).astype(np.uint64)

    def member(doc):
        kept = base[rng.random(400) < rng.choice([0.8, 0.9, 0.95])]
        more = rng.integers(1 << 41, 1 << 50, rng.integers(0, 60), dtype=np.uint64)
        return doc, doc, 0, np.unique(np.r_[kept, more])

    left, right = [member(i) for i in range(40)], [member(100 + i) for i in range(30)]
    alike = lambda a, b: ngram_join.alike(len(np.intersect1d(a[3], b[3])), len(a[3]), len(b[3]))
    for one, two in ((left, right), (left, None)):
        pairs = [(a[0], b[0]) for a in one for b in (two or one) if a[0] < b[0] and alike(a, b)]
        links = list(ngram_join.block_links(one, two))
        assert set(links) <= set(pairs) and 5 < len(links) < len(one) + len(two or ())
        forests = [ngram_join.Forest(), ngram_join.Forest()]
        for forest, edges in zip(forests, (pairs, links)):
            for a, b in edges:
                forest.link(a, b)
        assert all(forests[0].find(m[0]) == forests[1].find(m[0]) for m in one + (two or []))
