"""Hard negatives against a plain search, exact products, and heaps that merge."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from tests.llm import fixtures

from incidentlens.llm import hard_negatives, queries
from incidentlens.llm.hard_negatives import Heaps, strassen


def plain(rows):
    """rows: (vec_id, vector, label) as in the table."""
    usable = []
    for vec, v, label, *_ in rows:
        if vec is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [np.float32(x) for x in v]
        if sum((256.0 * float(x)) ** 2 for x in v) < hard_negatives.NORM:
            usable.append((vec, (label + 1) % 10 if vec % 7 == 0 else label, tuple(math.floor(256 * float(x)) for x in v)))
    out = Counter()
    for anchor, label, v in {row for row in usable if row[0] % 50 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(v, w)), vec, other) for vec, other, w in usable)
        for minus, positive, _ in [s for s in scored if s[2] == label and s[1] != anchor][:5]:
            fit = [s for s in scored if s[2] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus]
            for rank, (score, negative, _) in enumerate(fit[:3], 1):
                out[anchor, positive, rank, negative, -minus, -score] += 1
    return out


def test_hard_rows(spark, hard):
    got = Counter(tuple(r) for r in queries.op13_hard_negatives(spark, hard).collect())
    want = plain(fixtures.embeddings())
    assert got == want and len(want) > 60
    assert any(row[4] < 10_000 for row in want)


def test_many_cells(spark, hard, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 5)
    monkeypatch.setattr(hard_negatives, "TILE", 7)
    got = Counter(tuple(r) for r in queries.op13_hard_negatives(spark, hard).collect())
    assert got == plain(fixtures.embeddings())


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 64), (64, 64, 64), (130, 67, 201), (40, 0, 40), (512, 64, 300)])
def test_strassen(shape):
    rng = np.random.default_rng(sum(shape))
    for top in (300, 1 << 62):
        a = rng.integers(-top, top, shape[:2])
        b = rng.integers(-top, top, shape[1:])
        assert np.array_equal(strassen(a, b), a @ b)  # exact, or modulo 2**64 on both sides


def test_heaps_merge():
    rng = random.Random(3)
    entries = [(rng.randrange(4), rng.randrange(-20, 20), rng.randrange(50)) for _ in range(600)]
    whole, parts = Heaps(4, 5), [Heaps(4, 5) for _ in range(3)]
    for i, entry in enumerate(entries):
        for heaps in (whole, parts[i % 3]):
            heaps.offer(*(np.array([x]) for x in entry))
            if i % 50 == 7:
                heaps.merge()
    merged = Heaps(4, 5)
    for heaps in parts:
        heaps.merge()
        merged.offer(heaps.owner, heaps.score, heaps.id)
    want = [(o, s, i) for owner in range(4) for o, s, i in sorted((e for e in entries if e[0] == owner), key=lambda e: (-e[1], e[2]))[:5]]
    for heaps in (whole, merged):
        heaps.merge()
        assert list(zip(heaps.owner.tolist(), heaps.score.tolist(), heaps.id.tolist())) == want
        assert heaps.floor.tolist() == [want[5 * o + 4][1] for o in range(4)]
