"""MinHash components against all pairs, and what tables, stars and blocks write."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from tests.llm import brute, fixtures

from incidentlens.llm import minhash, queries
from incidentlens.workspace import Workspace

NAMES = ("doc_id", "n_shingles", "component_id", "kept")


def expected(texts):
    return Counter((d, n, c, d == c) for d, n, c in brute.components(texts, 3, 85))


def found(df):
    return Counter(tuple(row[n] for n in NAMES) for row in df.collect())


def edited(rng, words, share):
    return [f"{rng.randrange(10**6)}x" if rng.random() < share else w for w in words]


def groups(rng):
    """Groups of edited copies of one text around the bound, some of them split up by it."""
    texts = []
    for share in (0.01, 0.02, 0.025, 0.03, 0.05, 0.1):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        texts += [" ".join(edited(rng, base, share)) for _ in range(25)]
    return texts


def test_hard_rows(spark, hard):
    assert found(queries.op12_minhash(spark, hard)) == expected([(row[0], row[1]) for row in fixtures.documents()])


def test_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "PART", 8)
    rng = random.Random(4)
    texts = list(enumerate(groups(rng)))
    texts += [(3, texts[40][1]), (3, "short one"), (900, "short one"), (None, texts[3][1]), (901, "short ONE two"), (902, "short one two")]
    rng.shuffle(texts)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert found(minhash.near_duplicates(df)) == expected(texts)


def test_templates_write_rows_in_proportion(spark, monkeypatch):
    """Texts that share a template without being linked meet in tables, but never become rows in pairs."""
    written = {}
    for n in (100, 200):
        rng = random.Random(n)
        base = [f"w{i}" for i in range(200)]
        texts = [(i, " ".join(edited(rng, base, 0.06))) for i in range(n)]
        rows, save = [0], Workspace.write
        monkeypatch.setattr(Workspace, "write", lambda self, df, name: (t := save(self, df, name), rows.__setitem__(0, rows[0] + t.count()))[0])
        df = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"))
        assert df.filter("kept").count() > n / 2
        monkeypatch.setattr(Workspace, "write", save)
        written[n] = rows[0]
    assert written[200] < 2.5 * written[100]


def test_overlaps_and_bands():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 6_000, rng.integers(1, 5_000)).astype(np.uint64)) for _ in range(9)]
    got = minhash._overlaps(sets[:4], sets[4:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    sets = [s + np.uint64(6_000 * i) for i, s in enumerate(sets)]  # nothing in common
    made = minhash.bands(sets)
    assert made.shape == (9, 2 * minhash.COLLECTION) and len(np.unique(made)) == made.size
    for i, one in enumerate(sets):
        assert np.array_equal(minhash.bands([one])[0], made[i])


def test_share_of_pairs_that_meet():
    """The share of pairs of a given similarity with a table in common follows the formula."""
    rng = np.random.default_rng(2)
    for similarity, size in ((0.5, 300), (0.3, 300)):
        common = round(2 * size * similarity / (1 + similarity))
        met, pairs = 0, 400
        for _ in range(pairs):
            tokens = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
            a, b = tokens[:size], np.r_[tokens[:common], tokens[size:]]
            one, two = minhash.bands([a, b])
            same = one == two
            met += same[: minhash.COLLECTION].any() and same[minhash.COLLECTION :].any()
        want = (1 - (1 - similarity**minhash.WIDTH) ** minhash.COLLECTION) ** 2
        assert abs(met / pairs - want) < 0.1
