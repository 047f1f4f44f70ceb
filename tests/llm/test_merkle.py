"""The manifest against a plain tree, for several arities, and what proofs are for."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm import brute, fixtures

from incidentlens.llm import merkle, queries

COLUMNS = "doc_id bigint, lang string, text string"


def digest(*values):
    out = b""
    for v in values:
        data = b"" if v is None else str(v).encode()
        out += b"-" if v is None else f"{len(data)}:".encode() + data
    return brute.sha(out)


def climb(leaves, arity):
    """The top of a tree, and for every leaf its steps (slot, members)."""
    steps = [[] for _ in leaves]
    level, under = list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, over = [], []
        for start in range(0, len(level), arity):
            run = level[start : start + arity]
            for slot, ids in enumerate(under[start : start + arity]):
                for i in ids:
                    steps[i].append((slot, run))
            above.append(brute.sha("".join(run)))
            over.append([i for ids in under[start : start + arity] for i in ids])
        level, under = above, over
    return level[0], steps


def plain(rows, arity):
    """rows: (key, group, leaf, leaf now); yields key, leaf, subroot, root, proof, folded root."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = climb([r[2] for r in groups[g]], arity)
    root, upper = climb([trees[g][0] for g in names], arity)
    for g, more in zip(names, upper):
        for row, steps in zip(groups[g], trees[g][1]):
            proof, node = [], row[3]
            for slot, run in steps + more:
                proof += run[:slot] + run[slot + 1 :]
                node = brute.sha("".join([*run[:slot], node, *run[slot + 1 :]]))
            yield row[0], row[2], trees[g][0], root, brute.sha("".join(proof)), node, node == root


def test_hard_rows(spark, hard):
    rows = []
    for doc, text, lang, source, n, *_ in fixtures.documents():
        odd = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        now = text.translate(brute.AZ) if odd and text is not None else text
        rows.append((doc, lang, digest(doc, source, lang, n, text), digest(doc, source, lang, n, now)))
    got = Counter(tuple(r) for r in queries.op11_merkle(spark, hard).collect())
    assert got == Counter(plain(rows, 8))
    assert {row[-1] for row in got} == {True, False}


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_arities(spark, arity):
    rng = random.Random(arity)
    sizes = {"": 1, "a": arity, "b": arity**2 + 1, "é": 2 * arity**3 - 1, None: 3, "A": arity + 1}
    rows = [(rng.randrange(40), g, f"text {i}") for g, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    found = merkle.manifest(spark.createDataFrame(rows, COLUMNS), ("doc_id", "lang", "text"), "lang", "doc_id", arity)
    out = merkle.verify(found, F.col("leaf")).select(
        "doc_id", merkle.hexed(F.col("leaf")), merkle.hexed(F.col("subroot")), merkle.hexed(F.col("root")),
        F.sha2(F.array_join(F.transform(merkle.proof_digests(F.col("steps")), merkle.hexed), "").cast("binary"), 256),
        merkle.hexed(F.col("folded_root")), "verified",
    )
    want = plain([(k, g, digest(k, g, t), digest(k, g, t)) for k, g, t in rows], arity)
    assert Counter(tuple(r) for r in out.collect()) == Counter(want)


def test_values_do_not_run_together(spark):
    rows = [(1, "a", "bc"), (1, "ab", "c"), (1, None, "-"), (1, "-", None), (11, "", "a")]
    df = spark.createDataFrame(rows, COLUMNS).select(merkle.leaf_digest("doc_id", "lang", "text").alias("leaf"))
    assert df.distinct().count() == len(rows)
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame(rows, COLUMNS), ("text",), "lang", "doc_id", 1)


def test_rows_with_proofs_are_not_joined_again(spark):
    """Rows with whole proofs are wide; what the result needs of the leaves is with them before their proofs are."""
    rows = [(i, f"{i % 3}", f"text {i}") for i in range(100)]
    found = merkle.manifest(spark.createDataFrame(rows, COLUMNS), ("doc_id", "text"), "lang", "doc_id", carry={"size": F.length("text")})
    assert Counter(r.size for r in found.leaves.collect()) == {6: 10, 7: 90}
    plan = found.leaves._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Union") < plan.find("Join")
