"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams (MIN_N to MAX_N characters of the lower-cased text) that a text holds, hashed to BUCKETS
numbers: all that MIN_DOCS of the documents learned from hold. Each counts by its log ratio r = ln(P(present | toxic) / P(present | clean)), smoothed by
one document of either kind; a ridge logistic regression over these scaled features gives the score.

The fit is an L-BFGS descent: gradients are summed on the executors, over the sample's bucket lists, written once;
the driver holds vectors of BUCKETS numbers only. Labels are learned from TRAIN_ROWS labelled documents at most, those
with the smallest hash of their id; labels without a document do not count towards that.

Definitions
* null or empty text: no features, the score of the prior; texts are read whole, however long;
* a document labelled several times is toxic if one label says so; null labels are not learned from;
* without labels, or with one class only, the score is the smoothed share of toxic labels;
* of rows that share an id, the one with the smallest hash of its text is learned from;
* repeated document rows give one result row each; rows with null ids are scored, never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.tables import bounded_broadcast, map_batches, map_rows, return_memory, workspace

MIN_N, MAX_N = 3, 6
BUCKETS = 1 << 20
TRAIN_ROWS = 12_000
MIN_DOCS = 5  # n-grams in fewer documents tell nothing about new ones
THRESHOLD = 0.3
RIDGE = 1.0
# The descent ends after this many steps, or when the gradient is this much smaller than at its start.
STEPS, SMALL = 60, 1e-4
MEMORY = 5  # steps that L-BFGS looks back
PARTS = 8  # tasks of a pass over the sample, each of which sends the driver a number per bucket in use
ROW = 1 << 13  # bucket numbers in one row of the sample's lists, or those of one document
# Spark's reader holds what it takes of a row group at a time, 4,096 rows, so that row groups have to be small. Their size
# is looked at every 100 rows.
ROW_GROUP = 1 << 20
SPAN = 1 << 15  # numbers in one row of what a task sends the driver, so that the JVMs handle small arrays only
LOT = 1 << 17  # bucket numbers that a pass counts at a time; it holds several arrays of that length
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIXER = np.uint64(0xD6E8FEB86659FD93)


def ngram_buckets(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's n-grams, one array for each n."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    rolled = points * _MULTIPLIER
    for n in range(2, MAX_N + 1):
        if len(points) < n:
            return
        rolled = (rolled[:-1] + points[n - 1 :]) * _MULTIPLIER
        if n >= MIN_N:
            mixed = (rolled ^ (rolled >> np.uint64(32)) ^ np.uint64(n)) * _MIXER
            yield (mixed >> np.uint64(44)).astype(np.int64)


class Distinct:
    """The different bucket numbers of a text, in order of appearance, without sorting."""

    def __init__(self):
        self.at = np.zeros(BUCKETS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        parts = list(ngram_buckets(text))
        if not parts:
            return np.zeros(0, np.int64)
        numbers = np.concatenate(parts)
        places = np.arange(len(numbers), dtype=np.int32)
        self.at[numbers] = places  # the last place of each
        return numbers[self.at[numbers] == places]


@dataclass(frozen=True)
class Model:
    """A weight per bucket (packed doubles) and the intercept; of fixed size."""

    weights: bytes
    intercept: float

    def scorer(self):
        weights, distinct = np.frombuffer(self.weights), Distinct()

        def score(text: str | None) -> float:
            total = self.intercept + float(weights[distinct(text)].sum())
            return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))

        return score


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled documents whose id is not held out."""
    ws = workspace(docs)
    known = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
    )
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(train_rows)
    chosen = ws.save(chosen, "toxic-labels")
    sample = docs.select("doc_id", "text").join(bounded_broadcast(chosen.df, chosen.rows, 64), "doc_id")
    # One row per id, so that the bound holds for rows.
    sample = sample.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    lists = map_rows(sample.select("toxic", "text"), ["toxic", "text"], _lists, "toxic binary, ends binary, buckets binary")
    lists = ws.write(lists, "toxic-lists", **{"parquet.block.size": ROW_GROUP}).coalesce(PARTS)
    n_clean, n_toxic, held = _counts(lists)
    prior = float(np.log((n_toxic + 1) / (n_clean + 1)))
    if not (n_clean and n_toxic):
        return Model(np.zeros(BUCKETS).tobytes(), prior)
    used = np.flatnonzero(held.sum(axis=0) >= MIN_DOCS).astype(np.int32)  # all others weigh nothing
    held = held[:, used]
    ratios = np.log((held[1] + 1) / (n_toxic + 2)) - np.log((held[0] + 1) / (n_clean + 2))
    rows = n_clean + n_toxic
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean loss with its ridge, and its gradient, at scaled weights and an intercept."""
        total, slope = _pass(lists, shared, ratios * x[:-1], x[-1])
        value = (total + 0.5 * RIDGE * float(x[:-1] @ x[:-1])) / rows
        return value, np.append(ratios * slope[:-1] + RIDGE * x[:-1], slope[-1]) / rows

    found = descend(loss, np.append(np.zeros(len(used)), prior))
    shared.destroy()
    ws.close()
    weights = np.zeros(BUCKETS)
    weights[used] = found[:-1] * ratios
    return Model(weights.tobytes(), float(found[-1]))


def _lists(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Labels, ends and bucket numbers of documents, packed, some ROW numbers in a row."""
    distinct, labels, parts, held = Distinct(), [], [], 0

    def lot() -> tuple:
        ends = np.cumsum([len(p) for p in parts])
        return np.array(labels, np.int8).tobytes(), ends.astype(np.int64).tobytes(), np.concatenate(parts).astype(np.int32).tobytes()

    for toxic, text in rows:
        labels.append(int(toxic > 0))
        parts.append(distinct(text))
        held += len(parts[-1])
        if held >= ROW:
            yield lot()
            labels, parts, held = [], [], 0
    if labels:
        yield lot()


def _unpacked(rows: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, the number of buckets of each document, and the bucket numbers, of some LOT numbers each."""
    parts, held = [], 0
    for toxic, ends, buckets in rows:
        counts = np.diff(np.frombuffer(ends, np.int64), prepend=0)
        parts.append((np.frombuffer(toxic, np.int8), counts, np.frombuffer(buckets, np.int32)))
        held += len(parts[-1][2])
        if held >= LOT:
            yield tuple(map(np.concatenate, zip(*parts)))
            parts, held = [], 0
    if parts:
        yield tuple(map(np.concatenate, zip(*parts)))


def _counts(lists: DataFrame) -> tuple[int, int, np.ndarray]:
    """Clean and toxic documents, and how many of each kind hold a bucket."""

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, kinds = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
        for toxic, counts, buckets in _unpacked(rows):
            kinds += np.bincount(toxic, minlength=2)
            of = np.repeat(toxic, counts)
            for kind in (0, 1):
                held[kind] += np.bincount(buckets[of == kind], minlength=BUCKETS)
        for kind in (0, 1):
            for at in range(0, BUCKETS, SPAN):
                yield kind, at, int(kinds[kind]) if not at else 0, held[kind, at : at + SPAN].tobytes()

    kinds, held = [0, 0], np.zeros((2, BUCKETS), np.int64)
    schema = "kind int, at int, docs bigint, held binary"
    for kind, at, docs, part in map_rows(lists, ["toxic", "ends", "buckets"], count, schema).collect():
        kinds[kind] += docs
        held[kind, at : at + SPAN] += np.frombuffer(part, np.int32)
    return_memory()  # the driver's, of the tasks' counts
    return *kinds, held


def _pass(lists: DataFrame, used, weights: np.ndarray, intercept: float) -> tuple[float, np.ndarray]:
    """Sum of the logistic losses of all documents, and its slope by weight and intercept.

    ``used``: the buckets that the weights belong to, broadcast.
    """
    shared = lists.sparkSession.sparkContext.broadcast(weights)

    def slopes(rows: Iterator[tuple]) -> Iterator[tuple]:
        w, total, slope, shift = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
        w[used.value] = shared.value
        for toxic, counts, buckets in _unpacked(rows):
            at = np.repeat(np.arange(len(counts)), counts)
            z = np.bincount(at, w[buckets], len(counts)) + intercept
            total += float(np.logaddexp(0, np.where(toxic == 1, -z, z)).sum())
            error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic
            slope += np.bincount(buckets, error[at], BUCKETS)
            shift += float(error.sum())
        out = np.append(slope[used.value], shift).astype(np.float32)
        for at in range(0, len(out), SPAN):
            yield at, 0.0 if at else total, out[at : at + SPAN].tobytes()

    total, slope = 0.0, np.zeros(len(weights) + 1)
    for at, part, some in map_rows(lists, ["toxic", "ends", "buckets"], slopes, "at int, total double, slope binary").collect():
        total += part
        slope[at : at + SPAN] += np.frombuffer(some, np.float32)
    shared.destroy()
    return_memory()  # the driver's, of the tasks' slopes
    return total, slope


def descend(loss, x: np.ndarray) -> np.ndarray:
    """The minimum of a convex function, by L-BFGS with halved steps."""
    value, slope = loss(x)
    first, past = np.linalg.norm(slope), []
    for _ in range(STEPS):
        if np.linalg.norm(slope) <= SMALL * first:
            break
        way, shares = slope.copy(), []
        for s, y in reversed(past):
            shares.append((s @ way) / (y @ s))
            way -= shares[-1] * y
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, np.linalg.norm(slope))
        for (s, y), share in zip(past, reversed(shares)):
            way += (share - (y @ way) / (y @ s)) * s
        length, drop = 1.0, float(slope @ way)
        while True:
            there = x - length * way
            new, new_slope = loss(there)
            if new <= value - 1e-4 * length * drop or length < 1e-6:
                break
            length /= 2
        if new >= value:
            break
        step, turn = (there - x).astype(np.float32), (new_slope - slope).astype(np.float32)
        if step @ turn > 0:
            past = [*past[1 - MEMORY :], (step, turn)]
        x, value, slope = there, new, new_slope
    return x


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` per document row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = shared.value.scorer()
        return lambda columns: {
            "doc_id": columns["doc_id"],
            "score": [scorer(text) for text in columns["text"]],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_batches(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
