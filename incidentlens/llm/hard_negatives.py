"""Hard negatives for contrastive training: per anchor and positive, the best rows of another label whose score
lies in a window below the positive's.

Scores are integer inner products. Anchors and candidates meet in a grid of cells, every anchor of a block with
every candidate of a block, once to find the positives and once more for the negatives, whose windows hang on
them. In a cell both sides are cut into tiles, padded with zeros, and multiplied by *Strassen's recursion* on int64:
seven products of half the size instead of eight. All additions are exact modulo 2**64, so the scores are exact.
What a tile contributes goes into *heaps* of fixed size per anchor (positives) or anchor and positive (windows).
Heaps of equal bounds merge into one by keeping the best, within a cell and then across cells in Spark.

Both sides of a cell are bounded: candidates are dealt evenly whatever their values, a cell holds one block of
anchors and streams its candidates. The driver sees counts only.

Definitions
* a row without id, label or vector, or with a null, NaN or infinite component takes no part; nor does one
  whose components, scaled, have a sum of squares above 4e18, as its scores need not fit a BIGINT;
* component x counts as floor(256 * x) in double precision; a shorter vector is taken as filled up with zeros;
* order: higher scores first, then smaller ids. Positives have the anchor's label and another id;
* repeated rows count each for itself as candidates, and once as an anchor; anchors that share an id but
  differ otherwise are anchors of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.llm.tables import arrow_schema, map_arrow, mixed_partitions, workspace

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # the window, in percent of the positive's score
SCALE = 256
BLOCK = 1 << 16  # anchors, and candidates, in one cell
LEAST_BLOCK = 1 << 10  # small tables are dealt over all tasks, in blocks no smaller than this
TILE = 512
LEAF = 16  # products with a side of at most this length are taken directly
NORM = 4e18
LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices, exact modulo 2**64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    p, q, r = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:p, :q], a[:p, q:], a[p:, :q], a[p:, q:]
    b11, b12, b21, b22 = b[:q, :r], b[:q, r:], b[q:, :r], b[q:, r:]
    m1 = strassen(a11 + a22, b11 + b22)
    m2 = strassen(a21 + a22, b11)
    m3 = strassen(a11, b12 - b22)
    m4 = strassen(a22, b21 - b11)
    m5 = strassen(a11 + a12, b22)
    m6 = strassen(a21 - a11, b11 + b12)
    m7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * p, 2 * r), np.int64)
    out[:p, :r] = m1 + m4 - m5 + m7
    out[:p, r:] = m3 + m5
    out[p:, :r] = m2 + m4
    out[p:, r:] = m1 - m2 + m3 + m6
    return out[:m, :n]


def quantized(vectors: pa.Array) -> np.ndarray:
    """floor(256 * x) of lists of numbers, as rows filled up with zeros."""
    lengths = vectors.value_lengths().to_numpy()
    flat = np.floor(vectors.flatten().to_numpy().astype(np.float64) * SCALE).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


class Heaps:
    """The best ``size`` entries (score, id) of each of ``owners``, higher scores and then smaller ids first."""

    def __init__(self, owners: int, size: int):
        self.size = size
        self.owner = self.score = self.id = np.zeros(0, np.int64)
        self.floor = np.full(owners, LEAST)  # what an entry has to reach, as of the last merge
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def offer(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(owner):
            self.waiting.append((owner, score, ids))
            self.held += len(owner)
            if self.held > max(len(self.owner), 1 << 15):
                self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        parts = [(self.owner, self.score, self.id), *self.waiting]
        owner, score, ids = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
        best = place < self.size
        last = place == self.size - 1
        self.floor[owner[last]] = score[last]
        self.owner, self.score, self.id = owner[best], score[best], ids[best]
        self.waiting, self.held = [], 0


class PositiveSearch:
    """Rows of an anchor's label with another id."""

    def __init__(self, anchors: dict[str, np.ndarray], size: int):
        self.anchors, self.heaps = anchors, Heaps(len(anchors["key"]), size)

    def tile(self, at: slice, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> None:
        good = self.anchors["label"][at, None] == labels
        good &= (self.anchors["id"][at, None] != ids) & (scores >= self.heaps.floor[at, None])
        rows, columns = np.nonzero(good)
        self.heaps.offer(rows + at.start, scores[rows, columns], ids[columns])

    def found(self) -> dict[str, np.ndarray]:
        self.heaps.merge()
        h = self.heaps
        return {"key": self.anchors["key"][h.owner], "place": np.zeros(len(h.owner), np.int32), "score": h.score, "id": h.id}


class WindowSearch:
    """Rows of another label with a score in the window of each of an anchor's positives."""

    def __init__(self, anchors: dict[str, np.ndarray], size: int, low: int, high: int):
        self.anchors = anchors
        places = anchors["positives"]  # scores, a row per anchor, LEAST where there are no more
        self.width = places.shape[1]
        whole, part = places // 100, places % 100  # no product leaves 64 bits this way
        absent = places == LEAST
        self.low = np.where(absent, 1, low * whole - (-low * part) // 100)
        self.high = np.where(absent, 0, high * whole + high * part // 100)
        self.heaps = Heaps(places.size, size)

    def tile(self, at: slice, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> None:
        other = self.anchors["label"][at, None] != labels
        floor = self.heaps.floor.reshape(-1, self.width)
        for place in range(self.width):
            least = np.maximum(self.low[at, place], floor[at, place])
            rows, columns = np.nonzero(other & (scores >= least[:, None]) & (scores <= self.high[at, place, None]))
            self.heaps.offer((rows + at.start) * self.width + place, scores[rows, columns], ids[columns])

    def found(self) -> dict[str, np.ndarray]:
        self.heaps.merge()
        h = self.heaps
        row, place = np.divmod(h.owner, max(self.width, 1))
        return {"key": self.anchors["key"][row], "place": place.astype(np.int32), "score": h.score, "id": h.id}


def _padded(lists: pa.Array) -> np.ndarray:
    lengths = lists.value_lengths().to_numpy()
    out = np.full((len(lengths), int(lengths.max(initial=0))), LEAST)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _join_columns(parts: list[np.ndarray], fill: int = 0) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1])), constant_values=fill) for p in parts])


class Cell:
    """One block of anchors, gathered first, and the candidates that stream past it."""

    def __init__(self, search: Callable):
        self.search, self.parts, self.anchors = search, [], None

    def add_anchors(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def add_candidates(self, batch: pa.RecordBatch) -> None:
        if not self.parts:
            return
        if self.anchors is None:
            self.vectors = _join_columns([quantized(p.column("v")) for p in self.parts])
            columns = {n: np.concatenate([p.column(n).to_numpy() for p in self.parts]) for n in ("key", "id", "label")}
            columns["positives"] = _join_columns([_padded(p.column("positives")) for p in self.parts], LEAST)
            self.anchors = self.search(columns)
        labels, ids = batch.column("label").to_numpy(), batch.column("id").to_numpy()
        for start in range(0, batch.num_rows, TILE):
            tile = quantized(batch.column("v").slice(start, TILE))
            width = max(tile.shape[1], self.vectors.shape[1])
            right = np.pad(tile, ((0, 0), (0, width - tile.shape[1]))).T
            for top in range(0, len(self.vectors), TILE):
                left = self.vectors[top : top + TILE]
                left = np.pad(left, ((0, 0), (0, width - left.shape[1])))
                at, part = slice(top, top + len(left)), slice(start, start + len(tile))
                self.anchors.tile(at, strassen(left, right), labels[part], ids[part])

    def found(self) -> dict[str, np.ndarray] | None:
        return None if self.anchors is None else self.anchors.found()


FOUND = "key bigint, place int, score bigint, id bigint"


def _meet(anchors: DataFrame, n_anchors: int, rows: DataFrame, n_rows: int, search: Callable) -> DataFrame:
    """The heaps (FOUND) of all cells; ``anchors``: key, id, label, v, positives; ``rows``: id, label, v."""
    tasks = mixed_partitions(rows)
    down = max(1, -(-n_anchors // BLOCK))
    across = max(-(-n_rows // BLOCK), min(tasks, -(-n_rows // LEAST_BLOCK)), 1)

    def cells(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Dealt by position in the input, so that equal rows and ids spread like any other.
    left = anchors.withColumn("a", F.pmod("key", F.lit(down)).cast("int")).withColumn("c", cells(across)).withColumn("side", F.lit(0))
    right = rows.withColumn("c", F.pmod(F.monotonically_increasing_id(), F.lit(across)).cast("int"))
    right = right.withColumn("a", cells(down)).withColumn("side", F.lit(1))
    names = ["a", "c", "side", "key", "id", "label", "positives", "v"]
    nothing = F.array().cast("array<bigint>")
    both = left.select(*names).unionByName(
        right.withColumn("key", F.lit(None).cast("bigint")).withColumn("positives", nothing).select(*names)
    )
    dealt = both.repartition(F.col("a"), F.col("c")).sortWithinPartitions("a", "c", "side")
    schema = arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, here = None, None
        for batch in batches:
            marks = np.stack([batch.column(n).to_numpy() for n in ("a", "c", "side")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == end:
                    continue
                at, side = (marks[0, start], marks[1, start]), marks[2, start]
                if at != here:
                    if cell is not None and (out := cell.found()):
                        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
                    cell, here = Cell(search), at
                part = batch.slice(start, end - start)
                cell.add_candidates(part) if side else cell.add_anchors(part)
        if cell is not None and (out := cell.found()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return map_arrow(dealt, run, FOUND)


def _best(found: DataFrame, size: int) -> DataFrame:
    """The heaps of all cells merged: (key, place, score, id, rank)."""
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.lit(float(SCALE**2)) * x * x)
    kind = rows.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    named = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), vector.alias("v"))
    present = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    return named.filter(F.when(present & F.coalesce(whole, F.lit(False)), squares < NORM).otherwise(F.lit(False)))


def mine(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``. ``positives`` rows of its label are found per anchor, and for
    each of them ``negatives`` rows of other labels with low * positive_score <= 100 * score <= high * positive_score.
    """
    ws = workspace(rows)
    all_rows = usable(rows, id_col, label_col, vector_col)
    n_rows = all_rows.count()
    distinct = all_rows.filter(is_anchor).distinct()
    anchors = ws.save(distinct.withColumn("key", F.monotonically_increasing_id()), "anchors")
    nothing = F.array().cast("array<bigint>")
    met = _meet(
        anchors.df.withColumn("positives", nothing), anchors.rows, all_rows, n_rows, lambda a: PositiveSearch(a, positives)
    )
    best = ws.write(_best(met, positives).select("key", F.col("rank").alias("nth"), "score", "id"), "positives")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("nth", "score"))), lambda s: s.score)
    listed = best.groupBy("key").agg(scores.alias("positives"))
    chosen = ws.save(anchors.df.join(listed, "key"), "anchors-with-positives")
    met = _meet(chosen.df, chosen.rows, all_rows, n_rows, lambda a: WindowSearch(a, negatives, low, high))
    mined = _best(met, negatives).select("key", (F.col("place") + 1).alias("nth"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    mined = ws.write(mined, "negatives")
    named = best.withColumnsRenamed({"id": "positive_id", "score": "positive_score"})
    return (
        mined.join(named, ["key", "nth"])
        .join(anchors.df.select("key", F.col("id").alias("anchor_id")), "key")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
