"""MinHash near-duplicates by tensored banding, confirmed on the full sets, as components.

Two small collections of bands are made per document, COLLECTION on each side, every band a combination of
WIDTH minhashes. Table keys are all *pairs* of a band of one side and a band of the other: COLLECTION ** 2
tables of 2 * WIDTH minhashes each, from only 2 * COLLECTION * WIDTH minhashes, so that computing them grows
with the square root of the tables. Two sets of similarity s meet in a table with probability
(1 - (1 - s ** WIDTH) ** COLLECTION) ** 2: all but 6 in a million at the bound of 0.85, and all but some one in
ten million at 0.9. A pair meets only if it has a band in common on each side, so bands that no other document has are
dropped before pairs are formed.

Documents that meet are compared in full:
1. equal sets are one node;
2. in STAR_ROUNDS rounds each document is compared with one other of another component it meets in most
   tables, which joins up large groups in few comparisons;
3. tables that still hold several components are settled by *blocks*: all documents with one band in common on the
   first side, in sub-blocks of BLOCK sets, meet in one task per pair of sub-blocks. It counts the common
   shingles of many pairs at once, by products of 0/1 matrices over the shingles that repeat in it, and returns a
   spanning forest of the links it finds. Pairs are never rows, and none that meets in a table is left out.

Definitions
* fewer words than a shingle: the whole sequence is the one shingle; no words or null: n_shingles 0, linked
  with nothing; null ids are linked with nothing, have a null component and are kept;
* the sets of rows that share an id are linked with each other; each row gets its own n_shingles;
* shingles are compared, and equal sets told, by 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.components import components
from incidentlens.llm.tables import bounded_broadcast, map_batches, map_rows, workspace
from incidentlens.llm.words import WordNumbers, mixed, shingle_set, signed

SHINGLE = 3
PERCENT = 85
WIDTH = 2
COLLECTION = 10
STAR_ROUNDS = 2
BLOCK = 512  # sets in a sub-block
PART = 2_048  # sets compared with one star centre in one task
COLUMNS = 4_096  # shingles in one 0/1 matrix

_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, (2 * COLLECTION * WIDTH, 2), dtype=np.uint64)


def alike(overlap: int, n_a: int, n_b: int) -> bool:
    return 100 * overlap >= PERCENT * (n_a + n_b - overlap)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """Band numbers (a row per set, none of them empty; one side's COLLECTION columns, then the other's)."""
    starts = np.cumsum([0, *map(len, sets)][:-1])
    tokens = np.concatenate(sets)
    out = np.zeros((len(sets), 2 * COLLECTION), np.uint64)
    for number, (turn, factor) in enumerate(_SEEDS):
        least = np.minimum.reduceat((tokens ^ turn) * (factor | np.uint64(1)), starts)
        band = number // WIDTH
        # Bands of different places never share numbers, nor do the two orders of one band's minhashes.
        out[:, band] = mixed(out[:, band] * np.uint64(31) + mixed(least) + np.uint64(band + 1))
    return out


def set_number(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node, bands) per row; node: a number of its set."""

    def make():
        known = WordNumbers()

        def run(columns):
            sets = [shingle_set(text, known, SHINGLE) for text in columns["text"]]
            full = [s for s in sets if len(s)]
            made = iter(signed(bands(full)).tolist() if full else ())
            return {
                "doc_id": columns["doc_id"],
                "n": list(map(len, sets)),
                "node": [set_number(s) if len(s) else None for s in sets],
                "bands": [next(made) if len(s) else None for s in sets],
            }

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {kind}, n int, node bigint, bands array<bigint>")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, tokens): sorted shingle numbers, eight bytes each."""

    def make():
        known = WordNumbers()

        def run(columns):
            sets = [shingle_set(t, known, SHINGLE) for t in columns["text"]]
            return {"node": list(map(set_number, sets)), "tokens": [s.tobytes() for s in sets]}

        return run

    return map_batches(docs, make, "node bigint, tokens binary")


def _tables(nodes: DataFrame, ws) -> DataFrame:
    """(key, band, place, node, n): the table keys that several documents have; band: the one of the first side."""
    rows = nodes.select("node", "n", F.posexplode("bands").alias("place", "band"))
    repeated = rows.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("band")
    repeated = ws.save(repeated, "repeated-bands")
    shared = rows.join(bounded_broadcast(repeated.df, repeated.rows, 32), "band")
    sides = shared.groupBy("node", "n").agg(
        F.collect_list(F.when(F.col("place") < COLLECTION, F.struct("place", "band"))).alias("one"),
        F.collect_list(F.when(F.col("place") >= COLLECTION, F.col("band"))).alias("other"),
    )
    pairs = sides.select("node", "n", F.explode("one").alias("one"), "other").select("node", "n", "one.*", F.explode("other").alias("second"))
    keyed = ws.write(pairs.select(F.xxhash64("band", "second").alias("key"), "band", "place", "node", "n"), "tables")
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    met = ws.save(met, "met")
    return ws.write(keyed.join(bounded_broadcast(met.df, met.rows, 32), "key"), "meeting")


def _open(tables: DataFrame, roots: DataFrame | None, ws) -> DataFrame:
    """Rows of the tables with ``root``, of those table keys that several components share."""
    rows = tables.withColumn("root", F.col("node"))
    if roots is not None:
        known = roots.select("node", F.col("root").alias("known"))
        rows = tables.join(known, "node", "left").select(*tables.columns, F.coalesce("known", "node").alias("root"))
    rows = ws.write(rows, "rooted")
    several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    several = ws.save(several.select("key"), "open-keys")
    return ws.write(rows.join(bounded_broadcast(several.df, several.rows, 32), "key"), "open")


_SIZES_FIT = f"100L * least(l.n, r.n) >= {PERCENT}L * greatest(l.n, r.n)"


def _stars(rows: DataFrame, number: int) -> DataFrame:
    """(a, b): for each node b the a of another component that it meets in most tables, as one of them chose."""
    centres = rows.groupBy("key").agg(
        F.min_by(F.struct("node", "n", "root"), F.struct(F.xxhash64("root", F.lit(number)), "node")).alias("centre")
    )
    met = (
        rows.alias("l")
        .join(centres.select("key", "centre.*").alias("r"), "key")
        .filter(f"l.root <> r.root AND {_SIZES_FIT}")
        .groupBy(F.col("l.node").alias("b"), F.col("r.node").alias("a"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    return met.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Common numbers of two sorted sets, neither empty."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def _star_links(pairs, sets: DataFrame, ws) -> DataFrame:
    """(u, v) of the star pairs that are alike; a centre with many documents is dealt over several tasks."""
    counted = pairs.df.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    counted = ws.save(counted.select("a", F.ceil(F.col("members") / PART).cast("int").alias("parts")), "centres")
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    members = pairs.df.join(bounded_broadcast(counted.df, counted.rows, 32), "a").select("a", part.alias("part"), F.col("b").alias("node"))
    centres = counted.df.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"))
    both = centres.withColumn("side", F.lit(0)).unionByName(members.withColumn("side", F.lit(1)))
    dealt = both.join(sets, "node").repartition("a", "part").sortWithinPartitions("a", "part", "side", "node")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        centre, at = None, None
        for a, _, side, doc, tokens in rows:
            tokens = np.frombuffer(tokens, np.uint64)
            if not side:
                centre, at = tokens, a
            elif a == at and alike(_common(centre, tokens), len(centre), len(tokens)):
                yield a, doc

    return ws.write(map_rows(dealt, ["a", "part", "side", "node", "tokens"], run, "u bigint, v bigint"), "star-links")


class Forest:
    """Which documents of a block are linked already."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(above, above)
        return x

    def link(self, x: int, y: int) -> bool:
        """Whether the two were not linked before."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common tokens of every pair of a left and a right set, by 0/1 matrices over the tokens both sides hold."""
    out = np.zeros((len(left), len(right)), np.float32)
    one, two = np.concatenate(left), np.concatenate(right)
    columns = np.intersect1d(one, two)
    if not len(columns):
        return out
    owners = [np.repeat(np.arange(len(s)), [len(t) for t in s]) for s in (left, right)]
    places = []
    for tokens, owner in zip((one, two), owners):
        at = np.minimum(np.searchsorted(columns, tokens), len(columns) - 1)
        hit = columns[at] == tokens
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], owner[hit][order]))
    for start in range(0, len(columns), COLUMNS):
        part = []
        for (at, owner), rows in zip(places, (len(left), len(right))):
            low, high = np.searchsorted(at, [start, start + COLUMNS])
            matrix = np.zeros((rows, COLUMNS), np.float32)
            matrix[owner[low:high], at[low:high] - start] = 1
            part.append(matrix)
        out += part[0] @ part[1].T
    return out


def block_links(place: int, left: list[tuple], right: list[tuple] | None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between two sub-blocks (or within one) with the band ``place`` in common.

    Members are (doc, root, bands, tokens). A pair is looked at where it meets in a table, at the first band of
    the first side that it shares, and if it is not linked by now.
    """
    within = right is None
    right = left if within else right
    docs = [np.array([m[0] for m in side], np.int64) for side in (left, right)]
    roots = [np.array([m[1] for m in side], np.int64) for side in (left, right)]
    sides = [np.array([m[2] for m in side], np.int64) for side in (left, right)]
    sizes = [np.array([len(m[3]) for m in side], np.int64) for side in (left, right)]
    wanted = roots[0][:, None] != roots[1]
    if within:
        wanted &= docs[0][:, None] < docs[1]
    low = np.minimum(sizes[0][:, None], sizes[1])
    wanted &= 100 * low >= PERCENT * np.maximum(sizes[0][:, None], sizes[1])
    for earlier in range(place):
        wanted &= sides[0][:, None, earlier] != sides[1][:, earlier]
    meets = np.zeros_like(wanted)
    for number in range(COLLECTION, 2 * COLLECTION):
        meets |= sides[0][:, None, number] == sides[1][:, number]
    rows, columns = np.nonzero(wanted & meets)
    if len(rows) > 4 * (len(left) + len(right)):
        counts = _overlaps([m[3] for m in left], [m[3] for m in right])
        overlap = counts[rows, columns].astype(np.int64)
        union = sizes[0][rows] + sizes[1][columns] - overlap
        good = 100 * overlap >= PERCENT * union
        links = zip(rows[good].tolist(), columns[good].tolist())
    else:
        links = (
            (i, j) for i, j in zip(rows.tolist(), columns.tolist())
            if alike(_common(left[i][3], right[j][3]), len(left[i][3]), len(right[j][3]))
        )
    forest = Forest()
    for i, j in links:
        if forest.link(int(roots[0][i]), int(roots[1][j])):
            yield int(docs[0][i]), int(docs[1][j])


def _block_links(rows: DataFrame, nodes: DataFrame, sets: DataFrame, ws) -> DataFrame:
    """(u, v): links between components that share a table, as a spanning forest per pair of sub-blocks."""
    members = ws.write(rows.select("band", "place", "node", "root").distinct(), "block-members")
    counted = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("subs"))
    counted = ws.save(counted, "blocks")
    placed = members.join(bounded_broadcast(counted.df, counted.rows, 32), "band")
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int"))
    cells = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select(
        "band", "place", "node", "root", "sub", F.least("sub", "with").alias("x"), F.greatest("sub", "with").alias("y")
    )
    full = cells.join(nodes.select("node", "bands").join(sets, "node"), "node")
    names = ["band", "x", "y", "place", "sub", "node", "root", "bands", "tokens"]
    dealt = full.select(*names).repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "sub", "node")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (_, x, y), group in groupby(rows, key=lambda row: row[:3]):
            sides: tuple[list, list] = ([], [])
            for _, _, _, place, sub, doc, root, numbers, tokens in group:
                sides[sub != x].append((doc, root, numbers, np.frombuffer(tokens, np.uint64)))
            if sides[0] and (x == y or sides[1]):
                yield from block_links(place, sides[0], None if x == y else sides[1])

    return ws.write(map_rows(dealt, names, run, "u bigint, v bigint"), "block-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` (the smallest id of its component) per row."""
    ws = workspace(docs)
    scan = ws.write(_scan(docs), "scan")
    marked = scan.filter("doc_id IS NOT NULL AND node IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc"), "n", "node", "bands")
    # A node is a set; one document, the first, stands for it.
    nodes = ws.write(marked.groupBy("node").agg(F.min("doc").alias("head"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    shared = ws.save(marked.groupBy("doc").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("u")).filter("rows > 1"), "shared-ids")

    tables = _tables(nodes, ws)
    involved = tables.select("node").distinct().join(nodes.select("node", "head"), "node").select(F.col("head").alias("doc_id")).distinct()
    involved = ws.save(involved, "involved")
    texts = docs.join(bounded_broadcast(involved.df, involved.rows, 32), "doc_id", "left_semi").select("text")
    sets = ws.write(_sets(texts), "sets")
    if shared.rows:  # texts that stand on several rows with one id
        sets = ws.write(sets.dropDuplicates(["node"]), "sets")
        links = [marked.join(shared.df, "doc").select("u", F.col("node").alias("v")).filter("u <> v").distinct()]
        links = [ws.write(links[0], "shared-links")]
    else:
        links = []

    roots, rows = _roots(links, ws), tables
    for number in range(STAR_ROUNDS):
        rows = _open(rows.select(*tables.columns), roots, ws)
        pairs = ws.save(_stars(rows, number), "stars")
        if not pairs.rows:
            break
        links.append(_star_links(pairs, sets, ws))
        roots = _roots(links, ws)
    rows = _open(rows.select(*tables.columns), roots, ws)
    links.append(_block_links(rows, nodes, sets, ws))
    roots = _roots(links, ws)

    rooted = nodes.select("node", "head").join(roots, "node", "left").select("node", "head", F.coalesce("root", "node").alias("root"))
    rooted = ws.write(rooted, "rooted-nodes")
    least = rooted.groupBy("root").agg(F.min("head").alias("component"))
    found = ws.write(rooted.join(least, "root").select("node", "component"), "found")
    kind = docs.schema["doc_id"].dataType
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component").cast(kind), F.col("doc_id")))
    out = scan.select("doc_id", "n", "node").join(found, "node", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id")
    )
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))


def _roots(links: list[DataFrame], ws) -> DataFrame | None:
    return components(reduce(DataFrame.unionByName, links), ws) if links else None
