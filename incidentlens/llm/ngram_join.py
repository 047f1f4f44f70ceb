"""N-gram Jaccard join: documents whose sets of word shingles are 80 % alike, as components.

Every set is put in one global order. Sets that are alike share a token among the first
n - ceil(0.8 n) + 1 of that order (rare tokens first), so only tokens of these prefixes are joined. What
is compared in full is decided by a *prefix tree join*: the sets to be compared with a probe, frequent
tokens first, form a trie; it is walked in preorder, a path shared with the set before keeps its partial
overlap, and a subtree is left as soon as the overlap and the remaining length cannot reach the bound.

Links are wanted for components, so pairs that are connected already need no comparison:
1. equal sets become one node (the smallest id);
2. in STAR_ROUNDS rounds each document meets one other per round that shares prefix tokens with it but
   is not in its component, which joins up even very large groups of copies in few comparisons;
3. of the other pairs of different components, those that share a prefix token that at most CALM documents
   have there, among as many of their rarest tokens as the overlap they need leaves open, are compared;
4. documents with a token that more have there (*crowded* ones) are put in a second order among themselves, by
   exact counts of all their tokens, which moves what many share out of the prefixes. Again tokens of
   CALM documents or fewer give pairs. The documents of any other token meet in *blocks*: sub-blocks of BLOCK
   sets, one task per pair of them, where one side is a trie that all sets of the other walk together; documents
   that many such tokens connect meet once (a *family*) if that takes fewer copies of their sets. A block
   returns a spanning forest of its links, never pairs, so that rows stay in proportion to documents however
   many of them share a template. No pair is left out: a document that is not crowded meets all its
   partners in step 3, and two crowded ones that are alike share a token of the second order's prefixes.

Tokens that many documents share come late in the order, so that they stay out of prefixes. One pass over
all texts counts them in a table of fixed size (COUNT_SLOTS), whose slots several tokens share; it only
influences the order, and with it what is compared, not the result.

Definitions
* fewer words than a shingle: the whole sequence is the one shingle; no words or null: n_shingles 0,
  linked with nothing; null ids are linked with nothing and have a null component;
* repeated rows and rows that share an id are one node; each row gets its own n_shingles;
* shingles are compared by 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from incidentlens.llm.components import components
from incidentlens.llm.tables import arrow_schema, bounded_broadcast, map_arrow, map_batches, map_rows, narrow_join, pieces, release_shuffles, workspace
from incidentlens.llm.words import Runs, WordNumbers, signed, split_words

SHINGLE = 5
COUNT_SLOTS = 1 << 24
CHUNK = 1 << 16  # slots that travel together
COUNT_DOCS = 1 << 14  # documents counted before the counts are sent on, in 16 bits each
EXACT = 128  # counts below are told apart, higher ones by eighths of a power of two
STAR_ROUNDS = 2
CALM = 16  # a token that more documents have in their prefixes is settled without pairs
BLOCK = 256  # sets in one trie
WALK_BYTES = 64 << 20  # a table of which probes have which tokens
STEP = 128  # tokens looked at between two looks at the bound


def shingles(text: str | None, known: WordNumbers) -> np.ndarray:
    """Sorted distinct shingle numbers of a text, letters A-Z in lower case."""
    numbers = known.of(split_words(text, fold=True))
    if len(numbers) < SHINGLE:
        length = len(numbers)
        return Runs(numbers).of_length(length) if length else np.zeros(0, np.uint64)
    return np.unique(Runs(numbers).of_length(SHINGLE))


def prefix_length(n: int) -> int:
    return n + 4 * n // -5 + 1 if n else 0


def alike(overlap: int, n_a: int, n_b: int) -> bool:
    return 100 * overlap >= 80 * (n_a + n_b - overlap)


def least_overlap(n_a: int, n_b: int) -> int:
    """The smallest overlap of two sets that are alike."""
    return -(-4 * (n_a + n_b) // 9)


class TokenOrder:
    """Frequent tokens first; ties by number. ``weights`` is indexed by the tokens' lowest bits."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def sort(self, tokens: np.ndarray) -> np.ndarray:
        """``tokens``, sorted by number before, in this order."""
        weights = self.weights[(tokens & np.uint64(len(self.weights) - 1)).astype(np.int64)]
        return tokens[np.argsort(255 - weights, kind="stable")]

    def last(self, tokens: np.ndarray, n: int) -> np.ndarray:
        """The last n of ``sort(tokens)``."""
        return self.sort(tokens)[len(tokens) - n :]


def tree_join(probe: np.ndarray, sets: list[tuple[int, np.ndarray]], order: TokenOrder) -> Iterator[int]:
    """Ids of the sets that are alike with the probe (sorted by number)."""
    tree = sorted((order.sort(tokens).astype(">u8").tobytes(), key) for key, tokens in sets)
    before, overlaps = np.zeros(0, ">u8"), np.zeros(1, np.int64)
    for packed, key in tree:
        path = np.frombuffer(packed, ">u8")
        shared = min(len(path), len(before), len(overlaps) - 1)
        different = np.flatnonzero(path[:shared] != before[:shared])
        depth = int(different[0]) if len(different) else shared
        # Partial overlaps of the path shared with the set before are kept.
        overlaps = overlaps[: depth + 1]
        needed = least_overlap(len(probe), len(path))
        while depth < len(path):
            so_far = int(overlaps[-1])
            if so_far + min(len(path) - depth, len(probe) - so_far) < needed:
                break
            part = path[depth : depth + STEP].astype(np.uint64)
            at = np.minimum(np.searchsorted(probe, part), len(probe) - 1)
            overlaps = np.concatenate([overlaps, so_far + np.cumsum(probe[at] == part)])
            depth += len(part)
        before = path
        if depth == len(path) and alike(int(overlaps[-1]), len(probe), len(path)):
            yield key


def _scan(docs: DataFrame) -> DataFrame:
    """kind 0: (doc_id, n, signature) per row; kind 1: (chunk, packed), counts of token slots, compressed."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind int, doc_id {kind}, n bigint, signature binary, chunk int, packed binary"
    arrow = arrow_schema(schema)

    def made(**columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * rows), f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, counted = WordNumbers(), np.zeros(COUNT_SLOTS, np.uint16), 0

        def chunks() -> Iterator[pa.RecordBatch]:
            for chunk, part in enumerate(counts.reshape(-1, CHUNK)):
                if part.any():
                    yield made(kind=[1], chunk=[chunk], packed=[pa.compress(part.tobytes(), "zstd", asbytes=True)])
            counts[:] = 0

        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [shingles(text, known) for text in part.column("text").to_pylist()]
                np.add.at(counts, (np.concatenate(sets) & np.uint64(COUNT_SLOTS - 1)).astype(np.int64), 1)
                counted += len(sets)
                signatures = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield made(kind=[0] * len(sets), doc_id=part.column("doc_id"), n=list(map(len, sets)), signature=signatures)
                if counted >= COUNT_DOCS:
                    yield from chunks()
                    counted = 0
        yield from chunks()

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def _weights(scan: DataFrame) -> np.ndarray:
    """Counts of tokens by slot, in one byte each: an array of fixed size, whatever the input."""
    dealt = scan.filter("kind = 1").select("chunk", "packed").repartition("chunk").sortWithinPartitions("chunk")

    def add(rows: Iterator[tuple]) -> Iterator[tuple]:
        for chunk, same in groupby(rows, key=lambda row: row[0]):
            total = np.zeros(CHUNK, np.int64)
            for _, packed in same:
                total += np.frombuffer(pa.decompress(packed, 2 * CHUNK, "zstd", asbytes=True), np.uint16)
            high = EXACT + 8 * np.log2(np.maximum(total, EXACT) / EXACT)
            yield chunk, np.where(total < EXACT, total, np.minimum(high, 255)).astype(np.uint8).tobytes()

    out = np.zeros(COUNT_SLOTS, np.uint8)
    for row in map_rows(dealt, ["chunk", "packed"], add, "chunk int, weights binary").collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["weights"], np.uint8)
    return out


def _prefixes(docs: DataFrame, shared) -> DataFrame:
    """(token, doc, n, pos): the rarest tokens of each set, as many as its prefix holds, by rarity."""

    def make():
        known, order = WordNumbers(), TokenOrder(shared.value)

        def run(columns):
            sets = [shingles(text, known) for text in columns["text"]]
            parts = [order.last(s, prefix_length(len(s))) for s in sets]
            lengths = [len(p) for p in parts]
            return {
                "token": signed(np.concatenate(parts)),
                "doc": np.repeat(np.array(columns["doc"], np.int64), lengths),
                "n": np.repeat(np.array([len(s) for s in sets], np.int32), lengths),
                "pos": np.concatenate([np.arange(k - 1, -1, -1, dtype=np.int32) for k in lengths]),
            }

        return run

    return map_batches(docs.select("doc", "text"), make, "token bigint, doc bigint, n int, pos int")


def _sets(docs: DataFrame, wanted: DataFrame, rows: int, ws, name: str) -> DataFrame:
    """(doc, tokens): sorted shingle numbers, eight bytes each, of the documents ``wanted`` (column doc)."""

    def make():
        known = WordNumbers()

        def run(columns):
            return {"doc": columns["doc"], "tokens": [shingles(text, known).tobytes() for text in columns["text"]]}

        return run

    texts = narrow_join(docs.select("doc", "text"), wanted, rows, 32, "doc", "left_semi")
    return ws.write(map_batches(texts, make, "doc bigint, tokens binary"), name)


def _compare(pairs, docs: DataFrame, shared, ws) -> DataFrame:
    """(u, v) of the pairs (a, b) that are alike, by tree joins of BLOCK sets with one probe each.

    Texts travel, as they take about half of the bytes of their shingle numbers.
    """
    counted = pairs.df.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    counted = ws.save(counted, "probes")
    block = F.pmod(F.xxhash64("b"), F.col("blocks"))
    members = pairs.df.join(bounded_broadcast(counted.df, counted.rows, 32), "a").select("a", block.alias("block"), F.col("b").alias("doc"))
    probes = counted.df.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.col("a").alias("doc"))
    both = ws.save(probes.withColumn("side", F.lit(0)).unionByName(members.withColumn("side", F.lit(1))), "meeting")
    full = narrow_join(docs.select("doc", "text"), both.df, both.rows, 64, "doc")
    dealt = full.repartition("a", "block").sortWithinPartitions("a", "block", "side", "doc")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        known, order = WordNumbers(), TokenOrder(shared.value)
        for (a, _), group in groupby(rows, key=lambda row: row[:2]):
            probes, sets = [], []

            def links():
                found = {b for probe in probes if len(probe) for b in tree_join(probe, sets, order)}
                sets.clear()
                return [(a, b) for b in sorted(found)]

            for _, _, side, doc, text in group:
                tokens = shingles(text, known)
                if not side:
                    probes.append(tokens)
                    continue
                sets.append((doc, tokens))
                if len(sets) >= 2 * BLOCK:
                    yield from links()
            yield from links()

    return ws.write(map_rows(dealt, ["a", "block", "side", "doc", "text"], run, "u bigint, v bigint"), "links")


def _open_tokens(prefixes: DataFrame, roots: DataFrame, ws, **more: Column) -> DataFrame:
    """Prefix rows (token, doc, n, pos, root) of tokens that more than one component holds; ``more``: see below."""
    known = roots.select(F.col("node").alias("doc"), F.col("root").alias("known"))
    known = bounded_broadcast(known, roots.count(), 32)
    rows = prefixes.join(known, "doc", "left").select("token", "doc", "n", "pos", F.coalesce("known", "doc").alias("root"))
    return ws.write(_of_several(rows, "root", **more), "open")


def _of_several(rows: DataFrame, column: str, **more: Column) -> DataFrame:
    """Rows of tokens with more than one value in a column; one exchange, where a join would need two.

    ``more``: aggregates over a token's rows, as further columns.
    """
    same = Window.partitionBy("token")
    wide = {name: value.over(same) for name, value in more.items()}
    both = rows.withColumns({"low": F.min(column).over(same), "high": F.max(column).over(same), **wide})
    return both.filter("low <> high").drop("low", "high")


def _sizes_fit(n_a: str, n_b: str) -> str:
    return f"5 * least({n_a}, {n_b}) >= 4 * greatest({n_a}, {n_b})"


def _head(number: int) -> Column:
    """Whom the rows of a token meet in a round."""
    return F.min_by(F.struct("doc", "n", "root"), F.struct(F.xxhash64("root", F.lit(number)), "doc"))


def _star_pairs(rows: DataFrame) -> DataFrame:
    """For each document the one of another component that most of its tokens point to, by their ``head``."""
    met = (
        rows.filter(f"root <> head.root AND {_sizes_fit('n', 'head.n')}")
        .groupBy(F.col("doc").alias("b"), F.col("head.doc").alias("a"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    return met.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different components that can be alike.

    With an overlap of o at least, the n_a - o + 1 rarest tokens of one set and the n_b - o + 1 rarest of
    the other have one in common. For sets of equal size that is about a ninth of each, so that frequent
    tokens, at the end of the prefixes, hardly ever bring two documents together.
    """
    least = "ceil(4 * (l.n + r.n) / 9)"
    near = f"l.pos <= l.n - {least} AND r.pos <= r.n - {least}"
    pairs = rows.alias("l").join(rows.alias("r"), "token").filter(
        f"l.doc < r.doc AND l.root <> r.root AND {_sizes_fit('l.n', 'r.n')} AND {near}"
    )
    return pairs.select(F.col("l.doc").alias("a"), F.col("r.doc").alias("b")).distinct()


def _split(rows: DataFrame, ws) -> tuple[DataFrame, DataFrame]:
    """Rows of tokens that CALM documents or fewer have, and the rows of all others."""
    crowded = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > CALM).select("token")
    crowded = ws.save(crowded, "crowded-tokens")
    tokens = bounded_broadcast(crowded.df, crowded.rows, 32)
    return rows.join(tokens, "token", "left_anti"), rows.join(tokens, "token", "left_semi")


def _second_prefixes(crowded: DataFrame, docs: DataFrame, ws) -> DataFrame:
    """(token, doc, n, pos): prefixes of the documents of ``crowded``, in the order of exact counts among them."""
    ids = ws.save(crowded.select("doc").distinct(), "crowded-documents")

    def make():
        known = WordNumbers()

        def run(columns):
            sets = [shingles(text, known) for text in columns["text"]]
            lengths = [len(s) for s in sets]
            numbers = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
            return {
                "token": signed(np.concatenate(sets)),
                "doc": np.repeat(np.array(columns["doc"], np.int64), lengths),
                "n": np.repeat(np.array(lengths, np.int32), lengths),
                "number": np.repeat(signed(np.array(numbers, np.uint64)), lengths),
            }

        return run

    texts = narrow_join(docs.select("doc", "text"), ids.df, ids.rows, 32, "doc", "left_semi")
    tokens = ws.write(map_batches(texts, make, "token bigint, doc bigint, n int, number bigint"), "crowded-sets")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    # Tokens of one document only come first and can be shared with none: their number is all that matters.
    repeated = ws.write(tokens.join(counts, "token"), "repeated-in-crowded")
    own = Window.partitionBy("doc", "number")
    placed = repeated.withColumns({"rank": F.row_number().over(own.orderBy("c", "token")), "held": F.count(F.lit(1)).over(own)})
    placed = placed.withColumn("pos", (F.col("n") - F.col("held") + F.col("rank") - 1).cast("int"))
    return placed.filter("pos <= n - (4 * n + 4) div 5").select("token", "doc", "n", "pos")


class Forest:
    """Which components a block has linked so far."""

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


def walk_together(paths: list[np.ndarray], probes: list[np.ndarray], wanted: np.ndarray) -> Iterator[tuple[int, int]]:
    """(path, probe) of the wanted pairs that are alike; ``wanted``: a row per path, a column per probe.

    The paths, frequent tokens first, form a trie that is walked in preorder by all probes at once: of every
    node on the way the overlaps with all probes are kept, and a path is left where no probe can reach its bound.
    """
    tokens, counts = np.unique(np.concatenate(paths), return_counts=True)
    turns = np.empty(len(tokens), np.int64)
    turns[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    ordered = [np.sort(turns[np.searchsorted(tokens, path)]).astype(">u4") for path in paths]
    # Which probes have a token, by its turn; the last row is for none.
    has = np.zeros((len(tokens), len(probes)), bool)
    for number, probe in enumerate(probes):
        at = np.minimum(np.searchsorted(tokens, probe), len(tokens) - 1)
        has[turns[at[tokens[at] == probe]], number] = True
    sizes = np.array([len(p) for p in probes])
    overlaps = np.zeros((1 + max(len(p) for p in paths), len(probes)), np.int32)
    before, known = np.zeros(0, ">u4"), 0
    for i in sorted(range(len(paths)), key=lambda i: ordered[i].tobytes()):
        path = ordered[i]
        if not wanted[i].any():
            continue
        shared = min(len(path), len(before), known)
        different = np.flatnonzero(path[:shared] != before[:shared])
        depth = int(different[0]) if len(different) else shared
        needed = -(-4 * (len(path) + sizes) // 9)
        before = path
        while depth < len(path):
            so_far = overlaps[depth]
            if not (wanted[i] & (so_far + np.minimum(len(path) - depth, sizes - so_far) >= needed)).any():
                break
            part = path[depth : depth + STEP].astype(np.int64)
            overlaps[depth + 1 : depth + 1 + len(part)] = so_far + np.cumsum(has[part], axis=0, dtype=np.int32)
            depth += len(part)
        known = depth
        if depth == len(path):
            found = overlaps[depth].astype(np.int64)
            for j in np.flatnonzero(wanted[i] & (100 * found >= 80 * (len(path) + sizes - found))).tolist():
                yield i, j


def block_links(left: list[tuple], right: list[tuple] | None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between the sets of two sub-blocks, or within one.

    Members are (doc, root, pos, tokens); pos: the place of the block's token from the end of their order, or 0.
    """
    within = right is None
    right = left if within else right
    docs, roots, places = ([np.array([m[k] for m in side], np.int64) for side in (left, right)] for k in range(3))
    sizes = [np.array([len(m[3]) for m in side], np.int64) for side in (left, right)]
    wanted = roots[0][:, None] != roots[1]
    if within:
        wanted &= docs[0][:, None] < docs[1]
    least = -(-4 * (sizes[0][:, None] + sizes[1]) // 9)
    wanted &= (places[0][:, None] <= sizes[0][:, None] - least) & (places[1] <= sizes[1] - least)
    wanted &= 5 * np.minimum(sizes[0][:, None], sizes[1]) >= 4 * np.maximum(sizes[0][:, None], sizes[1])
    rows, columns = (np.flatnonzero(wanted.any(axis=k)) for k in (1, 0))
    forest = Forest()
    for some in _bounded(rows, sizes[0]):
        paths = [left[i][3] for i in some]
        width = max(1, WALK_BYTES // (5 * sum(map(len, paths))))
        for start in range(0, len(columns), width):
            part = columns[start : start + width]
            for i, j in walk_together(paths, [right[j][3] for j in part], wanted[np.ix_(some, part)]):
                if forest.link(int(roots[0][some[i]]), int(roots[1][part[j]])):
                    yield int(docs[0][some[i]]), int(docs[1][part[j]])


def _bounded(rows: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Lots of rows whose tokens, with one probe at least, fit WALK_BYTES."""
    start, held = 0, 0
    for end, size in enumerate(sizes[rows].tolist()):
        if held and 5 * (held + size) > WALK_BYTES:
            yield rows[start:end]
            start, held = end, 0
        held += size
    if start < len(rows):
        yield rows[start:]


def _grouped(rows: DataFrame, ws) -> DataFrame:
    """(kind, key, doc, n, pos, root): the groups in which documents meet, by token (kind 0) or by family (1).

    A family is what tokens connect. Where it takes fewer copies of sets, all its documents meet once
    instead of token by token; places do not count there.
    """
    heads = rows.groupBy("token").agg(F.min("doc").alias("head"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("subs"))
    headed = ws.write(rows.join(heads, "token"), "headed")
    families = components(headed.select(F.col("head").alias("u"), F.col("doc").alias("v")), ws)
    headed = headed.join(families.select(F.col("node").alias("doc"), F.col("root").alias("family")), "doc")
    headed = ws.write(headed, "families")
    members = headed.select("family", "doc", "n", "root").distinct()
    whole = members.groupBy("family").agg((F.count(F.lit(1)) * F.ceil(F.count(F.lit(1)) / BLOCK)).alias("whole"))
    parts = headed.groupBy("family").agg(F.sum("subs").alias("parts"))
    together = ws.save(whole.join(parts, "family").filter("whole <= parts").select("family"), "together")
    chosen = bounded_broadcast(together.df, together.rows, 32)
    by_family = members.join(chosen, "family").select(F.lit(1).alias("kind"), F.col("family").alias("key"), "doc", "n", F.lit(0).alias("pos"), "root")
    by_token = headed.join(chosen, "family", "left_anti").select(F.lit(0).alias("kind"), F.col("token").alias("key"), "doc", "n", "pos", "root")
    return ws.write(by_family.unionByName(by_token), "groups")


def _block_links(rows: DataFrame, docs: DataFrame, ws) -> DataFrame:
    """(u, v): links between components that share a token, as a spanning forest per pair of sub-blocks."""
    rows = _grouped(rows, ws)
    counted = rows.groupBy("kind", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("subs"))
    counted = ws.save(counted, "blocks")
    placed = rows.join(bounded_broadcast(counted.df, counted.rows, 32), ["kind", "key"])
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("doc"), F.col("subs")).cast("int"))
    cells = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select(
        "kind", "key", "doc", "n", "pos", "root", "sub", F.least("sub", "with").alias("x"), F.greatest("sub", "with").alias("y")
    )
    involved = ws.save(rows.select("doc").distinct(), "involved")
    sets = _sets(docs, involved.df, involved.rows, ws, "sets")
    # An id with several sets has rows for each; their sizes tell them apart, and equal sizes do no harm.
    full = cells.join(sets.withColumn("n", F.expr("int(octet_length(tokens) / 8)")), ["doc", "n"])
    by = ["kind", "key", "x", "y"]
    names = [*by, "sub", "doc", "pos", "root", "tokens"]
    dealt = full.select(*names).repartition(*by).sortWithinPartitions(*by, "sub", "doc")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (_, _, x, y), group in groupby(rows, key=lambda row: row[:4]):
            sides: tuple[list, list] = ([], [])
            for *_, sub, doc, pos, root, tokens in group:
                sides[sub != x].append((doc, root, pos, np.frombuffer(tokens, np.uint64)))
            if sides[0] and (x == y or sides[1]):
                yield from block_links(sides[0], None if x == y else sides[1])

    return ws.write(map_rows(dealt, names, run, "u bigint, v bigint"), "block-links")


def similar_components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` per document row."""
    ws = workspace(docs)
    scan = ws.write(_scan(docs), "scan")
    base = scan.filter("kind = 0").select("doc_id", F.col("doc_id").cast("bigint").alias("doc"), "n", "signature")
    shared = docs.sparkSession.sparkContext.broadcast(_weights(scan))

    marked = base.filter("doc IS NOT NULL AND signature IS NOT NULL")
    heads = ws.write(marked.groupBy("signature").agg(F.min("doc").alias("head")), "heads")
    equal = ws.write(
        marked.join(heads, "signature").select(F.col("head").alias("u"), F.col("doc").alias("v")).filter("u <> v").distinct(),
        "equal-sets",
    )
    # Ids with several different sets stay in, the others are stood for by their head.
    several = marked.groupBy("doc").agg(F.min("signature").alias("x"), F.max("signature").alias("y")).filter("x <> y")
    out = ws.save(equal.select(F.col("v").alias("doc")).join(several.select("doc"), "doc", "left_anti").distinct(), "copies")
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc"), "text")

    # Only what this leaves in has prefixes, so that later steps, which look texts up by them, need not ask again.
    found = ws.write(_prefixes(narrow_join(texts, out.df, out.rows, 64, "doc", "left_anti"), shared), "all-prefixes")
    written = ws.last
    rows = ws.write(_of_several(found, "doc").withColumn("root", F.col("doc")), "prefixes")
    ws.remove(written)
    release_shuffles(docs.sparkSession)

    links, roots, tested = equal, components(equal, ws), None
    for number in range(STAR_ROUNDS):
        rows = _open_tokens(rows.select("token", "doc", "n", "pos"), roots, ws, head=_head(number))
        pairs = ws.save(_star_pairs(rows) if tested is None else _not_in(_star_pairs(rows), tested), "pairs")
        if pairs.rows:
            tested = pairs.df if tested is None else tested.union(pairs.df)
            links = links.union(_compare(pairs, texts, shared, ws))
            roots = components(links, ws)
        release_shuffles(docs.sparkSession)
    calm, crowded = _split(_open_tokens(rows.select("token", "doc", "n", "pos"), roots, ws), ws)
    second = _second_prefixes(crowded, texts, ws)
    second_calm, hot = _split(_open_tokens(second, roots, ws), ws)
    pairs = _all_pairs(calm).union(_all_pairs(second_calm)).distinct()
    pairs = ws.save(pairs if tested is None else _not_in(pairs, tested), "pairs")
    links = links.union(_compare(pairs, texts, shared, ws)).union(_block_links(hot, texts, ws))
    release_shuffles(docs.sparkSession)
    roots = components(links, ws)
    return base.join(roots, base["doc"] == roots["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id")
    )


def _not_in(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    both_ways = tested.union(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both_ways, ["a", "b"], "left_anti")
