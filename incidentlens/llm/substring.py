"""Substring deduplication on a compacted de Bruijn graph of words.

Edges are runs of EDGE words. Of the edges in each window of WINDOW words the one with the smallest
number (the leftmost on ties) is its anchor, so equal windows have equal anchors. Neighbouring windows
with the same anchor are one *path piece*: a nonbranching stretch of the graph, kept as one row
(edge, path, document, place), where ``path`` numbers all words of its windows.

1. Edges that occur once are dropped by a count and a join; what is left can repeat.
2. Pieces with the same edge and path are compacted: the one with the smallest source coordinates
   (document, place) stays, the windows of all others start earlier elsewhere.
3. An edge with one path only is done. Where paths branch at an edge, the windows of each path's first
   piece are compared window by window, again by smallest coordinates.
4. Texts with anything to remove are read again and cut; each coordinate is checked against the text.

Copies of whole texts are set apart first, so that a large group of copies costs one row each. Rows with equal
id and text are read once and counted; what is to be removed is listed per id and text, so that a list is
bounded by one text however many rows share an id or have none.

Definitions
* order: smaller ``doc_id`` first, a null id before all others; then earlier start;
* rows that share an id count as the same document: at the same place neither removes the other's words;
* repeated rows get one result row each; null, empty and short texts (under WINDOW words) lose nothing;
* runs are compared by 64-bit numbers of words and runs.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.tables import bounded_broadcast, map_batches, workspace
from incidentlens.llm.words import Runs, WordNumbers, signed, split_words

WINDOW = 20
EDGE = 8
NO_ID = -(1 << 63)
DROP, CHECK = 0, 1


class Pieces:
    """Path pieces of texts that lie one behind the other in ``numbers``; ``lengths`` are their words.

    ``text`` tells which text a piece is of; its anchor ``place`` and ``first`` and ``last`` window start
    count from the start of that text.
    """

    def __init__(self, numbers: np.ndarray, lengths: list[int]):
        self.runs = Runs(numbers)
        ends = np.cumsum(np.array(lengths, np.int64))
        owner = np.repeat(np.arange(len(ends)), lengths)
        n = max(0, len(numbers) - WINDOW + 1)
        starts = np.flatnonzero(np.arange(n) + WINDOW <= ends[owner[:n]])  # windows inside one text
        if not len(starts):
            self.text = self.place = self.first = self.last = np.zeros(0, np.int64)
            self.edge = self.path = np.zeros(0, np.uint64)
            return
        edges = self.runs.of_length(EDGE)
        views = np.lib.stride_tricks.sliding_window_view(edges, WINDOW - EDGE + 1)[:n]
        anchors = (np.arange(n) + views.argmin(axis=1))[starts]
        # An anchor lies inside the window, so the next text has others.
        breaks = np.flatnonzero(np.diff(anchors)) + 1
        first = starts[np.concatenate([[0], breaks])]
        last = starts[np.concatenate([breaks - 1, [len(starts) - 1]])]
        place = anchors[np.concatenate([[0], breaks])]
        self.edge = edges[place]
        # The offset of the anchor is part of the path: else equal words could be cut differently.
        offset = (place - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        self.path = self.runs.between(first, last + WINDOW) ^ offset
        self.text = owner[first]
        begin = (ends - np.array(lengths, np.int64))[self.text]
        self.place, self.first, self.last = place - begin, first - begin, last - begin


def _pieces(docs: DataFrame) -> DataFrame:
    """(edge, path, doc, key, place) of every piece of every text."""

    def make():
        known = WordNumbers()

        def run(columns):
            words = [split_words(text) for text in columns["text"]]
            lengths = list(map(len, words))
            pieces = Pieces(known.of(list(chain.from_iterable(words))), lengths)
            return {
                "edge": signed(pieces.edge),
                "path": signed(pieces.path),
                "doc": np.array(columns["doc"], np.int64)[pieces.text],
                "key": np.array(columns["key"], np.int64)[pieces.text],
                "place": pieces.place.astype(np.int32),
            }

        return run

    return map_batches(docs.select("doc", "key", "text"), make, "edge bigint, path bigint, doc bigint, key bigint, place int")


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _base(docs: DataFrame) -> DataFrame:
    """Word count and digest of each text as it is."""

    def make():
        def run(columns):
            words = [split_words(text) for text in columns["text"]]
            return {
                "doc_id": columns["doc_id"],
                "doc": columns["doc"],
                "key": columns["key"],
                "text_key": columns["text_key"],
                "n_words": list(map(len, words)),
                "whole_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words],
            }

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, doc bigint, key bigint, text_key binary, n_words bigint, whole_sha256 string"
    return map_batches(docs.select("doc_id", "doc", "key", "text_key", "text"), make, schema)


def _branch_windows(texts: DataFrame) -> DataFrame:
    """(number, doc, key, start) of each window of the pieces that are to be checked."""

    def make():
        known = WordNumbers()

        def run(columns):
            numbers, docs, keys, starts = [], [], [], []
            for doc, own, text, fates in zip(columns["doc"], columns["key"], columns["text"], columns["fates"]):
                checked = {(f["place"], f["path"]) for f in fates if f["fate"] == CHECK}
                if not checked:
                    continue
                words = split_words(text)
                pieces = Pieces(known.of(words), [len(words)])
                windows = pieces.runs.of_length(WINDOW)
                for i, key in enumerate(zip(pieces.place.tolist(), signed(pieces.path).tolist())):
                    if key in checked:
                        at = np.arange(pieces.first[i], pieces.last[i] + 1)
                        numbers.append(windows[at])
                        starts.append(at)
                        docs.append(np.full(len(at), doc, np.int64))
                        keys.append(np.full(len(at), own, np.int64))
            return {
                "number": signed(_joined(numbers, np.uint64)),
                "doc": _joined(docs, np.int64),
                "key": _joined(keys, np.int64),
                "start": _joined(starts, np.int64).astype(np.int32),
            }

        return run

    return map_batches(texts.select("doc", "key", "text", "fates"), make, "number bigint, doc bigint, key bigint, start int")


def _cut(texts: DataFrame) -> DataFrame:
    """Texts without the words of removed windows."""

    def make():
        known = WordNumbers()

        def run(columns):
            out = {"doc_id": columns["doc_id"], "n": columns["n"], "n_words": [], "n_removed": [], "kept_text": []}
            for text, fates, starts in zip(columns["text"], columns["fates"], columns["starts"]):
                words = split_words(text)
                pieces = Pieces(known.of(words), [len(words)])
                gone = np.zeros(len(words) + 1, np.int64)
                dropped = {(f["place"], f["path"]) for f in fates or () if f["fate"] == DROP}
                for i, key in enumerate(zip(pieces.place.tolist(), signed(pieces.path).tolist())):
                    if key in dropped:
                        gone[pieces.first[i]] += 1
                        gone[pieces.last[i] + WINDOW] -= 1
                if starts:
                    windows = signed(pieces.runs.of_length(WINDOW))
                    for s in starts:
                        if s["start"] < len(windows) and windows[s["start"]] == s["number"]:
                            gone[s["start"]] += 1
                            gone[s["start"] + WINDOW] -= 1
                removed = np.cumsum(gone[:-1]) > 0
                kept = [w for w, r in zip(words, removed.tolist()) if not r]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_text"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            return out

        return run

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n bigint, n_words bigint, n_removed bigint, kept_text string"
    return map_batches(texts.select("doc_id", "n", "text", "fates", "starts"), make, schema)


def _once(rows: DataFrame, base: DataFrame, ws) -> DataFrame:
    """Rows with text, those with equal id and text as one row; ``n`` is their number."""
    same = ["doc_id", "doc", "key", "text_key"]
    several = base.filter("text_key IS NOT NULL").groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = ws.save(several.select("doc", "text_key").distinct(), "several")
    names = [*same, "text", F.lit(1).cast("bigint").alias("n")]
    if not several.rows:
        return rows.filter("text_key IS NOT NULL").select(*names)
    known = bounded_broadcast(several.df, several.rows, 64)
    single = rows.filter("text_key IS NOT NULL").join(known, ["doc", "text_key"], "left_anti").select(*names)
    joined = rows.join(known, ["doc", "text_key"], "left_semi").groupBy(*same)
    return single.unionByName(joined.agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words, joined by a space) per
    row, and the ``kept_text`` of texts that lost some words but not all (null for the others)."""
    ws = workspace(docs)
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("key"),
        F.unhex(F.md5("text")).alias("text_key"),
        "text",
    )
    base = ws.save(_base(rows), "base").df
    # Copies of a whole text: all but those with the smallest id lose every window.
    heads = base.filter("text_key IS NOT NULL").groupBy("text_key").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = ws.save(heads.filter("n > 1").drop("n"), "copied").df
    copies = ws.save(
        base.select("doc", "text_key").join(heads, "text_key").filter("doc <> head").select("doc", "text_key").distinct(),
        "copies",
    )
    copied = bounded_broadcast(copies.df, copies.rows, 128)
    first_rows = _once(rows.join(copied, ["doc", "text_key"], "left_anti"), base, ws)

    pieces = ws.write(_pieces(first_rows), "pieces")
    repeated = pieces.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("edge")
    repeated = ws.write(repeated, "repeated-edges")
    shared = ws.save(pieces.join(repeated.hint("merge"), "edge"), "shared-pieces").df
    place = F.struct("doc", "place")
    paths = ws.write(
        shared.groupBy("edge", "path").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")), "paths"
    )
    branches = paths.groupBy("edge").agg((F.count(F.lit(1)) > 1).alias("branching"))
    paths = ws.write(paths.join(branches, "edge").filter("n > 1 OR branching").drop("n"), "judged-paths")
    fate = F.when(place != F.col("head"), DROP).when(F.col("branching"), CHECK)
    fates = (
        shared.join(paths, ["edge", "path"])
        .select("doc", "key", F.struct("place", "path", fate.alias("fate")).alias("fate"))
        .filter("fate.fate IS NOT NULL")
        .groupBy("doc", "key")
        .agg(F.collect_list("fate").alias("fates"))  # at most one per word of the text
    )
    fates = ws.save(fates, "fates")
    wanted = bounded_broadcast(fates.df.select("doc", "key"), fates.rows, 64)
    own = ["doc", "key"]
    texts = ws.write(first_rows.join(wanted, own, "left_semi").join(fates.df, own), "branching-texts")

    windows = ws.write(_branch_windows(texts), "windows")
    heads = windows.groupBy("number").agg(
        F.min(F.struct("doc", "start")).alias("head"), F.count(F.lit(1)).alias("n")
    )
    heads = ws.write(heads.filter("n > 1").drop("n"), "window-heads")
    starts = (
        windows.join(heads, "number")
        .filter(F.struct("doc", "start") != F.col("head"))
        .groupBy("doc", "key")
        .agg(F.collect_list(F.struct("start", "number")).alias("starts"))
    )
    cut = ws.write(_cut(texts.join(ws.write(starts, "starts"), own, "left")), "cut")

    plain = base.join(copied.withColumn("copy", F.lit(True)), ["doc", "text_key"], "left").join(
        wanted.withColumn("read", F.lit(True)), own, "left"
    )
    is_copy = F.coalesce("copy", F.lit(False))
    emptied = is_copy & (F.col("n_words") >= WINDOW)
    untouched = plain.filter(is_copy | F.col("read").isNull()).select(
        "doc_id",
        "n_words",
        F.when(emptied, F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(emptied, hashlib.sha256(b"").hexdigest()).otherwise(F.col("whole_sha256")).alias("kept_sha256"),
        F.lit(None).cast("string").alias("kept_text"),
    )
    changed = cut.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "kept_text"
    )
    return untouched.unionByName(changed)
