"""Chunk-wise (approximate) suppression: survivors of each chunk, merged across chunks.

In the merge each survivor absorbs at most one survivor of every higher chunk, the first free
match, and takes over its fitness. Matching survivors can therefore remain; this is how the
chunked mode is defined. The matches between chunks can be listed (``chunk_edges``), but the merge
does without that list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rule import MatchRule
from ..sizes import Sizes
from ..workspace import SavedTable, Workspace
from .fitness import add_fitness
from .grid import GEOMETRY, match_condition, match_join
from .suppress import group_sizes, plain_round


def even_chunks(rows: int, chunks: int) -> Column:
    """Chunk number by position for ``row_id`` 0..rows-1: contiguous, equal up to one row."""
    return F.expr(f"(row_id * {int(chunks)}L) div {int(rows)}L")


def chunk_edges(
    local: DataFrame, rule: MatchRule, crowded: DataFrame | None = None
) -> DataFrame:
    """Matches between survivors of different chunks, from the lower chunk to the higher.

    ``local`` needs ``rank`` in (chunk, order in chunk). The survivors of one chunk do not match
    one another, so a row has a handful of edges per chunk.
    """
    anchors = local.select("rank", "row_id", "chunk_id", *rule.keys, *GEOMETRY, "cell")
    pairs = match_join(local, anchors, rule, "inner", crowded, extra="a_chunk_id < chunk_id")
    return pairs.selectExpr(
        *rule.keys,
        "a_rank AS src",
        "rank AS dst",
        "chunk_id AS dst_chunk",
        "a_row_id AS src_id",
        "row_id AS dst_id",
    )


def _free_pairs(
    points: DataFrame,
    sources: DataFrame,
    taken: DataFrame | None,
    rule: MatchRule,
    crowded: DataFrame | None,
) -> DataFrame:
    """(src, dst, dst_chunk): lower sources each point matches that have not absorbed from its chunk yet."""
    met = match_join(points, sources, rule, "inner", crowded, extra="a_rank < rank")
    pairs = met.selectExpr("a_rank AS src", "rank AS dst", "chunk_id AS dst_chunk")
    if taken is None:
        return pairs
    return pairs.join(taken.select("src", "dst_chunk"), ["src", "dst_chunk"], "left_anti")


def ordered_fold(rows: DataFrame, rule: MatchRule) -> DataFrame:
    """The absorptions (src, dst, dst_chunk), by walking each key group's rows in rank order.

    A row is absorbed by the first source it matches that has not absorbed from its chunk, and
    else becomes a source. ``rows`` carry ``settled`` (a source whatever it matches) and ``used``
    (chunks it has absorbed from). A group becomes one array, so its size must be known to be small.
    """
    fields = ", ".join(["rank", "chunk_id", "settled", "used", *GEOMETRY])
    groups = rows.groupBy(*rule.keys).agg(F.expr(f"array_sort(collect_list(struct({fields}))) AS rows"))
    free = f"{match_condition(rule, 'p.', 'k.')} AND NOT array_contains(k.used, p.chunk_id)"
    first = f"IF(p.settled, NULL, get(filter(s.sources, k -> {free}), 0).rank)"
    marked = """transform(s.sources, k -> IF(k.rank = hit,
        named_struct('rank', k.rank, 'chunk_id', k.chunk_id, 'settled', k.settled,
                     'used', concat(k.used, array(p.chunk_id)), {geometry}), k))"""
    marked = marked.format(geometry=", ".join(f"'{c}', k.{c}" for c in GEOMETRY))
    # The array of one element binds the source found to a name.
    step = f"""transform(array({first}), hit -> named_struct(
        'sources', IF(hit IS NULL, concat(s.sources, array(p)), {marked}),
        'taken', IF(hit IS NULL, s.taken, concat(s.taken, array(
            named_struct('src', hit, 'dst', p.rank, 'dst_chunk', p.chunk_id))))))[0]"""
    nothing = "CAST(array() AS array<struct<src: bigint, dst: bigint, dst_chunk: bigint>>)"
    start = f"named_struct('sources', filter(rows, p -> false), 'taken', {nothing})"
    return groups.selectExpr(f"inline(aggregate(rows, {start}, (s, p) -> {step}).taken)")


def absorptions(
    survivors: DataFrame,
    rule: MatchRule,
    ws: Workspace,
    crowded: DataFrame | None = None,
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """``(src, dst, dst_chunk)``: who absorbs whom if the matches are tried in (src, dst) order.

    A match is taken unless its dst or its src has been absorbed or its src already absorbed a
    row of that chunk. Two matches that exclude each other share a row, and stand in the same order
    by (src, dst) as by (dst, src); so rows can as well be taken in rank order, each going to the first
    source that is free for its chunk. Only survivors that have *acted*, being settled as sources,
    can take a row, and few of them match any one row: it only joins them while all nearer to it are
    busy with its chunk. So the matches between chunks, which grow with their number, are never listed.

    A round settles as sources the rows that no undecided lower row matches and no source is free
    for. Then each source takes the lowest undecided row it matches in every chunk at once, if it is the
    first source free for it and no undecided row before the source matches it.

    What is undecided is joined as it is, not without the rows that have just acted: an acting row has no
    free source, and one before a target's source would be the target's source itself. A source that is
    free for no undecided row never will be again, so only the others go on to the next round.
    """
    columns = ["rank", "row_id", "chunk_id", *rule.keys, *GEOMETRY, "cell"]
    undecided, sources, rounds, paths = survivors.select(*columns), None, [], []
    left, most = group_sizes(undecided, rule)
    while not sizes.foldable(left, most):
        taken = reduce(DataFrame.unionByName, rounds) if rounds else None
        ready = plain_round(undecided, rule, ws, crowded, ("chunk_id",)).select(*columns)
        made = [ws.last]
        if sources is not None:
            ready = ws.write(ready, "ready")
            made.append(ws.last)
            wanted = _free_pairs(ready, sources, taken, rule, crowded).selectExpr("dst AS rank")
            ready = ready.join(wanted.distinct(), "rank", "left_anti")
        acting = ws.write(ready.select(*columns), "acting")
        made.append(ws.last)
        sources = acting if sources is None else sources.unionByName(acting)
        pairs = ws.write(_free_pairs(undecided, sources, taken, rule, crowded), "free")
        made.append(ws.last)
        first_src = pairs.groupBy("dst", "dst_chunk").agg(F.min("src").alias("src"))
        first_dst = pairs.groupBy("src", "dst_chunk").agg(F.min("dst").alias("dst"))
        agreed = first_src.join(first_dst, ["src", "dst", "dst_chunk"])
        targets = undecided.join(agreed.selectExpr("dst AS rank", "src"), "rank")
        waiting = match_join(undecided, targets, rule, "inner", crowded, extra="rank < a_src")
        waiting = waiting.selectExpr("a_rank AS dst").distinct()
        found = agreed.join(waiting, "dst", "left_anti").select("src", "dst", "dst_chunk")
        rounds.append(ws.write(found, "taken"))
        gone = rounds[-1].selectExpr("dst AS rank").unionByName(acting.select("rank"))
        rest = undecided.join(gone, "rank", "left_anti").select(*columns)
        undecided = ws.write(rest, "undecided")
        kept = [ws.last]
        before = left
        left, most = group_sizes(undecided, rule)
        if left == before:
            raise ValueError("ranks must be unique and keys not NULL")
        if left:
            open_pairs = pairs.join(gone.selectExpr("rank AS dst"), "dst", "left_anti")
            sources = sources.join(open_pairs.selectExpr("src AS rank").distinct(), "rank", "left_semi")
            sources = ws.write(sources.select(*columns), "sources")
            kept.append(ws.last)
        for used in (*paths, *made):
            ws.remove(used)
        paths = kept
    if most:
        rounds.append(ws.write(_folded(undecided, sources, rounds, rule, crowded), "taken"))
    if not rounds:
        return undecided.selectExpr("rank AS src", "rank AS dst", "chunk_id AS dst_chunk")
    return reduce(DataFrame.unionByName, rounds)


def _folded(
    undecided: DataFrame,
    sources: DataFrame | None,
    rounds: list[DataFrame],
    rule: MatchRule,
    crowded: DataFrame | None,
) -> DataFrame:
    """What the undecided rows come to, together with the sources that match any of them."""
    columns = ["rank", "chunk_id", *rule.keys, *GEOMETRY]
    nothing = "CAST(array() AS array<bigint>) AS used"
    rows = undecided.selectExpr(*columns, "false AS settled", nothing)
    if sources is not None:
        met = match_join(undecided, sources, rule, "inner", crowded, extra="a_rank < rank")
        near = met.selectExpr(*[f"a_{c} AS {c}" for c in columns]).distinct()
        taken = reduce(DataFrame.unionByName, rounds)
        used = taken.groupBy(F.col("src").alias("rank")).agg(F.collect_list("dst_chunk").alias("used"))
        near = near.join(used, "rank", "left").selectExpr(
            *columns, "true AS settled", "coalesce(used, CAST(array() AS array<bigint>)) AS used"
        )
        rows = rows.unionByName(near)
    return ordered_fold(rows, rule)


def merge_chunks(
    local: SavedTable,
    rule: MatchRule,
    ws: Workspace,
    crowded: DataFrame | None = None,
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """Survivors of the merge with ``fitness`` summed up: own + (absorbed + 1) for each absorbed."""
    if not rule.can_match:
        return local.df
    taken = absorptions(local.df, rule, ws, crowded, sizes)
    passed_on = local.df.selectExpr("rank AS dst", "fitness + 1 AS fitness")
    gains = taken.join(passed_on, "dst").selectExpr("src AS owner_id", "fitness")
    total = add_fitness(gains).selectExpr("owner_id AS rank", "fitness AS gain")
    left = local.df.join(taken.selectExpr("dst AS rank"), "rank", "left_anti")
    merged = left.join(total, "rank", "left")
    others = [c for c in local.df.columns if c != "fitness"]
    return merged.selectExpr(*others, "fitness + coalesce(gain, 0L) AS fitness")
