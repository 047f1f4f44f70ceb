"""Merkle manifest of a dataset: a digest per row, a tree per group, a root over the groups, and proofs.

Levels are built by *sibling-shift self-joins*: a node that stands first in its run of ``arity`` nodes (slot
zero) computes the indices of its siblings and is joined with them by equality, once per offset: the one with
index XOR 1 in a binary tree, those with index + 1, + 2, ... otherwise. The slot-zero rows, which then hold the
whole run, emit the parents. A run's members are kept with the parent, so that proofs come from the
top down: a node's steps are its own run and then its parent's steps.

Every level is a written table, smaller by the arity than the one below; the driver only sees the largest
group's size. Runs are joined by (group, index), so that a group that holds most rows is spread like any other.

Definitions
* digest of a row: SHA-256 over the columns named, each ``-`` if null and else byte count, ``:``, value;
* leaves of a group ascend by the order column, nulls first, then by digest; rows that are equal in
  all columns named are leaves of their own, next to each other;
* a run is never padded: the last one holds fewer nodes, even one; a group of one row is its own subroot;
* groups ascend bytewise, null first; columns not named play no part and are not returned;
* an empty table has no rows and no root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.tables import workspace
from incidentlens.operators.ordering import with_position

ARITY = 8


def encoded(name: str) -> Column:
    """A value with its byte count before it, or ``-``: no two rows are encoded alike."""
    value = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*columns: str) -> Column:
    """SHA-256 of a row, 32 bytes; columns of any type that casts to a string."""
    return F.unhex(F.sha2(F.concat(*map(encoded, columns)).cast("binary"), 256))


def node_digest(members: Column) -> Column:
    """SHA-256 over the members' digests as hex text, 32 bytes."""
    return F.unhex(F.sha2(F.array_join(F.transform(members, hexed), "").cast("binary"), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the order column, the group, ``leaf``, what was carried, ``subroot``, ``root``, ``steps``.

    ``steps`` goes from the leaf's run to the root: structs of ``slot`` (where the node stands) and ``members``
    (the digests of its run, its own included). Digests are 32 bytes.
    """

    leaves: DataFrame
    order: str
    group: str


def _parents(nodes: DataFrame, arity: int) -> DataFrame:
    """(g, idx, held, digest, members) of the next level, from those that are not alone in their group."""
    active = nodes.filter("held > 1")
    if arity == 2:
        shifted = [(1, F.col("idx").bitwiseXOR(F.lit(1)))]
    else:
        shifted = [(d, F.col("idx") - F.lit(d)) for d in range(1, arity)]
    runs = active.filter(f"idx % {arity} = 0").select("g", "idx", "held", F.col("digest").alias("d0"))
    for offset, slot_zero in shifted:
        sibling = active.filter(f"idx % {arity} = {offset}").select("g", slot_zero.alias("idx"), F.col("digest").alias(f"d{offset}"))
        runs = runs.join(sibling, ["g", "idx"], "left")
    members = F.filter(F.array(*[f"d{i}" for i in range(arity)]), lambda d: d.isNotNull())
    rows = runs.select(
        "g", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(held + {arity - 1}) div {arity}").alias("held"), members.alias("members")
    )
    return rows.select("g", "idx", "held", node_digest(F.col("members")).alias("digest"), "members")


def _levels(nodes: DataFrame, arity: int, ws) -> list[DataFrame]:
    """Tables of all levels from the leaves up, until every group has one node."""
    out = [nodes]
    most = nodes.agg(F.max("held")).first()[0] or 0
    while most > 1:
        out.append(ws.write(_parents(out[-1], arity), "level"))
        most = -(-most // arity)
    return out


def _steps(levels: list[DataFrame], tops: DataFrame, arity: int, ws) -> DataFrame:
    """The lowest level with ``steps``; ``tops``: (g, steps) of each group's last node and other columns."""
    others = [c for c in tops.columns if c not in ("g", "steps")]
    known = None
    for height in range(len(levels) - 1, -1, -1):
        here = levels[height].drop("members")
        done = here.filter("held = 1").join(tops, "g")
        if known is not None:
            above = levels[height + 1].select("g", F.col("idx").alias("up"), "members")
            above = above.join(known.select("g", F.col("idx").alias("up"), "steps", *others), ["g", "up"])
            step = F.struct(F.expr(f"int(idx % {arity})").alias("slot"), "members")
            rest = here.filter("held > 1").withColumn("up", F.expr(f"idx div {arity}")).join(above, ["g", "up"])
            rest = rest.withColumn("steps", F.concat(F.array(step), "steps"))
            done = done.unionByName(rest.select(*done.columns))
        known = ws.write(done, "steps") if height else done
    return known


NO_STEPS = "CAST(array() AS array<struct<slot: int, members: array<binary>>>)"


def manifest(
    docs: DataFrame, columns: tuple[str, ...], group: str, order: str, arity: int = ARITY, carry: dict[str, Column] | None = None
) -> Manifest:
    """Trees over all rows of ``docs``; ``carry``: further columns by name, computed from its columns."""
    if arity < 2:
        raise ValueError("a run holds two nodes at least")
    ws = workspace(docs)
    rows = docs.select(
        F.col(order).alias("k"), F.col(group).cast("string").alias("grp"), leaf_digest(*columns).alias("digest"),
        *[c.alias(f"c_{n}") for n, c in (carry or {}).items()],
    )
    # Written before it is sorted, as the sort reads its input twice and the digests read all texts.
    digests = ws.write(rows, "digests")
    placed = ws.write(with_position(digests, ws, "grp", "k", "digest"), "placed")
    # Groups are numbered in order; there may be any number of them.
    sizes = placed.groupBy("grp").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("held"))
    groups = ws.write(with_position(ws.write(sizes, "sizes"), ws, "grp").withColumnRenamed("position", "g"), "groups")
    numbered = ws.write(
        placed.alias("p").join(groups.alias("s"), F.expr("p.grp <=> s.grp"))
        .select("p.*", "s.g", F.expr("p.position - s.first").alias("idx"), "s.held"),
        "leaves",
    )
    # The leaves' own columns go along as the lowest level, so that rows with their proofs need no further join.
    levels = _levels(numbered, arity, ws)
    # Subroots are the leaves of one more tree.
    subroots = levels[0].filter("held = 1").select("g", "digest")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.filter("held = 1").select("g", "digest"))
    subroots = ws.save(subroots, "subroots")
    crown = subroots.df.select(F.lit(0).alias("g"), F.col("g").alias("idx"), F.lit(subroots.rows).cast("bigint").alias("held"), "digest")
    upper = _levels(crown, arity, ws)
    root = upper[-1].filter("held = 1").select("g", F.col("digest").alias("root"))
    tops = _steps(upper, root.withColumn("steps", F.expr(NO_STEPS)), arity, ws)
    tops = ws.write(tops.select(F.col("idx").alias("g"), F.col("digest").alias("subroot"), "root", "steps"), "tops")
    proofs = _steps(levels, tops, arity, ws)
    carried = [F.col(f"c_{n}").alias(n) for n in carry or {}]
    leaves = proofs.select(
        F.col("k").alias(order), F.col("grp").alias(group), F.col("digest").alias("leaf"), *carried, "subroot", "root", "steps"
    )
    return Manifest(leaves, order, group)


def proof_digests(steps: Column) -> Column:
    """Digests of all siblings on the way to the root, left to right."""
    def siblings(step):
        return F.filter(step.members, lambda _, i: i != step.slot)

    return F.flatten(F.transform(steps, siblings))


def folded_root(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    def above(node, step):
        return node_digest(F.transform(step.members, lambda d, i: F.when(i == step.slot, node).otherwise(d)))

    return F.aggregate(steps, leaf, above)


def verify(found: Manifest, leaf: Column) -> DataFrame:
    """``found.leaves`` with ``folded_root`` of the digest that a row has now, and ``verified``."""
    folded = found.leaves.withColumn("folded_root", folded_root(leaf, F.col("steps")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
