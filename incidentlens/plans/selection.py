"""End-to-end selection: sample, thin out the sample, credit the rest, thin out what is left.

The exact result equals one greedy pass over (sample in sample order, then the rest by row_id);
staging it keeps every join linear, as later stages only see rows that no suppressor covers.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assign import assign_first, assign_nearest
from ..operators.chunks import merge_chunks
from ..operators.fitness import (
    conservation_check,
    fitness_counts,
    nonzero,
    run_summary,
    strong,
    with_fitness,
)
from ..operators.grid import GEOMETRY, comparable, crowded_cells, to_points
from ..operators.ordering import with_rank
from ..operators.sampling import draw_sample, find_cut, sample_size
from ..operators.suppress import greedy_survivors
from ..rule import STRONG_FITNESS, MatchRule
from ..sizes import Sizes
from ..workspace import SavedTable, Workspace, input_marks

INPUT = ("row_id", "lat", "lon", "bearing", "partial_location")
OUTPUT = ("row_id", "lat", "lon", "fitness")


@dataclass(frozen=True)
class HotspotRun:
    """Result of a run: ``suppressors(row_id, lat, lon, fitness, stage)``, fitness 0 included.

    ``owners(row_id, owner_id, stage)`` tells who stands for whom (exact mode only). Tables
    read from ``workspace``; close it when they have been written elsewhere.
    """

    incidents: DataFrame
    suppressors: DataFrame
    owners: DataFrame | None
    workspace: Workspace
    stage_seconds: dict[str, float] = field(default_factory=dict)

    def spots(self) -> DataFrame:
        """The hot spots: every suppressor that stands for another incident."""
        return nonzero(self.suppressors).select(*OUTPUT)

    def strong_spots(self, min_fitness: int = STRONG_FITNESS) -> DataFrame:
        return strong(self.spots(), min_fitness)

    def summary(self, min_fitness: int = STRONG_FITNESS) -> DataFrame:
        return run_summary(self.suppressors, min_fitness)

    def check(self) -> DataFrame:
        return conservation_check(self.suppressors, self.incidents)


class Stages:
    """Work shared by the two modes; every stage ends in saved tables."""

    def __init__(
        self,
        incidents: DataFrame,
        rule: MatchRule,
        workspace: Workspace | None,
        sizes: Sizes,
        nearest: bool = False,
        carry: tuple[str, ...] = (),
    ):
        self.rule = rule
        self.ws = workspace or Workspace(incidents.sparkSession)
        # The input is read once, here; everything else reads the narrow copy.
        used = incidents.select(*dict.fromkeys((*INPUT, *rule.extra_keys, *carry)))
        # What a run is made of, in so far as a later one may take up its steps.
        self.identity = {}
        if self.ws.named:
            self.identity = {
                "input": input_marks(incidents),
                "query": used._jdf.queryExecution().analyzed().canonicalized().toString(),
                "rule": [rule.mileage, rule.bearing_limit, *rule.extra_keys],
                "nearest": nearest,
            }
        saved = self.step("incidents", lambda ws: used)
        self.incidents, self.rows = saved.df, saved.rows
        self.sizes = sizes
        self.assign = assign_nearest if nearest else assign_first
        self.seconds: dict[str, float] = {}
        self._started = time.monotonic()

    def lap(self, stage: str) -> None:
        now = time.monotonic()
        self.seconds[stage] = now - self._started
        self._started = now

    def step(self, name: str, make: Callable[[Workspace], DataFrame], **more) -> SavedTable:
        """A stage's result; what it is made from is deleted, and a run of the same name finds it again."""
        return self.ws.step(name, {**self.identity, **more}, make)

    def run(self, suppressors: DataFrame, owners: DataFrame | None, **more) -> HotspotRun:
        """The result; suppressors are saved, as every use of a run reads them."""
        saved = self.step("suppressors", lambda ws: suppressors, **more).df
        return HotspotRun(self.incidents, saved, owners, self.ws, self.seconds)

    def crowded(self, points: DataFrame, rows: int, rule: MatchRule, ws: Workspace) -> DataFrame | None:
        return crowded_cells(points, rule, rows, ws, self.sizes)

    def survivors(self, points: DataFrame, rows: int, ws: Workspace) -> DataFrame:
        """Greedy suppression with the rule of the run."""
        crowded = self.crowded(points, rows, self.rule, ws)
        return greedy_survivors(points, self.rule, ws, crowded, self.sizes)

    def owners(self, points: DataFrame, rows: int, kept: DataFrame, ws: Workspace) -> DataFrame:
        """The points with ``owner_id``."""
        crowded = self.crowded(points, rows, self.rule, ws)
        return self.assign(points, kept, self.rule, crowded, self.sizes)

    def thin_sample(self, rows: int, pct: int, seed: int) -> DataFrame | None:
        """Survivors of the sample, or None when the sample is empty."""
        size = sample_size(rows, pct)
        if not size:
            return None

        def thinned(ws: Workspace) -> DataFrame:
            cut = find_cut(self.incidents, rows, size, seed, self.sizes)
            ranked = with_rank(draw_sample(self.incidents, cut), "digest", "row_id")
            sample = ws.save(to_points(ranked, self.rule, "rank"), "sample")
            return self.survivors(sample.df, sample.rows, ws)

        kept = self.step("sample-kept", thinned, pct=pct, seed=seed).df
        self.lap("thin_sample")
        return kept

    def credit(
        self, rows: int, kept: DataFrame | None, *carry: str, **more
    ) -> tuple[DataFrame | None, SavedTable]:
        """Owners of the incidents the sample's survivors match, and the unmatched points."""
        points = to_points(self.incidents, self.rule, "row_id", *carry)
        if kept is None:
            tail = self.step("tail", lambda ws: points)
            self.lap("credit")
            return None, tail
        # One pass writes both results; of an owned row only the owner is kept.
        geometry = [
            f"CASE WHEN owner_id IS NULL THEN {c} END AS {c}"
            for c in points.columns
            if c not in ("rank", "row_id")
        ]

        def credited(ws: Workspace) -> DataFrame:
            owned = self.owners(points, rows, kept, ws)
            return owned.selectExpr("rank", "row_id", "owner_id", *geometry)

        found = self.step("owned", credited, **more).df
        matched = found.filter("owner_id IS NOT NULL").select("row_id", "owner_id")
        open_points = found.filter("owner_id IS NULL").select(*points.columns)
        tail = SavedTable(open_points, open_points.count())
        self.lap("credit")
        return matched, tail

    def outside(self) -> DataFrame:
        """Rows that match nothing (no finite coordinates): they stand for themselves."""
        odd = self.incidents.filter(f"NOT {comparable(self.incidents, self.rule)}")
        return odd.select("row_id", "lat", "lon")


def _zero(df: DataFrame, stage: str) -> DataFrame:
    return df.selectExpr("row_id", "lat", "lon", "0L AS fitness", f"'{stage}' AS stage")


def _staged(df: DataFrame, stage: str) -> DataFrame:
    return df.selectExpr(*OUTPUT, f"'{stage}' AS stage")


def _with_owned(kept: DataFrame, owners: DataFrame, stage: str) -> DataFrame:
    return _staged(with_fitness(kept, fitness_counts(owners)), stage)


def _nothing_matches(stages: Stages) -> HotspotRun:
    alone = _zero(stages.incidents, "rest")
    owners = stages.incidents.selectExpr("row_id", "row_id AS owner_id", "'rest' AS stage")
    return stages.run(alone, owners)


def hotspots(
    incidents: DataFrame,
    pct: int,
    mileage: float,
    seed: int = 42,
    *,
    rule: MatchRule | None = None,
    nearest: bool = False,
    workspace: Workspace | None = None,
    sizes: Sizes = Sizes(),
) -> HotspotRun:
    """Exact selection.

    ``incidents`` needs ``row_id`` (BIGINT, unique, file order), ``lat``, ``lon``, ``bearing``
    and ``partial_location``. ``pct`` percent form the initial suppressors; ``mileage`` is the
    diameter of a spot. ``rule`` replaces the default match rule; ``nearest`` credits incidents
    to the closest instead of the first matching suppressor.
    """
    rule = rule or MatchRule(mileage)
    stages = Stages(incidents, rule, workspace, sizes, nearest)
    if not rule.can_match:
        return _nothing_matches(stages)
    rows = stages.rows
    kept = stages.thin_sample(rows, pct, seed)
    drawn = {"pct": pct, "seed": seed}
    matched, tail = stages.credit(rows, kept, **drawn)
    late = stages.step("late", lambda ws: stages.survivors(tail.df, tail.rows, ws), **drawn).df

    def owned(ws: Workspace) -> DataFrame:
        return stages.owners(tail.df, tail.rows, late, ws).select("row_id", "owner_id")

    late_owned = stages.step("late-owned", owned, **drawn).df
    stages.lap("thin_rest")
    suppressors = _with_owned(late, late_owned, "rest").unionByName(
        _zero(stages.outside(), "rest")
    )
    owners = late_owned.withColumn("stage", F.lit("rest"))
    if kept is not None:
        suppressors = _with_owned(kept, matched, "sample").unionByName(suppressors)
        owners = matched.withColumn("stage", F.lit("sample")).unionByName(owners)
    return stages.run(suppressors, owners, **drawn)


def dedupe_points(
    incidents: DataFrame,
    mileage: float,
    order: str = "row_id",
    *,
    rule: MatchRule | None = None,
    workspace: Workspace | None = None,
    sizes: Sizes = Sizes(),
) -> HotspotRun:
    """Greedy suppression of a whole table by a unique BIGINT ``order`` column, without a sample."""
    rule = rule or MatchRule(mileage)
    stages = Stages(incidents, rule, workspace, sizes, carry=(order,))
    if not rule.can_match:
        return _nothing_matches(stages)
    points = to_points(stages.incidents, rule, order)

    def survivors(ws: Workspace) -> DataFrame:
        saved = ws.save(points, "points")
        return stages.survivors(saved.df, saved.rows, ws)

    kept = stages.step("kept", survivors, order=order).df

    def owners_of(ws: Workspace) -> DataFrame:
        return stages.owners(points, stages.rows, kept, ws).select("row_id", "owner_id")

    owned = stages.step("owned", owners_of, order=order).df
    stages.lap("thin_rest")
    suppressors = _with_owned(kept, owned, "rest").unionByName(_zero(stages.outside(), "rest"))
    owners = owned.withColumn("stage", F.lit("rest"))
    return stages.run(suppressors, owners, order=order)


def hotspots_chunked(
    incidents: DataFrame,
    pct: int,
    mileage: float,
    seed: int = 42,
    *,
    chunk_col: str = "chunk_id",
    rule: MatchRule | None = None,
    workspace: Workspace | None = None,
    sizes: Sizes = Sizes(),
) -> HotspotRun:
    """Approximate selection: the rest is thinned out per chunk, then chunks are merged.

    ``chunk_col`` (BIGINT, not NULL) assigns each incident to a chunk; chunks are a property of
    the data here and independent of Spark partitions.
    """
    rule = rule or MatchRule(mileage)
    incidents = incidents.withColumn("chunk_id", F.col(chunk_col).cast("bigint"))
    stages = Stages(incidents, rule, workspace, sizes, carry=("chunk_id",))
    if not rule.can_match:
        return _nothing_matches(stages)
    rows = stages.rows
    kept = stages.thin_sample(rows, pct, seed)
    drawn = {"pct": pct, "seed": seed, "chunks": chunk_col}
    matched, tail = stages.credit(rows, kept, "chunk_id", **drawn)

    def merge(ws: Workspace) -> DataFrame:
        local = thin_chunks(tail, rule, ws, sizes)
        crowded = stages.crowded(local.df, local.rows, rule, ws)
        return merge_chunks(local, rule, ws, crowded, sizes)

    merged = stages.step("merged", merge, **drawn).df
    stages.lap("thin_rest")
    suppressors = _staged(merged, "rest").unionByName(_zero(stages.outside(), "rest"))
    if kept is not None:
        suppressors = _with_owned(kept, matched, "sample").unionByName(suppressors)
    return stages.run(suppressors, None, **drawn)


def thin_chunks(
    points: SavedTable, rule: MatchRule, ws: Workspace, sizes: Sizes = Sizes()
) -> SavedTable:
    """Survivors of greedy suppression inside each chunk with their local fitness.

    Ranked by (chunk_id, rank), the order in which chunks are merged.
    """
    within = rule.also_equal("chunk_id")
    crowded = crowded_cells(points.df, within, points.rows, ws, sizes)
    kept = greedy_survivors(points.df, within, ws, crowded, sizes)
    counts = fitness_counts(assign_first(points.df, kept, within, crowded, sizes))
    ranked = with_rank(with_fitness(kept, counts), "chunk_id", "rank")
    return ws.save(
        ranked.select(
            "rank", "row_id", "chunk_id", *rule.keys, *GEOMETRY, "cell", "fitness"
        ),
        "chunk-survivors",
    )
