
from __future__ import annotations

import os
import sys
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixture  # noqa: E402
import oracle  # noqa: E402
from fixture import CHUNKS, MANY_CHUNKS, MILEAGE, PCT, SEED  # noqa: E402
from incidentlens import (  # noqa: E402
    MatchRule,
    Sizes,
    Workspace,
    dedupe_points,
    hotspots,
    hotspots_chunked,
)
from incidentlens.operators import assign, chunks, fitness, graph, pairs  # noqa: E402
from incidentlens.operators.grid import crowded_cells, to_points  # noqa: E402
from incidentlens.operators.ordering import with_position  # noqa: E402
from incidentlens.operators.sampling import (  # noqa: E402
    draw_sample,
    find_cut,
    sample_size,
    without_sample,
)
from incidentlens.operators.suppress import first_round_survivors, head_edges  # noqa: E402
from incidentlens.plans.selection import Stages, thin_chunks  # noqa: E402
from incidentlens.sources import (  # noqa: E402
    ParsedIncidents,
    parse_lines,
    read_hotspots,
    read_incidents,
    write_hotspots,
)

# The operators for training data may be absent, or something they need; the others work without.
try:
    import corpus_pipeline
    from incidentlens.llm import queries as llm_queries
except ImportError as error:
    warnings.warn(f"queries for training data are left out: {error}", stacklevel=1)
    corpus_pipeline = llm_queries = None

RULE = MatchRule(MILEAGE)
ROUNDS_ONLY = Sizes(fold_rows=0, fold_work=0, broadcast_bytes=0)
# Small sizes that make the paths for large tables run on small ones.
SWEEPS = Sizes(fold_rows=0, fold_work=0, slow_share=0.0, tile_rows=100)
SALTED = Sizes(split_rows=20, broadcast_bytes=0)
PREFIXES = Sizes(sort_rows=50)
KEYED = RULE.also_equal("weekday")
Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Exact hot-spot selection on the smallest tables."""
    return hotspots_exact(spark, "/root/testdata/sf0.001")


# Sources and sinks -------------------------------------------------------------------------


def scan_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    path = f"{ws.path}/incident-files"
    fixture.lines(spark, sf_dir, broken=False).orderBy("row_id").select("line").write.text(path)
    good = read_incidents(spark, path, workspace=ws).good
    return good.select("row_id", "lat", "lon", "bearing", "partial_location", "weekday")


def parse_incident_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ParsedIncidents(parse_lines(fixture.lines(spark, sf_dir, broken=True)))
    return parsed.good.select("row_id", "lat", "lon", "bearing", "partial_location")


def incident_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ParsedIncidents(parse_lines(fixture.lines(spark, sf_dir, broken=True)))
    return parsed.rejects.select("row_id", "reject_reason")


def incident_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = to_points(fixture.incidents(spark, sf_dir), RULE, "row_id").select("row_id", "loc_key")
    return with_position(roads, Workspace(spark), "loc_key", "row_id")


def hotspots_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = hotspots(fixture.incidents(spark, sf_dir), PCT, MILEAGE, SEED)
    path = f"{run.workspace.path}/output"
    write_hotspots(run.suppressors, path)
    return read_hotspots(spark, path)


def hotspots_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = hotspots(fixture.incidents(spark, sf_dir), PCT, MILEAGE, SEED)
    path = f"{run.workspace.path}/output"
    write_hotspots(run.suppressors, path)
    return read_hotspots(spark, f"{path}_grt10")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotspots(fixture.incidents(spark, sf_dir), PCT, MILEAGE, SEED).summary()


# Predicates --------------------------------------------------------------------------------


def road_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.road_counts(fixture.incidents(spark, sf_dir))


def guarded_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pairs.guarded_distances(fixture.incidents(spark, sf_dir)))


def pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every incident with the first suppressor of the sample that matches it."""
    points, kept = _sampled(spark, sf_dir)
    owned = assign.assign_first(points, kept, RULE).select("row_id", "owner_id")
    all_pairs = assign.match_pairs(points, kept, RULE)
    return _rounded(
        all_pairs.join(
            owned.withColumnRenamed("owner_id", "suppressor_id"), ["row_id", "suppressor_id"]
        )
    )


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(assign.near_pairs(*_sampled(spark, sf_dir), RULE))


def bearing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = assign.near_pairs(*_sampled(spark, sf_dir), RULE)
    return near.filter(F.col("turn") < RULE.bearing_limit).select("row_id", "suppressor_id", "turn")


def match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(assign.match_pairs(*_sampled(spark, sf_dir), RULE))


def match_pairs_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(assign.match_pairs(*_sampled(spark, sf_dir, KEYED), KEYED))


def hotspots_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = hotspots(fixture.incidents(spark, sf_dir), PCT, MILEAGE, SEED)
    return fitness.nonzero(run.suppressors).select("row_id", "stage", "fitness")


# Sampling ----------------------------------------------------------------------------------


def sample_size_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = fixture.incidents(spark, sf_dir).agg(F.count(F.lit(1)).alias("incidents"))
    size = sample_size(counted.first()["incidents"], PCT)
    return counted.withColumn("sample_size", F.lit(size).cast("bigint"))


def suppressor_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidents = fixture.incidents(spark, sf_dir)
    return draw_sample(incidents, _cut(incidents)).select("row_id", "digest")


def to_be_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidents = fixture.incidents(spark, sf_dir)
    return without_sample(incidents, _cut(incidents)).select("row_id", "lat", "lon")


# Joins -------------------------------------------------------------------------------------


def match_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = to_points(fixture.incidents(spark, sf_dir), RULE, "row_id")
    return head_edges(points, RULE)


def match_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other incidents each one matches, from the compressed graph of all matches."""
    ws = Workspace(spark)
    points = ws.write(to_points(fixture.incidents(spark, sf_dir), RULE, "row_id"), "points")
    return graph.match_graph(points, RULE, ws).degrees()


def assign_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = assign.assign_first(*_sampled(spark, sf_dir), RULE)
    return owned.filter("owner_id IS NOT NULL").select("row_id", "owner_id")


def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = assign.assign_nearest(*_sampled(spark, sf_dir), RULE)
    return owned.filter("owner_id IS NOT NULL").select("row_id", "owner_id")


def unmatched_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = assign.assign_first(*_sampled(spark, sf_dir), RULE)
    return assign.unmatched(owned).select("row_id", "lat", "lon")


def chunk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, _ = _chunk_survivors(spark, sf_dir)
    return chunks.chunk_edges(local.df, RULE).select("src_id", "dst_id")


# Aggregations and selection ----------------------------------------------------------------


def incident_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.incidents(spark, sf_dir).agg(F.count(F.lit(1)).alias("incidents"))


def fitness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitness.fitness_counts(assign.assign_first(*_sampled(spark, sf_dir), RULE))


def fitness_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial counts per chunk, summed up; suppressors without any keep 0."""
    points, kept = _sampled(spark, sf_dir, carry_chunks=True)
    owned = assign.assign_first(points, kept, RULE)
    partial = [fitness.fitness_counts(owned.filter(f"chunk_id = {c}")) for c in range(CHUNKS)]
    merged = fitness.add_fitness(*partial)
    return fitness.with_fitness(kept, merged).select("row_id", "fitness")


def greedy_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled by rounds alone, as on roads with very many incidents."""
    run = dedupe_points(fixture.incidents(spark, sf_dir), MILEAGE, sizes=ROUNDS_ONLY)
    return run.owners.selectExpr("row_id", "owner_id = row_id AS kept", "owner_id")


def dedupe_along_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In an order that runs along the roads, settled by sweeps over tiles."""
    incidents = fixture.incidents(spark, sf_dir)
    ordered = with_position(incidents, Workspace(spark), "partial_location", "lat", "row_id")
    run = dedupe_points(ordered, MILEAGE, "position", sizes=SWEEPS)
    return run.owners.selectExpr("row_id", "owner_id = row_id AS kept", "owner_id")


def first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = to_points(fixture.incidents(spark, sf_dir), RULE, "row_id")
    return first_round_survivors(points, RULE, Workspace(spark))


def assign_first_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As with cells so full that they are split over tasks."""
    points, kept = _sampled(spark, sf_dir)
    crowded = crowded_cells(points, RULE, points.count(), Workspace(spark), SALTED)
    owned = assign.assign_first(points, kept, RULE, crowded, SALTED)
    return owned.filter("owner_id IS NOT NULL").select("row_id", "owner_id")


def suppressor_sample_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As with a table too large to sort: the cut-off is found from counts per digest prefix."""
    incidents = fixture.incidents(spark, sf_dir)
    rows = incidents.count()
    cut = find_cut(incidents, rows, sample_size(rows, PCT), SEED, PREFIXES)
    return draw_sample(incidents, cut).select("row_id", "digest")


def road_counts_sharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose capitals are longer than their small letters."""
    fixture.incidents(spark, sf_dir).createOrReplaceTempView("incidents")
    return pairs.road_counts(spark.sql(fixture.SHARP_SQL))


def guarded_distance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With gaps in the row ids, as rejected lines leave them."""
    parsed = ParsedIncidents(parse_lines(fixture.lines(spark, sf_dir, broken=True)))
    return _rounded(pairs.guarded_distances(parsed.good))


def suppressors_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of the sample with the fitness they have inside the sample."""
    incidents = fixture.incidents(spark, sf_dir)
    sample = to_points(draw_sample(incidents, _cut(incidents)), RULE, "row_id")
    _, kept = _sampled(spark, sf_dir)
    counts = fitness.fitness_counts(assign.assign_first(sample, kept, RULE))
    return fitness.with_fitness(kept, counts).select("row_id", "lat", "lon", "fitness")


def fitness_after_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitness inside the sample plus fitness gained from the rest."""
    incidents = fixture.incidents(spark, sf_dir)
    cut = _cut(incidents)
    _, kept = _sampled(spark, sf_dir)
    stages = [
        fitness.fitness_counts(assign.assign_first(to_points(part, RULE, "row_id"), kept, RULE))
        for part in (draw_sample(incidents, cut), without_sample(incidents, cut))
    ]
    total = fitness.add_fitness(*stages)
    return fitness.with_fitness(kept, total).select("row_id", "fitness")


def suppressed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents suppressed inside the sample, by the sample in all, by the rest, and in total."""
    incidents = fixture.incidents(spark, sf_dir)
    run = hotspots(incidents, PCT, MILEAGE, SEED)
    dropped = run.owners.filter("owner_id <> row_id")
    sampled = F.expr(_cut(incidents).contains())
    by_sample = F.col("stage") == "sample"
    return dropped.agg(
        F.count_if(by_sample & sampled).alias("within_sample"),
        F.count_if(by_sample).alias("by_sample"),
        F.count_if(~by_sample).alias("by_rest"),
        F.count(F.lit(1)).alias("total"),
    )


def chunk_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, _ = _chunk_survivors(spark, sf_dir)
    return local.df.select("row_id", "chunk_id", "fitness")


def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled by rounds alone, as on roads with very many incidents."""
    local, ws = _chunk_survivors(spark, sf_dir)
    return chunks.merge_chunks(local, RULE, ws, sizes=ROUNDS_ONLY).select("row_id", "chunk_id", "fitness")


def chunk_merge_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With many chunks, between which far more rows match than survive."""
    local, ws = _chunk_survivors(spark, sf_dir, MANY_CHUNKS)
    return chunks.merge_chunks(local, RULE, ws, sizes=ROUNDS_ONLY).select("row_id", "chunk_id", "fitness")


def conservation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotspots(fixture.incidents(spark, sf_dir), PCT, MILEAGE, SEED).check()


def all_suppressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = hotspots(fixture.incidents(spark, sf_dir), PCT, MILEAGE, SEED)
    return run.suppressors.select("row_id", "lat", "lon", "stage", "fitness")


# Pipelines ---------------------------------------------------------------------------------


def hotspots_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotspots(fixture.incidents(spark, sf_dir), PCT, MILEAGE, SEED).spots()


def hotspots_chunked_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotspots_chunked(_with_chunks(spark, sf_dir), PCT, MILEAGE, SEED).spots()


def hotspots_no_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_points(fixture.incidents(spark, sf_dir), MILEAGE).spots()


# Shared steps ------------------------------------------------------------------------------


def _rounded(distances: DataFrame) -> DataFrame:
    """Math libraries may differ in the last digit."""
    return distances.withColumn("miles", F.round("miles", 6))


def _cut(incidents: DataFrame):
    rows = incidents.count()
    return find_cut(incidents, rows, sample_size(rows, PCT), SEED)


def _with_chunks(spark: SparkSession, sf_dir: str, number: int = CHUNKS) -> DataFrame:
    incidents = fixture.incidents(spark, sf_dir)
    return incidents.withColumn("chunk_id", chunks.even_chunks(incidents.count(), number))


def _sampled(
    spark: SparkSession, sf_dir: str, rule: MatchRule = RULE, carry_chunks: bool = False
) -> tuple[DataFrame, DataFrame]:
    """All incidents as points, and the survivors of the sample."""
    incidents = _with_chunks(spark, sf_dir) if carry_chunks else fixture.incidents(spark, sf_dir)
    stages = Stages(incidents, rule, None, Sizes())
    kept = stages.thin_sample(incidents.count(), PCT, SEED)
    carry = ["chunk_id"] if carry_chunks else []
    return to_points(incidents, rule, "row_id", *carry), kept


def _chunk_survivors(spark: SparkSession, sf_dir: str, number: int = CHUNKS):
    ws = Workspace(spark)
    points = ws.save(
        to_points(_with_chunks(spark, sf_dir, number), RULE, "row_id", "chunk_id"), "points"
    )
    return thin_chunks(points, RULE, ws), ws


CORE: dict[str, Query] = {
    query.__name__: query
    for query in (
        scan_incidents,
        parse_incident_lines,
        incident_rejects,
        incident_order,
        hotspots_output,
        hotspots_strong,
        run_summary,
        road_counts,
        pair_distance,
        guarded_distance,
        near_pairs,
        bearing_pairs,
        match_pairs,
        match_pairs_keyed,
        hotspots_nonzero,
        suppressor_sample,
        to_be_reduced,
        match_edges,
        match_degree,
        assign_first,
        assign_nearest,
        unmatched_points,
        chunk_edges,
        incident_count,
        fitness_counts,
        fitness_merged,
        greedy_suppress,
        dedupe_along_roads,
        first_round,
        assign_first_salted,
        suppressor_sample_prefix,
        road_counts_sharp,
        guarded_distance_gaps,
        suppressors_clean,
        fitness_after_assign,
        suppressed_totals,
        chunk_suppress,
        chunk_merge,
        chunk_merge_many,
        conservation_check,
        all_suppressors,
        hotspots_exact,
        hotspots_no_sample,
    )
} | {"sample_size": sample_size_query, "hotspots_chunked": hotspots_chunked_query}


def queries() -> dict[str, Query]:
    """One entry per operator of the inventory."""
    out = dict(CORE)
    if llm_queries:
        out |= llm_queries.QUERIES
        out["pipeline"] = corpus_pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    """Sequential counterparts in DuckDB SQL, independent of grids and rounds."""
    out = oracle.statements()
    if llm_queries:
        out |= llm_queries.ORACLE
        if corpus_pipeline.ORACLE_SQL:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
