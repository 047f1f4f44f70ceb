"""Benchmark of the three pipelines; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads, BENCH_RUNS how often
each pipeline runs. The time of a pipeline is the median of its runs. With BENCH_MORE=1 harder inputs are timed
once each, beside the sum: rows in order along the roads, a third of all rows in one place, ten times the rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixture  # noqa: E402
from fixture import CHUNKS, MILEAGE, PCT, SEED  # noqa: E402
from incidentlens import Workspace, dedupe_points, hotspots, hotspots_chunked  # noqa: E402
from incidentlens.operators.chunks import even_chunks  # noqa: E402
from incidentlens.operators.ordering import with_position  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    incidents = fixture.incidents(spark, SF_DIR)
    rows = incidents.count()
    in_chunks = incidents.withColumn("chunk_id", even_chunks(rows, CHUNKS))
    pipelines = {
        "hotspots_exact": lambda: hotspots(incidents, PCT, MILEAGE, SEED),
        "hotspots_chunked": lambda: hotspots_chunked(in_chunks, PCT, MILEAGE, SEED),
        "hotspots_no_sample": lambda: dedupe_points(incidents, MILEAGE),
    }
    seconds, stages, counts = {}, {}, {}
    for name, pipeline in pipelines.items():
        times = []
        for _ in range(RUNS):
            started = time.monotonic()
            run = pipeline()
            run.spots().write.format("noop").mode("overwrite").save()
            times.append(time.monotonic() - started)
            stages[name] = {k: round(v, 3) for k, v in run.stage_seconds.items()}
            counts[name] = run.summary().first().asDict()
            run.workspace.close()
        seconds[name] = round(statistics.median(times), 3)
    more = {}
    if os.environ.get("BENCH_MORE") == "1":
        place = "IF(row_id % 3 = 0, {place} + row_id % 89 * 1e-7, {column}) AS {column}"
        one_place = [place.format(column="lat", place="52.1e0"), place.format(column="lon", place="-1.1e0")]
        hot = incidents.selectExpr("row_id", *one_place, "bearing", "IF(row_id % 3 = 0, 'Road 1', partial_location) AS partial_location")
        shifts = "explode(sequence(0L, 9L)) AS copy"
        tenfold = incidents.selectExpr("row_id", "lat", "lon", "bearing", "partial_location", shifts).selectExpr(
            "row_id * 10 + copy AS row_id", "lat + copy * 1e-4 AS lat", "lon + copy * 7e-4 AS lon", "bearing", "partial_location"
        )
        along = with_position(incidents, Workspace(spark), "partial_location", "lat", "row_id")
        harder = {
            "dedupe_along_roads": lambda: dedupe_points(along, MILEAGE, "position"),
            "hotspots_hot_place": lambda: hotspots(hot, PCT, MILEAGE, SEED),
            "hotspots_tenfold": lambda: hotspots(tenfold, PCT, MILEAGE, SEED),
        }
        for name, pipeline in harder.items():
            started = time.monotonic()
            run = pipeline()
            run.spots().write.format("noop").mode("overwrite").save()
            more[name] = round(time.monotonic() - started, 3)
            run.workspace.close()
    print(
        json.dumps(
            {
                "metric": "hot-spot selection, median wall time, sum over pipelines",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "incidents": rows,
                "stage_seconds": stages,
                "counts": counts,
                "more": more,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
