"""Hot-spot output: all spots, and the strong ones beside them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.fitness import nonzero
from ..rule import STRONG_FITNESS
from ..workspace import Files

OUTPUT_SCHEMA = "lat DOUBLE, lon DOUBLE, fitness BIGINT"


def strong_path(path: str, min_fitness: int = STRONG_FITNESS) -> str:
    return f"{path}_grt{min_fitness}"


def write_hotspots(
    suppressors: DataFrame,
    path: str,
    min_fitness: int = STRONG_FITNESS,
    format: str = "csv",
    incidents: DataFrame | None = None,
    mode: str = "error",
) -> dict[str, int]:
    """Write ``lat, lon, fitness`` of all spots to ``path`` and of the strong ones next to it.

    One pass writes both into a folder of its own, which is then renamed: either both outputs appear, or
    what was there before stays. ``mode`` is ``error`` (existing outputs are left alone) or
    ``overwrite``. The number of rows of either, counted while writing, is returned and stands in the
    file ``_manifest.json`` of both.

    Executors write their own parts; text output is tab-separated without header. Given the
    parsed ``incidents``, coordinates are repeated exactly as they stood in the input.
    """
    if mode not in ("error", "overwrite"):
        raise ValueError(f"mode must be error or overwrite, not {mode}")
    files = Files(suppressors.sparkSession)
    targets = {"all": path, "strong": strong_path(path, min_fitness)}
    taken = [target for target in targets.values() if files.exists(target)]
    if taken and mode == "error":
        raise FileExistsError(", ".join(taken))
    spots = nonzero(suppressors)
    if incidents is not None:
        texts = incidents.select("row_id", "lat_text", "lon_text")
        spots = spots.join(texts, "row_id").selectExpr(
            "lat_text AS lat", "lon_text AS lon", "fitness"
        )
    outputs = f"explode(IF(fitness > {int(min_fitness)}, array('all', 'strong'), array('all'))) AS output"
    seen = Observation()
    both = spots.selectExpr("lat", "lon", "fitness", outputs).observe(
        seen, *[F.count_if(F.col("output") == name).alias(name) for name in targets]
    )
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        writer = both.write.partitionBy("output").format(format)
        if format == "csv":
            writer = writer.option("sep", "\t")
        writer.save(staging)
        rows = seen.get
        for name in targets:
            files.make(f"{staging}/output={name}")  # there are no parts of an empty output
            files.put(f"{staging}/output={name}/_manifest.json", json.dumps({"rows": rows, "output": name}))
        _publish(files, {f"{staging}/output={name}": target for name, target in targets.items()})
    finally:
        files.delete(staging)
    return rows


def _publish(files: Files, moves: dict[str, str]) -> None:
    """Rename folders to their targets, all or none; what stood at a target is deleted at the end."""
    aside, done = {}, []
    try:
        for source, target in moves.items():
            if files.exists(target):
                old = f"{target.rstrip('/')}.old-{uuid.uuid4().hex}"
                files.rename(target, old)
                aside[target] = old
            files.rename(source, target)
            done.append(target)
    except BaseException:
        for target in done:
            files.delete(target)
        for target, old in aside.items():
            files.rename(old, target)
        raise
    for old in aside.values():
        files.delete(old)


def read_hotspots(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    reader = spark.read.schema(OUTPUT_SCHEMA).format(format)
    if format == "csv":
        reader = reader.option("sep", "\t")
    return reader.load(path)
