"""Delimited incident files: scan, field split, typing, rejects and row identity."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace

# The fields of a line, in file order.
INCIDENT_SCHEMA = T.StructType(
    [
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("bearing", T.IntegerType()),
        T.StructField("partial_location", T.StringType()),
        T.StructField("full_location", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("weekday", T.StringType()),
    ]
)
REQUIRED_FIELDS = 4
# A table of this many splits, 24 bytes each, is small enough for every executor.
BROADCAST_SPLITS = 500_000


@dataclass(frozen=True)
class ParsedIncidents:
    """Parsed lines; those that cannot be read are set apart, not dropped silently."""

    parsed: DataFrame

    @property
    def good(self) -> DataFrame:
        return self.parsed.filter("reject_reason IS NULL").drop("reject_reason", "line")

    @property
    def rejects(self) -> DataFrame:
        return self.parsed.filter("reject_reason IS NOT NULL").select(
            "row_id", "line", "reject_reason"
        )


def parse_lines(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """Type the fields of ``line``; ``reject_reason`` is NULL for usable lines.

    Keeps the latitude and longitude texts, since output repeats them as they were written.
    Missing fields behind the road name become NULL. Numbers may be padded with blanks; a
    bearing with a fraction is rejected.
    """
    others = [c for c in lines.columns if c != "line"]
    split = lines.withColumn("fields", F.split("line", re.escape(sep)))
    typed = [
        f"try_cast(get(fields, {i}) AS {field.dataType.simpleString()}) AS {field.name}"
        for i, field in enumerate(INCIDENT_SCHEMA)
    ]
    parsed = split.selectExpr(
        *others,
        "line",
        *typed,
        "get(fields, 0) AS lat_text",
        "get(fields, 1) AS lon_text",
        "size(fields) AS field_count",
    )
    reason = f"""CASE WHEN field_count < {REQUIRED_FIELDS} THEN 'missing field'
        WHEN lat IS NULL THEN 'bad latitude'
        WHEN lon IS NULL THEN 'bad longitude'
        WHEN bearing IS NULL THEN 'bad bearing' END"""
    kept = [c for c in parsed.columns if c not in ("line", "field_count")]
    return parsed.selectExpr(
        *kept, f"{reason} AS reject_reason", f"CASE WHEN {reason} IS NOT NULL THEN line END AS line"
    )


def read_incidents(
    spark: SparkSession,
    path: str,
    sep: str = "\t",
    min_partitions: int | None = None,
    workspace: Workspace | None = None,
) -> ParsedIncidents:
    """Read text files of incidents; ``row_id`` numbers the lines in file order from 0.

    The text is scanned once: parsed lines are saved as Parquet with the number of their split and their
    order within the task. The running line count of the splits, in order of file and position, gives
    the number of each split's first line. That table, three BIGINTs per split, is counted and
    broadcast, so that the lines are numbered where they lie; beyond ``BROADCAST_SPLITS`` splits it is joined.
    """
    ws = workspace or Workspace(spark)
    lines = spark.read.text(path).selectExpr(
        "value AS line",
        "_metadata.file_path AS file",
        "_metadata.file_block_start AS block",
        "xxhash64(_metadata.file_path, _metadata.file_block_start) AS split",
        "monotonically_increasing_id() AS seq",
    )
    parsed = ws.write(parse_lines(lines, sep), "parsed-lines")
    splits = parsed.groupBy("split").agg(
        F.min("file").alias("file"),
        F.min("block").alias("block"),
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("held"),
    )
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("held").over(before), F.lit(0))
    starts = ws.save(splits.select("split", "first_seq", start.alias("start")), "split-starts")
    few = starts.rows <= BROADCAST_SPLITS
    numbered = parsed.join(F.broadcast(starts.df) if few else starts.df, "split").selectExpr(
        "start + seq - first_seq AS row_id",
        *[c for c in parsed.columns if c not in ("file", "block", "split", "seq")],
    )
    if min_partitions:
        numbered = numbered.repartition(min_partitions)
    return ParsedIncidents(numbered)
