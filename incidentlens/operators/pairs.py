"""Comparison of incidents that follow one another in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import fold_case, guarded_distance_miles
from ..workspace import Workspace
from .ordering import with_position


def consecutive(incidents: DataFrame, ws: Workspace) -> DataFrame:
    """Each incident with its successor in ``row_id`` order (columns with prefix ``n_``).

    Row ids may have gaps, as lines that cannot be read keep their numbers.
    """
    narrow = incidents.selectExpr(
        "row_id", f"{fold_case('partial_location')} AS loc_key", "lat", "lon", "bearing"
    )
    placed = ws.write(with_position(narrow, ws, "row_id"), "placed")
    following = placed.selectExpr(
        "position - 1 AS position", *[f"{c} AS n_{c}" for c in narrow.columns]
    )
    return placed.join(following, "position").drop("position")


def guarded_distances(incidents: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """Miles to the successor, -1 when it lies on another road."""
    ws = ws or Workspace(incidents.sparkSession)
    miles = guarded_distance_miles("loc_key", "lat", "lon", "n_loc_key", "n_lat", "n_lon")
    return consecutive(incidents, ws).selectExpr("row_id", "n_row_id AS next_id", f"{miles} AS miles")


def road_counts(incidents: DataFrame) -> DataFrame:
    """Incidents per road, names compared ignoring case."""
    roads = incidents.selectExpr(f"{fold_case('partial_location')} AS loc_key")
    return roads.groupBy("loc_key").count().withColumnRenamed("count", "incidents")
