"""Geometry as native Spark SQL expressions (no UDF, so they stay in generated code).

Each function takes and returns SQL text, for ``F.expr`` / ``selectExpr``. A distance has some
forty nodes; as text it reaches the JVM in one call, node by node it would take dozens.
"""

from __future__ import annotations

import math

# Sphere radius in kilometres and kilometres per mile.
EARTH_RADIUS_KM = 6372.8
KM_PER_MILE = 1.609344

EARTH_RADIUS_MILES = EARTH_RADIUS_KM / KM_PER_MILE


def double(value: float) -> str:
    """A DOUBLE literal that keeps every bit."""
    if math.isinf(value):
        return f"double('{'-' if value < 0 else ''}infinity')"
    return f"{value!r}D"


def haversine_miles(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance in miles between two points given in degrees."""
    north = f"pow(sin(radians({lat2} - {lat1}) / 2), 2)"
    east = f"pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    shrink = f"cos(radians({lat1})) * cos(radians({lat2}))"
    return f"{double(2 * EARTH_RADIUS_MILES)} * asin(sqrt({north} + {shrink} * {east}))"


def guarded_distance_miles(
    key1: str, lat1: str, lon1: str, key2: str, lat2: str, lon2: str
) -> str:
    """Distance in miles, or -1 when the two points lie on different roads."""
    miles = haversine_miles(lat1, lon1, lat2, lon2)
    return f"CASE WHEN {key1} = {key2} THEN {miles} ELSE -1D END"


def bearing_difference(bearing1: str, bearing2: str) -> str:
    """Angle between two whole-degree headings, 0 to 180; 350 and 10 differ by 20."""
    turn = f"pmod(bigint({bearing1}) - {bearing2}, 360)"
    return f"least({turn}, 360 - {turn})"


def unit_vector(lat: str, lon: str) -> dict[str, str]:
    """Point on the unit sphere; free of special cases at the poles and the date line."""
    return {
        "x": f"cos(radians({lat})) * cos(radians({lon}))",
        "y": f"cos(radians({lat})) * sin(radians({lon}))",
        "z": f"sin(radians({lat}))",
    }


def is_finite(lat: str, lon: str) -> str:
    """NaN sorts above every number, so one comparison rules out NaN and both infinities."""
    top = double(math.inf)
    return f"abs({lat}) < {top} AND abs({lon}) < {top}"
