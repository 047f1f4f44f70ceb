from .geo import (
    EARTH_RADIUS_MILES,
    bearing_difference,
    double,
    guarded_distance_miles,
    haversine_miles,
    is_finite,
    unit_vector,
)
from .keys import fold_case, sample_digest

__all__ = [
    "EARTH_RADIUS_MILES",
    "bearing_difference",
    "double",
    "fold_case",
    "guarded_distance_miles",
    "haversine_miles",
    "is_finite",
    "sample_digest",
    "unit_vector",
]
