"""The match rule: when two incidents stand for the same spot."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from .functions import EARTH_RADIUS_MILES

# Default heading limit in degrees (strict) and default strong-spot fitness (strict).
BEARING_LIMIT = 60
STRONG_FITNESS = 10


@dataclass(frozen=True)
class MatchRule:
    """Same road, at most ``mileage / 2`` miles apart, headings less than ``bearing_limit`` apart.

    ``mileage`` is a diameter. ``extra_keys`` are further columns that must be equal, strings
    ignoring case.
    """

    mileage: float
    bearing_limit: int = BEARING_LIMIT
    extra_keys: tuple[str, ...] = ()

    def __post_init__(self):
        if math.isnan(self.mileage):
            raise ValueError("mileage must be a number")
        if self.bearing_limit != int(self.bearing_limit):
            raise ValueError("bearing_limit counts whole degrees")
        object.__setattr__(self, "extra_keys", tuple(self.extra_keys))

    @property
    def radius_miles(self) -> float:
        return self.mileage / 2

    @property
    def keys(self) -> tuple[str, ...]:
        return ("loc_key", *self.extra_keys)

    @property
    def can_match(self) -> bool:
        """False when not even identical incidents match."""
        return self.radius_miles >= 0 and self.bearing_limit > 0

    @property
    def chord(self) -> float:
        """Straight-line distance on the unit sphere that corresponds to the radius."""
        return 2 * math.sin(min(self.radius_miles / (2 * EARTH_RADIUS_MILES), math.pi / 2))

    def also_equal(self, *columns: str) -> MatchRule:
        return replace(self, extra_keys=(*self.extra_keys, *columns))
