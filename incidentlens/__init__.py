"""Selection of traffic-incident hot spots with Spark DataFrames."""

from .plans import HotspotRun, dedupe_points, hotspots, hotspots_chunked
from .rule import MatchRule
from .sizes import Sizes
from .workspace import Workspace

__all__ = [
    "HotspotRun",
    "MatchRule",
    "Sizes",
    "Workspace",
    "dedupe_points",
    "hotspots",
    "hotspots_chunked",
]
