from .selection import HotspotRun, dedupe_points, hotspots, hotspots_chunked

__all__ = ["HotspotRun", "dedupe_points", "hotspots", "hotspots_chunked"]
