from .incidents import INCIDENT_SCHEMA, ParsedIncidents, parse_lines, read_incidents
from .sinks import read_hotspots, write_hotspots

__all__ = [
    "INCIDENT_SCHEMA",
    "ParsedIncidents",
    "parse_lines",
    "read_hotspots",
    "read_incidents",
    "write_hotspots",
]
