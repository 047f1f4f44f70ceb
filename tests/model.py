"""Plain sequential restatements on small inputs, to compare the Spark jobs with."""

from __future__ import annotations

import hashlib
import math
import random

RADIUS_MILES = 6372.8 / 1.609344
SCHEMA = "row_id BIGINT, lat DOUBLE, lon DOUBLE, bearing INT, partial_location STRING"


def miles(p, q) -> float:
    a = (
        math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        + math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        * math.cos(math.radians(p[1]))
        * math.cos(math.radians(q[1]))
    )
    return 2 * RADIUS_MILES * math.asin(math.sqrt(a)) if a <= 1 else math.nan


def matches(p, q, mileage: float, limit: int = 60) -> bool:
    turn = abs((abs(p[3] - q[3]) + 180) % 360 - 180)
    return p[4].lower() == q[4].lower() and turn < limit and miles(p, q) <= mileage / 2


def greedy(rows, mileage: float, limit: int = 60) -> dict[int, int]:
    """row_id -> row_id of its owner, walking the rows in the given order."""
    kept, owner = [], {}
    for row in rows:
        first = next((k for k in kept if matches(k, row, mileage, limit)), None)
        if first is None:
            kept.append(row)
        owner[row[0]] = (first or row)[0]
    return owner


def fitness(owner: dict[int, int]) -> dict[int, int]:
    out = {kept: 0 for row, kept in owner.items() if row == kept}
    for row, kept in owner.items():
        out[kept] += row != kept
    return out


def sample_first(rows, pct: int, seed: int):
    """The rows in processing order: sample in digest order, then the rest by row_id."""
    digest = {r[0]: hashlib.md5(f"{r[0]}:{seed}".encode()).hexdigest() for r in rows}
    ordered = sorted(rows, key=lambda r: (digest[r[0]], r[0]))
    size = len(rows) * pct // 100
    return ordered[:size], sorted(ordered[size:])


def chunked(rows, chunk_of, pct: int, seed: int, mileage: float) -> dict[int, int]:
    """Fitness of the chunk-wise survivors, chunk by chunk and pair by pair."""
    sample, rest = sample_first(rows, pct, seed)
    owner = greedy(sample, mileage)
    kept = [r for r in sample if owner[r[0]] == r[0]]
    tail = []
    for row in rest:
        first = next((k for k in kept if matches(k, row, mileage)), None)
        if first is None:
            tail.append(row)
        else:
            owner[row[0]] = first[0]
    total = fitness(owner) if owner else {}
    parts = {}
    for chunk in sorted({chunk_of(r) for r in tail}):
        mine = [r for r in tail if chunk_of(r) == chunk]
        own = greedy(mine, mileage)
        counts = fitness(own)
        parts[chunk] = [[r, counts[r[0]]] for r in mine if own[r[0]] == r[0]]
    for chunk in sorted(parts):
        for src in parts[chunk]:
            gain = 0
            for other in (c for c in parts if c > chunk):
                hit = next((d for d in parts[other] if matches(src[0], d[0], mileage)), None)
                if hit:
                    gain += hit[1] + 1
                    parts[other].remove(hit)
            total[src[0][0]] = src[1] + gain
    return total


def random_rows(n: int, seed: int, roads: int = 3, span: float = 0.02, hot: int = 0):
    """``hot`` of the rows pile up within a few yards on one road."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        road = f"Road {rng.randrange(roads)}"
        lat, lon = 52 + rng.random() * span, -1.2 + rng.random() * span
        if i % n < hot:
            road, lat, lon = "ROAD 0", 52.001 + rng.random() * 2e-5, -1.199
        name = road.upper() if rng.random() < 0.5 else road
        rows.append((i, lat, lon, rng.randrange(360), name))
    ids = list(range(n))
    rng.shuffle(ids)
    return sorted((new, *row[1:]) for new, row in zip(ids, rows))
