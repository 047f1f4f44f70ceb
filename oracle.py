"""DuckDB SQL for every query.

Greedy suppression is written as the plain sequential walk (a recursive query per road that
appends a row unless it matches a kept one), so it shares nothing with the grid joins and rounds
of the Spark side.
"""

from __future__ import annotations

import math

from fixture import CHUNKS, INCIDENTS_SQL, MANY_CHUNKS, MILEAGE, PCT, SEED, SHARP_SQL

from incidentlens.functions import EARTH_RADIUS_MILES

RADIUS = MILEAGE / 2
LIMIT = 60

INCIDENTS = f"""
inc AS (SELECT *, lower(upper(partial_location)) AS loc_key FROM ({INCIDENTS_SQL})),
ranked AS (
  SELECT *, md5(concat(CAST(row_id AS STRING), ':{SEED}')) AS digest, count(*) OVER () AS n,
         row_number() OVER (ORDER BY md5(concat(CAST(row_id AS STRING), ':{SEED}')), row_id) AS pos
  FROM inc),
marked AS (
  SELECT *, pos <= n * {PCT} // 100 AS sampled, row_id * {CHUNKS} // n AS chunk_id FROM ranked)
"""


def miles(p: str, q: str) -> str:
    return (
        f"{2 * EARTH_RADIUS_MILES!r}e0 * asin(sqrt("
        f"pow(sin(radians({q}.lat - {p}.lat) / 2), 2) + pow(sin(radians({q}.lon - {p}.lon) / 2), 2)"
        f" * cos(radians({p}.lat)) * cos(radians({q}.lat))))"
    )


def turn(p: str, q: str) -> str:
    return f"abs((abs({p}.bearing - {q}.bearing) + 180) % 360 - 180)"


def match(p: str, q: str) -> str:
    return f"{miles(p, q)} <= {RADIUS!r}e0 AND {turn(p, q)} < {LIMIT}"


def walk(name: str, source: str, group: str, order: str) -> str:
    """CTEs ending in ``name(grp, row_id, kept, owner_id)``: the sequential greedy pass."""
    return f"""
{name}_seq AS (
  SELECT *, {group} AS grp, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS i
  FROM {source}),
{name}_adj AS (
  SELECT p.grp, p.i, p.row_id, coalesce(list(q.i) FILTER (WHERE q.i IS NOT NULL), []) AS lower
  FROM {name}_seq p LEFT JOIN {name}_seq q
    ON q.grp = p.grp AND q.i < p.i AND {match("p", "q")}
  GROUP BY p.grp, p.i, p.row_id),
{name}_walk AS (
  SELECT DISTINCT grp, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept FROM {name}_seq
  UNION ALL
  SELECT w.grp, a.i,
         CASE WHEN list_has_any(a.lower, w.kept) THEN w.kept ELSE list_append(w.kept, a.i) END
  FROM {name}_walk w JOIN {name}_adj a ON a.grp = w.grp AND a.i = w.i + 1),
{name}_end AS (SELECT grp, arg_max(kept, i) AS kept FROM {name}_walk GROUP BY grp),
{name}_own AS (
  SELECT a.grp, a.row_id, list_contains(e.kept, a.i) AS kept,
         CASE WHEN list_contains(e.kept, a.i) THEN a.i
              ELSE list_min(list_intersect(a.lower, e.kept)) END AS owner_i
  FROM {name}_adj a JOIN {name}_end e ON e.grp = a.grp),
{name} AS (
  SELECT o.grp, o.row_id, o.kept, s.row_id AS owner_id
  FROM {name}_own o JOIN {name}_seq s ON s.grp = o.grp AND s.i = o.owner_i)
"""


def query(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


# Sample first, then the rest in file order.
FULL_ORDER = "CASE WHEN sampled THEN 0 ELSE 1 END, CASE WHEN sampled THEN digest END, row_id"
EXACT = [INCIDENTS, walk("greedy", "marked", "loc_key", FULL_ORDER)]
WHOLE = [INCIDENTS, walk("greedy", "marked", "loc_key", "row_id")]

SAMPLE = [
    INCIDENTS,
    "sample AS (SELECT * FROM marked WHERE sampled)",
    walk("thin", "sample", "loc_key", "digest, row_id"),
    "kept AS (SELECT m.* FROM marked m JOIN thin t ON t.row_id = m.row_id AND t.kept)",
]
# An incident that is a suppressor matches no other one but itself.
OWNED = [
    *SAMPLE,
    f"""owned AS (
  SELECT p.row_id, p.lat, p.lon, p.sampled, p.chunk_id,
         arg_min(k.row_id, (k.digest, k.row_id)) AS owner_id,
         arg_min(k.row_id, ({miles("k", "p")}, k.digest, k.row_id)) AS nearest_id
  FROM marked p LEFT JOIN kept k ON k.loc_key = p.loc_key AND {match("k", "p")}
  GROUP BY p.row_id, p.lat, p.lon, p.sampled, p.chunk_id)""",
]
SURVIVORS = [
    *EXACT,
    """survivors AS (
  SELECT m.row_id, m.lat, m.lon, CASE WHEN m.sampled THEN 'sample' ELSE 'rest' END AS stage,
         f.members - 1 AS fitness
  FROM (SELECT owner_id, count(*) AS members FROM greedy GROUP BY owner_id) f
  JOIN marked m ON m.row_id = f.owner_id)""",
]


def chunked(source: str, before: list[str], chunks: int = CHUNKS) -> list[str]:
    """CTEs ending in ``local`` (survivors per chunk), ``edges`` and ``merged``."""
    return [
        *before,
        walk("inner_walk", source, "concat(loc_key, '#', CAST(chunk_id AS STRING))", "row_id"),
        f"""local AS (
  SELECT m.*, f.members - 1 AS fitness
  FROM (SELECT owner_id, count(*) AS members FROM inner_walk GROUP BY owner_id) f
  JOIN {source} m ON m.row_id = f.owner_id)""",
        f"""edges AS (
  SELECT p.loc_key, p.row_id AS src_id, q.row_id AS dst_id, q.chunk_id AS dst_chunk
  FROM local p JOIN local q
    ON q.loc_key = p.loc_key AND p.chunk_id < q.chunk_id AND {match("p", "q")})""",
        """edge_seq AS (
  SELECT *, row_number() OVER (PARTITION BY loc_key ORDER BY src_id, dst_id) AS j FROM edges)""",
        f"""edge_walk AS (
  SELECT DISTINCT loc_key, CAST(0 AS BIGINT) AS j, CAST([] AS BIGINT[]) AS gone,
         CAST([] AS BIGINT[]) AS slots, CAST([] AS BIGINT[]) AS taken
  FROM edge_seq
  UNION ALL
  SELECT w.loc_key, e.j,
         CASE WHEN free THEN list_append(w.gone, e.dst_id) ELSE w.gone END,
         CASE WHEN free THEN list_append(w.slots, e.slot) ELSE w.slots END,
         CASE WHEN free THEN list_append(w.taken, e.j) ELSE w.taken END
  FROM edge_walk w
  JOIN (SELECT *, src_id * {chunks} + dst_chunk AS slot FROM edge_seq) e
    ON e.loc_key = w.loc_key AND e.j = w.j + 1
  CROSS JOIN LATERAL (
    SELECT NOT list_contains(w.gone, e.dst_id) AND NOT list_contains(w.gone, e.src_id)
           AND NOT list_contains(w.slots, e.slot) AS free))""",
        """edge_end AS (SELECT loc_key, arg_max(taken, j) AS taken FROM edge_walk GROUP BY loc_key),
taken AS (
  SELECT s.src_id, s.dst_id FROM edge_seq s JOIN edge_end e
    ON e.loc_key = s.loc_key AND list_contains(e.taken, s.j)),
merged AS (
  SELECT l.row_id, l.lat, l.lon, l.chunk_id,
         CAST(l.fitness + coalesce(g.gain, 0) AS BIGINT) AS fitness
  FROM local l
  LEFT JOIN (SELECT t.src_id, sum(d.fitness + 1) AS gain
             FROM taken t JOIN local d ON d.row_id = t.dst_id GROUP BY t.src_id) g
    ON g.src_id = l.row_id
  WHERE l.row_id NOT IN (SELECT dst_id FROM taken))""",
    ]


CHUNK_WHOLE = chunked("marked", [INCIDENTS])
CHUNK_MANY = chunked(
    "many",
    [INCIDENTS, f"many AS (SELECT * REPLACE (row_id * {MANY_CHUNKS} // n AS chunk_id) FROM marked)"],
    MANY_CHUNKS,
)
CHUNK_TAIL = chunked(
    "tail",
    [
        *OWNED,
        "tail AS (SELECT m.* FROM marked m JOIN owned o ON o.row_id = m.row_id "
        "AND o.owner_id IS NULL)",
    ],
)


def pair_rows(condition: str, columns: str = "") -> str:
    return f"""
SELECT p.row_id, k.row_id AS suppressor_id, round({miles("k", "p")}, 6) AS miles {columns}
FROM marked p JOIN kept k
  ON k.loc_key = p.loc_key AND k.row_id <> p.row_id AND {condition}"""


def head_edges() -> str:
    """Lowest row per narrow cell and heading sector, against the higher rows it matches."""
    # Side of a cube whose diagonal is the matching distance, less a millionth.
    side = 2 * math.sin(RADIUS / (2 * EARTH_RADIUS_MILES)) * (1 - 1e-6) / math.sqrt(3.0)
    place = [f"floor({axis} / {side!r})" for axis in "xyz"]
    groups = ", ".join(["loc_key", *place, f"bearing // {LIMIT}"])
    return query(
        [
            INCIDENTS,
            """placed AS (
  SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y,
         sin(radians(lat)) AS z FROM marked)""",
            f"heads AS (SELECT min(row_id) AS row_id FROM placed GROUP BY {groups})",
        ],
        f"""SELECT h.row_id AS src_id, q.row_id AS dst_id
FROM heads JOIN marked h USING (row_id) JOIN marked q
  ON q.loc_key = h.loc_key AND q.row_id > h.row_id AND {match("h", "q")}""",
    )


def statements() -> dict[str, str]:
    keyed = [
        INCIDENTS,
        "sample AS (SELECT * FROM marked WHERE sampled)",
        walk("thin", "sample", "concat(loc_key, '#', weekday)", "digest, row_id"),
        SAMPLE[-1],
    ]
    credits = "SELECT owner_id, count(*) AS fitness FROM owned WHERE owner_id <> row_id {} GROUP BY 1"
    with_zero = "SELECT k.row_id, {} coalesce(c.fitness, 0) AS fitness FROM kept k LEFT JOIN ({}) c ON c.owner_id = k.row_id"
    survivor_columns = "row_id, lat, lon, fitness"
    rejects = """SELECT row_id, CASE row_id % 50 WHEN 0 THEN 'missing field' WHEN 1 THEN 'bad latitude'
WHEN 2 THEN 'bad longitude' ELSE 'bad bearing' END AS reject_reason FROM inc WHERE row_id % 50 < 4"""
    parsed = """SELECT row_id, lat, lon, bearing,
CASE WHEN row_id % 50 = 4 THEN '' ELSE partial_location END AS partial_location
FROM inc WHERE row_id % 50 >= 4"""
    merged_all = f"""
SELECT {survivor_columns} FROM merged WHERE fitness <> 0
UNION ALL
SELECT k.row_id, k.lat, k.lon, c.fitness FROM kept k JOIN ({credits.format("")}) c
  ON c.owner_id = k.row_id"""
    return {
        "scan_incidents": query(
            [INCIDENTS], "SELECT row_id, lat, lon, bearing, partial_location, weekday FROM inc"
        ),
        "parse_incident_lines": query([INCIDENTS], parsed),
        "incident_rejects": query([INCIDENTS], rejects),
        "incident_order": query(
            [INCIDENTS],
            "SELECT row_id, loc_key, row_number() OVER (ORDER BY loc_key, row_id) - 1 AS position "
            "FROM inc",
        ),
        "hotspots_output": query(
            SURVIVORS, "SELECT lat, lon, fitness FROM survivors WHERE fitness <> 0"
        ),
        "hotspots_strong": query(
            SURVIVORS, "SELECT lat, lon, fitness FROM survivors WHERE fitness > 10"
        ),
        "run_summary": query(
            SURVIVORS,
            "SELECT count(*) AS candidates, count(*) FILTER (WHERE fitness <> 0) AS final, "
            "count(*) FILTER (WHERE fitness > 10) AS strong, "
            "CAST(sum(fitness) AS BIGINT) AS suppressed FROM survivors",
        ),
        "road_counts": query(
            [INCIDENTS], "SELECT loc_key, count(*) AS incidents FROM inc GROUP BY loc_key"
        ),
        "pair_distance": query(
            OWNED,
            f"""SELECT p.row_id, k.row_id AS suppressor_id, round({miles("k", "p")}, 6) AS miles
FROM owned o JOIN marked p ON p.row_id = o.row_id JOIN kept k ON k.row_id = o.owner_id
WHERE k.row_id <> p.row_id""",
        ),
        "guarded_distance": query(
            [INCIDENTS],
            f"""SELECT p.row_id, q.row_id AS next_id,
CASE WHEN p.loc_key = q.loc_key THEN round({miles("p", "q")}, 6) ELSE -1e0 END AS miles
FROM inc p JOIN inc q ON q.row_id = p.row_id + 1""",
        ),
        "near_pairs": query(
            SAMPLE,
            pair_rows(
                f"{miles('k', 'p')} <= {RADIUS!r}e0", f", CAST({turn('k', 'p')} AS BIGINT) AS turn"
            ),
        ),
        "bearing_pairs": query(
            SAMPLE,
            f"""SELECT p.row_id, k.row_id AS suppressor_id,
CAST({turn("k", "p")} AS BIGINT) AS turn
FROM marked p JOIN kept k ON k.loc_key = p.loc_key AND k.row_id <> p.row_id AND {match("k", "p")}""",
        ),
        "match_pairs": query(SAMPLE, pair_rows(match("k", "p"))),
        "match_pairs_keyed": query(keyed, pair_rows(match("k", "p") + " AND k.weekday = p.weekday")),
        "hotspots_nonzero": query(
            SURVIVORS, "SELECT row_id, stage, fitness FROM survivors WHERE fitness <> 0"
        ),
        "sample_size": query(
            [INCIDENTS],
            f"SELECT count(*) AS incidents, count(*) * {PCT} // 100 AS sample_size FROM inc",
        ),
        "suppressor_sample": query(
            [INCIDENTS], "SELECT row_id, digest FROM marked WHERE sampled"
        ),
        "to_be_reduced": query(
            [INCIDENTS], "SELECT row_id, lat, lon FROM marked WHERE NOT sampled"
        ),
        "match_edges": head_edges(),
        "assign_first": query(
            OWNED, "SELECT row_id, owner_id FROM owned WHERE owner_id IS NOT NULL"
        ),
        "assign_nearest": query(
            OWNED,
            "SELECT row_id, nearest_id AS owner_id FROM owned WHERE nearest_id IS NOT NULL",
        ),
        "unmatched_points": query(
            OWNED, "SELECT row_id, lat, lon FROM owned WHERE owner_id IS NULL"
        ),
        "chunk_edges": query(CHUNK_WHOLE, "SELECT src_id, dst_id FROM edges"),
        "incident_count": query([INCIDENTS], "SELECT count(*) AS incidents FROM inc"),
        "fitness_counts": query(OWNED, credits.format("")),
        "fitness_merged": query(OWNED, with_zero.format("", credits.format(""))),
        "greedy_suppress": query(WHOLE, "SELECT row_id, kept, owner_id FROM greedy"),
        "dedupe_along_roads": query(
            [INCIDENTS, walk("greedy", "marked", "loc_key", "partial_location, lat, row_id")],
            "SELECT row_id, kept, owner_id FROM greedy",
        ),
        "first_round": query(
            [INCIDENTS],
            f"""SELECT p.row_id FROM marked p WHERE NOT EXISTS (
  SELECT 1 FROM marked q WHERE q.loc_key = p.loc_key AND q.row_id < p.row_id AND {match("p", "q")})""",
        ),
        "match_degree": query(
            [INCIDENTS],
            f"""SELECT p.row_id, count(q.row_id) AS degree FROM inc p
LEFT JOIN inc q ON q.loc_key = p.loc_key AND q.row_id <> p.row_id AND {match("p", "q")} GROUP BY p.row_id""",
        ),
        "assign_first_salted": query(
            OWNED, "SELECT row_id, owner_id FROM owned WHERE owner_id IS NOT NULL"
        ),
        "suppressor_sample_prefix": query(
            [INCIDENTS], "SELECT row_id, digest FROM marked WHERE sampled"
        ),
        "road_counts_sharp": query(
            [INCIDENTS, f"incidents AS (SELECT * FROM inc), sharp AS ({SHARP_SQL})"],
            "SELECT lower(partial_location) AS loc_key, count(*) AS incidents FROM sharp GROUP BY 1",
        ),
        "guarded_distance_gaps": query(
            [
                INCIDENTS,
                f"""parsed AS ({parsed}),
placed AS (SELECT *, lower(partial_location) AS road, row_number() OVER (ORDER BY row_id) AS i FROM parsed)""",
            ],
            f"""SELECT p.row_id, q.row_id AS next_id,
CASE WHEN p.road = q.road THEN round({miles("p", "q")}, 6) ELSE -1e0 END AS miles
FROM placed p JOIN placed q ON q.i = p.i + 1""",
        ),
        "suppressors_clean": query(
            OWNED, with_zero.format("k.lat, k.lon,", credits.format("AND sampled"))
        ),
        "fitness_after_assign": query(OWNED, with_zero.format("", credits.format(""))),
        "suppressed_totals": query(
            EXACT,
            """SELECT count(*) FILTER (WHERE m.sampled) AS within_sample,
count(*) FILTER (WHERE o.sampled) AS by_sample, count(*) FILTER (WHERE NOT o.sampled) AS by_rest,
count(*) AS total
FROM greedy g JOIN marked m ON m.row_id = g.row_id JOIN marked o ON o.row_id = g.owner_id
WHERE NOT g.kept""",
        ),
        "chunk_suppress": query(
            CHUNK_WHOLE, "SELECT row_id, chunk_id, fitness FROM local"
        ),
        "chunk_merge_many": query(CHUNK_MANY, "SELECT row_id, chunk_id, fitness FROM merged"),
        "chunk_merge": query(CHUNK_WHOLE, "SELECT row_id, chunk_id, fitness FROM merged"),
        "conservation_check": query(
            SURVIVORS,
            """, totals AS (SELECT (SELECT count(*) FROM inc) AS incidents, count(*) AS survivors,
CAST(sum(fitness) AS BIGINT) AS suppressed FROM survivors)
SELECT *, incidents - suppressed AS raw_spots, incidents - suppressed = survivors AS conserved
FROM totals""",
        ),
        "all_suppressors": query(
            SURVIVORS, "SELECT row_id, lat, lon, stage, fitness FROM survivors"
        ),
        "hotspots_exact": query(
            SURVIVORS, f"SELECT {survivor_columns} FROM survivors WHERE fitness <> 0"
        ),
        "hotspots_chunked": query(CHUNK_TAIL, merged_all),
        "hotspots_no_sample": query(
            [
                *WHOLE,
                """survivors AS (
  SELECT m.row_id, m.lat, m.lon, f.members - 1 AS fitness
  FROM (SELECT owner_id, count(*) AS members FROM greedy GROUP BY owner_id) f
  JOIN marked m ON m.row_id = f.owner_id)""",
            ],
            f"SELECT {survivor_columns} FROM survivors WHERE fitness <> 0",
        ),
    }
