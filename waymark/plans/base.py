"""Common table expressions in DuckDB SQL for the views that queries start from."""

from __future__ import annotations

from waymark.functions.geo import AMBIGUITY_BANDS, DIRECTIONS_8, DIRECTIONS_16, DIST_BANDS

POIS = """pois AS (
  SELECT id, name, type_3, score, nation,
    (CASE WHEN r = 0 THEN ax WHEN r = 1 THEN ax + 0.5 WHEN r = 2 THEN ax + 1 + g % 29 WHEN r = 3 THEN ax + 31
      ELSE (id * 7919 + id * id * 31) % 3001 END)::DOUBLE AS x,
    (CASE WHEN r < 4 THEN ay ELSE (id * 104729 + id * id * id * 17) % 3011 END)::DOUBLE AS y,
    (CASE WHEN r = 0 THEN 1 + g % 4 ELSE 0 END)::INT AS priority
  FROM (SELECT *, CASE WHEN g % 3 = 0 THEN 240 * (((g * 7919 + g * g * 31) % 3001) // 240) + 108 ELSE (g * 7919 + g * g * 31) % 3001 END AS ax,
      (g * 104729 + g * g * g * 17) % 3011 AS ay
    FROM (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS type_3, c_acctbal AS score, c_nationkey AS nation,
      c_custkey % 10 AS r, c_custkey // 10 AS g FROM customer)))"""

ROADS = """roads AS (
  SELECT n_nationkey::BIGINT AS road_id, n_name AS road, n_nationkey % 2 = 0 AS v, 120.0::DOUBLE * (n_nationkey + 1) AS p,
    [35.0, 25.0, 15.0, 10.0, 6.0][n_regionkey + 1]::DOUBLE AS width FROM nation)"""

JUNCTIONS = """junctions AS (
  SELECT a.road || '/' || b.road AS name, a.p AS x, b.p AS y FROM roads a, roads b WHERE a.v AND NOT b.v)"""


def azimuth(dx: str, dy: str) -> str:
    turned = f"degrees(atan2({dx}, {dy}))"
    return (
        f"CASE WHEN {dx} <> 0 OR {dy} <> 0 THEN CASE WHEN {turned} < 0 THEN CASE WHEN {turned} + 360 >= 360 THEN 0.0 "
        f"ELSE {turned} + 360 END ELSE {turned} END END"
    )


def sector(az: str, names: tuple[str, ...]) -> str:
    w = 360 / len(names)
    out = f"CASE WHEN {az} BETWEEN {360 - w / 2} AND 360 OR {az} BETWEEN 0 AND {w / 2} THEN '{names[0]}'"
    for k, name in enumerate(names[1:], 1):
        out += f" WHEN {az} BETWEEN {w * (k - 0.5)} AND {w * (k + 0.5)} THEN '{name}'"
    return out + " END"


def dist_level(d: str) -> str:
    *inner, (last, most) = DIST_BANDS
    return "CASE " + " ".join(f"WHEN {d} < {end} THEN '{n}'" for n, end in inner) + f" WHEN {d} <= {most} THEN '{last}' END"


CANDIDATES = f"""candidates AS (
  SELECT *, {dist_level("distance")} AS dist_level, {sector("azimuth", DIRECTIONS_8)} AS direction_8,
    count(*) OVER (PARTITION BY landmark_id) AS poi_count
  FROM (SELECT l.id AS landmark_id, t.id AS target_id, l.x AS lx, l.y AS ly, t.x AS rx, t.y AS ry,
      sqrt((t.x - l.x) * (t.x - l.x) + (t.y - l.y) * (t.y - l.y)) AS distance,
      {azimuth("(t.x - l.x)", "(t.y - l.y)")} AS azimuth
    FROM pois l JOIN pois t ON l.priority > 0 AND t.priority = 0 AND l.id <> t.id) WHERE distance <= 1000)"""

TOPOLOGY = """on_roads AS (
  SELECT landmark_id, target_id, road_id, road, width, abs(CASE WHEN v THEN lx - p ELSE ly - p END) AS dl,
    abs(CASE WHEN v THEN rx - p ELSE ry - p END) AS dt, abs(CASE WHEN v THEN ly - ry ELSE lx - rx END) AS along,
    CASE WHEN v THEN p BETWEEN least(lx, rx) AND greatest(lx, rx) ELSE p BETWEEN least(ly, ry) AND greatest(ly, ry) END AS crossed
  FROM candidates, roads WHERE distance <= 500),
ranked50 AS (SELECT *, row_number() OVER (PARTITION BY landmark_id, target_id ORDER BY dl + dt, road_id) AS n FROM on_roads WHERE dl <= 50 OR dt <= 50),
ranked80 AS (SELECT *, row_number() OVER (PARTITION BY landmark_id, target_id ORDER BY dl + dt, road_id) AS n FROM on_roads WHERE dl <= 80 OR dt <= 80),
blocked AS (SELECT DISTINCT landmark_id, target_id FROM on_roads WHERE crossed),
corners AS (SELECT id, arg_min(name, (d, name)) AS corner FROM (
    SELECT t.id, j.name, sqrt((t.x - j.x) * (t.x - j.x) + (t.y - j.y) * (t.y - j.y)) AS d FROM pois t, junctions j) WHERE d <= 60 GROUP BY id),
classed AS (
  SELECT c.*, a.road AS road50, b.road AS road80, corner, CASE
      WHEN distance < 1 THEN 'Coincident'
      WHEN distance BETWEEN 1 AND 30 AND x.landmark_id IS NULL THEN 'Abutting'
      WHEN corner IS NOT NULL THEN 'Intersection'
      WHEN distance BETWEEN 30 AND 500 AND a.along <= 20 AND abs(a.dl + a.dt - a.width) < 10 AND a.dl > 0 AND a.dt > 0 THEN 'Opposite'
      WHEN distance BETWEEN 50 AND 500 AND b.along <= 200 AND b.dl > 1 AND b.dt > 1 THEN 'SameSide'
      ELSE 'Isolated' END AS topology,
    CASE WHEN poi_count >= 1000 THEN 5 WHEN poi_count >= 500 THEN 4 WHEN poi_count >= 200 THEN 3 ELSE 2 END AS max_keep
  FROM candidates c
  LEFT JOIN ranked50 a ON a.landmark_id = c.landmark_id AND a.target_id = c.target_id AND a.n = 1
  LEFT JOIN ranked80 b ON b.landmark_id = c.landmark_id AND b.target_id = c.target_id AND b.n = 1
  LEFT JOIN blocked x ON x.landmark_id = c.landmark_id AND x.target_id = c.target_id
  LEFT JOIN corners k ON k.id = c.target_id),
topology AS (SELECT *, CASE topology WHEN 'Intersection' THEN corner WHEN 'Opposite' THEN road50 WHEN 'SameSide' THEN road80 END AS road_name FROM classed)"""

#: Roads with bends, and their pieces with the length of the road before each.
BENT = """bent AS (
  SELECT road_id, road, width, CASE WHEN v THEN [(p, -200.0), (p + 60, 800.0), (p - 40 + 10 * (road_id % 5), 1900.0), (p + 30, 3400.0)]
    ELSE [(-200.0, p), (700.0, p + 50), (1800.0, p - 60), (3400.0, p + 20)] END::STRUCT(x DOUBLE, y DOUBLE)[] AS points FROM roads),
bent_ends AS (SELECT road_id, k, points[k].x AS x1, points[k].y AS y1, points[k + 1].x AS x2, points[k + 1].y AS y2 FROM (SELECT *, unnest([1, 2, 3]) AS k FROM bent)),
bent_pieces AS (SELECT *, sum(len) OVER (PARTITION BY road_id ORDER BY k) - len AS upto FROM (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM bent_ends)),
bent_feet AS (SELECT id, road_id, x, y, upto, x1, y1, x2, y2, len, least(len, greatest(0.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / len)) AS foot FROM pois, bent_pieces),
bent_places AS (SELECT id, road_id, min(d) AS d, arg_min(upto + foot, (d, upto + foot)) AS pos FROM (SELECT *,
    sqrt((x - (x1 + (x2 - x1) * (foot / len))) * (x - (x1 + (x2 - x1) * (foot / len))) + (y - (y1 + (y2 - y1) * (foot / len))) * (y - (y1 + (y2 - y1) * (foot / len)))) AS d
  FROM bent_feet) GROUP BY id, road_id),
bent_crossed AS (SELECT DISTINCT landmark_id, target_id, road_id FROM candidates, bent_pieces WHERE distance <= 30
  AND least(x1, x2) <= greatest(lx, rx) AND least(lx, rx) <= greatest(x1, x2) AND least(y1, y2) <= greatest(ly, ry) AND least(ly, ry) <= greatest(y1, y2)
  AND sign((x2 - x1) * (ly - y1) - (y2 - y1) * (lx - x1)) * sign((x2 - x1) * (ry - y1) - (y2 - y1) * (rx - x1)) <= 0
  AND sign((rx - lx) * (y1 - ly) - (ry - ly) * (x1 - lx)) * sign((rx - lx) * (y2 - ly) - (ry - ly) * (x2 - lx)) <= 0)"""

_BENT_ON = """on_roads AS (
  SELECT c.landmark_id, c.target_id, r.road_id, road, width, l.d AS dl, t.d AS dt, abs(l.pos - t.pos) AS along, x.road_id IS NOT NULL AS crossed
  FROM candidates c JOIN bent_places l ON l.id = c.landmark_id JOIN bent_places t ON t.id = c.target_id AND t.road_id = l.road_id JOIN bent r ON r.road_id = l.road_id
  LEFT JOIN bent_crossed x ON x.landmark_id = c.landmark_id AND x.target_id = c.target_id AND x.road_id = r.road_id WHERE distance <= 500),
ranked50 AS"""
BENT_TOPOLOGY = _BENT_ON + TOPOLOGY.split("ranked50 AS", 1)[1]

_CENTRE = "list_position([" + ", ".join(f"'{d}'" for d in DIRECTIONS_8) + "], direction_8) * 45 - 45"
_OFF = f"(abs(azimuth - ({_CENTRE})) % 360)"

LABELS = f"""labelled0 AS (
  SELECT *, CASE WHEN topology IN ('Coincident', 'Abutting', 'Intersection') THEN 'Implicit' ELSE 'Explicit' END AS combo_class,
    CASE WHEN (topology IN ('Opposite', 'Abutting') AND distance < 200) OR topology = 'Intersection' THEN {sector("azimuth", DIRECTIONS_16)}
      ELSE direction_8 END AS direction_16,
    coalesce(azimuth % 22.5 BETWEEN 20 AND 25, false) AS is_ambiguous,
    CASE WHEN direction_8 IS NOT NULL THEN CASE WHEN {_OFF} > 180 THEN 360 - {_OFF} ELSE {_OFF} END END AS deviation,
    coalesce(trim(road_name) <> '', false) AS has_road_ref FROM topology),
labelled1 AS (
  SELECT *, CASE WHEN deviation IS NULL THEN NULL {" ".join(f"WHEN deviation <= {b} THEN '{n}'" for n, b in AMBIGUITY_BANDS)} ELSE 'CROSS_BOUNDARY' END AS ambiguity_level,
    CASE WHEN topology IN ('Opposite', 'SameSide', 'Intersection') THEN CASE WHEN has_road_ref THEN 'SCENE-B' ELSE 'SCENE-E' END
      WHEN topology = 'Abutting' AND combo_class = 'Explicit' THEN 'SCENE-A' WHEN topology = 'Coincident' THEN 'SCENE-D'
      WHEN topology IN ('Isolated', 'Detour') OR combo_class = 'Implicit' THEN 'SCENE-C' ELSE 'SCENE-E' END AS scene_code FROM labelled0),
labelled AS (SELECT *, concat_ws('_', scene_code, topology, dist_level, coalesce(direction_8, 'None'), coalesce(ambiguity_level, 'EXACT')) AS template_key FROM labelled1)"""

KEPT = """kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY landmark_id, topology, dist_level ORDER BY distance, target_id) AS rn
  FROM labelled) WHERE rn <= max_keep)"""

PAIRS = f"WITH {POIS},\n{CANDIDATES}"
WITH_TOPOLOGY = f"WITH {POIS},\n{ROADS},\n{JUNCTIONS},\n{CANDIDATES},\n{TOPOLOGY}"
WITH_BENT_TOPOLOGY = f"WITH {POIS},\n{ROADS},\n{JUNCTIONS},\n{CANDIDATES},\n{BENT},\n{BENT_TOPOLOGY}"
RELATIONS = f"{WITH_TOPOLOGY},\n{LABELS},\n{KEPT}"
