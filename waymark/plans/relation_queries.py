"""Queries on candidates, topology, labels and kept relations, and the evaluation of their shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo, lines
from waymark.operators import relations as rel
from waymark.operators import stats, tiles
from waymark.operators.spatial import distance_join, lines_near, near_any
from waymark.plans import base
from waymark.sources import tables

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(function):  # noqa: ANN001, ANN202
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rel.candidates(tables.pois(spark, sf))


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return rel.relations(tables.pois(spark, sf), tables.roads(spark, sf), tables.junctions(spark, sf), order=["distance", "target_id"])


def _r(name: str, digits: int = 6):  # noqa: ANN202
    return F.round(name, digits).alias(name)


@query(f"{base.PAIRS} SELECT direction_8, dist_level, count(*) AS n, round(sum(distance), 3) AS total_m FROM candidates GROUP BY ALL")
def relation_counts(spark, sf):
    """The flagship: candidate pairs by direction and band."""
    return _pairs(spark, sf).groupBy("direction_8", "dist_level").agg(F.count("*").alias("n"), F.round(F.sum("distance"), 3).alias("total_m"))


@query(f"{base.PAIRS} SELECT landmark_id, target_id, round(distance, 6) AS distance, round(azimuth, 6) AS azimuth, dist_level, direction_8 FROM candidates WHERE distance <= 300")
def distance_join_pairs(spark, sf):
    """J1 with G1-G4 at 300 m."""
    pairs = tiles.measured(tables.pois(spark, sf), 300.0)
    level, direction = geo.dist_level(F.col("distance")).alias("dist_level"), geo.direction_8(F.col("azimuth")).alias("direction_8")
    return pairs.select("landmark_id", "target_id", geo.rounded(F.col("distance")).alias("distance"), geo.rounded(F.col("azimuth")).alias("azimuth"), level, direction)


@query(f"""WITH {base.POIS} SELECT l.id AS a, t.id AS b FROM pois l JOIN pois t ON l.id < t.id
  AND sqrt((t.x - l.x) * (t.x - l.x) + (t.y - l.y) * (t.y - l.y)) <= 25""")
def distance_self_join_salted(spark, sf):
    pois = tables.pois(spark, sf)
    left = pois.select(F.col("id").alias("a"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = pois.select(F.col("id").alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return distance_join(left, right, 25.0, salts=4).filter("a < b").select("a", "b")


@query(f"""{base.PAIRS} SELECT landmark_id, poi_count, CASE WHEN poi_count >= 1000 THEN 5 WHEN poi_count >= 500 THEN 4 WHEN poi_count >= 200 THEN 3 ELSE 2 END AS max_keep
  FROM candidates GROUP BY ALL""")
def candidate_keep(spark, sf):
    """A1."""
    places = rel.with_keep(tables.pois(spark, sf)).filter("poi_count > 0")
    return places.select(F.col("id").alias("landmark_id"), "poi_count", "max_keep")


@query(f"{base.WITH_TOPOLOGY} SELECT topology, road_name, count(*) AS n, round(sum(distance), 3) AS total_m FROM topology GROUP BY ALL")
def topology_cascade(spark, sf):
    """G7-G12, J3-J8."""
    totals = rel.topology_totals(tables.pois(spark, sf), tables.roads(spark, sf), tables.junctions(spark, sf))
    return totals.select("topology", "road_name", "n", _r("total_m", 3))


@query(f"{base.WITH_BENT_TOPOLOGY} SELECT landmark_id, target_id, topology, road_name FROM topology WHERE distance <= 500")
def bent_road_topology(spark, sf):
    """J3, J6, J7, G8-G12, G14, G15 along roads with bends and oblique pieces, pair by pair."""
    pairs = rel.classed(tables.pois(spark, sf), tables.bent_roads(spark, sf), tables.junctions(spark, sf), within=500.0)
    return pairs.select("landmark_id", "target_id", "topology", "road_name")


@query(f"""WITH {base.POIS}, {base.ROADS}, {base.CANDIDATES}, {base.BENT}, whole AS (SELECT road_id, sum(len) AS size FROM bent_pieces GROUP BY road_id)
  SELECT id, road_id, round(d, 6) AS d, round(pos, 6) AS pos, round(pos / size, 6) AS fraction FROM bent_places JOIN whole USING (road_id) WHERE d <= 80""")
def located_on_roads(spark, sf):
    """Every place's nearest point on each bent road within 80 m: distance, length before it, share of the line."""
    places, roads = tables.pois(spark, sf), tables.bent_roads(spark, sf)
    held = roads.select("road_id", lines.segments(F.col("points")).alias("segs"))
    met = lines_near(places, roads, 80.0).select("id", "road_id").join(places.select("id", "x", "y"), "id").join(held, "road_id")
    at = lines.located(F.col("segs"), F.col("x"), F.col("y"))
    part = lines.fraction(F.col("segs"), F.col("x"), F.col("y"))
    return met.select("id", "road_id", F.round(at["d"], 6).alias("d"), F.round(at["pos"], 6).alias("pos"), F.round(part, 6).alias("fraction"))


@query(f"WITH {base.POIS}, {base.ROADS}, {base.CANDIDATES}, {base.BENT} SELECT * FROM bent_crossed")
def crossed_roads(spark, sf):
    """The bent roads that the straight line of a close pair crosses."""
    pairs = rel.candidates(tables.pois(spark, sf), 30.0).select("landmark_id", "target_id", "lx", "ly", "rx", "ry")
    places = tables.pois(spark, sf)
    near = lines_near(places, tables.bent_roads(spark, sf), 30.0).select(F.col("id").alias("landmark_id"), "road_id")  # a crossing is no farther than the pair
    met = pairs.join(near, "landmark_id").join(tables.bent_roads(spark, sf).select("road_id", lines.segments(F.col("points")).alias("segs")), "road_id")
    over = F.exists("segs", lambda s: lines.crosses(s, F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry")))
    return met.filter(over).select("landmark_id", "target_id", "road_id")


@query(f"""WITH {base.POIS}, {base.ROADS}, {base.CANDIDATES}, {base.BENT}, l AS (SELECT road_id, 0 AS line, CASE WHEN road_id % 3 = 2 THEN list_reverse(points) ELSE points END AS points FROM bent
    UNION ALL SELECT road_id, 1, [(0.0, 0.0), (1.0, road_id)]::STRUCT(x DOUBLE, y DOUBLE)[] FROM bent WHERE road_id % 2 = 0)
  SELECT road_id, line, list_transform(points, lambda p: p.x) AS xs, list_transform(points, lambda p: p.y) AS ys FROM l""")
def merged_lines(spark, sf):
    """The parts of a bent road, some turned round, are one line again; a part apart is a line of its own."""
    rows, k, p = tables.bent_roads(spark, sf), F.col("road_id"), F.col("points")
    a, b, c = F.slice(p, 1, 2), F.slice(p, 2, 2), F.slice(p, 3, 2)
    apart = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(1.0).alias("x"), k.cast("double").alias("y")))
    parts = F.when(k % 3 == 0, F.array(a, F.reverse(b), c)).when(k % 3 == 1, F.array(b, F.reverse(c), F.reverse(a))).otherwise(F.array(F.reverse(a), b, c))
    parts = F.when(k % 2 == 0, F.concat(parts, F.array(apart))).otherwise(parts)
    found = rows.select("road_id", F.posexplode(lines.merged(parts)).alias("line", "points"))
    return found.select("road_id", "line", F.transform("points", lambda q: q["x"]).alias("xs"), F.transform("points", lambda q: q["y"]).alias("ys"))


_COLUMNS = (
    "landmark_id", "target_id", "distance", "azimuth", "dist_level", "direction_8", "direction_16", "topology", "road_name", "combo_class",
    "is_ambiguous", "deviation", "ambiguity_level", "scene_code", "template_key", "has_road_ref",
)


@query(f"""{base.RELATIONS} SELECT {", ".join(f"round(k.{c}, 6) AS {c}" if c in ("distance", "azimuth", "deviation") else f"k.{c}" for c in _COLUMNS)},
  l.name AS landmark_name, l.type_3 AS landmark_type_3, t.name AS target_name, t.type_3 AS target_type_3
  FROM kept k JOIN pois l ON l.id = k.landmark_id JOIN pois t ON t.id = k.target_id""")
def spatial_relations(spark, sf):
    """The whole chain: W1 and J9 over the cascade, G5, G6, G13, G24-G28."""
    out = rel.with_attributes(_kept(spark, sf), tables.pois(spark, sf))
    return out.select(
        *(_r(c) if c in ("distance", "azimuth", "deviation") else F.col(c) for c in _COLUMNS),
        "landmark_name", "landmark_type_3", "target_name", "target_type_3",
    )


@query(f"""WITH {base.POIS}, {base.ROADS} SELECT id, road_id, round(d, 6) AS d FROM (
  SELECT id, road_id, abs(CASE WHEN v THEN x - p ELSE y - p END) AS d FROM pois, roads) WHERE d <= 50""")
def lines_near_points(spark, sf):
    """The kernel of J6 and J7."""
    return lines_near(tables.pois(spark, sf), tables.roads(spark, sf), 50.0).select("id", "road_id", _r("d"))


@query(f"""WITH {base.POIS}, {base.ROADS}, {base.JUNCTIONS} SELECT id, arg_min(name, (d, name)) AS near_name FROM (
  SELECT id, j.name, sqrt((p.x - j.x) * (p.x - j.x) + (p.y - j.y) * (p.y - j.y)) AS d FROM pois p, junctions j) WHERE d <= 60 GROUP BY id""")
def near_junction(spark, sf):
    """J4 and J5."""
    return near_any(tables.pois(spark, sf), tables.junctions(spark, sf), 60.0)


@query(f"""WITH {base.POIS}, {base.ROADS}, near AS (SELECT id, road_id, abs(CASE WHEN v THEN x - p ELSE y - p END) AS d FROM pois, roads)
  SELECT id, arg_min(road_id, (d, road_id)) AS road_id, round(min(d), 6) AS d FROM near WHERE d <= 250 GROUP BY id""")
def nearest_road(spark, sf):
    """The transfer of road measures to places: each place's nearest road."""
    near = lines_near(tables.pois(spark, sf), tables.roads(spark, sf), 250.0)
    return near.groupBy("id").agg(F.min_by("road_id", F.struct("d", "road_id")).alias("road_id"), F.round(F.min("d"), 6).alias("d"))


def _values(names) -> str:  # noqa: ANN001
    return ", ".join(f"('{n}', {k})" for k, n in enumerate(names))


def _distribution_sql(column: str, names, where: str = "kept", with_: str = base.RELATIONS) -> str:  # noqa: ANN001
    return f"""{with_}, wanted(name, ord) AS (VALUES {_values(names)}),
  counted AS (SELECT {column} AS name, count(*) AS n FROM {where} GROUP BY 1)
  SELECT wanted.name, ord, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS percent FROM wanted LEFT JOIN counted ON wanted.name = counted.name"""


def _distribution(df: DataFrame, column: str, names) -> DataFrame:  # noqa: ANN001
    return stats.distribution(df, column, names).withColumn("percent", F.round("percent", 6))


@query(_distribution_sql("direction_8", geo.DIRECTIONS_8))
def direction_distribution(spark, sf):
    """A2."""
    return _distribution(_kept(spark, sf), "direction_8", geo.DIRECTIONS_8)


@query(_distribution_sql("topology", geo.TOPOLOGIES))
def topology_distribution(spark, sf):
    """A12, with a class that never occurs."""
    return _distribution(_kept(spark, sf), "topology", geo.TOPOLOGIES)


@query(_distribution_sql("dist_level", [n for n, _ in geo.DIST_BANDS], "candidates", base.PAIRS))
def natural_distance_distribution(spark, sf):
    """Shares in the space of all candidates."""
    return _distribution(_pairs(spark, sf), "dist_level", [n for n, _ in geo.DIST_BANDS])


@query(f"{base.RELATIONS} SELECT coalesce(is_ambiguous, false) AS is_ambiguous, count(*) AS n FROM kept GROUP BY 1")
def ambiguity_flag_distribution(spark, sf):
    """A3."""
    return _kept(spark, sf).groupBy(F.coalesce("is_ambiguous", F.lit(False)).alias("is_ambiguous")).agg(F.count("*").alias("n"))


_EVALUATED = (("EXACT", 3.0), ("SLIGHT", 11.25), ("MODERATE", 22.5))


@query(f"""{base.RELATIONS} SELECT CASE WHEN deviation IS NULL THEN NULL WHEN deviation <= 3 THEN 'EXACT' WHEN deviation <= 11.25 THEN 'SLIGHT'
  WHEN deviation <= 22.5 THEN 'MODERATE' ELSE 'CROSS_BOUNDARY' END AS level, count(*) AS n FROM kept GROUP BY 1""")
def ambiguity_level_distribution(spark, sf):
    """A4, at the evaluation's own bands."""
    return _kept(spark, sf).groupBy(geo.ambiguity_level(F.col("deviation"), _EVALUATED).alias("level")).agg(F.count("*").alias("n"))


@query(f"""{base.RELATIONS} SELECT direction_8, {", ".join(f"count(*) FILTER (dist_level = '{n}') AS {n}, round(100.0 * count(*) FILTER (dist_level = '{n}') / count(*), 6) AS {n}_percent" for n, _ in geo.DIST_BANDS)}
  FROM kept WHERE direction_8 IS NOT NULL GROUP BY 1""")
def direction_distance_crosstab(spark, sf):
    """A5."""
    return stats.crosstab(_kept(spark, sf).filter("direction_8 is not null"), "direction_8", "dist_level", [n for n, _ in geo.DIST_BANDS])


@query(f"""{base.RELATIONS}, per AS (SELECT landmark_id, count(*) AS n FROM kept GROUP BY 1)
  SELECT (SELECT count(*) FROM kept) AS relations, (SELECT count(DISTINCT landmark_id) FROM kept) AS landmarks, (SELECT count(DISTINCT target_id) FROM kept) AS targets,
  (SELECT count(*) FROM pois WHERE priority > 0) AS all_landmarks, (SELECT count(*) FROM pois WHERE priority = 0) AS all_targets,
  round(avg(n), 6) AS avg_n, max(n) AS max_n, min(n) AS min_n, median(n)::DOUBLE AS median_n FROM per""")
def relation_scale(spark, sf):
    """A6."""
    kept, pois = _kept(spark, sf), tables.pois(spark, sf)
    scale = kept.agg(F.count("*").alias("relations"), F.count_distinct("landmark_id").alias("landmarks"), F.count_distinct("target_id").alias("targets"))
    whole = pois.agg(F.count_if(F.col("priority") > 0).alias("all_landmarks"), F.count_if(F.col("priority") == 0).alias("all_targets"))
    per = kept.groupBy("landmark_id").agg(F.count("*").alias("n"))
    per = per.agg(F.round(F.avg("n"), 6).alias("avg_n"), F.max("n").alias("max_n"), F.min("n").alias("min_n"), F.median("n").alias("median_n"))
    return stats.beside(scale, whole, per)


@query(f"""{base.PAIRS}, per AS (SELECT landmark_id, count(*) AS n FROM candidates GROUP BY 1)
  SELECT round(avg(n), 6) AS avg_n, max(n) AS max_n, min(n) AS min_n, quantile_cont(n, 0.5)::DOUBLE AS median_n, sum(n)::BIGINT AS pairs FROM per""")
def candidate_statistics(spark, sf):
    """A7."""
    per = tiles.counted(tables.pois(spark, sf), rel.RADIUS)
    return per.agg(
        F.round(F.avg("n"), 6).alias("avg_n"), F.max("n").alias("max_n"), F.min("n").alias("min_n"),
        F.expr("percentile_cont(0.5) within group (order by n)").alias("median_n"), F.sum("n").alias("pairs"),
    )


@query(f"""{base.RELATIONS} SELECT round(avg(distance), 2) AS mean, round(median(distance), 2) AS median, round(min(distance), 2) AS min,
  round(max(distance), 2) AS max, round(stddev_samp(distance), 2) AS sd FROM kept""")
def distance_statistics(spark, sf):
    """A8."""
    d = F.col("distance")
    made = {"mean": F.avg(d), "median": F.median(d), "min": F.min(d), "max": F.max(d), "sd": F.stddev_samp(d)}
    return _kept(spark, sf).agg(*(F.round(v, 2).alias(k) for k, v in made.items()))


@query(f"""{base.RELATIONS} SELECT count(*) AS total, count(*) FILTER (direction_8 IS DISTINCT FROM ({base.sector("azimuth", geo.DIRECTIONS_8)})) AS direction_errors,
  count(*) FILTER (dist_level IS DISTINCT FROM ({base.dist_level("distance")})) AS level_errors, count(*) FILTER (azimuth < 0 OR azimuth >= 360) AS azimuth_errors,
  count(*) FILTER (distance < 0 OR distance > 1000) AS distance_errors, count(*) FILTER (rx NOT BETWEEN 0 AND 3000 OR ry NOT BETWEEN 0 AND 3000) AS box_errors,
  count(*) FILTER (azimuth IS NULL) AS null_azimuths FROM kept""")
def relation_consistency(spark, sf):
    """Stored labels against recomputed ones, ranges and nulls."""
    az, d = F.col("azimuth"), F.col("distance")
    return _kept(spark, sf).agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("direction_8").eqNullSafe(geo.direction_8(az))).alias("direction_errors"),
        F.count_if(~F.col("dist_level").eqNullSafe(geo.dist_level(d))).alias("level_errors"),
        F.count_if((az < 0) | (az >= 360)).alias("azimuth_errors"),
        F.count_if((d < 0) | (d > 1000)).alias("distance_errors"),
        F.count_if(~geo.in_box(F.col("rx"), F.col("ry"), 0, 3000, 0, 3000)).alias("box_errors"),
        F.count_if(az.isNull()).alias("null_azimuths"),
    )


def _entropy_sql(column: str, classes: int) -> str:
    return f"""{base.RELATIONS}, counted AS (SELECT {column} AS name, count(*)::DOUBLE AS n FROM kept WHERE {column} IS NOT NULL GROUP BY 1),
  shares AS (SELECT n / sum(n) OVER () AS p FROM counted)
  SELECT '{column}' AS name, round(coalesce(-sum(p * ln(p)) / nullif(ln(count(*)), 0), 0), 6) AS entropy FROM shares"""


@query(" UNION ALL ".join(f"SELECT * FROM ({_entropy_sql(c, 0)})" for c in ("direction_8", "dist_level", "topology")))
def relation_entropy(spark, sf):
    """Normalised entropies of three classes."""
    kept = _kept(spark, sf)
    out = None
    for column in ("direction_8", "dist_level", "topology"):
        counted = kept.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        one = stats.entropy(counted, "n").select(F.lit(column).alias("name"), F.round("entropy", 6).alias("entropy"))
        out = one if out is None else out.union(one)
    return out


@query(f"""{base.RELATIONS}, wild AS (SELECT direction_8 AS name, count(*)::DOUBLE AS n FROM candidates WHERE direction_8 IS NOT NULL GROUP BY 1),
  ours AS (SELECT direction_8 AS name, count(*)::DOUBLE AS n FROM kept WHERE direction_8 IS NOT NULL GROUP BY 1)
  SELECT name, round(o.n / (SELECT sum(n) FROM ours), 6) AS share, round(a.n / (SELECT sum(n) FROM wild), 6) AS natural_share,
  round(o.n / (SELECT sum(n) FROM ours) - a.n / (SELECT sum(n) FROM wild), 6) AS shift FROM wild a JOIN ours o USING (name)""")
def sampling_balance(spark, sf):
    """Shares of kept relations against those in the space of all candidates."""
    return stats.share_shift(_kept(spark, sf), tiles.directed(tables.pois(spark, sf), rel.RADIUS), "direction_8")


@query(f"""{base.RELATIONS}, ranked AS (SELECT landmark_id, target_id, topology, row_number() OVER (PARTITION BY topology ORDER BY distance, landmark_id, target_id) AS n,
    count(*) OVER (PARTITION BY topology) AS size, count(*) OVER () AS total FROM kept)
  SELECT landmark_id, target_id, topology FROM ranked WHERE n <= least(size, greatest(30, round_even(2000.0 * size / total, 0)))""")
def stratified_sample(spark, sf):
    """S5."""
    order = ["distance", "landmark_id", "target_id"]
    return stats.stratified_sample(_kept(spark, sf), "topology", 2000, 30, order).select("landmark_id", "target_id", "topology")


@query(f"""{base.RELATIONS} SELECT quality, count(*) AS n FROM (SELECT CASE WHEN (dist_level = 'VeryClose' AND distance > 50) OR (dist_level = 'Close' AND distance > 200)
  OR (dist_level = 'Medium' AND distance > 500) OR (dist_level = 'Far' AND distance < 500) OR azimuth IS NULL OR azimuth < 0 OR azimuth >= 360 THEN 'SUSPECT' ELSE 'VALID' END AS quality FROM kept) GROUP BY 1""")
def relation_quality(spark, sf):
    """F29."""
    label = geo.relation_quality(F.col("dist_level"), F.col("distance"), F.col("azimuth"), F.col("topology"))
    return _kept(spark, sf).groupBy(label.alias("quality")).agg(F.count("*").alias("n"))


@query(f"""{base.WITH_TOPOLOGY}, {base.LABELS} SELECT landmark_id, target_id, topology, dist_level FROM (SELECT *, row_number() OVER (PARTITION BY landmark_id, topology, dist_level
  ORDER BY md5(landmark_id || '-' || target_id || '-42'), target_id) AS rn FROM labelled) WHERE rn <= max_keep""")
def relations_hash_choice(spark, sf):
    """W1 with a seeded hash order, one that SQL has."""
    order = [F.md5(F.concat_ws("-", "landmark_id", "target_id", F.lit(42))), F.col("target_id")]
    kept = rel.relations(tables.pois(spark, sf), tables.roads(spark, sf), tables.junctions(spark, sf), order=order, rank=tiles.by_md5(42))
    return kept.select("landmark_id", "target_id", "topology", "dist_level")


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, name, n, percent FROM ({_distribution_sql(c, names)})" for k, c, names in (
    ("direction", "direction_8", geo.DIRECTIONS_8), ("distance", "dist_level", [n for n, _ in geo.DIST_BANDS]), ("topology", "topology", geo.TOPOLOGIES),
    ("ambiguity", "ambiguity_level", [*(n for n, _ in geo.AMBIGUITY_BANDS), "CROSS_BOUNDARY"]))))
def distribution_bundle(spark, sf):
    """The tables of the distribution workbook, one below the other."""
    made = rel.distribution_bundle(_kept(spark, sf))
    out = None
    for kind in ("direction", "distance", "topology", "ambiguity"):
        one = made[kind].select(F.lit(kind).alias("kind"), "name", "n", F.round("percent", 6).alias("percent"))
        out = one if out is None else out.union(one)
    return out
