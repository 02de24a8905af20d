"""Landmark-to-target relations: candidates, topology against roads and junctions, labels, deterministic top-k."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import tallies, tiles
from waymark.operators.spatial import distance_join, near_any
from waymark.operators.staging import staged

RADIUS = 1000.0
JUNCTION_RADIUS = 60.0
# How many relations of a class a landmark keeps, by its number of candidates.
KEEP_BANDS = ((1000, 5), (500, 4), (200, 3))


def max_keep(count: Column) -> Column:
    out = F.lit(None)
    for least, keep in KEEP_BANDS:
        out = F.when(count >= least, keep) if least == KEEP_BANDS[0][0] else out.when(count >= least, keep)
    return out.otherwise(2)


def candidates(pois: DataFrame, radius: float = RADIUS, carry: Sequence[str] = (), carry_landmark: Sequence[str] = ()) -> DataFrame:
    """Pairs of a landmark (priority over 0) and another background place within ``radius``, measured and labelled.
    ``carry`` and ``carry_landmark`` name columns of either place that come along: joins of places before this one
    are cheaper than joins of pairs after it."""
    left = pois.filter("priority > 0").select(F.col("id").alias("landmark_id"), F.col("x").alias("lx"), F.col("y").alias("ly"), *carry_landmark)
    right = pois.filter("priority = 0").select(F.col("id").alias("target_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), *carry)
    pairs = distance_join(left, right, radius).filter("landmark_id <> target_id")
    az = geo.azimuth(F.col("rx") - F.col("lx"), F.col("ry") - F.col("ly"))
    pairs = pairs.withColumn("azimuth", az)
    return pairs.withColumns({"dist_level": geo.dist_level(F.col("distance")), "direction_8": geo.direction_8(F.col("azimuth"))})


def with_keep(pois: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Places with ``poi_count``, each landmark's number of candidates, and ``max_keep``, how many relations of a
    class it keeps."""
    counts = tiles.counted(pois, radius).withColumnRenamed("n", "poi_count")
    return pois.join(counts, "id", "left").withColumn("max_keep", max_keep(F.col("poi_count")))


def with_corners(pois: DataFrame, junctions: DataFrame) -> DataFrame:
    """Places with ``junction_t``, the nearest junction's name where one is near."""
    corners = near_any(pois, junctions, JUNCTION_RADIUS).withColumnRenamed("near_name", "junction_t")
    return pois.join(corners, "id", "left")


def labelled(pois: DataFrame, roads: DataFrame, junctions: DataFrame, radius: float = RADIUS) -> DataFrame:
    """All candidate pairs with counts, topology and labels."""
    return with_labels(classed(pois, roads, junctions, radius))


def classed(pois: DataFrame, roads: DataFrame, junctions: DataFrame, radius: float = RADIUS, within: float | None = None, nearest: int | None = None, rank: Callable | None = None) -> DataFrame:
    """All candidate pairs, or those ``within`` a smaller distance, with counts, topology and road. With ``nearest``, the
    pairs that can be among so many nearest of their landmark, topology and band, or first by ``rank``, are enough."""
    if nearest is None or within is not None:
        places = staged(with_corners(with_keep(pois, radius), junctions), "places")  # both sides of all pairs come from it
        pairs = tiles.judged(places, roads, radius if within is None else within, ["poi_count", "max_keep"])
    else:  # counts come with the pairs
        pairs = tiles.first(staged(with_corners(pois, junctions), "places"), roads, radius, nearest, rank)
        pairs = pairs.withColumn("poi_count", F.sum("n").over(Window.partitionBy("landmark_id"))).filter("topology is not null").drop("n")
        pairs = pairs.withColumn("max_keep", max_keep(F.col("poi_count")))
    pairs = pairs.withColumn("azimuth", geo.azimuth(F.col("rx") - F.col("lx"), F.col("ry") - F.col("ly")))
    return pairs.withColumns({"dist_level": geo.dist_level(F.col("distance")), "direction_8": geo.direction_8(F.col("azimuth"))})


def topology_totals(pois: DataFrame, roads: DataFrame, junctions: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Number and summed distance of all candidate pairs by topology and road."""
    return tallies.by_topology(staged(with_corners(pois, junctions), "places"), roads, radius)


def with_labels(pairs: DataFrame) -> DataFrame:
    """Adds the fine direction, ambiguity flag and class, deviation, scene and template key."""
    az, topology = F.col("azimuth"), F.col("topology")
    out = pairs.withColumns(
        {
            "direction_16": geo.direction_16(az, topology, F.col("distance")),
            "is_ambiguous": geo.is_ambiguous(az),
            "combo_class": geo.combo_class(topology),
            "deviation": geo.deviation(az, F.col("direction_8")),
            "has_road_ref": geo.has_road_ref(F.col("road_name")),
        }
    )
    out = out.withColumns(
        {
            "ambiguity_level": geo.ambiguity_level(F.col("deviation")),
            "scene_code": geo.scene_code(topology, F.col("combo_class"), F.col("road_name")),
        }
    )
    key = geo.template_key(F.col("scene_code"), topology, F.col("dist_level"), F.col("direction_8"), F.col("ambiguity_level"))
    return out.withColumn("template_key", key)


def selected(pairs: DataFrame, order: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """The ``max_keep`` first relations of each landmark, topology and band: by ``order``, else by a seeded hash of
    the pair, so that a choice is the same in every run and partitioning."""
    ordering = [*order] if order else [F.xxhash64("landmark_id", "target_id", F.lit(seed)), F.col("target_id")]
    most = max(keep for _, keep in KEEP_BANDS)  # a fixed limit, by which tasks drop rows before the shuffle
    rank = F.row_number().over(Window.partitionBy("landmark_id", "topology", "dist_level").orderBy(*ordering))
    return pairs.filter("topology is not null and dist_level is not null").withColumn("rn", rank).filter(F.col("rn") <= most).filter("rn <= max_keep").drop("rn")


def with_attributes(pairs: DataFrame, pois: DataFrame, attributes: Sequence[str] = ("name", "type_3")) -> DataFrame:
    """Joins attributes of both places, prefixed ``landmark_`` and ``target_``."""
    for side in ("landmark", "target"):
        named = pois.select(F.col("id").alias(f"{side}_id"), *(F.col(a).alias(f"{side}_{a}") for a in attributes))
        pairs = pairs.join(named, f"{side}_id")
    return pairs


def relations(
    pois: DataFrame, roads: DataFrame, junctions: DataFrame, radius: float = RADIUS, order: Sequence[str] | None = None, rank: Callable | None = None
) -> DataFrame:
    """The whole chain from places to kept, labelled relations. An order that begins with the distance, or with what
    ``rank`` tells (see ``tiles.judged``), lets later pairs of a class stay where they arise. The kept rows are written
    once, as queries read them several times; labels come last, and each query computes those that it reads."""
    prunes = rank is not None or (order and isinstance(order[0], str) and order[0] == "distance")
    nearest = max(keep for _, keep in KEEP_BANDS) if prunes else None
    return with_labels(staged(selected(classed(pois, roads, junctions, radius, nearest=nearest, rank=rank), order), "kept"))


def distribution_bundle(kept: DataFrame) -> dict[str, DataFrame]:
    """The overview of kept relations and their distributions by direction, band, topology and ambiguity, with the
    cross-table of direction and band: tables for ``sinks.bundle``."""
    from waymark.operators import stats

    levels = [name for name, _ in geo.DIST_BANDS]
    return {
        "overview": kept.agg(F.count("*").alias("relations"), F.count_distinct("landmark_id").alias("landmarks"), F.count_distinct("target_id").alias("targets")),
        "direction": stats.distribution(kept, "direction_8", geo.DIRECTIONS_8),
        "distance": stats.distribution(kept, "dist_level", levels),
        "topology": stats.distribution(kept, "topology", geo.TOPOLOGIES),
        "ambiguity": stats.distribution(kept, "ambiguity_level", [*(name for name, _ in geo.AMBIGUITY_BANDS), "CROSS_BOUNDARY"]),
        "direction_distance": stats.crosstab(kept.filter("direction_8 is not null"), "direction_8", "dist_level", levels),
    }
