"""Distance joins, nearest neighbours and nearest lines over grid cells.

A plain distance condition plans as a nested loop over both tables. Here both sides get a grid cell, the smaller
side is repeated into the cells around its own, and the join is an equi-join on cells with an exact check after.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import lines
from waymark.functions.geo import distance
from waymark.operators.staging import staged

FEW = 64


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def _around(v: Column, radius: float, size: float) -> Column:
    return F.sequence(_cell(v - radius, size), _cell(v + radius, size))


def distance_join(left: DataFrame, right: DataFrame, radius: float, cell: float | None = None, salts: int = 1, group: str | None = None) -> DataFrame:
    """Pairs of ``left(.., lx, ly)`` and ``right(.., rx, ry)`` at most ``radius`` apart, with their ``distance``.

    ``left`` is repeated into the cells that its circle meets, so it should be the smaller side. ``salts`` deals the
    rows of a crowded cell to so many tasks, at the price of as many copies of ``left``. Null places meet nothing.
    With ``group``, a column of both, only places of one group meet.
    Places are dealt evenly first: they are few beside their pairs, which would else arise in as many tasks as the
    places have files if ``left`` is broadcast.
    """
    right = right.repartition(int(right.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = cell or float(radius)
    probe = left.withColumn("_cx", F.explode(_around(F.col("lx"), radius, size))).withColumn("_cy", F.explode(_around(F.col("ly"), radius, size)))
    held = right.withColumns({"_cx": _cell(F.col("rx"), size), "_cy": _cell(F.col("ry"), size)})
    on, cells = ["_cx", "_cy", *([group] if group else [])], ["_cx", "_cy"]
    if salts > 1:
        probe = probe.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        held = held.withColumn("_salt", F.pmod(F.xxhash64("rx", "ry"), F.lit(salts)).cast("int"))
        on, cells = [*on, "_salt"], [*cells, "_salt"]
    pairs = probe.join(held, on).drop(*cells)
    return pairs.withColumn("distance", distance(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry"))).filter(F.col("distance") <= radius)


def near_any(points: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """The rows of ``points(id, x, y)`` within ``radius`` of some ``places(name, x, y)``, with the nearest place's
    ``near_name`` (the first by name at a tie)."""
    left = places.select(F.col("name").alias("near"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = points.select("id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return distance_join(left, right, radius).groupBy("id").agg(F.min_by("near", F.struct("distance", "near")).alias("near_name"))


def lines_near(points: DataFrame, roads: DataFrame, radius: float, cell: float = 250.0) -> DataFrame:
    """``(id, road_id, d)`` for every line of ``roads(road_id, points)`` within ``radius`` of ``points(id, x, y)``.

    Pieces are cut to the cell size, so that a long line is in the cells along it only.
    """
    pieces = roads.select("road_id", F.explode(lines.segments(F.col("points"))).alias("s"))
    n = F.greatest(F.lit(1), F.ceil(F.col("s.len") / cell).cast("int"))
    cut = pieces.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda axis, k: F.col(f"s.{axis}1") + (F.col(f"s.{axis}2") - F.col(f"s.{axis}1")) * k / F.col("n")
    cover = lambda axis: F.sequence(
        _cell(F.least(at(axis, F.col("k")), at(axis, F.col("k") + 1)) - radius, cell),
        _cell(F.greatest(at(axis, F.col("k")), at(axis, F.col("k") + 1)) + radius, cell),
    )
    cells = cut.withColumn("_cx", F.explode(cover("x"))).withColumn("_cy", F.explode(cover("y"))).select("road_id", "s", "_cx", "_cy").distinct()
    keyed = points.select("id", "x", "y", _cell(F.col("x"), cell).alias("_cx"), _cell(F.col("y"), cell).alias("_cy"))
    met = keyed.join(cells, ["_cx", "_cy"]).select("id", "road_id", lines.to_piece(F.col("s"), F.col("x"), F.col("y"))["d"].alias("d"))
    return met.filter(F.col("d") <= radius).groupBy("id", "road_id").agg(F.min("d").alias("d"))


def nearest(
    points: DataFrame, k: int, cell: float, group: str | None = None, least_distance: float = 1e-9, most_rings: int = 1 << 20
) -> DataFrame:
    """``(id, n, distance)``: the ``k`` nearest others of each of ``points(id, x, y[, group])`` at most, by group.

    Searches ever larger circles: a point is settled once ``k`` others lie within the circle's radius; the rest go on
    with the radius doubled until every point of the group is within it. Only members of one group meet. Others at ``least_distance`` or closer don't
    count.
    """
    by = group or "_all"
    points = points.select("id", "x", "y", *([group] if group else [F.lit(0).alias(by)]))
    sizes = points.groupBy(by).agg(
        F.count("*").alias("total"), (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) * 1.5 + cell).alias("span")
    )
    few = sizes.filter(F.col("total") <= FEW).select(by)  # a group of so few is compared as it is, at no radius
    span = sizes.filter(F.col("total") > FEW).agg(F.max("span")).first()[0]

    def sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
        return (
            left.select(by, F.col("id").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly")),
            right.select(by, F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry")),
        )

    def top(met: DataFrame) -> DataFrame:
        met = met.filter((F.col("lid") != F.col("rid")) & (F.col("distance") > least_distance))
        order = Window.partitionBy("lid").orderBy("distance", "rid")
        return met.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select(F.col("lid").alias("id"), "n", "distance")

    small = points.join(few, by, "left_semi")
    one, other = sides(small, small)
    done = top(one.join(other, by).withColumn("distance", distance(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry"))))
    if span is None:
        return done
    points = points.join(few, by, "left_anti")
    left, radius = points, cell
    for _ in range(most_rings):
        found = staged(top(distance_join(*sides(left, points), radius, group=by)), "nearest")
        if radius > span:
            return done.union(found)
        full = found.filter(F.col("n") == k).select("id")
        done = done.union(found.join(full, "id", "left_semi"))
        left, radius = left.join(full, "id", "left_anti"), radius * 2
        if left.isEmpty():
            break
    return done


def covered_cells(points: DataFrame, radius: float, cell: float) -> DataFrame:
    """Cells ``(cx, cy)`` whose centre lies within ``radius`` of one of ``points(x, y)``: the union of their circles,
    to the accuracy of the cell."""
    reach = F.sequence(F.lit(-int(radius // cell) - 1), F.lit(int(radius // cell) + 1))
    near = points.select("x", "y", F.explode(reach).alias("dx")).select("x", "y", "dx", F.explode(reach).alias("dy"))
    near = near.withColumns({"cx": _cell(F.col("x"), cell) + F.col("dx"), "cy": _cell(F.col("y"), cell) + F.col("dy")})
    off = distance(F.col("x"), F.col("y"), (F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell)
    return near.filter(off <= radius).select("cx", "cy").distinct()


def hull_area(points: DataFrame) -> DataFrame:
    """``(hull)``: the area of the convex hull. Each task keeps its own hull's corners only; one more pass over
    these gives the whole."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[float, float]] = []
        for batch in batches:
            held = hull([*held, *zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in held], pa.float64()) for k in (0, 1)], names=["x", "y"])

    found = points.select(F.col("x").cast("double"), F.col("y").cast("double")).dropna().mapInArrow(corners, "x double, y double")
    whole = found.repartition(1).mapInArrow(corners, "x double, y double").collect()
    ring = [(r.x, r.y) for r in whole]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True))) / 2
    return points.sparkSession.createDataFrame([(area,)], "hull double")


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, by a monotone chain."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def chain(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(ordered) + chain(ordered[::-1])


def coverage(centres: DataFrame, points: DataFrame, radius: float, cell: float) -> DataFrame:
    """Area of the circles' union over that of the hull of ``points``."""
    covered = covered_cells(centres, radius, cell).agg((F.count("*") * (cell * cell)).alias("covered"))
    return covered.crossJoin(F.broadcast(hull_area(points))).withColumn("coverage", F.try_divide("covered", "hull"))
