"""The driver tables, and relative-location views derived from them by exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROAD_FROM, ROAD_TO = -200.0, 3400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on a square of about 3 km, in groups of ten around an anchor; every tenth is a landmark. Cubes are of
    remainders, as those of keys leave whole numbers of 64 bits from 815,606 on."""
    base = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey id", "c_name name", "c_mktsegment type_3", "c_acctbal score", "c_nationkey nation", "c_custkey % 10 r", "c_custkey div 10 g"
    )
    anchored = base.selectExpr(
        "*",
        "if(g % 3 = 0, 240 * (((g * 7919 + g * g * 31) % 3001) div 240) + 108, (g * 7919 + g * g * 31) % 3001) ax",
        "(g % 3011 * 104729 + (g % 3011) * (g % 3011) * (g % 3011) * 17) % 3011 ay",
    )
    return anchored.selectExpr(
        "id", "name", "type_3", "score", "nation",
        "cast(case when r = 0 then ax when r = 1 then ax + 0.5 when r = 2 then ax + 1 + g % 29 when r = 3 then ax + 31"
        " else (id * 7919 + id * id * 31) % 3001 end as double) x",
        "cast(if(r < 4, ay, (id % 3011 * 104729 + (id % 3011) * (id % 3011) * (id % 3011) * 17) % 3011) as double) y",
        "cast(if(r = 0, 1 + g % 4, 0) as int) priority",
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of straight roads: ``(road_id, name, width, points)``."""
    point = lambda a, b: F.struct(F.when(F.col("v"), a).otherwise(b).alias("x"), F.when(F.col("v"), b).otherwise(a).alias("y"))
    p = (F.lit(120.0) * (F.col("n_nationkey") + 1)).alias("p")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("road_id"), F.col("n_name").alias("name"), "n_regionkey", p, (F.col("n_nationkey") % 2 == 0).alias("v"))
    width = F.element_at(F.array(*(F.lit(float(w)) for w in (35, 25, 15, 10, 6))), F.col("n_regionkey").cast("int") + 1)
    return rows.select(
        "road_id", "name", width.alias("width"), F.array(point(F.col("p"), F.lit(ROAD_FROM)), point(F.col("p"), F.lit(ROAD_TO))).alias("points")
    )


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where roads of the grid meet: ``(name, x, y)``. The grid has a fixed number of roads."""
    rows = roads(spark, sf_dir).select("name", F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"), (F.col("road_id") % 2 == 0).alias("v"))
    up = rows.filter("v").select(F.col("name").alias("a"), "x", F.lit(1).alias("one"))
    across = rows.filter("not v").select(F.col("name").alias("b"), "y", F.lit(1).alias("one"))
    return up.join(across, "one").select(F.concat_ws("/", "a", "b").alias("name"), "x", "y")


def bent_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roads of the grid with two bends each, all pieces oblique: ``(road_id, name, width, points)``."""
    k, p = F.col("road_id"), F.lit(120.0) * (F.col("road_id") + 1)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    up = F.array(at(p, F.lit(-200)), at(p + 60, F.lit(800)), at(p - 40 + 10 * (k % 5), F.lit(1900)), at(p + 30, F.lit(3400)))
    across = F.array(at(F.lit(-200), p), at(F.lit(700), p + 50), at(F.lit(1800), p - 60), at(F.lit(3400), p + 20))
    return roads(spark, sf_dir).select("road_id", "name", "width", F.when(k % 2 == 0, up).otherwise(across).alias("points"))
