"""What figures draw, as small tables: densities, cumulative shares, two-dimensional counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.stats import with_scalars


def density(df: DataFrame, column: str, points: int = 50, by: str | None = None) -> DataFrame:
    """``([by,] k, x, density)``: a Gaussian kernel density at evenly spaced places, with Scott's bandwidth; for ``by`` one
    for each group, as a violin draws it. Groups whose values are all one have none.

    Each value adds to a fixed number of sums in the task that holds it, so that values don't meet their places by a join.
    """
    by = [by] if by else []
    rows = df.filter(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("v"))
    one = rows.withColumn("_one", F.lit(1))
    keys = by or ["_one"]
    found = one.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"), F.stddev_samp("v").alias("sd"))
    found = found.filter("sd > 0").withColumn("width", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    held = one.join(F.broadcast(found), keys) if not by else one.join(found, keys)
    place = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / float(points - 1)
    kernel = lambda k: F.exp(-0.5 * F.pow((F.col("v") - place(k)) / F.col("width"), F.lit(2.0)))
    sums = held.groupBy(*keys, "lo", "hi", "n", "width").agg(F.array(*(F.sum(kernel(k)) for k in range(points))).alias("sums"))
    each = sums.select(*by, "lo", "hi", "n", "width", F.posexplode("sums").alias("k", "s"))
    return each.select(*by, "k", place(F.col("k")).alias("x"), (F.col("s") / (F.col("n") * F.col("width") * math.sqrt(2 * math.pi))).alias("density"))


def cumulative(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """``(k, x, share)``: the share of values up to each of evenly spaced places."""
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    bounds = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    place = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / float(points - 1)
    held = with_scalars(rows, bounds)
    sums = held.groupBy("lo", "hi", "n").agg(F.array(*(F.count_if(F.col("v") <= place(k)) for k in range(points))).alias("sums"))
    return sums.select("lo", "hi", "n", F.posexplode("sums").alias("k", "s")).select("k", place(F.col("k")).alias("x"), (F.col("s") / F.col("n")).alias("share"))


def cells(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """``(bin_x, bin_y, n)``: counts over an even grid between the extremes of both columns, as a heat map draws them."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    bounds = rows.agg(*(f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("lo", F.min), ("hi", F.max))))

    def bin_of(c: str) -> Column:
        share = F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}"))
        return F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins)).cast("int").alias(f"bin_{c}")

    return with_scalars(rows, bounds).groupBy(bin_of("x"), bin_of("y")).agg(F.count("*").alias("n"))
