"""Distributions, descriptives, tests and agreement measures, each as small aggregates of a table of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators.staging import running


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    out = first.withColumn("_one", F.lit(1))
    for other in others:
        out = out.join(other.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row table, which is broadcast."""
    return df.crossJoin(F.broadcast(scalars))


def distribution(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """``(name, ord, n, percent)`` for each of the ordered ``names``, zero where none occurs."""
    counted = df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("ord", T.IntegerType())])
    wanted = df.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], schema)
    out = wanted.join(counted, "name", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    total = out.agg(F.sum("n").alias("_total"))
    return with_scalars(out, total).withColumn("percent", F.try_divide(100.0 * F.col("n"), F.col("_total"))).drop("_total")


def crosstab(df: DataFrame, row: str, column: str, names: Sequence[str]) -> DataFrame:
    """Counts of ``column`` in each ``row``, with row percentages."""
    counted = df.groupBy(row).agg(
        F.count("*").alias("_total"), *(F.count_if(F.col(column) == n).alias(n) for n in names)
    )
    return counted.select(row, *names, *(F.round(100.0 * F.col(n) / F.col("_total"), 6).alias(f"{n}_percent") for n in names))


def entropy(counts: DataFrame, column: str) -> DataFrame:
    """Entropy of counts over that of as many equal ones; 0 for a single class or none."""
    total = counts.agg(F.sum(column).cast("double").alias("_total"))
    p = F.try_divide(F.col(column), F.col("_total"))
    used = with_scalars(counts.filter(F.col(column) > 0), total)
    sums = used.agg((-F.sum(p * F.log(p))).alias("h"), F.count("*").alias("k"))
    return sums.select(F.coalesce(F.try_divide(F.col("h"), F.log(F.when(F.col("k") > 1, F.col("k")))), F.lit(0.0)).alias("entropy"))


def share_shift(ours: DataFrame, natural: DataFrame, column: str) -> DataFrame:
    """Shares of a class in two tables and their difference. ``natural`` may hold classes with their number ``n`` instead."""

    def shares(df: DataFrame, name: str, n: Column) -> DataFrame:
        counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(n.alias("n"))
        return with_scalars(counted, counted.agg(F.sum("n").alias("t"))).select("name", (F.col("n") / F.col("t")).alias(name))

    n = F.count("*")
    both = shares(ours, "share", n).join(shares(natural, "natural_share", F.sum("n") if "n" in natural.columns else n), "name")
    return both.select("name", F.round("share", 6).alias("share"), F.round("natural_share", 6).alias("natural_share"), F.round(F.col("share") - F.col("natural_share"), 6).alias("shift"))


def stratified_sample(df: DataFrame, column: str, total: int, least: int, order: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Of each class its share of ``total`` rows, ``least`` where it has them; by ``order``, else by a seeded hash."""
    counts = df.groupBy(column).agg(F.count("*").alias("_size"))
    counts = with_scalars(counts, counts.agg(F.sum("_size").alias("_total")))
    quota = F.least(F.col("_size").cast("double"), F.greatest(F.lit(float(least)), F.bround(float(total) * F.col("_size") / F.col("_total"))))
    ordering = [*order] if order else [F.xxhash64(*df.columns, F.lit(seed))]
    ranked = df.join(counts.select(column, quota.alias("_quota")), column)
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(column).orderBy(*ordering)))
    return ranked.filter("_n <= _quota").drop("_n", "_quota")


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42, order: Sequence[Column | str] | None = None) -> DataFrame:
    """``n`` rows by a seeded hash of their key, or by ``order``: the same in every run and partitioning."""
    return df.orderBy(*(order or [F.xxhash64(key, F.lit(seed)), key])).limit(n)


def min_max(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns scaled to 0..1 over the whole table; null where all values are one."""
    bounds = df.agg(*(f(source).alias(f"_{k}_{new}") for new, source in columns.items() for k, f in (("lo", F.min), ("hi", F.max))))
    out = with_scalars(df, bounds)
    made = {new: F.try_divide(F.col(source) - F.col(f"_lo_{new}"), F.col(f"_hi_{new}") - F.col(f"_lo_{new}")) for new, source in columns.items()}
    return out.withColumns(made).select(*df.columns, *(c for c in made if c not in df.columns)) if not set(made) & set(df.columns) else out.withColumns(made).select(*df.columns)


def corrected_skewness(column: str) -> Column:
    """Sample skewness with bias correction, from the population moment."""
    n = F.count(column)
    return F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.skewness(column)


def corrected_kurtosis(column: str) -> Column:
    """Sample excess kurtosis with bias correction, from the population moment."""
    n = F.count(column)
    return F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6)


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with the interpolated quantile ``name: (column, share)`` of the values that are not null, exactly, from the
    running totals of the distinct values' counts: no task holds the values, as it would to sort them in a buffer."""
    rows = []
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
        upto = running(counts, [F.col("_v")], F.col("_n"), "_upto", "quantiles")
        held = with_scalars(upto, upto.agg(F.sum("_n").alias("_total")))
        made = []
        for name, q in ((n, q) for n, (c, q) in wanted.items() if c == column):
            at = (F.col("_total") - 1) * F.lit(float(q))
            value = lambda i: F.max(F.when((i >= F.col("_upto") - F.col("_n")) & (i < F.col("_upto")), F.col("_v")))
            made += [value(F.floor(at)).alias(f"_lo_{name}"), value(F.ceil(at)).alias(f"_hi_{name}"), F.max(at - F.floor(at)).alias(f"_part_{name}")]
        rows.append(held.agg(*made))
    out = beside(*rows)
    lo, hi, part = (lambda n, k=k: F.col(f"_{k}_{n}") for k in ("lo", "hi", "part"))
    return out.select(*(F.when(lo(n) == hi(n), lo(n)).otherwise(lo(n) * (1 - part(n)) + hi(n) * part(n)).alias(n) for n in wanted))


def descriptives(df: DataFrame, column: str, population: bool = True, shares: Sequence[float] = (0.25, 0.75, 0.9, 0.95)) -> DataFrame:
    """Count, mean, median, sd, range, skewness, kurtosis and quantiles."""
    skew, kurt = (F.skewness(column), F.kurtosis(column)) if population else (corrected_skewness(column), corrected_kurtosis(column))
    made = {
        "n": F.count(column), "mean": F.avg(column), "sd": F.stddev_samp(column), "min": F.min(column), "max": F.max(column), "skew": skew, "kurt": kurt,
    }
    ranks = {"median": (column, 0.5)} | {f"p{round(q * 100)}": (column, q) for q in shares}
    both = beside(df.agg(*(v.alias(k) for k, v in made.items())), quantiles(df, ranks))
    names = ["n", "mean", "median", "sd", "min", "max", "skew", "kurt", *list(ranks)[1:]]
    return both.select(*(F.round(k, 6).alias(k) if k != "n" else F.col(k) for k in names))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Ranks with ties averaged, from running totals of the distinct values' counts."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    upto = running(counts, [F.col(column)], F.col("_n"), "_upto", "ranks")
    return df.join(upto.select(column, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out)), column)


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman coefficients with two-sided p-values by the normal approximation of Fisher's z."""
    rows = average_ranks(average_ranks(df.select(a, b).dropna(), a, "_ra"), b, "_rb")
    sums = rows.agg(F.count("*").alias("n"), F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))
    p = lambda r: 2 * upper_tail(F.abs(F.atanh(F.least(F.lit(1 - 1e-15), F.abs(r)))) * F.sqrt(F.greatest(F.col("n") - 3, F.lit(0))))
    return sums.withColumns({"pearson_p": p(F.col("pearson")), "spearman_p": p(F.col("spearman"))})


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z >= 0, by a rational approximation good to 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def separation(df: DataFrame, value: str, group: Column) -> DataFrame:
    """Welch's t, Mann-Whitney U of the first group and Cohen's d of rows where ``group`` is true against the rest."""
    rows = average_ranks(df.select(F.col(value).alias("v"), group.alias("g")).dropna(), "v", "rank")
    part = lambda f, g: f(F.when(F.col("g") == g, F.col("v")))
    s = rows.agg(
        *(f.alias(k) for g, x in ((True, "1"), (False, "0")) for f, k in (
            (F.count_if(F.col("g") == g).cast("double"), f"n{x}"), (part(F.avg, g), f"m{x}"), (part(F.var_samp, g), f"s{x}"))),
        F.sum(F.when(F.col("g"), F.col("rank"))).alias("r1"),
    )
    a, b = F.col("s1") / F.col("n1"), F.col("s0") / F.col("n0")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("s1") + (F.col("n0") - 1) * F.col("s0")) / (F.col("n1") + F.col("n0") - 2))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    return s.select(
        F.round((F.col("m1") - F.col("m0")) / F.sqrt(a + b), 6).alias("t"),
        F.round((a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1)), 4).alias("df"),
        u.alias("u"),
        F.round((u - F.col("n1") * F.col("n0") / 2) / F.sqrt(F.col("n1") * F.col("n0") * (F.col("n1") + F.col("n0") + 1) / 12), 6).alias("u_z"),
        F.round((F.col("m1") - F.col("m0")) / pooled, 6).alias("d"),
    )


def kappa(df: DataFrame, a: str, b: str, weighted: bool = False) -> DataFrame:
    """Cohen's kappa of two raters' labels over the rows where both are given; quadratic weights if ``weighted``."""
    rated = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    if weighted:  # the mean square of differences, observed and of independent raters, from moments
        x, y = F.col("a").cast("double"), F.col("b").cast("double")
        sums = rated.agg(
            F.count("*").alias("n"), F.avg((x - y) * (x - y)).alias("wo"), (F.avg(x * x) + F.avg(y * y) - 2 * F.avg(x) * F.avg(y)).alias("we")
        )
        return sums.select("n", F.round("wo", 6).alias("disagreement"), F.round(F.coalesce(1 - F.try_divide("wo", "we"), F.lit(1.0)), 6).alias("kappa"))
    sums = rated.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("po"))
    rows, cols = rated.groupBy("a").agg(F.count("*").alias("na")), rated.groupBy(F.col("b").alias("a")).agg(F.count("*").alias("nb"))
    met = rows.join(cols, "a").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("both"))
    pe = F.try_divide(F.col("both"), F.col("n").cast("double") * F.col("n"))
    kappa_ = F.coalesce(F.try_divide(F.col("po") - pe, 1 - pe), F.lit(1.0))
    return beside(sums, met).select("n", F.round("po", 6).alias("agreement"), F.round(kappa_, 6).alias("kappa"))
