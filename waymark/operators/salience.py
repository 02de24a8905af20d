"""Salience: percentile scaling, isolation, name-based cognition, fusion, selection of landmarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.spatial import nearest
from waymark.operators.staging import running
from waymark.operators.stats import beside, min_max, quantiles, with_scalars

# Weights of the signals, the sigmoid, and the quota of a grid cell.
COGNITION_WEIGHTS = (0.2, 0.35, 0.25, 0.2)
SPATIAL_WEIGHTS = (0.4, 0.35, 0.25)
FUSION = (0.2, 0.8, 8.0, 0.5)
GRID_METRES, QUOTA_FACTOR, QUOTA_POWER = 1000.0, 0.2, 0.8
PROTECTED_FACTOR = 0.7


def percentile_scaled(df: DataFrame, value: str, out: str, key: str) -> DataFrame:
    """Positive values to 50..100 by rank (ties in order of ``key``), 75 for a single one, others to 0.

    Ranks are counted over ranges of the value, so that no task sorts them all.
    """
    positive = df.filter(F.col(value) > 0).select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    ranked = running(positive, [F.col("_v"), F.col("_k")], F.lit(1).cast("long"), "_i", "percentile-ranks")
    ranks = with_scalars(ranked, ranked.agg(F.count("*").alias("_t")))
    scaled = F.when(F.col("_t") == 1, 75.0).otherwise(50 + 50.0 * (F.col("_i") - 1) / (F.col("_t") - 1))
    ranks = ranks.select(F.col("_k"), scaled.alias(out))
    return df.join(ranks, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(out, F.coalesce(out, F.lit(0.0)))


def isolation(pois: DataFrame, types: str, k: int = 3, cell: float = 200.0) -> DataFrame:
    """``(id, mean_isolation, max_isolation)``: for each type of a place the mean distance to its ``k`` nearest others
    of that type (fewer, if there are fewer; none without), over all its types. Types are a multi-value string."""
    each = F.explode(F.filter(F.transform(F.split(F.coalesce(types, F.lit("unknown")), r"\|"), lambda x: F.trim(x)), lambda x: x != ""))
    typed = pois.select("id", "x", "y", each.alias("type"))
    keyed = typed.select(F.struct("id", "type").alias("id"), "x", "y", "type")
    found = nearest(keyed, k, cell, "type").groupBy("id").agg(F.avg("distance").alias("d"))
    return found.groupBy(F.col("id.id").alias("id")).agg(F.avg("d").alias("mean_isolation"), F.max("d").alias("max_isolation"))


def _any(words: Sequence[str], test) -> Column:  # noqa: ANN001
    return F.exists(F.array(*map(F.lit, words)), test) if words else F.lit(False)


def clean_name(name: Column, prefixes: Sequence[str]) -> Column:
    """Without bracketed parts, without each prefix once (longest first), without white space."""
    out = F.regexp_replace(name, r"[\(（].*?[\)）]", "")
    for prefix in sorted(prefixes, key=lambda p: (-len(p), p)):
        out = F.when(F.startswith(out, F.lit(prefix)), F.substr(out, F.lit(len(prefix) + 1))).otherwise(out)
    return F.regexp_replace(out, r"\s+", "")


def knowledge_signal(name: Column, type_3: Column, suffixes: Sequence[str], proper: Sequence[str]) -> Column:
    flags = (
        F.length(name).between(3, 10),
        ~_any(suffixes, lambda s: F.endswith(name, s)),
        _any(proper, lambda p: F.contains(name, p)),
        F.contains(name, type_3),
    )
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0)) / 4


def brand_signal(name: Column, weights: dict[str, float]) -> Column:
    held = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(float(v)).alias("weight")) for w, v in weights.items()))
    found = F.transform(F.filter(held, lambda h: F.contains(name, h["word"])), lambda h: h["weight"])
    return F.least(F.coalesce(F.array_max(found), F.lit(0.0)) / 0.5, F.lit(1.0))


def penalty(name: Column, facilities: Sequence[tuple[str, float]], proper: Sequence[str]) -> Column:
    """The factor of the first facility word in a name; for names that begin with a proper noun a mild one."""
    held = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(float(f)).alias("factor")) for w, f in facilities))
    factor = F.get(F.filter(held, lambda h: F.contains(name, h["word"])), F.lit(0))["factor"]
    protected = _any(proper, lambda p: F.startswith(name, p))
    return F.when(factor.isNull(), 1.0).when(protected, PROTECTED_FACTOR).otherwise(factor)


def tokens(name: Column, suffixes: Sequence[str] = ()) -> Column:
    """Words of letters or digits, without single characters, numbers and suffixes. A plain splitter that takes the
    place of a dictionary-based one, which is not at hand."""
    found = F.regexp_extract_all(F.lower(name), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    keep = lambda t: (F.length(t) >= 2) & ~F.rlike(t, F.lit("^[0-9]+$")) & ~_any(suffixes, lambda s: s == t)
    return F.filter(found, keep)


def uniqueness(df: DataFrame, name: str, key: str, suffixes: Sequence[str] = ()) -> DataFrame:
    """Adds ``uniqueness``: log10(1 + rows / frequency of the most frequent token), scaled to 0..1 over the table."""
    each = df.select(F.col(key).alias("_k"), F.explode(tokens(F.col(name), suffixes)).alias("_t"))
    counts = each.groupBy("_t").agg(F.count("*").alias("_c"))
    most = each.join(counts, "_t").groupBy("_k").agg(F.max("_c").alias("_m"))
    out = with_scalars(df.join(most, F.col(key) == F.col("_k"), "left").drop("_k"), df.agg(F.count("*").alias("_n")))
    raw = F.when(F.col("_m").isNull(), 0.0).otherwise(F.log10(1 + F.col("_n") / F.col("_m")))
    return min_max(out.withColumn("_raw", raw), {"uniqueness": "_raw"}).drop("_raw", "_m", "_n")


def category_fame(df: DataFrame, category: str, q: float = 0.9) -> DataFrame:
    """Adds ``fame``: the share of a category's rows whose uniqueness is over the table's quantile."""
    held = with_scalars(df, quantiles(df, {"_q": ("uniqueness", q)}))
    fame = held.groupBy(category).agg(F.avg((F.col("uniqueness") > F.col("_q")).cast("int")).alias("fame"))
    return df.join(fame, category, "left")


def cognition(
    df: DataFrame, key: str, prefixes: Sequence[str], suffixes: Sequence[str], proper: dict[str, float], facilities: Sequence[tuple[str, float]]
) -> DataFrame:
    """Adds the signals, the penalty and ``cognition_score`` in 0..1 to ``(name, type_3, ..)``."""
    name = F.col("clean_name")
    df = df.withColumn("clean_name", clean_name(F.col("name"), prefixes))
    df = df.withColumns({"knowledge": knowledge_signal(name, F.col("type_3"), suffixes, list(proper)), "brand": brand_signal(name, proper)})
    df = category_fame(uniqueness(df, "clean_name", key, suffixes), "type_3")
    a, b, c, d = COGNITION_WEIGHTS
    base = a * F.col("knowledge") + b * F.col("uniqueness") + c * F.col("brand") + d * F.col("fame")
    df = df.withColumn("penalty", penalty(F.col("name"), facilities, list(proper))).withColumn("_raw", base * F.col("penalty"))
    return min_max(df, {"cognition_score": "_raw"}).drop("_raw")


def composite(df: DataFrame, spatial: Sequence[float] = SPATIAL_WEIGHTS, fusion: Sequence[float] = FUSION) -> DataFrame:
    """Adds ``spatial_score`` from exposure, centrality and isolation, and the sigmoid ``composite_score``."""
    raw = spatial[0] * F.col("exposure") + spatial[1] * F.col("centrality") + spatial[2] * F.col("isolation")
    df = min_max(df.withColumn("_raw", raw), {"spatial_score": "_raw"}).drop("_raw")
    signal = fusion[0] * F.col("spatial_score") + fusion[1] * F.col("cognition_score")
    return df.withColumn("composite_score", sigmoid(signal, fusion[2], fusion[3]))


def sigmoid(x: Column, k: float | Column, x0: float | Column) -> Column:
    return 1 / (1 + F.exp(-k * (x - x0))) if isinstance(k, Column) else 1 / (1 + F.exp(F.lit(-k) * (x - x0)))


def selected_landmarks(df: DataFrame, key: str = "id", grid: float = GRID_METRES) -> DataFrame:
    """Adds ``grid_x``, ``grid_y`` and ``landmark_priority`` (0: not selected).

    In each cell the rows from the cell's 70th percentile of the composite score on are ranked by class, then score,
    then key; the cell's quota of them is selected.
    """
    shares = {f"_{c[0]}{k}": (c, k / 10) for c in ("spatial_score", "cognition_score") for k in (6, 7, 8)}
    rows = with_scalars(df, beside(df.agg(F.min("x").alias("_x"), F.min("y").alias("_y")), quantiles(df, shares)))
    s, c = F.col("spatial_score"), F.col("cognition_score")
    label = (
        F.when((s >= F.col("_s8")) & (c >= F.col("_c8")), 1)
        .when((c >= F.col("_c7")) & (s <= F.col("_s6")), 2)
        .when((s >= F.col("_s7")) & (c <= F.col("_c6")), 3)
        .otherwise(4)
    )
    rows = rows.withColumns(
        {"grid_x": F.floor((F.col("x") - F.col("_x")) / grid).cast("long"), "grid_y": F.floor((F.col("y") - F.col("_y")) / grid).cast("long"), "_class": label}
    )
    cells = rows.groupBy("grid_x", "grid_y").agg(F.count("*").alias("_n"), F.percentile("composite_score", 0.7).alias("_p70"))
    quota = F.greatest(F.lit(1), F.floor(QUOTA_FACTOR * F.pow(F.col("_n").cast("double"), F.lit(QUOTA_POWER))).cast("int"))
    rows = rows.join(cells.withColumn("_quota", quota), ["grid_x", "grid_y"])
    passing = F.col("composite_score") >= F.col("_p70")
    order = Window.partitionBy("grid_x", "grid_y").orderBy(F.when(passing, 0).otherwise(1), "_class", F.desc("composite_score"), key)
    chosen = passing & (F.row_number().over(order) <= F.col("_quota"))
    return rows.withColumn("landmark_priority", F.when(chosen, F.col("_class")).otherwise(0)).select(*df.columns, "grid_x", "grid_y", "landmark_priority")
