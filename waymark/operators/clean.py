"""Cleaning of raw places: filters with a log of rejects, deduplication, category parsing, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import haversine

# The words by which a name is closed or meaningless, and the box of valid coordinates.
CLOSED_WORDS = ("暂停营业", "已停业", "关闭", "装修中", "暂停服务")
MEANINGLESS_WORDS = ("测试", "test", "中国邮政", "国家电网", "中国移动", "中国联通", "中国电信")
GENERIC_TYPES = ("", "公司")
UNCLASSIFIED = "未分类"
BOX = (115.4, 117.5, 39.4, 41.0)


def first_by_id(df: DataFrame, id_col: str = "poi_id", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """The first row of each id, and the others as rejects. ``order`` has no equal values within an id.

    The first is found by a partial aggregate and joined back, which Spark can split where an id is frequent; rows
    without an id count as one id.
    """
    firsts = df.groupBy(F.col(id_col).alias("_id")).agg(F.min(order).alias("_first"))
    held = df.join(firsts, F.col(id_col).eqNullSafe(F.col("_id")))
    gone = held.filter(F.col(order) > F.col("_first")).select(F.col(id_col).alias("poi_id"), F.lit("duplicate_id").alias("reason"))
    return held.filter(F.col(order) == F.col("_first")).drop("_id", "_first"), gone


def apart_by_location(df: DataFrame, metres: float = 1.0, id_col: str = "poi_id", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Drops a row if an earlier one of the same name lies within ``metres``, whether or not that one is dropped.

    Rows of a name meet by cells of latitude only, of which each row is in three, so that a frequent name isn't
    compared pairwise. Rows without coordinates or name stay.
    """
    cell = 2 * metres / 111_000
    at = F.floor(F.col("lat") / cell).cast("long")
    near = df.filter("name is not null and lon is not null and lat is not null")
    late = near.select(F.col(id_col).alias("_id"), "name", F.col(order).alias("_o"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), at.alias("_c"))
    early = near.select("name", F.col(order).alias("_o1"), F.col("lon").alias("_lon1"), F.col("lat").alias("_lat1"), F.explode(F.array(at - 1, at, at + 1)).alias("_c"))
    # Of rows at one place of one name only the earliest can be the reason.
    early = early.groupBy("name", "_c", "_lon1", "_lat1").agg(F.min("_o1").alias("_o1"))
    met = late.join(early, ["name", "_c"]).filter("_o1 < _o").filter(haversine(F.col("_lon"), F.col("_lat"), F.col("_lon1"), F.col("_lat1")) <= metres)
    gone = met.select(F.col("_id").alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti"), gone.select(F.col(id_col).alias("poi_id"), F.lit("duplicate_location").alias("reason"))


def rejected(df: DataFrame, reason: str, bad: Column, id_col: str = "poi_id") -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rejects with their reason. An undecided condition passes."""
    bad = F.coalesce(bad, F.lit(False))
    return df.filter(~bad), df.filter(bad).select(F.col(id_col).alias("poi_id"), F.lit(reason).alias("reason"))


def words_pattern(words: Sequence[str]) -> str:
    return "|".join(words)


def normalised_address(a: Column) -> Column:
    return F.regexp_replace(F.replace(F.regexp_replace(a, r"^\s+|\s+$", ""), F.lit("北京城区"), F.lit("北京市")), r"\s+", " ")


def region_of(a: Column, regions: Sequence[str]) -> Column:
    """The first of ``regions``, in their order, that an address contains; else empty."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, regions)), lambda r: F.contains(a, r)), F.lit(0)), F.lit(""))


def with_categories(df: DataFrame, column: str = "category") -> DataFrame:
    """``type_1`` to ``type_3`` from a path of three, empty where it is shorter."""
    parts = F.split(column, ";")
    return df.withColumns({f"type_{k + 1}": F.coalesce(F.get(parts, F.lit(k)), F.lit("")) for k in range(3)})


def codes_of(column: str) -> Column:
    """Trimmed codes of a multi-value string."""
    return F.transform(F.split(column, r"\|"), lambda x: F.trim(x))


def specific_type(type_3: Column, type_1: Column, type_2: Column, brands: Sequence[str] = ()) -> Column:
    """The longest part (the first at a tie) that names neither the levels above nor a brand; if none is left, the
    longest of all; without parts, the unclassified label."""
    parts = F.filter(F.transform(F.split(F.trim(type_3), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    own = F.filter(
        parts,
        lambda x: ~F.coalesce((x == type_1) | (x == type_2), F.lit(False)) & ~(F.exists(F.array(*map(F.lit, brands)), lambda b: F.contains(x, b)) if brands else F.lit(False)),
    )
    longest = lambda a: F.aggregate(a, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.when(type_3.isNull() | (F.size(parts) == 0), UNCLASSIFIED).otherwise(F.when(F.size(own) > 0, longest(own)).otherwise(longest(parts)))


def cleaned(df: DataFrame, deleted_codes: Sequence[str] = (), citycode: str = "010", adcode: str = "110000") -> tuple[DataFrame, DataFrame]:
    """The whole chain in fixed order over ``(ord, poi_id, name, category, codes, lon, lat, address)``.

    Returns clean rows with categories and area codes, and the log ``(poi_id, reason)`` of what each step took.
    """
    df, gone = first_by_id(df)
    log = [gone]
    df, gone = apart_by_location(df)
    log.append(gone)

    def step(reason: str, bad: Column) -> None:
        nonlocal df
        df, gone = rejected(df, reason, bad)
        log.append(gone)

    lon, lat = F.col("lon"), F.col("lat")
    step("null_coordinates", lon.isNull() | lat.isNull())
    step("zero_coordinates", (lon == 0) & (lat == 0))
    step("outside_box", ~(lon.between(*BOX[:2]) & lat.between(*BOX[2:])))
    step("null_address", F.col("address").isNull())
    df = df.withColumn("address", normalised_address(F.col("address")))
    step("closed", F.col("name").rlike(words_pattern(CLOSED_WORDS)))
    step("empty_category", F.col("category").isNull() | (F.trim("category") == ""))
    df = with_categories(df)
    step("meaningless", F.col("name").rlike(words_pattern(MEANINGLESS_WORDS)) & F.coalesce(F.col("type_2"), F.lit("")).isin(*GENERIC_TYPES))
    if deleted_codes:
        step("deleted_code", F.arrays_overlap(codes_of("codes"), F.array(*map(F.lit, deleted_codes))))
    df = df.withColumns({"citycode": F.lit(citycode), "adcode": F.lit(adcode)})
    all_gone = log[0]
    for gone in log[1:]:
        all_gone = all_gone.unionByName(gone)
    return df, all_gone


def profile(df: DataFrame) -> DataFrame:
    """Per column: its type, rows and nulls, in one pass."""
    counts = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{k}") for k, c in enumerate(df.columns)))
    facts = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"_{k}").alias("nulls")) for k, (c, t) in enumerate(df.dtypes)))
    return counts.select("rows", F.explode(facts).alias("f")).select("f.column", "f.type", "rows", "f.nulls")


def quality_report(clean: DataFrame, log: DataFrame) -> DataFrame:
    """Kept and taken rows, their rate of all, by reason."""
    kept = clean.agg(F.lit("kept").alias("reason"), F.count("*").alias("n"))
    both = kept.union(log.groupBy("reason").agg(F.count("*").alias("n")))
    total = both.agg(F.sum("n").alias("_t"))
    return both.crossJoin(F.broadcast(total)).select("reason", "n", F.round(F.try_divide(100.0 * F.col("n"), F.col("_t")), 6).alias("percent"))


def district_of(file_name: Column) -> Column:
    """The district that a file is of: what stands before the fixed suffix, else the first district word."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    named, word = F.regexp_extract(stem, "^(.+?)_POI数据$", 1), F.regexp_extract(stem, "[一-龥]+区", 0)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(word, F.lit("")))


def file_report(raw: DataFrame, clean: DataFrame, districts: DataFrame | None = None, file_col: str = "source_file") -> DataFrame:
    """Per input file: rows in, rows kept, what became of it and why. One job cleans all files; this tells what it made
    of each. With ``districts(district, adcode)`` a file is skipped whose name has no district or one that isn't there;
    ``cleanable`` drops its rows beforehand."""
    read = raw.groupBy(file_col).agg(F.count("*").alias("rows"))
    kept = clean.groupBy(file_col).agg(F.count("*").alias("kept"))
    out = read.join(kept, file_col, "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))
    reason = F.lit(None).cast("string")
    if districts is not None:
        out = out.withColumn("district", district_of(F.col(file_col))).join(districts.select("district", "adcode"), "district", "left")
        reason = F.when(F.col("district").isNull(), "no district in the name").when(F.col("adcode").isNull(), "unknown district")
    return out.select(file_col, "rows", "kept", F.when(reason.isNull(), "processed").otherwise("skipped").alias("status"), reason.alias("reason"))


def cleanable(raw: DataFrame, districts: DataFrame, file_col: str = "source_file") -> DataFrame:
    """The rows of files whose district is known."""
    return raw.withColumn("_district", district_of(F.col(file_col))).join(districts.select(F.col("district").alias("_district")), "_district", "left_semi").drop("_district")
