"""Joins of descriptions, relations and landmarks for refinement, export and evaluation; keys and columns of inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators.staging import running

PENDING_COLUMNS = ("road_name", "direction_8", "ambiguity_level", "dist_level", "distance")
EXPORT_COLUMNS = ("rx", "ry", "distance", "dist_level", "azimuth", "direction_8", "direction_16", "topology", "combo_class")
EVALUATION_COLUMNS = ("scene_code", "ambiguity_level", "rx", "ry", "direction_8", "distance", "topology", "landmark_id")


def pending_descriptions(descriptions: DataFrame, relations: DataFrame, after: int = 0, most: int | None = None) -> DataFrame:
    """Descriptions without a final text, from key ``after`` on, with what their relation tells; nulls where there is
    none. With ``most``, the first so many by key, which are chosen before the join."""
    rows = descriptions.filter(F.col("id") >= after).filter(F.coalesce("description", F.lit("")) == "")
    if most is not None:
        rows = rows.orderBy("id").limit(most)
    told = relations.select(F.col("id").alias("fid"), *PENDING_COLUMNS)
    return rows.join(told, "fid", "left").select("id", "description_raw", "template_key", *PENDING_COLUMNS)


def exported_descriptions(descriptions: DataFrame, relations: DataFrame) -> DataFrame:
    """Descriptions whose relation is there, with its measures and labels."""
    told = relations.select(F.col("id").alias("fid"), *EXPORT_COLUMNS)
    return descriptions.join(told, "fid").select("id", "description", "ref_name", *EXPORT_COLUMNS)


def exported_landmarks(landmarks: DataFrame, places: DataFrame) -> DataFrame:
    """Selected landmarks, all columns, with the geographic coordinates of their place."""
    at = places.select("poi_id", F.col("lon").alias("wgs84_x"), F.col("lat").alias("wgs84_y"))
    return landmarks.filter("priority > 0").join(at, "poi_id").select(*landmarks.columns, "wgs84_x", "wgs84_y")


def evaluated_descriptions(descriptions: DataFrame, relations: DataFrame) -> DataFrame:
    """Descriptions with the labels of the relation that they were made from, by the relation's key."""
    told = relations.select(F.col("id").alias("fid"), *EVALUATION_COLUMNS)
    return descriptions.join(told, "fid").select("id", "description", "description_raw", "ref_name", *EVALUATION_COLUMNS)


def merged_first(df: DataFrame, key: str, order: str, measures: dict[str, Column], first: Sequence[str]) -> DataFrame:
    """One row for each key: aggregated ``measures``, and of the other columns those of the first row in ``order``. One
    aggregation does what joining aggregates with first geometries would."""
    held = F.min_by(F.struct(*first), order).alias("_first")
    return df.groupBy(key).agg(*(m.alias(name) for name, m in measures.items()), held).select(key, *measures, *(F.col(f"_first.{c}") for c in first))


def with_key(df: DataFrame, order: Sequence[str], key: str = "fid") -> DataFrame:
    """``df`` with a whole-number ``key``: its own column of that name, whatever its letter case, else the row's number
    in ``order``, from 1."""
    own = next((c for c in df.columns if c == key), next((c for c in df.columns if c.lower() == key.lower()), None))
    if own is None:
        return running(df, [F.col(f"`{c}`") for c in order], F.lit(1).cast("long"), key, "keys")
    return df.select(*(F.col(f"`{c}`").cast("long").alias(key) if c == own else F.col(f"`{c}`") for c in df.columns))


def usable_roads(df: DataFrame, kind: str = "highway") -> DataFrame:
    """Rows with a road class, where there is such a column; lists as one text each."""
    rows = df.filter(F.col(kind).isNotNull()) if kind in df.columns else df
    text = lambda f: F.array_join(F.col(f"`{f.name}`").cast("array<string>"), ", ").alias(f.name)
    flat = lambda f: isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, T.StructType)
    return rows.select(*(text(f) if flat(f) else F.col(f"`{f.name}`") for f in rows.schema.fields))


def with_suffix(path: Column, suffix: str) -> Column:
    """A file's path with ``suffix`` before its extension."""
    return F.regexp_replace(path, r"^(.*?[^/])(\.[^./]*)?$", f"$1{suffix}$2")


def updated(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A new snapshot of ``df`` in which the rows that ``changes`` has take their ``columns`` from there, nulls included.
    Of changes that repeat a key the largest counts."""
    held = changes.groupBy(key).agg(F.max(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)))).alias("_change"))
    out = df.join(held, key, "left")
    new = lambda c: F.when(F.col("_change").isNotNull(), F.col(f"_change.c{columns.index(c)}")).otherwise(F.col(c)).alias(c)
    return out.select(*(new(c) if c in columns else F.col(c) for c in df.columns))
