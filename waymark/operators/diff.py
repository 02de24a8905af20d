"""Differences of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.staging import running


def _texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns))


def row_differences(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of either table whose keys, as text, the other has nowhere; ``side`` tells whose. Nulls equal nulls."""
    keys = list(keys or a.columns)
    left, right = _texts(a, keys), _texts(b, keys)

    def only(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        other = y.distinct().select(*(F.col(c).alias(f"_{c}") for c in keys))
        on = F.lit(True)
        for c in keys:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return x.join(other, on, "left_anti").withColumn("side", F.lit(side))

    return only(left, right, "a").union(only(right, left, "b"))


def cell_differences(a: DataFrame, b: DataFrame, order: Sequence[str]) -> DataFrame:
    """Cells that differ between rows at the same place after sorting: ``(row, column, a, b)``; a missing row gives
    nulls. Sorting by ``order`` puts all rows in one sequence, as the comparison asks for."""
    columns = [c for c in a.columns if c in b.columns]

    def numbered(df: DataFrame, name: str) -> DataFrame:
        held = df.select(*(F.col(f"`{c}`") for c in columns))
        ties = [F.col(f"`{c}`").cast("string") for c in columns if c not in order]  # rows that the order leaves equal
        rows = running(held, [*(F.col(f"`{c}`") for c in order), *ties], F.lit(1).cast("long"), "_row", f"cells-{name}")
        return rows.select(F.col("_row").alias("row"), F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns)).alias(name))

    both = numbered(a, "a").join(numbered(b, "b"), "row", "full")
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"a.`{c}`").alias("a"), F.col(f"b.`{c}`").alias("b")) for c in columns))
    return both.select("row", F.explode(cells).alias("x")).select("row", "x.*").filter(~F.col("a").eqNullSafe(F.col("b")))


def summary(differences: DataFrame) -> DataFrame:
    return differences.groupBy("side").agg(F.count("*").alias("n"))
