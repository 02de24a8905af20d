"""Sinks: delimited text, JSON reports, table bundles, and idempotent replacement by key partitions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Delimited text that ``readers.csv`` reads back as it was: quotes doubled, white space kept."""
    df.write.mode("overwrite").csv(path, header=header, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def csv_file(df: DataFrame, path: str) -> None:
    """One file with a byte-order mark, streamed row by row through the driver: for a final export."""
    import csv as writer

    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        rows = writer.writer(out)
        rows.writerow(df.columns)
        rows.writerows(df.toLocalIterator(prefetchPartitions=True))


def report(df: DataFrame) -> str:
    """A small table as a JSON array."""
    row = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("json")).first()
    return row.json


def bundle(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as Parquet in a folder of its name: what a workbook of several sheets is elsewhere."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replaces the partitions that ``df`` has rows of and leaves the others: a rerun gives the same table."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
