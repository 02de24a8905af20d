"""Tables written between steps, and running totals over a global order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where it is unset, a temporary folder is
    made and set on a local master; on a cluster that is an error, as executors would not see it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='waymark-')}")
            held = context._jsc.sc().getCheckpointDir()
        found = held.get()
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe from lost executors, its lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/waymark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: Sequence[Column], amount: Column, out: str, name: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``amount`` over all rows up to each one in ``order``.

    Rows are dealt into ranges of the order and written with their range's number, so that the totals of the ranges
    and the sums within them are of the same ranges at any size; no task holds the table.
    """
    ranged = df.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), "_amount": amount})
    ranged = staged(ranged, name)
    totals = ranged.groupBy("_range").agg(F.sum("_amount").alias("_total"))  # a row for each range
    upto = F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select("_range", F.coalesce(upto, F.lit(0)).alias("_before"))
    inside = F.sum("_amount").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("_inside", inside).join(before, "_range").withColumn(out, F.col("_inside") + F.col("_before")).drop("_range", "_amount", "_inside", "_before")
