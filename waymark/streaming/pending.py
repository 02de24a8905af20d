"""The pending queue: descriptions that wait for refinement, as a stream of files with a log of what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def pending(rows: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """The rows whose key isn't done yet, each key once."""
    rows = rows.dropDuplicates([key])
    return rows if done is None else rows.join(done.select(key), key, "left_anti")


def refine_stream(
    spark: SparkSession, source: str, schema: StructType | str, sink: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame], once: bool = True
) -> StreamingQuery:
    """Reads new Parquet files of ``source`` and appends ``work`` of the rows that ``sink`` lacks. A batch that is
    run again after a failure finds its finished keys in the sink, so that nothing is done twice."""

    def batch(rows: DataFrame, _: int) -> None:
        session = rows.sparkSession
        try:
            done = session.read.parquet(sink)
        except Exception as error:  # noqa: BLE001  the sink does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            done = None
        work(pending(rows, done, key)).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
