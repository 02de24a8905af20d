"""Shared folders, staged tables and Arrow helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder is made and set on a local master; on a cluster that is an error, as executors
    would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
        found = f"file://{tempfile.mkdtemp(prefix='waymark-')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


_STAGED: list[str] = []


def staged_path(spark: SparkSession, name: str) -> str:
    _STAGED.append(f"{shared_dir(spark)}/waymark-{name}-{uuid.uuid4().hex}")
    return _STAGED[-1]


def clear_staged(spark: SparkSession, since: int, *keep: str) -> None:
    """Deletes the intermediate tables that this process has written from number ``since`` on, except ``keep``; what
    reads them is void then. Others' tables, and those that earlier results still read, stay."""
    for path in [p for p in _STAGED[since:] if p not in keep]:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _STAGED.remove(path)


def staged_count() -> int:
    return len(_STAGED)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = staged_path(df.sparkSession, name)
    out = written(df, path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more; other tables stay."""
    for df in tables:
        if path := getattr(df, "staged_at", None):
            delete(df.sparkSession, path)


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sampled(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` of ``rows``, those whose hash of ``key`` is lowest; all, if they are fewer. One count, no sort."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written with a number for each row, and that column's name; the written table fixes the numbers."""
    row = free_name(df, "__row")
    return staged(df.withColumn(row, F.monotonically_increasing_id()), name), row


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names, so that clashing names of other columns don't matter.
    Ids are whole numbers, or text of whole numbers; other text raises."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 21) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and UTF-8 texts (null: empty) in slices of about ``most_bytes``; a longer text is a slice of its own."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary()).to_pylist()
        start = size = 0
        for i, text in enumerate(texts):
            if text is None:
                texts[i] = text = b""
            if size and size + len(text) > most_bytes:
                yield ids.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text)
        if start < len(texts):
            yield ids.slice(start), texts[start:]


def tokenizer_path(name: str) -> str:
    """A public vocabulary file by name; a name with a slash is a path already."""
    if "/" in name:
        return name
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
