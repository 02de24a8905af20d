"""Readers: files with lineage, JSON places, paged remote sources, GeoPackage lines, spreadsheets, coordinates."""

from __future__ import annotations

import sqlite3
import struct
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark.functions.geo import transverse_mercator

PAGE_ROWS, MOST_PAGES, RETRIES = 25, 8, 3


def csv(spark: SparkSession, path: str | Sequence[str], schema: str, lineage: bool = False) -> DataFrame:
    """Delimited text with a header and a given schema; ``lineage`` adds the name of each row's file."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')
    return df.withColumn("source_file", F.col("_metadata.file_name")) if lineage else df


def parquet(spark: SparkSession, path: str, lineage: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("source_file", F.col("_metadata.file_name")) if lineage else df


def shares(spark: SparkSession, path: str) -> DataFrame:
    """``(dimension, name, share)`` of a JSON object of distributions, ``{dimension: {name: share}}``, as kept offline."""
    text = spark.read.text(path, wholetext=True)
    held = text.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("dimension", "of"))
    return held.select("dimension", F.explode("of").alias("name", "share"))


def json_places(df: DataFrame, column: str) -> DataFrame:
    """Rows of JSON arrays of places, their ``lon,lat`` location split into numbers."""
    names = ("id", "name", "type", "typecode", "location", "address", "pname", "cityname", "adname")
    items = F.from_json(column, "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>")
    rows = df.select(F.inline(items))
    at = F.split("location", ",")
    number = lambda k: F.get(at, F.lit(k)).try_cast("double")
    return rows.select(
        F.col("id").alias("poi_id"), "name", F.col("type").alias("category"), F.col("typecode").alias("codes"), number(0).alias("lon"), number(1).alias("lat"),
        "address", F.col("pname").alias("province"), F.col("cityname").alias("city"), F.col("adname").alias("district"),
    )


Fetch = Callable[[str, int], Sequence[str]]


def pages(fetch: Fetch, code: str, most: int = MOST_PAGES, wait: Callable[[float], None] = time.sleep) -> Iterator[tuple[str | None, str | None]]:
    """All rows of a code, page by page, until a page isn't full, as ``(row, None)``. A failing call is tried again, later
    each time; where it keeps failing, what is missing is told by a last ``(None, error)``."""
    for page in range(1, most + 1):
        for attempt in range(1, RETRIES + 1):
            try:
                rows = list(fetch(code, page))
                break
            except OSError as error:
                if attempt == RETRIES:
                    yield None, f"page {page} and after: {type(error).__name__} {error}".rstrip()
                    return
                wait(10.0 * attempt)
        yield from ((row, None) for row in rows)
        if len(rows) < PAGE_ROWS:
            return


class _Code(InputPartition):
    pass


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Fetch, codes: Sequence[str], wait: float = 1.0) -> None:
        self.fetch, self.codes, self.wait = fetch, codes, wait

    def partitions(self) -> list[InputPartition]:
        return [_Code(c) for c in self.codes]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row, error in pages(self.fetch, partition.value, wait=lambda s: time.sleep(s * self.wait)):
            yield partition.value, row, error


def paged_source(fetch: Fetch, codes: Sequence[str], name: str = "waymark_paged", wait: float = 1.0) -> type[DataSource]:
    """A data source class that reads each code's pages in a task of its own: register it, then
    ``spark.read.format(name).load()``. ``fetch(code, page)`` gives rows as JSON text. A code of which pages are
    missing has a row with ``error``. ``wait`` scales the pauses after failures."""
    held = sorted({str(c).zfill(6) for c in codes})

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "code string, json string, error string"

        def reader(self, schema: object) -> DataSourceReader:
            return PagedReader(fetch, held, wait)

    return Paged


def _lines(blob: bytes) -> list[list[tuple[float, float]] | None]:
    """The lines of a GeoPackage geometry, one for each part; what has none gives one null."""
    if blob is None or blob[:2] != b"GP":
        return [None]
    at = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    order, kind = _wkb_head(blob, at)
    parts = 1
    if kind % 1000 == 5:
        parts = struct.unpack_from(order + "I", blob, at + 5)[0]
        at += 9
    out: list[list[tuple[float, float]] | None] = []
    for _ in range(parts):
        order, kind = _wkb_head(blob, at)
        if kind % 1000 == 1:
            return [[struct.unpack_from(order + "2d", blob, at + 5)]]
        if kind % 1000 != 2:
            return [None]
        size = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
        n = struct.unpack_from(order + "I", blob, at + 5)[0]
        flat = struct.unpack_from(f"{order}{n * size}d", blob, at + 9)
        out.append([(flat[k], flat[k + 1]) for k in range(0, n * size, size)])
        at += 9 + 8 * n * size
    return out or [None]


def _wkb_head(blob: bytes, at: int) -> tuple[str, int]:
    order = "<" if blob[at] else ">"
    return order, struct.unpack_from(order + "I", blob, at + 1)[0]


class _Rows(InputPartition):
    pass


class GeoPackageReader(DataSourceReader):
    """Features by ranges of row numbers, each range in a task of its own."""

    def __init__(self, path: str, table: str, geometry: str, columns: Sequence[str], rows: int) -> None:
        self.path, self.table, self.geometry, self.columns, self.rows = path, table, geometry, list(columns), rows

    def _found(self, sql: str, *values: int) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            yield from con.execute(sql, values)

    def partitions(self) -> list[InputPartition]:
        least, most = next(self._found(f'SELECT min(rowid), max(rowid) FROM "{self.table}"'))
        if least is None:
            return [_Rows((1, 0))]
        return [_Rows((at, min(most, at + self.rows - 1))) for at in range(least, most + 1, self.rows)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in (self.geometry, *self.columns))
        for blob, *rest in self._found(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', *partition.value):
            srs = struct.unpack_from("<i" if blob[3] & 1 else ">i", blob, 4)[0] if blob and blob[:2] == b"GP" else None
            for line in _lines(blob):
                yield (*(None if v is None else str(v) for v in rest), srs, line)


def geopackage(spark: SparkSession, path: str, table: str, geometry: str = "geom", columns: Sequence[str] = (), rows: int = 50_000) -> DataFrame:
    """Features of a GeoPackage file that executors can open, with ``points`` in the file's own coordinates and their
    system's ``srs_id``. A line of several parts gives a row for each, with the feature's columns."""
    schema = ", ".join([*(f"`{c}` string" for c in columns), "srs_id int", "points array<struct<x:double,y:double>>"])

    class GeoPackage(DataSource):
        @classmethod
        def name(cls) -> str:
            return "waymark_geopackage"

        def schema(self) -> str:
            return schema

        def reader(self, schema: object) -> DataSourceReader:
            return GeoPackageReader(path, table, geometry, columns, rows)

    spark.dataSource.register(GeoPackage)
    return spark.read.format("waymark_geopackage").load()


def in_metres(df: DataFrame, points: str = "points", srs: str = "srs_id") -> DataFrame:
    """``df`` with geographic ``points`` (EPSG:4326) projected to UTM zone 50 N, others as they are."""

    def projected(p: Column) -> Column:
        x, y = transverse_mercator(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    turned = F.when(F.col(srs) == 4326, F.transform(points, projected)).otherwise(F.col(points))
    return df.withColumns({points: turned, srs: F.when(F.col(srs) == 4326, 32650).otherwise(F.col(srs)).cast("int")})


def coordinates(df: DataFrame, key: Column, x: str, y: str, order: str) -> DataFrame:
    """``(key, x, y)``: of rows that repeat a key the last by ``order`` counts."""
    return df.groupBy(key.alias("key")).agg(F.max_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), order).alias("p")).select("key", "p.x", "p.y")
