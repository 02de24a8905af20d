"""Queries on joins for refinement, export and evaluation, on keys, and on projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import exports, textgen
from waymark.plans import base
from waymark.plans.relation_queries import _kept
from waymark.sources import tables

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(function):  # noqa: ANN001, ANN202
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


# Relations under a key; descriptions of some of them under a key of their own, some done, some of relations that are gone.
_TABLES = f"""{base.RELATIONS}, rels AS (SELECT landmark_id * 1000000 + target_id AS id, * FROM kept),
  descs AS (SELECT id * 2 + 1 AS id, CASE WHEN id % 11 = 0 THEN -id ELSE id END AS fid, CASE WHEN id % 3 = 0 THEN 'text ' || id WHEN id % 3 = 1 THEN '' END AS description,
    'raw ' || id AS description_raw, template_key, 'ref ' || landmark_id AS ref_name FROM rels WHERE id % 5 <> 0)"""


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf).withColumn("id", F.expr("landmark_id * 1000000 + target_id"))


def _descriptions(relations: DataFrame) -> DataFrame:
    return relations.filter("id % 5 <> 0").selectExpr(
        "id * 2 + 1 id", "if(id % 11 = 0, -id, id) fid", "case id % 3 when 0 then concat('text ', id) when 1 then '' end description",
        "concat('raw ', id) description_raw", "template_key", "concat('ref ', landmark_id) ref_name",
    )


def _columns(names) -> str:  # noqa: ANN001
    return ", ".join(f"round({c}, 6) AS {c}" if c in ("distance", "azimuth") else f"r.{c}" for c in names)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("distance", "azimuth") if c in df.columns})


@query(f"""{_TABLES} SELECT d.id, description_raw, d.template_key, {_columns(exports.PENDING_COLUMNS)} FROM descs d LEFT JOIN rels r ON d.fid = r.id
  WHERE d.id >= 40000000 AND coalesce(description, '') = ''""")
def pending_descriptions(spark, sf):
    """What waits for refinement, with its relation where there is one."""
    rows = _relations(spark, sf)
    return _rounded(exports.pending_descriptions(_descriptions(rows), rows, 40_000_000))


@query(f"""{_TABLES} SELECT d.id, description_raw, d.template_key, {_columns(exports.PENDING_COLUMNS)} FROM
  (SELECT * FROM descs WHERE id >= 40000000 AND coalesce(description, '') = '' ORDER BY id LIMIT 300) d LEFT JOIN rels r ON d.fid = r.id""")
def pending_page(spark, sf):
    """A batch of 300, as refinement takes them."""
    rows = _relations(spark, sf)
    return _rounded(exports.pending_descriptions(_descriptions(rows), rows, 40_000_000, 300))


@query(f"""{_TABLES} SELECT d.id, description, ref_name, {_columns(exports.EXPORT_COLUMNS)} FROM descs d, rels r WHERE d.fid = r.id""")
def exported_descriptions(spark, sf):
    """J11."""
    rows = _relations(spark, sf)
    return _rounded(exports.exported_descriptions(_descriptions(rows), rows))


@query(f"""WITH {base.POIS}, l AS (SELECT 'P' || id AS poi_id, name, priority FROM pois) SELECT l.*, 116 + x / 100000 AS wgs84_x, 39.5 + y / 100000 AS wgs84_y
  FROM l, pois p WHERE l.poi_id = 'P' || p.id AND l.priority > 0 AND p.id % 7 <> 0""")
def exported_landmarks(spark, sf):
    """J12."""
    places = tables.pois(spark, sf)
    at = places.filter("id % 7 <> 0").selectExpr("concat('P', id) poi_id", "116 + x / 100000 lon", "39.5 + y / 100000 lat")
    return exports.exported_landmarks(places.selectExpr("concat('P', id) poi_id", "name", "priority"), at)


@query(f"""{_TABLES} SELECT d.id, description, description_raw, ref_name, {_columns(exports.EVALUATION_COLUMNS)} FROM descs d JOIN rels r ON d.fid = r.id""")
def evaluated_descriptions(spark, sf):
    """J13, by the relation's key."""
    rows = _relations(spark, sf)
    return _rounded(exports.evaluated_descriptions(_descriptions(rows), rows))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem)
  SELECT l_suppkey AS fid, round(avg(l_quantity), 6) AS mean_quantity, max(l_quantity) AS max_quantity, max(l_partkey) FILTER (n = 1) AS l_partkey, max(l_linenumber) FILTER (n = 1) AS l_linenumber
  FROM f GROUP BY l_suppkey""")
def merged_attributes(spark, sf):
    """Aggregates and first attributes by key, in one aggregation."""
    rows = tables.table(spark, sf, "lineitem").withColumn("place", F.struct("l_orderkey", "l_linenumber"))
    measures = {"mean_quantity": F.round(F.avg("l_quantity"), 6), "max_quantity": F.max("l_quantity")}
    return exports.merged_first(rows.withColumnRenamed("l_suppkey", "fid"), "fid", "place", measures, ["l_partkey", "l_linenumber"])


@query("""SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS fid, o_orderkey, o_orderdate FROM orders""")
def numbered_rows(spark, sf):
    """a key by place in an order."""
    return exports.with_key(tables.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query("""SELECT n_nationkey::BIGINT AS fid, n_name, concat(n_nationkey, ', ', n_regionkey) AS refs FROM nation WHERE n_nationkey % 4 <> 0""")
def usable_roads(spark, sf):
    """no rows without a class, lists as text, a key in whatever letter case."""
    rows = tables.table(spark, sf, "nation").selectExpr("cast(n_nationkey as string) FID", "n_name", "array(n_nationkey, n_regionkey) refs", "if(n_nationkey % 4 = 0, null, 'primary') highway")
    return exports.with_key(exports.usable_roads(rows), []).drop("highway")


@query("""SELECT n_nationkey AS k, 'in.put/' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '_clean.xlsx' ELSE '_clean' END AS path FROM nation""")
def output_paths(spark, sf):
    """F20."""
    path = F.expr("concat('in.put/', n_name, if(n_nationkey % 2 = 0, '.xlsx', ''))")
    return tables.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), exports.with_suffix(path, "_clean").alias("path"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'changed' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders""")
def updated_rows(spark, sf):
    """SNK7: a new snapshot instead of updates row by row."""
    rows = tables.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = rows.filter("o_orderkey % 3 < 2").selectExpr("o_orderkey", "if(o_orderkey % 3 = 1, 'changed', null) o_orderstatus")
    return exports.updated(rows, changes, "o_orderkey", ["o_orderstatus"])


_GEOGRAPHIC = "116 + x / 10000 AS lon, 39.5 + y / 10000 AS lat"
_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_E = 2 * math.sqrt(_N) / (1 + _N)


def _gauss(central: float, scale: float) -> str:
    """The series of the transverse projection, in plain SQL."""
    alpha = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
    radius = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * scale
    t = f"sinh(atanh(sin(radians(lat))) - {_E!r} * atanh({_E!r} * sin(radians(lat))))"
    lam = f"radians(lon - {central})"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x += f" + {c!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})"
        y += f" + {c!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})"
    return f"round(500000 + {radius!r} * ({x}), 3), round({radius!r} * ({y}), 3)"


_UTM, _CGCS = _gauss(117, 0.9996).split(", round(", 1), _gauss(117, 1.0).split(", round(", 1)


@query(f"""WITH {base.POIS}, g AS (SELECT id, {_GEOGRAPHIC} FROM pois)
  SELECT id, round(radians(lon) * 6378137, 3) AS web_x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS web_y,
  {_UTM[0]} AS utm_x, round({_UTM[1]} AS utm_y, {_CGCS[0]} AS gk_x, round({_CGCS[1]} AS gk_y FROM g""")
def projections(spark, sf):
    """EPSG:3857, UTM zone 50 N, and the three-degree zone of 117 E at scale 1."""
    rows = tables.pois(spark, sf).selectExpr("id", "116 + x / 10000 lon", "39.5 + y / 10000 lat")
    lon, lat = F.col("lon"), F.col("lat")
    named = {"web": geo.web_mercator(lon, lat), "utm": geo.transverse_mercator(lon, lat), "gk": geo.transverse_mercator(lon, lat, scale=1.0)}
    at: list[Column] = [F.round(c, 3).alias(f"{name}_{axis}") for name, xy in named.items() for axis, c in zip("xy", xy, strict=True)]
    return rows.select("id", *at)


def _roll(salt: int) -> Column:
    return F.pmod(F.col("n_nationkey") * 7919 + salt * 12347, F.lit(9973)) / 9973.0


def _u(salt: int) -> str:
    return f"(((n_nationkey * 7919 + {salt * 12347}) % 9973) / 9973e0)"


def _pick(pool, salt: int) -> str:  # noqa: ANN001
    return "[" + ", ".join(f"'{p}'" for p in pool) + f"][floor({_u(salt)} * {len(pool)})::INT + 1]"


_EXACT = ", ".join(f"'{w}'" for w in textgen.EXACT_ADVERBS)


@query(f"""WITH n AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'East' WHEN 1 THEN 'Northwest' WHEN 2 THEN 'South' END AS d, (n_nationkey % 7)::DOUBLE AS off,
    CASE n_nationkey % 3 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'SLIGHT' ELSE 'MODERATE' END AS level FROM nation),
  a AS (SELECT *, CASE d WHEN 'East' THEN '东' WHEN 'Northwest' THEN '西北' WHEN 'South' THEN '南' END AS root, CASE level WHEN 'EXACT' THEN {_pick(textgen.ADVERBS["EXACT"], 1)}
    WHEN 'SLIGHT' THEN {_pick(textgen.ADVERBS["SLIGHT"], 1)} ELSE {_pick(textgen.ADVERBS["MODERATE"], 1)} END AS adv, {_pick(textgen.EXACT_ADVERBS, 5)} AS exact FROM n)
  SELECT n_nationkey AS k, CASE WHEN root IS NULL THEN '附近' ELSE CASE WHEN adv IN ({_EXACT}) THEN adv ELSE exact END || root || CASE WHEN off > 3 THEN '偏' ELSE '' END END AS precise,
  CASE WHEN root IS NULL THEN '附近' ELSE root || {_pick(textgen.SUFFIXES, 4)} END AS functional,
  CASE WHEN root IS NULL THEN '附近' WHEN adv = '' THEN root WHEN adv IN ({_EXACT}) THEN adv || root || CASE WHEN {_u(2)} < 0.3 THEN {_pick(textgen.SIDES, 3)} ELSE '' END
    WHEN {_u(2)} < 0.8 THEN adv || '偏' || root ELSE adv || root END AS vague FROM a""")
def composed_directions(spark, sf):
    """Phrases at a given granularity."""
    rows = tables.table(spark, sf, "nation").selectExpr(
        "n_nationkey", "case n_nationkey % 4 when 0 then 'East' when 1 then 'Northwest' when 2 then 'South' end d", "cast(n_nationkey % 7 as double) off",
        "case n_nationkey % 3 when 0 then 'EXACT' when 1 then 'SLIGHT' else 'MODERATE' end level",
    )
    made = [textgen.composed_direction(F.col("d"), F.col("off"), F.col("level"), g, _roll).alias(g) for g in ("precise", "functional", "vague")]
    return rows.select(F.col("n_nationkey").alias("k"), *made)
