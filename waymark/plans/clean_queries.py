"""Queries on cleaning, type repair, differences and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import clean, diff
from waymark.plans import base
from waymark.sources import tables

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(function):  # noqa: ANN001, ANN202
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


# Raw places with every fault the cleaning looks for; DIV is the whole-number division of either dialect.
_RAW = """SELECT c_custkey AS ord, concat('P', c_custkey - CASE WHEN c_custkey % 11 = 0 AND c_custkey > 0 THEN 1 ELSE 0 END) AS poi_id,
  CASE WHEN c_custkey % 37 = 5 THEN concat(c_name, '暂停营业') WHEN c_custkey % 41 = 7 THEN concat('测试', c_name)
    WHEN c_custkey % 5 < 2 THEN concat('Chain ', (c_custkey DIV 5) % 20) ELSE c_name END AS name,
  CASE WHEN c_custkey % 29 = 3 THEN NULL WHEN c_custkey % 31 = 4 THEN '' WHEN c_custkey % 3 = 0 THEN c_mktsegment
    WHEN c_custkey % 3 = 1 THEN concat(c_mktsegment, ';公司;x') ELSE concat(c_mktsegment, ';N', c_nationkey, ';', c_mktsegment, '|BUILD|', c_name) END AS category,
  concat('0', 50000 + c_custkey % 90, CASE WHEN c_custkey % 4 = 0 THEN concat(' | 0', 60000 + c_custkey % 50) ELSE '' END) AS codes,
  CASE WHEN c_custkey % 43 = 1 THEN NULL WHEN c_custkey % 47 = 2 THEN 0e0 ELSE 115.3e0 + ((c_custkey DIV 5 * 7919) % 2300) / 1000e0 END AS lon,
  CASE WHEN c_custkey % 47 = 2 THEN 0e0 ELSE 39.3e0 + ((c_custkey DIV 5 * 104729) % 1800) / 1000e0 END AS lat,
  CASE WHEN c_custkey % 23 = 6 THEN NULL ELSE concat('  北京城区  ', c_mktsegment, '   路 ') END AS address
  FROM customer"""
_RAW_SQL = "raw AS (" + _RAW.replace("DIV", "//") + ")"
_DELETED = ("050010", "060020", "050077")


def raw_places(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_RAW.replace("FROM customer", "FROM {customer}"), customer=tables.table(spark, sf, "customer"))


_BOX = f"lon BETWEEN {clean.BOX[0]} AND {clean.BOX[1]} AND lat BETWEEN {clean.BOX[2]} AND {clean.BOX[3]}"
_HAVERSINE = """2 * 6371000 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"""
_CHAIN = f"""{_RAW_SQL},
s1 AS (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY ord) AS n FROM raw),
u AS (SELECT * FROM s1 WHERE n = 1),
near AS (SELECT DISTINCT a.poi_id FROM u a JOIN u b ON a.name = b.name AND b.ord < a.ord AND {_HAVERSINE} <= 1.0),
judged AS (SELECT u.*, CASE WHEN near.poi_id IS NOT NULL THEN 'duplicate_location' WHEN lon IS NULL OR lat IS NULL THEN 'null_coordinates'
    WHEN lon = 0 AND lat = 0 THEN 'zero_coordinates' WHEN NOT ({_BOX}) THEN 'outside_box' WHEN address IS NULL THEN 'null_address'
    WHEN regexp_matches(name, '{"|".join(clean.CLOSED_WORDS)}') THEN 'closed' WHEN category IS NULL OR trim(category) = '' THEN 'empty_category'
    WHEN regexp_matches(name, '{"|".join(clean.MEANINGLESS_WORDS)}') AND coalesce(string_split(category, ';')[2], '') IN ('', '公司') THEN 'meaningless'
    WHEN len(list_intersect(list_transform(string_split(codes, '|'), lambda c: trim(c)), {list(_DELETED)})) > 0 THEN 'deleted_code' END AS reason
  FROM u LEFT JOIN near USING (poi_id)),
gone AS (SELECT poi_id, 'duplicate_id' AS reason FROM s1 WHERE n > 1 UNION ALL SELECT poi_id, reason FROM judged WHERE reason IS NOT NULL)"""


@query(f"""WITH {_CHAIN} SELECT poi_id, name, lon, lat, regexp_replace(replace(regexp_replace(address, '^\\s+|\\s+$', '', 'g'), '北京城区', '北京市'), '\\s+', ' ', 'g') AS address,
  coalesce(string_split(category, ';')[1], '') AS type_1, coalesce(string_split(category, ';')[2], '') AS type_2, coalesce(string_split(category, ';')[3], '') AS type_3,
  '010' AS citycode, '110000' AS adcode FROM judged WHERE reason IS NULL""")
def clean_places(spark, sf):
    """F2-F8, F10-F14, F16, F17."""
    kept, _ = clean.cleaned(raw_places(spark, sf), _DELETED)
    return kept.select("poi_id", "name", "lon", "lat", "address", "type_1", "type_2", "type_3", "citycode", "adcode")


@query(f"WITH {_CHAIN} SELECT poi_id, reason FROM gone")
def clean_log(spark, sf):
    """The log of rejects."""
    return clean.cleaned(raw_places(spark, sf), _DELETED)[1]


@query(f"""WITH {_CHAIN}, c AS (SELECT reason, count(*) AS n FROM gone GROUP BY 1 UNION ALL SELECT 'kept', count(*) FROM judged WHERE reason IS NULL)
  SELECT reason, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM c""")
def quality_report(spark, sf):
    """F18."""
    return clean.quality_report(*clean.cleaned(raw_places(spark, sf), _DELETED))


@query(f"""WITH {_RAW_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY ord) AS n FROM raw), u AS (SELECT * FROM s WHERE n = 1)
  SELECT poi_id, ord FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE a.name = b.name AND b.ord < a.ord AND {_HAVERSINE} <= 1.0)""")
def dedup_by_location(spark, sf):
    """F3, J21, G22."""
    return clean.apart_by_location(clean.first_by_id(raw_places(spark, sf))[0])[0].select("poi_id", "ord")


@query(f"""WITH {_RAW_SQL} SELECT 'name' AS "column", count(*) AS rows, count(*) FILTER (name IS NULL) AS nulls FROM raw
  UNION ALL SELECT 'lon', count(*), count(*) FILTER (lon IS NULL) FROM raw UNION ALL SELECT 'category', count(*), count(*) FILTER (category IS NULL) FROM raw
  UNION ALL SELECT 'address', count(*), count(*) FILTER (address IS NULL) FROM raw""")
def profile_columns(spark, sf):
    """F1."""
    return clean.profile(raw_places(spark, sf).select("name", "lon", "category", "address")).drop("type")


_REGIONS = ("AUTO", "BUILD", "MACH")


@query(f"""WITH {_RAW_SQL} SELECT ord, CASE WHEN contains(address, 'AUTO') THEN 'AUTO' WHEN contains(address, 'BUILD') THEN 'BUILD' WHEN contains(address, 'MACH') THEN 'MACH' ELSE '' END AS region,
  round_even(ord / 8e0, 1) AS eighths, 'active' AS status FROM raw""")
def region_and_rounding(spark, sf):
    """F9, F15."""
    eighths = F.bround(F.col("ord") / 8.0, 1).alias("eighths")
    return raw_places(spark, sf).select("ord", clean.region_of(F.col("address"), _REGIONS).alias("region"), eighths, F.lit("active").alias("status"))


_BRANDS = ("BUILD",)


@query(f"""WITH {_RAW_SQL}, t AS (SELECT ord, string_split(category, ';')[1] AS t1, string_split(category, ';')[2] AS t2, string_split(category, ';')[3] AS t3 FROM raw),
  p AS (SELECT *, list_filter(list_transform(string_split(trim(t3), '|'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM t),
  o AS (SELECT *, list_filter(parts, lambda x: x <> t1 AND x <> t2 AND NOT contains(x, 'BUILD')) AS own FROM p),
  c AS (SELECT *, CASE WHEN len(own) > 0 THEN own ELSE parts END AS pick FROM o)
  SELECT ord, CASE WHEN t3 IS NULL OR len(parts) = 0 THEN '未分类' ELSE pick[list_position(list_transform(pick, lambda x: length(x)), list_max(list_transform(pick, lambda x: length(x))))] END AS type_3 FROM c""")
def specific_types(spark, sf):
    """F22."""
    parts = F.split("category", ";")
    rows = raw_places(spark, sf).select("ord", *(F.get(parts, F.lit(k)).alias(f"t{k + 1}") for k in range(3)))
    return rows.select("ord", clean.specific_type(F.col("t3"), F.col("t1"), F.col("t2"), _BRANDS).alias("type_3"))


@query(f"""WITH {_RAW_SQL}, t AS (SELECT coalesce(string_split(category, ';')[3], '') AS t3 FROM raw)
  SELECT count(*) AS rows, count(*) FILTER (contains(t3, '|')) AS changed, count(DISTINCT t3) AS kinds FROM t""")
def type_change_report(spark, sf):
    """how many values the repair changes."""
    parts = F.split("category", ";")
    rows = raw_places(spark, sf).select(*(F.coalesce(F.get(parts, F.lit(k)), F.lit("")).alias(f"t{k + 1}") for k in range(3)))
    rows = rows.withColumn("after", F.when(F.contains(F.col("t3"), F.lit("|")), clean.specific_type(F.col("t3"), F.col("t1"), F.col("t2"))).otherwise(F.col("t3")))
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("t3") != F.col("after")).alias("changed"), F.count_distinct("t3").alias("kinds"))


_WIDTHS = {"motorway": 35.0, "primary": 25.0, "secondary": 15.0, "tertiary": 10.0, "residential": 6.0, "footway": 1.5}
_KIND = "CASE n_nationkey % 8 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'tertiary' WHEN 4 THEN 'residential' WHEN 5 THEN 'footway' WHEN 6 THEN 'unheard_of' END"


@query(f"""SELECT n_nationkey AS road_id, {_KIND} AS highway, coalesce(w, 4.0)::DOUBLE AS width FROM nation
  LEFT JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in _WIDTHS.items())}) t(k, w) ON k = {_KIND}""")
def road_widths(spark, sf):
    """F24, J18."""
    from waymark.sources import lexicons

    rows = tables.table(spark, sf, "nation").selectExpr("n_nationkey road_id", f"{_KIND} highway")
    return lexicons.with_width(rows, "highway", _WIDTHS).select("road_id", "highway", "width")


# Two versions of a table: the second lacks some values and has some rows under other keys.
_VERSIONS = """a AS (SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_custkey::VARCHAR AS o_custkey FROM orders),
  b AS (SELECT (CASE WHEN o_orderkey % 101 = 7 THEN o_orderkey + 1000000000 ELSE o_orderkey END)::VARCHAR AS o_orderkey,
    CASE WHEN o_orderkey % 89 = 3 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_custkey::VARCHAR AS o_custkey FROM orders),
  d AS (SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))"""


def _two_orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a = tables.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    b = a.selectExpr("if(o_orderkey % 101 = 7, o_orderkey + 1000000000, o_orderkey) o_orderkey", "if(o_orderkey % 89 = 3, null, o_orderstatus) o_orderstatus", "o_custkey")
    return a, b


@query(f"WITH {_VERSIONS} SELECT * FROM d")
def row_differences(spark, sf):
    """J19, U3."""
    return diff.row_differences(*_two_orders(spark, sf))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) AS row, p_partkey::VARCHAR AS k, p_name, p_size::VARCHAR AS p_size FROM part),
  c AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'new' ELSE p_name END AS p_name, CASE WHEN p_partkey % 9 <> 0 THEN p_size END AS p_size FROM part
    UNION ALL SELECT r_regionkey + 1000000000, r_name, 1 FROM region),
  b AS (SELECT row_number() OVER (ORDER BY p_partkey) AS row, p_partkey::VARCHAR AS k, p_name, p_size::VARCHAR AS p_size FROM c),
  j AS (SELECT row, a.k AS ak, b.k AS bk, a.p_name AS an, b.p_name AS bn, a.p_size AS az, b.p_size AS bz FROM a FULL JOIN b USING (row))
  SELECT row, 'p_name' AS "column", an AS a, bn AS b FROM j WHERE an IS DISTINCT FROM bn UNION ALL SELECT row, 'p_size', az, bz FROM j WHERE az IS DISTINCT FROM bz
  UNION ALL SELECT row, 'p_partkey', ak, bk FROM j WHERE ak IS DISTINCT FROM bk""")
def cell_differences(spark, sf):
    """J20."""
    a = tables.table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    b = a.selectExpr("p_partkey", "if(p_partkey % 7 = 0, 'new', p_name) p_name", "if(p_partkey % 9 <> 0, p_size, null) p_size")
    b = b.union(tables.table(spark, sf, "region").selectExpr("r_regionkey + 1000000000L", "r_name", "1"))
    return diff.cell_differences(a, b, ["p_partkey"])


@query(f"WITH {_VERSIONS} SELECT side, count(*) AS n FROM d GROUP BY 1")
def difference_summary(spark, sf):
    return diff.summary(diff.row_differences(*_two_orders(spark, sf)))


@query("""SELECT part_code, n FROM (SELECT lpad((c_nationkey * 100 + 7)::VARCHAR, 6, '0') AS part_code, count(*) AS n FROM customer GROUP BY 1) ORDER BY n DESC, part_code LIMIT 10""")
def top_codes(spark, sf):
    """SRC4, S4, U2: padded codes, the ten most frequent."""
    code = F.lpad((F.col("c_nationkey") * 100 + 7).cast("string"), 6, "0").alias("part_code")
    return tables.table(spark, sf, "customer").groupBy(code).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part_code").limit(10)


@query(f"""WITH {base.POIS} SELECT id, name, priority, NULL::VARCHAR AS note FROM pois WHERE priority > 0 UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier""")
def union_of_files(spark, sf):
    """Tables of different columns."""
    a = tables.pois(spark, sf).filter("priority > 0").select("id", "name", "priority")
    b = tables.table(spark, sf, "supplier").selectExpr("s_suppkey id", "s_name name", "'supplier' note")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN concat('D', n_nationkey) WHEN n_nationkey % 3 = 1 THEN '朝阳区' END AS district FROM nation")
def district_from_file(spark, sf):
    """F19."""
    name = F.expr("case n_nationkey % 3 when 0 then concat('D', n_nationkey, '_POI数据.xlsx') when 1 then concat(n_nationkey, '-朝阳区-', n_nationkey, '.csv') else 'none.csv' end")
    return tables.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), clean.district_of(name).alias("district"))


@query("""SELECT event_id, (115 + (event_id % 200) / 100e0) AS lon, (39 + (event_id % 150) / 100e0) AS lat, event_type AS name, (props->>'k')::INT AS k FROM events""")
def json_rows(spark, sf):
    """SRC3: rows from JSON text with a joined location."""
    from waymark.sources import readers

    location = F.expr("concat(115 + (event_id % 200) / 100e0, ',', 39 + (event_id % 150) / 100e0)")
    text = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), location.alias("location"), F.get_json_object("props", "$.k").alias("typecode")))
    rows = readers.json_places(tables.table(spark, sf, "events").select(F.concat(F.lit("["), text, F.lit("]")).alias("json")), "json")
    return rows.select(F.col("poi_id").cast("long").alias("event_id"), "lon", "lat", "name", F.col("codes").cast("int").alias("k"))


_FILE = "concat('D', ord % 16, CASE WHEN ord % 16 = 5 THEN '.csv' ELSE '_POI数据.xlsx' END)"


@query(f"""WITH {_CHAIN}, f AS (SELECT {_FILE} AS source_file, ord % 16 AS d, count(*) AS rows FROM raw GROUP BY ALL),
  k AS (SELECT {_FILE} AS source_file, count(*) AS kept FROM judged WHERE reason IS NULL GROUP BY 1)
  SELECT source_file, rows, CASE WHEN d IN (5, 11) THEN 0 ELSE coalesce(kept, 0) END AS kept, CASE WHEN d IN (5, 11) THEN 'skipped' ELSE 'processed' END AS status,
    CASE d WHEN 5 THEN 'no district in the name' WHEN 11 THEN 'unknown district' END AS reason FROM f LEFT JOIN k USING (source_file)""")
def file_report(spark, sf):
    """F21, SRC12: what one job over all files made of each."""
    raw = raw_places(spark, sf).withColumn("source_file", F.expr(_FILE))
    districts = spark.range(16).filter("id <> 11").selectExpr("concat('D', id) district", "concat('1101', id) adcode")
    kept = clean.cleaned(raw, _DELETED)[0]
    return clean.file_report(raw, clean.cleanable(kept, districts), districts)
