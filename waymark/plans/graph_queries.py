"""Queries on the road graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import graph, spatial
from waymark.plans import base
from waymark.sources import tables

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(function):  # noqa: ANN001, ANN202
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


def road_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The road grid cut at its junctions, with one road left apart, as lines ``(road_id, points)``."""
    spots = tables.junctions(spark, sf)
    point = F.struct("x", "y")
    from pyspark.sql import Window

    parts = []
    for base_id, along, across in ((0, "x", "y"), (100_000_000, "y", "x")):
        w = Window.partitionBy(along).orderBy(across)
        cut = spots.select("x", "y", F.lead(point).over(w).alias("q"), (F.col("x") * 10_000 + F.col("y")).cast("long").alias("n"))
        parts.append(cut.filter("q is not null").select((F.lit(base_id) + F.col("n")).alias("road_id"), F.array(point, "q").alias("points")))
    apart = spark.range(1).select(F.lit(-1).cast("long").alias("road_id"), F.array(F.struct(F.lit(9000.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(9000.0).alias("x"), F.lit(50.0).alias("y"))).alias("points"))
    return parts[0].union(parts[1]).union(apart)


_PIECES = f"""WITH {base.ROADS}, {base.JUNCTIONS}, up AS (SELECT x, y, lead(y) OVER (PARTITION BY x ORDER BY y) AS y2 FROM junctions), across AS (SELECT x, y, lead(x) OVER (PARTITION BY y ORDER BY x) AS x2 FROM junctions),
  pieces AS (SELECT (x * 10000 + y)::BIGINT AS fid, x AS ax, y AS ay, x AS bx, y2 AS b_y FROM up WHERE y2 IS NOT NULL UNION ALL SELECT 100000000 + (x * 10000 + y)::BIGINT, x, y, x2, y FROM across WHERE x2 IS NOT NULL
    UNION ALL SELECT -1, 9000, 0, 9000, 50)"""


@query(f"{_PIECES} SELECT ax, ay, bx, b_y, fid, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS weight FROM pieces")
def graph_edges(spark, sf):
    """N1."""
    return graph.edges_of(road_pieces(spark, sf)).selectExpr("a.x ax", "a.y ay", "b.x bx", "b.y b_y", "fid", "weight")


@query(f"""{_PIECES}, nodes AS (SELECT ax AS x, ay AS y FROM pieces UNION SELECT bx, b_y FROM pieces),
  least_of AS (SELECT x, y FROM nodes ORDER BY x, y LIMIT 1)
  SELECT CASE WHEN n.x = 9000 THEN 9000.0 ELSE m.x END AS x, CASE WHEN n.x = 9000 THEN 0.0 ELSE m.y END AS y, count(*) AS nodes FROM nodes n, least_of m GROUP BY 1, 2""")
def graph_components(spark, sf):
    """N2."""
    found = graph.components(graph.edges_of(road_pieces(spark, sf)))
    return found.groupBy("component").agg(F.count("*").alias("nodes")).select("component.x", "component.y", "nodes")


@query(f"""{_PIECES}, spots AS (SELECT x, y, dense_rank() OVER (ORDER BY x)::INT AS i, dense_rank() OVER (ORDER BY y)::INT AS j FROM junctions),
  e AS (SELECT fid, a.i AS i1, a.j AS j1, b.i AS i2, b.j AS j2 FROM pieces p JOIN spots a ON a.x = p.ax AND a.y = p.ay JOIN spots b ON b.x = p.bx AND b.y = p.b_y),
  paths AS (SELECT d, f, factorial((d + f)::INT)::DOUBLE / factorial(d::INT)::DOUBLE / factorial(f::INT)::DOUBLE AS n FROM range(13) a(d), range(13) b(f)),
  met AS (SELECT fid, abs(s.i - i1) AS d1, abs(s.j - j1) AS f1, abs(t.i - i2) AS d2, abs(t.j - j2) AS f2, abs(t.i - s.i) AS d, abs(t.j - s.j) AS f FROM e, spots s, spots t
    WHERE CASE WHEN i2 > i1 THEN s.i <= i1 AND t.i >= i2 AND j1 BETWEEN least(s.j, t.j) AND greatest(s.j, t.j) ELSE s.j <= j1 AND t.j >= j2 AND i1 BETWEEN least(s.i, t.i) AND greatest(s.i, t.i) END),
  share AS (SELECT fid, sum(a.n * b.n / c.n) AS v FROM met JOIN paths a ON a.d = d1 AND a.f = f1 JOIN paths b ON b.d = d2 AND b.f = f2 JOIN paths c ON c.d = met.d AND c.f = met.f GROUP BY fid)
  SELECT fid AS road_id, round(coalesce(2 * v / ((SELECT count(*) FROM spots) * ((SELECT count(*) FROM spots) - 1)), 0), 9) AS betweenness FROM pieces LEFT JOIN share USING (fid)""")
def edge_betweenness(spark, sf):
    """In a grid all monotone paths are shortest, so that binomials count them."""
    roads = road_pieces(spark, sf)
    scored = graph.edge_betweenness(graph.largest(graph.edges_of(roads)))
    return graph.to_roads(roads, scored).select("road_id", F.round("betweenness", 9).alias("betweenness"))


@query(f"""WITH {base.POIS}, l AS (SELECT x, y FROM pois WHERE priority > 0),
  c AS (SELECT DISTINCT cx, cy FROM (SELECT x, y, floor(x / 50)::BIGINT + dx AS cx, floor(y / 50)::BIGINT + dy AS cy FROM l, range(-5, 6) a(dx), range(-5, 6) b(dy))
    WHERE ((cx + 0.5) * 50 - x) * ((cx + 0.5) * 50 - x) + ((cy + 0.5) * 50 - y) * ((cy + 0.5) * 50 - y) <= 200 * 200)
  SELECT count(*) AS cells, count(*) * 2500.0 AS area FROM c""")
def buffer_cover(spark, sf):
    """The union of circles of G19, by raster cells."""
    found = spatial.covered_cells(tables.pois(spark, sf).filter("priority > 0"), 200.0, 50.0)
    return found.agg(F.count("*").alias("cells"), (F.count("*") * 2500.0).alias("area"))


@query(f"""WITH RECURSIVE {base.POIS}, l AS (SELECT x, y FROM pois WHERE priority > 0),
  c AS (SELECT DISTINCT cx, cy FROM (SELECT x, y, floor(x / 50)::BIGINT + dx AS cx, floor(y / 50)::BIGINT + dy AS cy FROM l, range(-5, 6) a(dx), range(-5, 6) b(dy))
    WHERE ((cx + 0.5) * 50 - x) * ((cx + 0.5) * 50 - x) + ((cy + 0.5) * 50 - y) * ((cy + 0.5) * 50 - y) <= 200 * 200),
  spots AS MATERIALIZED (SELECT list(p ORDER BY p.x, p.y) AS p FROM (SELECT DISTINCT {{'x': x, 'y': y}} AS p FROM pois)),
  chain(side, i, s) AS (SELECT side, 1, []::STRUCT(x DOUBLE, y DOUBLE)[] FROM (VALUES (1), (-1)) v(side)
    UNION ALL SELECT side, CASE WHEN pop THEN i ELSE i + 1 END, CASE WHEN pop THEN s[:len(s) - 1] ELSE list_append(s, q) END FROM (SELECT *,
      len(s) > 1 AND (s[-1].x - s[-2].x) * (q.y - s[-2].y) - (s[-1].y - s[-2].y) * (q.x - s[-2].x) <= 0 AS pop
      FROM (SELECT side, i, s, CASE WHEN side = 1 THEN p[i] ELSE p[len(p) + 1 - i] END AS q FROM chain, spots WHERE i <= len(p)))),
  whole AS (SELECT s FROM chain, spots WHERE i = len(p) + 1),
  hull AS (SELECT sum(s[k].x * s[k + 1].y - s[k + 1].x * s[k].y) / 2 AS hull FROM (SELECT s, unnest(range(1, len(s))) AS k FROM whole))
  SELECT (SELECT count(*) * 2500.0 FROM c) AS covered, hull, (SELECT count(*) * 2500.0 FROM c) / hull AS coverage FROM hull""")
def coverage(spark, sf):
    """The share of the hull that circles around landmarks cover."""
    pois = tables.pois(spark, sf)
    return spatial.coverage(pois.filter("priority > 0"), pois, 200.0, 50.0)


@query(f"""WITH {base.POIS}, {base.ROADS}, {base.CANDIDATES}, {base.BENT}, l AS (SELECT road_id * 10 AS road_id, 3 AS parts, points FROM bent WHERE road_id % 5 <> 0
    UNION ALL SELECT road_id * 10, 1, points[1:2] FROM bent WHERE road_id % 5 = 0 UNION ALL SELECT road_id * 10 + 1, 1, points[2:3] FROM bent WHERE road_id % 5 = 0
    UNION ALL SELECT road_id * 10 + 2, 1, points[3:4] FROM bent WHERE road_id % 5 = 0 UNION ALL SELECT road_id * 10 + 3, 2, [points[2], {{'x': -1.0, 'y': road_id::DOUBLE}}, points[3]] FROM bent WHERE road_id % 5 = 0),
  t AS (SELECT road_id, parts, CASE WHEN points[1] > points[-1] THEN list_reverse(points) ELSE points END AS points FROM l)
  SELECT road_id, parts, list_transform(points, lambda p: p.x) AS xs, list_transform(points, lambda p: p.y) AS ys FROM t""")
def merged_chains(spark, sf):
    """Pieces of bent roads are whole again, but where a by-road, of two pieces itself, leaves and joins them."""
    rows, p, k = tables.bent_roads(spark, sf), F.col("points"), F.col("road_id")
    pieces = rows.select((k * 10).alias("road_id"), F.array(F.slice(p, 1, 2), F.reverse(F.slice(p, 2, 2)), F.slice(p, 3, 2)).alias("parts"))
    pieces = pieces.select("road_id", F.posexplode("parts").alias("n", "points")).select((F.col("road_id") + F.col("n")).alias("road_id"), "points")
    corner = F.struct(F.lit(-1.0).alias("x"), k.cast("double").alias("y"))
    ways = F.array(F.array(F.element_at(p, 2), corner), F.array(F.element_at(p, 3), corner))
    aside = rows.filter(k % 5 == 0).select(k, F.posexplode(ways).alias("n", "points")).select((F.col("road_id") * 10 + 3 + F.col("n")).alias("road_id"), "points")
    found = graph.merged_chains(pieces.union(aside))
    return found.select("road_id", "parts", F.transform("points", lambda q: q["x"]).alias("xs"), F.transform("points", lambda q: q["y"]).alias("ys"))
