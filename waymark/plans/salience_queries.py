"""Queries on scaling, isolation, cognition, fusion, selection, quadrants, sensitivity and separation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import figures, salience, stats
from waymark.operators.spatial import nearest
from waymark.plans import base
from waymark.sources import tables

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(function):  # noqa: ANN001, ANN202
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


_PREFIXES = ("Customer", "Chain")
_SUFFIXES = ("0", "11", "店")
_PROPER = {"#00000": 0.2, "77": 0.4, "123": 0.6}
_FACILITIES = (("99", 0.15), ("5", 0.30), ("3", 0.50))


@query(f"""WITH {base.POIS}, v AS (SELECT id, score - 3000 AS v FROM pois),
  r AS (SELECT id, row_number() OVER (ORDER BY v, id) AS i, count(*) OVER () AS n FROM v WHERE v > 0)
  SELECT v.id, round(coalesce(CASE WHEN n = 1 THEN 75.0 ELSE 50 + 50.0 * (i - 1) / (n - 1) END, 0), 6) AS scaled FROM v LEFT JOIN r ON v.id = r.id""")
def percentile_scale(spark, sf):
    """W2."""
    rows = tables.pois(spark, sf).select("id", (F.col("score") - 3000).alias("v"))
    return salience.percentile_scaled(rows, "v", "scaled", "id").select("id", F.round("scaled", 6).alias("scaled"))


@query(f"""WITH {base.POIS} SELECT id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 9) AS scaled FROM pois""")
def min_max_scale(spark, sf):
    """W3."""
    return stats.min_max(tables.pois(spark, sf).select("id", "score"), {"scaled": "score"}).select("id", F.round("scaled", 9).alias("scaled"))


@query(f"""WITH {base.POIS}, t AS (SELECT id, x, y, unnest(CASE WHEN id % 3 = 0 THEN [type_3, 'extra'] ELSE [type_3] END) AS type FROM pois),
  d AS (SELECT a.id, a.type, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d, b.id AS other FROM t a JOIN t b ON a.type = b.type AND a.id <> b.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY id, type ORDER BY d, other) AS n FROM d WHERE d > 1e-9),
  m AS (SELECT id, type, avg(d) AS d FROM r WHERE n <= 3 GROUP BY ALL)
  SELECT id, round(avg(d), 6) AS mean_isolation, round(max(d), 6) AS max_isolation FROM m GROUP BY id""")
def isolation(spark, sf):
    """Nearest others by type, multi-valued types."""
    pois = tables.pois(spark, sf)
    types = F.when(F.col("id") % 3 == 0, F.concat("type_3", F.lit(" | extra"))).otherwise(F.col("type_3"))
    found = salience.isolation(pois, types)
    return found.select("id", F.round("mean_isolation", 6).alias("mean_isolation"), F.round("max_isolation", 6).alias("max_isolation"))


@query(f"""WITH {base.POIS}, p AS (SELECT * FROM pois WHERE priority > 0),
  d AS (SELECT a.id, min(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) AS d FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id)
  SELECT round(avg(d), 6) AS mean_m, round(max(d), 6) AS max_m FROM d""")
def landmark_spacing(spark, sf):
    """J16."""
    found = nearest(tables.pois(spark, sf).filter("priority > 0"), 1, 100.0, least_distance=-1.0)
    return found.agg(F.round(F.avg("distance"), 6).alias("mean_m"), F.round(F.max("distance"), 6).alias("max_m"))


_CLEAN = "CASE WHEN starts_with(n1, 'Chain') THEN substr(n1, 6) ELSE n1 END"
_KNOWLEDGE = f"""((length(c) BETWEEN 3 AND 10)::INT + (NOT ({" OR ".join(f"ends_with(c, '{s}')" for s in _SUFFIXES)}))::INT
  + ({" OR ".join(f"contains(c, '{p}')" for p in _PROPER)})::INT + contains(c, type_3)::INT) / 4"""
_PENALTY = "CASE " + "".join(f"WHEN contains(name, '{w}') THEN {f} " for w, f in _FACILITIES) + "END"
_COGNITION = f"""named AS (SELECT id, name, type_3, x, y, score, priority, CASE WHEN starts_with(name, 'Customer') THEN substr(name, 9) ELSE name END AS n1 FROM pois),
  cleaned AS (SELECT *, regexp_replace({_CLEAN}, '\\s+', '', 'g') AS c FROM named),
  toks AS (SELECT id, unnest(list_filter(regexp_extract_all(lower(c), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN {_SUFFIXES})) AS t FROM cleaned),
  freq AS (SELECT t, count(*) AS n FROM toks GROUP BY t),
  most AS (SELECT id, max(n) AS m FROM toks JOIN freq USING (t) GROUP BY id),
  raw AS (SELECT cleaned.*, CASE WHEN m IS NULL THEN 0.0 ELSE log10(1 + count(*) OVER () / m) END AS u, {_KNOWLEDGE} AS knowledge,
    least(coalesce(greatest({", ".join(f"CASE WHEN contains(c, '{w}') THEN {v} END" for w, v in _PROPER.items())}), 0) / 0.5, 1.0)::DOUBLE AS brand,
    coalesce({_PENALTY}, 1.0)::DOUBLE AS penalty FROM cleaned LEFT JOIN most USING (id)),
  uniq AS (SELECT *, (u - min(u) OVER ()) / nullif(max(u) OVER () - min(u) OVER (), 0) AS uniqueness FROM raw),
  famed AS (SELECT *, avg((uniqueness > (SELECT quantile_cont(uniqueness, 0.9) FROM uniq))::INT) OVER (PARTITION BY type_3) AS fame FROM uniq),
  scored AS (SELECT *, (0.2 * knowledge + 0.35 * uniqueness + 0.25 * brand + 0.2 * fame) * penalty AS q FROM famed),
  cognition AS (SELECT *, (q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()) AS cognition_score FROM scored)"""


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """Names with words that repeat, so that tokens differ in frequency."""
    name = F.expr("concat(name, ' ', case when id % 4 = 0 then 'tea house' when id % 9 = 1 then concat('gate', id % 13) else 'yard' end)")
    return tables.pois(spark, sf).withColumn("name", name)


_NAMED = base.POIS.replace("SELECT id, name, type_3", "SELECT id, concat(name, ' ', CASE WHEN id % 4 = 0 THEN 'tea house' WHEN id % 9 = 1 THEN concat('gate', id % 13) ELSE 'yard' END) AS name, type_3", 1)


def _cognition(spark: SparkSession, sf: str) -> DataFrame:
    return salience.cognition(_named(spark, sf), "id", _PREFIXES, _SUFFIXES, _PROPER, _FACILITIES)


@query(f"""WITH {_NAMED}, {_COGNITION} SELECT id, c AS clean_name, round(knowledge, 6) AS knowledge, round(brand, 6) AS brand, round(uniqueness, 6) AS uniqueness,
  round(fame, 6) AS fame, penalty, round(cognition_score, 6) AS cognition_score FROM cognition""")
def cognition(spark, sf):
    """L1-L7, J22, A26, A27."""
    keep = ("knowledge", "brand", "uniqueness", "fame", "cognition_score")
    return _cognition(spark, sf).select("id", "clean_name", "penalty", *(F.round(c, 6).alias(c) for c in keep))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.pois(spark, sf).withColumns(
        {
            "exposure": F.col("id") % 101 / 1.0,
            "centrality": (F.col("id") * 37) % 89 / 1.0,
            "isolation": (F.col("id") * 53) % 97 / 1.0,
            "cognition_score": (F.col("id") * 71) % 1009 / 1008.0,
        }
    )
    return salience.composite(rows)


_SCORES = f"""{base.POIS}, signals AS (SELECT *, 0.4e0 * (id % 101) + 0.35e0 * ((id * 37) % 89) + 0.25e0 * ((id * 53) % 97) AS raw, ((id * 71) % 1009) / 1008e0 AS cognition_score FROM pois),
  spatial AS (SELECT *, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS spatial_score FROM signals),
  scores AS (SELECT *, 1 / (1 + exp(-8e0 * (0.2e0 * spatial_score + 0.8e0 * cognition_score - 0.5e0))) AS composite_score FROM spatial)"""


@query(f"WITH {_SCORES} SELECT id, round(spatial_score, 6) AS spatial_score, round(composite_score, 6) AS composite_score FROM scores")
def composite(spark, sf):
    """L8, L9."""
    return _scores(spark, sf).select("id", F.round("spatial_score", 6).alias("spatial_score"), F.round("composite_score", 6).alias("composite_score"))


_SELECTION = f"""{_SCORES}, q AS (SELECT quantile_cont(spatial_score, 0.6) AS s6, quantile_cont(spatial_score, 0.7) AS s7, quantile_cont(spatial_score, 0.8) AS s8,
    quantile_cont(cognition_score, 0.6) AS c6, quantile_cont(cognition_score, 0.7) AS c7, quantile_cont(cognition_score, 0.8) AS c8, min(x) AS x0, min(y) AS y0 FROM scores),
  celled AS (SELECT scores.*, floor((x - x0) / 1000)::BIGINT AS grid_x, floor((y - y0) / 1000)::BIGINT AS grid_y,
    CASE WHEN spatial_score >= s8 AND cognition_score >= c8 THEN 1 WHEN cognition_score >= c7 AND spatial_score <= s6 THEN 2
      WHEN spatial_score >= s7 AND cognition_score <= c6 THEN 3 ELSE 4 END AS class FROM scores, q),
  cells AS (SELECT grid_x, grid_y, count(*) AS n, quantile_cont(composite_score, 0.7) AS p70 FROM celled GROUP BY ALL),
  passing AS (SELECT c.*, greatest(1, floor(0.2e0 * pow(n, 0.8e0))) AS quota, row_number() OVER (PARTITION BY c.grid_x, c.grid_y ORDER BY class, composite_score DESC, id) AS k
    FROM celled c JOIN cells USING (grid_x, grid_y) WHERE composite_score >= p70),
  chosen AS (SELECT c.id, c.grid_x, c.grid_y, CASE WHEN k <= quota THEN c.class ELSE 0 END AS landmark_priority FROM celled c LEFT JOIN passing p ON c.id = p.id)"""


@query(f"WITH {_SELECTION} SELECT id, grid_x, grid_y, coalesce(landmark_priority, 0) AS landmark_priority FROM chosen")
def landmark_selection(spark, sf):
    """L10, L11, A28, A29, W4, G18."""
    return salience.selected_landmarks(_scores(spark, sf)).select("id", "grid_x", "grid_y", "landmark_priority")


@query(f"""WITH {_SELECTION} SELECT coalesce(landmark_priority, 0) AS landmark_priority, count(*) AS n FROM chosen GROUP BY 1""")
def priority_counts(spark, sf):
    """A30."""
    return salience.selected_landmarks(_scores(spark, sf)).groupBy("landmark_priority").agg(F.count("*").alias("n"))




@query("""WITH m AS (SELECT count(*) AS n, avg(l_extendedprice) AS a, stddev_samp(l_extendedprice) AS sd, median(l_extendedprice) AS md, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
    quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.75) AS p75, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem),
  d AS (SELECT avg(pow(l_extendedprice - a, 2)) AS m2, avg(pow(l_extendedprice - a, 3)) AS m3, avg(pow(l_extendedprice - a, 4)) AS m4 FROM lineitem, m)
  SELECT n, round(a, 6) AS mean, round(md, 6) AS median, round(sd, 6) AS sd, round(lo, 6) AS min, round(hi, 6) AS max, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurt,
  round(p25, 6) AS p25, round(p75, 6) AS p75, round(p90, 6) AS p90, round(p95, 6) AS p95 FROM m, d""")
def descriptives_population(spark, sf):
    """A15."""
    return stats.descriptives(tables.table(spark, sf, "lineitem"), "l_extendedprice")


@query("""SELECT count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(stddev_samp(l_quantity), 6) AS sd, round(min(l_quantity), 6) AS min,
  round(max(l_quantity), 6) AS max, round(skewness(l_quantity), 6) AS skew, round(kurtosis(l_quantity), 6) AS kurt FROM lineitem""")
def descriptives_corrected(spark, sf):
    """A14."""
    return stats.descriptives(tables.table(spark, sf, "lineitem"), "l_quantity", population=False, shares=())


@query("""WITH v AS (SELECT c_acctbal - 3000 AS v FROM customer) SELECT count(*) FILTER (v > 0) AS n, round(avg(v) FILTER (v > 0), 6) AS mean, round(max(v) FILTER (v > 0), 6) AS max,
  round(min(v) FILTER (v > 0), 6) AS min, round(median(v) FILTER (v > 0), 6) AS median, count(*) FILTER (v <= 0) AS not_positive FROM v""")
def positive_statistics(spark, sf):
    """A25."""
    v = F.col("c_acctbal") - 3000
    p = F.when(v > 0, v)
    made = {"mean": F.avg(p), "max": F.max(p), "min": F.min(p), "median": F.median(p)}
    return tables.table(spark, sf, "customer").agg(F.count(p).alias("n"), *(F.round(c, 6).alias(k) for k, c in made.items()), F.count_if(v <= 0).alias("not_positive"))


_RANKED = """r AS (SELECT l_quantity AS a, l_discount AS b, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS rb FROM lineitem)"""


@query(f"WITH {_RANKED} SELECT count(*) AS n, round(corr(a, b), 9) AS pearson, round(corr(ra, rb), 9) AS spearman FROM r")
def correlations(spark, sf):
    """A16; p-values are tested on hand rows."""
    found = stats.correlations(tables.table(spark, sf, "lineitem"), "l_quantity", "l_discount")
    return found.select("n", F.round("pearson", 9).alias("pearson"), F.round("spearman", 9).alias("spearman"))




def _q(p: int) -> str:
    return f"quantile_cont(spatial_score, 0.{p}) AS s{p}, quantile_cont(cognition_score, 0.{p}) AS c{p}"


@query(f"""WITH {_SCORES} SELECT count(*) FILTER (spatial_score >= s80 AND cognition_score >= c80) AS q1, count(*) FILTER (cognition_score >= c75 AND spatial_score <= s60) AS q2,
  count(*) FILTER (spatial_score >= s75 AND cognition_score <= c60) AS q3, count(*) FILTER (spatial_score < s75 AND cognition_score < c75) AS q4, count(*) AS n
  FROM scores, (SELECT {_q(80)}, {_q(75)}, {_q(60)} FROM scores)""")
def quadrants_overlapping(spark, sf):
    """A17."""
    shares = {f"{k[0]}{p}": (f"{k}_score", p / 100) for k in ("spatial", "cognition") for p in (80, 75, 60)}
    rows = stats.with_scalars(df := _scores(spark, sf), stats.quantiles(df, shares))
    s, c, v = F.col("spatial_score"), F.col("cognition_score"), F.col
    return rows.agg(
        F.count_if((s >= v("s80")) & (c >= v("c80"))).alias("q1"), F.count_if((c >= v("c75")) & (s <= v("s60"))).alias("q2"),
        F.count_if((s >= v("s75")) & (c <= v("c60"))).alias("q3"), F.count_if((s < v("s75")) & (c < v("c75"))).alias("q4"), F.count("*").alias("n"),
    )


_QUADRANT = "CASE WHEN spatial_score >= s75 AND cognition_score >= c75 THEN 'Q1' WHEN cognition_score >= c75 THEN 'Q2' WHEN spatial_score >= s75 THEN 'Q3' ELSE 'Q4' END"


def _with_quadrant(df: DataFrame) -> DataFrame:
    held = stats.with_scalars(df, stats.quantiles(df, {"s75": ("spatial_score", 0.75), "c75": ("cognition_score", 0.75)}))
    return held.withColumn("quadrant", F.expr(_QUADRANT))


@query(f"""WITH {_SCORES}, x AS (SELECT *, {_QUADRANT} AS quadrant FROM scores, (SELECT {_q(75)} FROM scores))
  SELECT quadrant, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM x), 6) AS percent, round(avg(spatial_score), 6) AS mean_spatial, round(avg(cognition_score), 6) AS mean_cognition,
  round(avg(composite_score), 6) AS mean, round(median(composite_score), 6) AS median, round(stddev_samp(composite_score), 6) AS sd FROM x GROUP BY 1""")
def quadrants_orthogonal(spark, sf):
    """A18, A21."""
    rows = _with_quadrant(_scores(spark, sf))
    total = rows.agg(F.count("*").alias("t"))
    made = rows.groupBy("quadrant").agg(
        F.count("*").alias("n"), F.round(F.avg("spatial_score"), 6).alias("mean_spatial"), F.round(F.avg("cognition_score"), 6).alias("mean_cognition"),
        F.round(F.avg("composite_score"), 6).alias("mean"), F.round(F.median("composite_score"), 6).alias("median"), F.round(F.stddev_samp("composite_score"), 6).alias("sd"),
    )
    return stats.with_scalars(made, total).withColumn("percent", F.round(100.0 * F.col("n") / F.col("t"), 6)).drop("t")


@query(f"""WITH {_SCORES}, x AS (SELECT *, {_QUADRANT} AS quadrant, 0.5e0 * spatial_score + 0.5e0 * cognition_score AS s FROM scores, (SELECT {_q(75)} FROM scores)),
  p AS (SELECT a.v::DOUBLE AS x0, b.v::DOUBLE AS k FROM (VALUES (0.3), (0.4), (0.5), (0.6), (0.7)) a(v), (VALUES (4), (6), (8), (10), (12)) b(v)),
  l AS (SELECT x0, k, quadrant, 1 / (1 + exp(-k * (s - x0))) AS v FROM x, p)
  SELECT x0, k, round(avg(v), 6) AS mean, round(avg(v) FILTER (quadrant = 'Q1'), 6) AS q1_mean, round(avg(v) FILTER (quadrant = 'Q4'), 6) AS q4_mean,
  round(100.0 * avg((v < 0.10)::INT), 6) AS suppressed, round(avg(v) FILTER (quadrant = 'Q1') / avg(v) FILTER (quadrant = 'Q4'), 6) AS ratio FROM l GROUP BY x0, k""")
def sigmoid_sensitivity(spark, sf):
    """A grid of 25 parameter pairs, broadcast."""
    grid = spark.createDataFrame([(x0, float(k)) for x0 in (0.3, 0.4, 0.5, 0.6, 0.7) for k in (4, 6, 8, 10, 12)], "x0 double, k double")
    rows = stats.with_scalars(_with_quadrant(_scores(spark, sf)), grid)
    v = salience.sigmoid(0.5 * F.col("spatial_score") + 0.5 * F.col("cognition_score"), F.col("k"), F.col("x0"))
    of = lambda q: F.avg(F.when(F.col("quadrant") == q, F.col("v")))
    return rows.withColumn("v", v).groupBy("x0", "k").agg(
        F.round(F.avg("v"), 6).alias("mean"), F.round(of("Q1"), 6).alias("q1_mean"), F.round(of("Q4"), 6).alias("q4_mean"),
        F.round(100.0 * F.avg((F.col("v") < 0.10).cast("int")), 6).alias("suppressed"), F.round(of("Q1") / of("Q4"), 6).alias("ratio"),
    )


@query(f"""WITH {_SCORES}, l AS (SELECT 'sigmoid' AS model, composite_score AS v FROM scores UNION ALL SELECT 'linear', 0.5e0 * spatial_score + 0.5e0 * cognition_score FROM scores
    UNION ALL SELECT 'product', sqrt(greatest(spatial_score * cognition_score, 0)) FROM scores), a AS (SELECT model, avg(v) AS m FROM l GROUP BY 1),
  d AS (SELECT model, avg(pow(v - m, 2)) AS m2, avg(pow(v - m, 3)) AS m3, avg(pow(v - m, 4)) AS m4 FROM l JOIN a USING (model) GROUP BY 1)
  SELECT model, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, round(any_value(m3 / pow(m2, 1.5)), 6) AS skew,
  round(any_value(m4 / (m2 * m2) - 3), 6) AS kurt, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM l JOIN d USING (model) GROUP BY model""")
def fusion_models(spark, sf):
    """A20."""
    rows = _scores(spark, sf).select(
        F.expr("stack(3, 'sigmoid', composite_score, 'linear', 0.5e0 * spatial_score + 0.5e0 * cognition_score, 'product', sqrt(greatest(spatial_score * cognition_score, 0e0))) as (model, v)")
    )
    made = {
        "mean": F.avg("v"), "sd": F.stddev_samp("v"), "median": F.median("v"), "p75": F.percentile("v", 0.75), "skew": F.skewness("v"), "kurt": F.kurtosis("v"),
        "iqr": F.percentile("v", 0.75) - F.percentile("v", 0.25),
    }
    return rows.groupBy("model").agg(*(F.round(c, 6).alias(k) for k, c in made.items()))


_SUMMARY = "count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(median(v), 6) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr"


@query(f"""WITH l AS (SELECT l_extendedprice AS v, l_returnflag AS f FROM lineitem)
  SELECT CASE WHEN f = 'R' THEN 'selected' ELSE 'background' END AS side, {_SUMMARY} FROM l GROUP BY 1 UNION ALL SELECT f, {_SUMMARY} FROM l GROUP BY 1""")
def separation_table(spark, sf):
    """In halves and by class."""
    rows = tables.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("v"), F.col("l_returnflag").alias("f"))
    made = {"mean": F.avg("v"), "sd": F.stddev_samp("v"), "median": F.median("v"), "iqr": F.percentile("v", 0.75) - F.percentile("v", 0.25)}
    one = lambda key: rows.groupBy(key.alias("side")).agg(F.count("*").alias("n"), *(F.round(c, 6).alias(k) for k, c in made.items()))
    return one(F.when(F.col("f") == "R", "selected").otherwise("background")).union(one(F.col("f")))


@query("""WITH r AS (SELECT l_extendedprice AS v, l_returnflag = 'R' AS g, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS k FROM lineitem),
  s AS (SELECT count(*) FILTER (g)::DOUBLE AS n1, count(*) FILTER (NOT g)::DOUBLE AS n0, avg(v) FILTER (g) AS m1, avg(v) FILTER (NOT g) AS m0, var_samp(v) FILTER (g) AS s1, var_samp(v) FILTER (NOT g) AS s0,
    sum(k) FILTER (g) AS r1 FROM r), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, s1 / n1 AS a, s0 / n0 AS b FROM s)
  SELECT round((m1 - m0) / sqrt(a + b), 6) AS t, round((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)), 4) AS df, u::DOUBLE AS u,
  round((u - n1 * n0 / 2) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12), 6) AS u_z, round((m1 - m0) / sqrt(((n1 - 1) * s1 + (n0 - 1) * s0) / (n1 + n0 - 2)), 6) AS d FROM u""")
def separation_tests(spark, sf):
    """A23."""
    return stats.separation(tables.table(spark, sf, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R")


_KAPPA = """p AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n) AS t FROM p),
  ra AS (SELECT a, sum(n) AS na FROM p GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM p GROUP BY b),
  g AS (SELECT {w} AS w, coalesce(n, 0) AS n, na, nb, t FROM ra CROSS JOIN rb CROSS JOIN t LEFT JOIN p ON p.a = ra.a AND p.b = rb.b),
  k AS (SELECT sum(w * n / t) AS wo, sum(w * na * nb / t / t) AS we, any_value(t)::BIGINT AS n FROM g)"""


@query(f"WITH {_KAPPA.format(w='(ra.a <> rb.b)::INT')} SELECT n, round(1 - wo, 6) AS agreement, round(1 - wo / we, 6) AS kappa FROM k")
def kappa_unweighted(spark, sf):
    """A34, A36."""
    return stats.kappa(tables.table(spark, sf, "labels"), "quality", "toxic")


@query(f"WITH {_KAPPA.format(w='(ra.a - rb.b) * (ra.a - rb.b)')} SELECT n, round(wo, 6) AS disagreement, round(1 - wo / we, 6) AS kappa FROM k")
def kappa_quadratic(spark, sf):
    """A35."""
    return stats.kappa(tables.table(spark, sf, "labels"), "quality", "toxic", weighted=True)


@query("""SELECT 'quality' AS dimension, count(quality) AS n, round(avg(quality), 6) AS mean, round(stddev_samp(quality), 6) AS sd FROM labels
  UNION ALL SELECT 'toxic', count(toxic), round(avg(toxic), 6), round(stddev_samp(toxic), 6) FROM labels""")
def rating_summary(spark, sf):
    """A33."""
    rows = tables.table(spark, sf, "labels").unpivot([], ["quality", "toxic"], "dimension", "v")
    return rows.groupBy("dimension").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"))


@query("""WITH m AS (SELECT p_brand AS name, sum(p_retailprice) AS size, avg(p_size) AS d1, count(*) AS d2 FROM part GROUP BY 1),
  s AS (SELECT *, (ln(size) - min(ln(size)) OVER ()) / (max(ln(size)) OVER () - min(ln(size)) OVER ()) AS scale FROM m)
  SELECT name, round(scale, 6) AS scale, round((scale + d1 / 50 + d2 / 200e0) / 3, 6) AS capability, round((scale + d1 / 50 + d2 / 200e0) / avg(scale + d1 / 50 + d2 / 200e0) OVER (), 6) AS ratio FROM s""")
def benchmark_capability(spark, sf):
    """A37."""
    rows = tables.table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.log(F.sum("p_retailprice")).alias("l"), F.avg("p_size").alias("d1"), F.count("*").alias("d2"))
    rows = stats.min_max(rows, {"scale": "l"}).withColumn("s", F.col("scale") + F.col("d1") / 50 + F.col("d2") / 200.0)
    rows = stats.with_scalars(rows, rows.agg(F.avg("s").alias("m")))
    return rows.select("name", F.round("scale", 6).alias("scale"), F.round(F.col("s") / 3, 6).alias("capability"), F.round(F.col("s") / F.col("m"), 6).alias("ratio"))


@query(f"WITH {base.POIS} SELECT id, score, 'top' AS side FROM (SELECT * FROM pois ORDER BY score DESC, id LIMIT 10) UNION ALL SELECT id, score, 'bottom' FROM (SELECT * FROM pois ORDER BY score, id LIMIT 10)")
def largest_and_smallest(spark, sf):
    """S1, S3."""
    pois = tables.pois(spark, sf).select("id", "score")
    top, bottom = pois.orderBy(F.desc("score"), "id").limit(10), pois.orderBy("score", "id").limit(10)
    return top.withColumn("side", F.lit("top")).union(bottom.withColumn("side", F.lit("bottom")))


@query("""WITH b AS (SELECT greatest(0, least(19, floor((l_extendedprice - lo) / (hi - lo) * 20)))::INT AS bin FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem))
  SELECT bin, count(*) AS n FROM b GROUP BY 1""")
def histogram_data(spark, sf):
    """SNK10: what a histogram draws."""
    rows = tables.table(spark, sf, "lineitem")
    rows = stats.with_scalars(rows, rows.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")))
    bin_ = F.greatest(F.lit(0), F.least(F.lit(19), F.floor((F.col("l_extendedprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20))).cast("int")
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '-42'), o_orderkey LIMIT 20000")
def seeded_sample(spark, sf):
    """20,000 rows, or all of fewer; the same in every run."""
    order = [F.md5(F.concat_ws("-", "o_orderkey", F.lit(42))), "o_orderkey"]
    return stats.hash_sample(tables.table(spark, sf, "orders"), 20_000, "o_orderkey", order=order).select("o_orderkey")


_PLACES = "SELECT *, lo + (hi - lo) * k / 49e0 AS x FROM (SELECT *, unnest(range(50)) AS k FROM b)"


@query(f"""WITH v AS (SELECT c_mktsegment AS segment, c_acctbal::DOUBLE AS v FROM customer),
  b AS (SELECT segment, min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) * pow(count(*)::DOUBLE, -0.2) AS width FROM v GROUP BY segment), g AS ({_PLACES})
  SELECT segment, k, round(x, 6) AS x, round(sum(exp(-0.5 * pow((v - x) / width, 2))) / (n * width * sqrt(2 * pi())), 9) AS density FROM g JOIN v USING (segment) GROUP BY segment, k, x, n, width""")
def violin_data(spark, sf):
    """SNK10: what violins and density curves draw."""
    rows = tables.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return figures.density(rows, "c_acctbal", by="segment").withColumns({"x": F.round("x", 6), "density": F.round("density", 9)})


@query(f"""WITH v AS (SELECT c_acctbal::DOUBLE AS v FROM customer), b AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) * pow(count(*)::DOUBLE, -0.2) AS width FROM v), g AS ({_PLACES})
  SELECT k, round(x, 6) AS x, round(sum(exp(-0.5 * pow((v - x) / width, 2))) / (n * width * sqrt(2 * pi())), 9) AS density FROM g, v GROUP BY k, x, n, width""")
def density_data(spark, sf):
    """SNK10."""
    found = figures.density(tables.table(spark, sf, "customer"), "c_acctbal")
    return found.withColumns({"x": F.round("x", 6), "density": F.round("density", 9)})


@query(f"""WITH v AS (SELECT l_extendedprice::DOUBLE AS v FROM lineitem), b AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM v), g AS ({_PLACES})
  SELECT k, round(x, 6) AS x, round((count(*) FILTER (v <= x)) / any_value(n), 9) AS share FROM g, v GROUP BY k, x""")
def cumulative_data(spark, sf):
    """SNK10: what a cumulative curve draws."""
    found = figures.cumulative(tables.table(spark, sf, "lineitem"), "l_extendedprice")
    return found.withColumns({"x": F.round("x", 6), "share": F.round("share", 9)})


@query(f"""WITH {base.POIS}, v AS (SELECT x, score AS y FROM pois), b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM v)
  SELECT least(19, floor((x - lx) / (hx - lx) * 20))::INT AS bin_x, least(19, floor((y - ly) / (hy - ly) * 20))::INT AS bin_y, count(*) AS n FROM v, b GROUP BY 1, 2""")
def heat_map_data(spark, sf):
    """SNK10: what a heat map draws."""
    return figures.cells(tables.pois(spark, sf), "x", "score")
