"""Numbers over a global order, and what rests on them, at sizes at which ranges split."""

from pyspark.sql import functions as F

from waymark.operators import diff, salience, spatial, staging, stats


def test_a_large_table_does_not_differ_from_itself(spark):
    a = spark.range(1_200_000).selectExpr("id", "id * 7 % 1000 v", "md5(cast(id as string)) h", "id / 3 f")
    assert diff.cell_differences(a, a, ["id"]).isEmpty()
    b = a.withColumn("v", F.expr("if(id = 777777, -1, v)"))
    assert [tuple(r) for r in diff.cell_differences(a, b, ["id"]).collect()] == [(777_778, "v", str(777_777 * 7 % 1000), "-1")]


def test_running_totals(spark):
    rows = spark.range(5000).selectExpr("id * 7919 % 5000 id", "id % 3 w").repartition(5)
    got = sorted((r.id, r.upto) for r in staging.running(rows, [F.col("id")], F.col("w"), "upto", "test").collect())
    total = 0
    for r, (i, upto) in zip(sorted(rows.collect()), got, strict=True):
        total += r.w
        assert (r.id, total) == (i, upto)
    assert staging.running(rows.limit(0), [F.col("id")], F.col("w"), "upto", "test").count() == 0


def test_ranks_with_ties(spark):
    rows = spark.createDataFrame([(x,) for x in (5.0, 1.0, 5.0, None, 2.0, 5.0, 2.0)], "v double")
    assert sorted((r.v, r.k) for r in stats.average_ranks(rows, "v", "k").collect()) == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (5.0, 5.0), (5.0, 5.0), (5.0, 5.0)]
    scaled = salience.percentile_scaled(spark.createDataFrame([(k, float(k - 2)) for k in range(6)], "k long, v double"), "v", "p", "k")
    assert sorted((r.k, r.p) for r in scaled.collect()) == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 50.0), (4, 75.0), (5, 100.0)]


def test_nearest_by_group_against_all_pairs(spark):
    """Small groups, large ones, far outliers and members at one place."""
    rows = [(i, float(i * 7919 % 1000), float(i * 104729 % 997), "large") for i in range(300)] + [(1000, 90_000.0, 5.0, "large"), (1001, 10.0, 10.0, "alone")]
    rows += [(2000 + i, float(i * i), 50_000.0 * (i % 2), "few") for i in range(5)] + [(3000, 1.0, 1.0, "few"), (3001, 1.0, 1.0, "few")]
    df = spark.createDataFrame(rows, "id long, x double, y double, kind string")
    for group in ("kind", None):
        got = sorted((r.id, r.n, round(r.distance, 6)) for r in spatial.nearest(df, 3, 40.0, group).collect())
        want = []
        for i, x, y, kind in rows:
            far = sorted(((x - p) ** 2 + (y - q) ** 2) ** 0.5 for j, p, q, other in rows if j != i and (group is None or other == kind) and ((x - p) ** 2 + (y - q) ** 2) ** 0.5 > 1e-9)
            want += [(i, n, round(d, 6)) for n, d in enumerate(far[:3], 1)]
        assert got == sorted(want)
