from waymark.plans import registry


def test_seeded_sample_has_20000_rows_or_all(spark):
    query = registry.queries()["seeded_sample"]
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert query(spark, "/root/testdata/sf0.001").distinct().count() == orders.count() < 20_000
    assert query(spark, "/root/testdata/sf0.1").distinct().count() == 20_000
