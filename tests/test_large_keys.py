"""Places of keys whose cubes don't fit whole numbers of 64 bits."""

from waymark.sources import tables


def test_places_of_large_keys(spark, tmp_path):
    keys = [0, 7, 3010, 3011, 89_999, 815_739, 899_994, 899_999, 12_345_670, 12_345_678]
    rows = [(k, f"c{k}", k % 25, 1.0, "M") for k in keys]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.id: (r.x, r.y) for r in tables.pois(spark, str(tmp_path)).collect()}
    for k in keys:
        r, g = k % 10, k // 10
        ax, ay = (g * 7919 + g * g * 31) % 3001, (g * 104729 + g**3 * 17) % 3011
        ax = ax // 240 * 240 + 108 if g % 3 == 0 else ax
        x = {0: ax, 1: ax + 0.5, 2: ax + 1 + g % 29, 3: ax + 31}.get(r, (k * 7919 + k * k * 31) % 3001)
        assert got[k] == (x, ay if r < 4 else (k * 104729 + k**3 * 17) % 3011)
