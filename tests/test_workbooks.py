import json

import pytest

from waymark.sources import readers, workbooks


def test_round_trip_and_append(spark, tmp_path):
    path = f"{tmp_path}/book.xlsx"
    a = spark.createDataFrame([(1, "a<&>\"b", 1.5, None), (2, " line\nbreak 日本 ", None, True)], "k long, `a name` string, x double, ok boolean").orderBy("k")
    b = spark.createDataFrame([("x",)], "only string")
    workbooks.save({"first": a, "second & more": b}, path)
    assert workbooks.sheet_names(path) == ["first", "second & more"]
    got = workbooks.read(spark, path, "first")
    assert got.columns == ["k", "a name", "x", "ok"]
    assert sorted(map(tuple, got.collect())) == [("1", 'a<&>"b', "1.5", None), ("2", " line\nbreak 日本 ", None, "True")]
    workbooks.save({"first": a.filter("k = 1"), "third": b}, path, append=True)
    assert workbooks.sheet_names(path) == ["first", "second & more", "third"]
    assert [r.k for r in workbooks.read(spark, path, 0).collect()] == ["1", "2", "1"] and workbooks.read(spark, path, 1).first().only == "x"
    with pytest.raises(ValueError, match="columns"):
        workbooks.save({"third": a}, path, append=True)
    assert workbooks.read(spark, path, 2).count() == 1  # what failed left the file as it was


def test_many_columns(spark, tmp_path):
    names = [f"c{k}" for k in range(60)]
    df = spark.createDataFrame([tuple(range(60))], ", ".join(f"{n} long" for n in names))
    workbooks.save({"s": df}, f"{tmp_path}/wide.xlsx")
    assert list(workbooks.read(spark, f"{tmp_path}/wide.xlsx").first()) == [str(k) for k in range(60)]


def test_offline_shares(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"distance": {"Close": 0.25, "Far": 0.75}, "direction": {"North": 1.0}}))
    assert sorted(map(tuple, readers.shares(spark, f"{tmp_path}/d.json").collect())) == [("direction", "North", 1.0), ("distance", "Close", 0.25), ("distance", "Far", 0.75)]
