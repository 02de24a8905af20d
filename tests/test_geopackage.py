import sqlite3
import struct

from waymark.sources import readers


def line(points, order="<", kind=2):
    flat = [v for p in points for v in p]
    return (b"\x01" if order == "<" else b"\x00") + struct.pack(f"{order}II{len(flat)}d", kind, len(points), *flat)


def test_every_part_of_a_line_is_a_row(spark, tmp_path):
    head = b"GP\x00\x01" + struct.pack("<i", 4326)
    multi = lambda kind, *parts: head + b"\x01" + struct.pack("<II", kind, len(parts)) + b"".join(parts)
    blobs = [
        ("two", multi(5, line([(1, 2), (3, 4)]), line([(5, 6), (7, 8), (9, 9)], ">"))),
        ("z", multi(1005, line([(1, 2, 0), (3, 4, 0)], kind=1002), line([(5, 6, 1), (7, 8, 1)], kind=1002))),
        ("none", multi(5)),
        ("one", head + line([(1, 1), (2, 2)])),
    ]
    with sqlite3.connect(f"{tmp_path}/g.gpkg") as con:
        con.execute("CREATE TABLE roads (geom BLOB, name TEXT)")
        con.executemany("INSERT INTO roads VALUES (?, ?)", [(b, n) for n, b in blobs])
    held = readers.geopackage(spark, f"{tmp_path}/g.gpkg", "roads", columns=["name"], rows=3)
    assert held.rdd.getNumPartitions() == 2 and {r.srs_id for r in held.collect()} == {4326}
    rows = sorted(held.collect(), key=lambda r: (["two", "z", "none", "one"].index(r.name), str(r.points)))
    assert [(r.name, r.points and [tuple(p) for p in r.points]) for r in rows] == [
        ("two", [(1, 2), (3, 4)]), ("two", [(5, 6), (7, 8), (9, 9)]), ("z", [(1, 2), (3, 4)]), ("z", [(5, 6), (7, 8)]), ("none", None), ("one", [(1, 1), (2, 2)]),
    ]


def test_geographic_lines_are_projected(spark):
    rows = [(4326, [(117.0, 0.0), (117.0, 40.0)]), (32650, [(1.0, 2.0)]), (None, None)]
    got = readers.in_metres(spark.createDataFrame(rows, "srs_id int, points array<struct<x:double,y:double>>")).collect()
    assert [r.srs_id for r in got] == [32650, 32650, None] and got[1].points == [(1.0, 2.0)] and got[2].points is None
    assert abs(got[0].points[0].x - 500_000) < 1e-6 and abs(got[0].points[1].y - 4_427_757.219) < 0.01
