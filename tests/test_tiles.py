"""Counts and topology in blocks of packed places against plain loops, and places that lie on a road."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, lines
from waymark.operators import relations, tiles
from waymark.plans import relation_queries

PLACES = "id long, x double, y double, priority int"
ROADS = "road_id long, name string, width double, points array<struct<x:double,y:double>>"


def test_a_place_on_a_road_is_at_no_distance(spark):
    """Steps by shares of the length missed the place by 1e-13 m."""
    rows = [(float(v),) for v in range(0, 3001)]
    df = spark.createDataFrame(rows, "v double")
    for points in ("array(struct(120d x, -200d y), struct(120d x, 3400d y))", "array(struct(3400d x, 120d y), struct(-200d x, 120d y))"):
        up = "120d y" not in points
        x, y = (F.lit(120.0), F.col("v")) if up else (F.col("v"), F.lit(120.0))
        assert df.filter(lines.located(lines.segments(F.expr(points)), x, y)["d"] != 0).count() == 0


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("LANDMARKS", 3), ("TARGETS", 5), ("BLOCK", 16)):
        monkeypatch.setattr(tiles, name, value)


def places(rng, n):
    spot = lambda: (rng.randrange(0, 900) / 2, rng.randrange(-500, 500) / 2)
    rows = [(i, *spot(), i % 4 == 0) for i in range(n)]
    rows += [(n, 100.0, 50.0, True), (n + 1, 100.0, 50.0, False), (n + 2, None, 3.0, True), (n + 3, 5.0, None, False)]
    rows += [(0, 101.0, 51.0, False), (4, 99.0, 50.0, False)]  # ids that landmarks have
    rows += [(1000 + i, 120.0, 50.0 + i % 2, False) for i in range(30)]  # a crowd
    return [(i, x, y, int(p)) for i, x, y, p in rows]


def pairs(rows, radius):
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    for i, x, y, p in known:
        for j, u, v, q in known:
            if p and not q and i != j and (d := math.sqrt((u - x) * (u - x) + (v - y) * (v - y))) <= radius:
                yield (i, j, x, y, u, v, d)


def test_counts_against_all_pairs(spark, small_blocks):
    rows = places(random.Random(4), 80)
    for radius in (60.0, 250.0, 1000.0):
        want = {}
        for i, *_ in pairs(rows, radius):
            want[i] = want.get(i, 0) + 1
        assert {r.id: r.n for r in tiles.counted(spark.createDataFrame(rows, PLACES), radius).collect()} == want


def test_topology_against_all_pairs(spark, small_blocks):
    rows = places(random.Random(8), 60)
    ways = [(7, "up", 20.0, [(120.0, -200.0), (120.0, 3400.0)]), (3, "across", 35.0, [(-200.0, 0.0), (700.0, 0.0)]), (9, None, 6.0, [(300.0, -100.0), (340.0, 90.0), (300.0, 400.0)])]
    corners = [("c", 120.0, 0.0), ("b", 300.0, 0.0)]
    got = relations.classed(spark.createDataFrame(rows, PLACES), spark.createDataFrame(ways, ROADS), spark.createDataFrame(corners, "name string, x double, y double"))
    got = sorted(((r.landmark_id, r.target_id, r.distance, r.topology, r.road_name) for r in got.collect()), key=repr)

    def located(points, x, y):
        best, at = [], 0.0
        for (a, b), (c, d) in zip(points, points[1:], strict=False):
            size = math.dist((a, b), (c, d))
            p = min(size, max(0.0, ((x - a) * (c - a) + (y - b) * (d - b)) / size))
            fx, fy = a + (c - a) * (p / size), b + (d - b) * (p / size)
            fx, fy = (x if d == b and 0 < p < size else fx), (y if c == a and 0 < p < size else fy)
            best.append((math.sqrt((fx - x) ** 2 + (fy - y) ** 2), at + p))
            at += size
        return min(best)

    def side(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 0) - (v < 0)

    def crosses(points, p, q):
        for a, b in zip(points, points[1:], strict=False):
            over = all(min(a[k], b[k]) <= max(p[k], q[k]) and min(p[k], q[k]) <= max(a[k], b[k]) for k in (0, 1))
            if over and side(a, b, p) * side(a, b, q) <= 0 and side(p, q, a) * side(p, q, b) <= 0:
                return True
        return False

    want = []
    for i, j, x, y, u, v, d in pairs(rows, 1000.0):
        corner = min(((math.dist((u, v), (cx, cy)), n) for n, cx, cy in corners if math.dist((u, v), (cx, cy)) <= 60), default=(0, None))[1]
        at = [(r, *located(pts, x, y), *located(pts, u, v), w, n, pts) for r, n, w, pts in ways]
        least = lambda most: min(((a[1] + a[3], a[0], a) for a in at if min(a[1], a[3]) <= most), default=(0, 0, None))[2]  # noqa: B023, E731
        a, b, topology, road = least(50), least(80), "Isolated", None
        if d < 1:
            topology = "Coincident"
        elif d <= 30 and not any(crosses(w[-1], (x, y), (u, v)) for w in at):
            topology = "Abutting"
        elif corner:
            topology, road = "Intersection", corner
        elif 30 <= d <= 500 and a and abs(a[2] - a[4]) <= 20 and abs(a[1] + a[3] - a[5]) < 10 and a[1] > 0 and a[3] > 0:
            topology, road = "Opposite", a[6]
        elif 50 <= d <= 500 and b and abs(b[2] - b[4]) <= 200 and b[1] > 1 and b[3] > 1:
            topology, road = "SameSide", b[6]
        want.append((i, j, d, topology, road))
    assert got == sorted(want, key=repr)
    assert {w[3] for w in want} == set(tiles.CLASSES)


def test_nearest_pairs_choose_the_same_relations(spark, small_blocks):
    rows = spark.createDataFrame(places(random.Random(5), 90), PLACES)
    ways = spark.createDataFrame([(7, "up", 20.0, [(120.0, -200.0), (120.0, 3400.0)])], ROADS)
    corners = spark.createDataFrame([("c", 120.0, 0.0)], "name string, x double, y double")
    order = ["distance", "target_id"]
    kept = relations.relations(rows, ways, corners, order=order)
    want = relations.selected(relations.classed(rows, ways, corners), order)
    key = lambda df: sorted((r.landmark_id, r.target_id, r.distance, r.topology) for r in df.collect())
    assert key(kept) == key(want) and len(key(want)) > 100


def test_rank_by_md5_is_that_of_the_text():
    rng = random.Random(3)
    ids = [[0, 7, None, -12, 10**12, *(rng.randrange(10**6) for _ in range(40))], [None, 5, 10**15, *(rng.randrange(10**7) for _ in range(70))]]
    for more in ([], [9 * 10**18]):
        left, right = [*ids[0], *more], ids[1]
        li, ti = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij"))
        got = tiles.by_md5(42)(pa.array(left, pa.int64()), pa.array(right, pa.int64()))(li, ti)
        text = lambda i, j: "-".join(str(v) for v in (left[i], right[j], 42) if v is not None)  # noqa: B023, E731
        assert got.tolist() == [int(hashlib.md5(text(i, j).encode()).hexdigest()[:8], 16) for i, j in zip(li, ti, strict=True)]
    long = tiles.by_md5(10**20)(pa.array([10**18]), pa.array([10**18]))(np.array([0]), np.array([0]))  # more than a block
    assert long.tolist() == [int(hashlib.md5(f"{10**18}-{10**18}-{10**20}".encode()).hexdigest()[:8], 16)]


def test_pairs_first_by_md5_choose_the_same_relations(spark, small_blocks):
    rows = spark.createDataFrame(places(random.Random(6), 90), PLACES)
    ways = spark.createDataFrame([(7, "up", 20.0, [(120.0, -200.0), (120.0, 3400.0)])], ROADS)
    corners = spark.createDataFrame([("c", 120.0, 0.0)], "name string, x double, y double")
    order = [F.md5(F.concat_ws("-", "landmark_id", "target_id", F.lit(42))), F.col("target_id")]
    kept = relations.relations(rows, ways, corners, order=order, rank=tiles.by_md5(42))
    want = relations.selected(relations.classed(rows, ways, corners), order)
    key = lambda df: sorted((r.landmark_id, r.target_id, r.distance, r.topology) for r in df.collect())
    assert key(kept) == key(want) and len(key(want)) > 100


def test_kept_relations_are_computed_once(spark):
    rows = spark.createDataFrame(places(random.Random(7), 20), PLACES)
    ways = spark.createDataFrame([(7, "up", 20.0, [(120.0, -200.0), (120.0, 3400.0)])], ROADS)
    corners = spark.createDataFrame([("c", 120.0, 0.0)], "name string, x double, y double")
    plan = relations.relations(rows, ways, corners, order=["distance", "target_id"])._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Window" not in plan


def test_measured_pairs_against_all_pairs(spark, small_blocks):
    rows = places(random.Random(9), 70)
    df = spark.createDataFrame(rows, PLACES)
    for radius in (60.0, 300.0):
        got = tiles.measured(df, radius).collect()
        want = {(i, j, d, u - x, v - y) for i, j, x, y, u, v, d in pairs(rows, radius)}
        turn = lambda dx, dy: None if dx == dy == 0 else round(math.degrees(math.atan2(dx, dy)) % 360, 9)
        far = lambda az: None if az is None else round(az, 9)
        assert sorted(((r.landmark_id, r.target_id, r.distance, far(r.azimuth)) for r in got), key=repr) == sorted(((i, j, d, turn(p, q)) for i, j, d, p, q in want), key=repr)
        assert any(r.azimuth is None for r in got)


def test_rounded_measures(spark):
    rows = [(v,) for v in (0.0, 0.5e-6, 1.4e-6, 299.9999995, 359.9999999, 123.4567891, 45.0)]
    got = spark.createDataFrame([*rows, (None,)], "v double").select(geo.rounded(F.col("v"))).collect()
    assert [r[0] for r in got] == [0.0, 1e-6, 1e-6, 300.0, 360.0, 123.456789, 45.0, None]


@pytest.mark.parametrize("by_hash", [False, True])
def test_streams_of_small_blocks_choose_the_same_relations(spark, small_blocks, monkeypatch, by_hash):
    for name, value in (("PACK", 3), ("START", 2), ("TARGETS", 16), ("BLOCK", 40)):
        monkeypatch.setattr(tiles, name, value)
    rng = random.Random(12)
    rows = places(rng, 60) + [(2000 + i, rng.randrange(-1200, 1600) / 1, rng.randrange(-1200, 1200) / 1, int(i % 10 == 0)) for i in range(250)]
    rows += [(3000, 0.0, 0.0, 1), (3001, 500.0, 0.0, 0), (3002, 0.0, 1000.0, 0), (3003, 200.0, 0.0, 0), (3005, 400.0, -15.0, 1), (3006, 405.0, 17.0, 0)]
    rows += [] if by_hash else [(4, 640.0, 0.0, 1)]  # an id of two landmarks, whose pairs have one hash
    rows = spark.createDataFrame(rows, PLACES)
    ways = [(7, "up", 20.0, [(120.0, -200.0), (120.0, 3400.0)]), (3, "across", 35.0, [(-200.0, 0.0), (700.0, 0.0)]), (9, None, None, [(300.0, -100.0), (340.0, 90.0), (300.0, 400.0)])]
    ways = spark.createDataFrame(ways, ROADS)
    corners = spark.createDataFrame([("c", 120.0, 0.0), ("b", 300.0, 0.0)], "name string, x double, y double")
    order = [F.md5(F.concat_ws("-", "landmark_id", "target_id", F.lit(42))), F.col("target_id")] if by_hash else ["distance", "target_id"]
    kept = relations.relations(rows, ways, corners, order=order, rank=tiles.by_md5(42) if by_hash else None)
    want = relations.selected(relations.classed(rows, ways, corners), order)
    key = lambda df: sorted((tuple(r) for r in df.select("landmark_id", "target_id", "distance", "topology", "road_name", "poi_count", "max_keep").collect()), key=repr)
    assert key(kept) == key(want) and {r[3] for r in key(want)} == set(tiles.CLASSES)


def test_nearest_pairs_of_all_tiles_leave_the_worker(spark):
    """The nearest of every tile left it before: 62,932 pairs here."""
    rng = random.Random(13)
    rows = [(i, rng.uniform(0, 2500), rng.uniform(0, 2500), int(i % 100 == 0)) for i in range(20000)]
    rows = spark.createDataFrame(rows, PLACES)
    ways = spark.createDataFrame([(7, "up", 20.0, [(1200.0, -200.0), (1200.0, 3400.0)])], ROADS)
    corners = spark.createDataFrame([("c", 1200.0, 300.0)], "name string, x double, y double")
    pairs = relations.classed(rows, ways, corners, nearest=5).localCheckpoint()
    kept = relations.selected(pairs, ["distance", "target_id"]).count()
    assert kept > 2000 and pairs.count() < 3 * kept


def test_only_the_nearest_at_the_end_leave_the_worker(spark):
    """Pairs that nearer ones of later blocks displaced left it before."""
    rng = random.Random(14)
    rows = [(i, rng.uniform(0, 2000), rng.uniform(0, 2000), int(i % 100 == 0)) for i in range(6000)]
    ways = spark.createDataFrame([(7, "up", 20.0, [(1200.0, -200.0), (1200.0, 3400.0)])], ROADS)
    corners = spark.createDataFrame([("c", 1200.0, 300.0)], "name string, x double, y double")
    pairs = relations.classed(spark.createDataFrame(rows, PLACES), ways, corners, nearest=5)
    sizes = [r["count"] for r in pairs.groupBy("landmark_id", "topology", "dist_level").count().collect()]
    assert len(sizes) > 200 and max(sizes) == 5


def test_directions_against_all_pairs(spark, small_blocks):
    rows = places(random.Random(15), 80)
    edge = [(5000 + k, 100.0 + 80 * math.sin(math.radians(az)), 50.0 + 80 * math.cos(math.radians(az)), 0) for k, az in enumerate(np.arange(16) * 22.5)]
    df = spark.createDataFrame([*rows, *edge, (None, 90.0, 50.0, 0), (6000, float("nan"), 5.0, 0)], PLACES)
    for radius in (60.0, 250.0, 1000.0):
        got = {r.direction_8: r.n for r in tiles.directed(df, radius).collect()}
        want = {}
        for i, j, x, y, u, v, _ in pairs([*rows, *edge], radius):
            az = math.degrees(math.atan2(u - x, v - y))
            az += 360 if az < 0 else 0
            name = next((n for k, n in enumerate(geo.DIRECTIONS_8) if abs(az - 45 * k) <= 22.5 or (k == 0 and az >= 337.5)), None)
            if (x, y) != (u, v):
                want[name] = want.get(name, 0) + 1
        assert got == want and len(got) == 8


def test_natural_directions_are_no_rows_of_pairs(spark):
    """Every pair was a row whose direction came from one oversized method."""
    plan = relation_queries.sampling_balance(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ATAN2" not in plan.split("== Optimized Logical Plan ==")[1] and "MapInArrow" in plan
