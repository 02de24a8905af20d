"""Totals by topology and road against those of the pairs themselves, and places laid out in blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_tiles import PLACES, ROADS, places
from waymark.operators import relations, tallies, tiles
from waymark.plans import relation_queries


def test_places_are_laid_out_once():
    rng = np.random.default_rng(3)
    for n, size in ((0, 4), (1, 4), (4, 4), (5, 4), (37, 3), (1000, 64)):
        x, y = rng.integers(0, 50, n).astype(float), rng.random(n)
        order, starts = tallies._laid(x, y, size)
        assert sorted(order) == list(range(n))
        assert all(0 < e - s <= size for s, e in zip(starts, [*starts, n][1:], strict=True)) and starts[:1] == [0][:n]


@pytest.mark.parametrize("rows_, columns, block, wide", [(3, 5, 16, None), (64, 1024, 1 << 18, 35.0), (200, 40, 1000, 470.0)])
def test_totals_against_pairs(spark, monkeypatch, rows_, columns, block, wide):
    monkeypatch.setattr(tallies, "ROWS", rows_)
    monkeypatch.setattr(tallies, "COLUMNS", columns)
    monkeypatch.setattr(tiles, "BLOCK", block)
    monkeypatch.setattr(tiles, "TARGETS", 90)
    rng = random.Random(16)
    rows = places(rng, 60) + [(2000 + i, rng.randrange(-1200, 1600) / 1, rng.randrange(-1200, 1200) / 1, int(i % 8 == 0)) for i in range(600)]
    rows += [(3000, 0.0, 0.0, 1), (3001, 500.0, 0.0, 0), (3002, 0.0, 1000.0, 0), (3003, 200.0, 0.0, 0), (3005, 400.0, -15.0, 1), (3006, 405.0, 17.0, 0)]
    ways = [(7, "up", 20.0, [(120.0, -1200.0), (120.0, 3400.0)]), (3, "across", wide, [(-1200.0, 0.0), (700.0, 0.0)]), (9, None, None, [(300.0, -100.0), (340.0, 90.0), (300.0, 400.0)])]
    ways += [(20 + k, f"w{k % 3}", 6.0, [(-1200.0, 140.0 * k - 700), (200.0, 150.0 * k - 700), (1600.0, 140.0 * k - 690)]) for k in range(8)]
    frames = spark.createDataFrame(rows, PLACES), spark.createDataFrame(ways, ROADS), spark.createDataFrame([("c", 120.0, 0.0), ("b", 300.0, 0.0)], "name string, x double, y double")
    known = frames[0].filter("id is not null")
    for radius in (1000.0, 300.0):
        got = {(r.topology, r.road_name): (r.n, r.total_m) for r in relations.topology_totals(*frames, radius).collect()}
        pairs = relations.classed(known, *frames[1:], radius).groupBy("topology", "road_name").agg(F.count("*").alias("n"), F.sum("distance").alias("total_m"))
        want = {(r.topology, r.road_name): (r.n, r.total_m) for r in pairs.collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], rel_tol=1e-9, abs_tol=1e-6) for k in want)
        assert radius < 1000 or {t for t, _ in want} >= set(tiles.CLASSES) - ({"Opposite"} if wide != 35.0 else set())


def test_totals_without_roads_and_beside_odd_places(spark):
    rows = [(1, 0.0, 0.0, 1), (2, 3.0, 4.0, 0), (3, 600.0, 0.0, 0), (1, 1.0, 0.0, 0), (None, 1.0, 0.0, 0), (4, float("nan"), 0.0, 0), (5, None, 0.0, 1), (6, float("inf"), 0.0, 0)]
    frames = spark.createDataFrame(rows, PLACES), spark.createDataFrame([], ROADS), spark.createDataFrame([("c", 600.0, 9.0)], "name string, x double, y double")
    got = {tuple(r) for r in relations.topology_totals(*frames).collect()}
    assert got == {("Abutting", None, 1, 5.0), ("Intersection", "c", 1, 600.0)}


def test_cascade_gives_only_totals(spark):
    """Every pair left the worker as a row before."""
    plan = relation_queries.topology_cascade(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "landmark_id" not in plan
