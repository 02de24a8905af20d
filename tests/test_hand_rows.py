"""Hand-computed rows: every boundary of the labels, measures with closed forms, readers and sinks."""

import itertools
import json
import math
import random
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, lines
from waymark.operators import clean, graph, refine, relations, salience, spatial, stats, textgen, textmetrics
from waymark.plans import graph_queries
from waymark.sources import lexicons, readers, sinks
from waymark.streaming import pending


def values(spark, column, rows, schema="a double"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.coalesce(1).select(column).collect()]


def test_azimuth(spark):
    got = values(spark, geo.azimuth(F.col("a"), F.col("b")), [(0.0, 1.0), (1.0, 0.0), (0.0, -1.0), (-1.0, 0.0), (0.0, 0.0), (-1e-300, 1.0)], "a double, b double")
    assert got == [0, 90, 180, 270, None, 0]


def test_sectors_and_bands(spark):
    az = [22.5, 22.51, 67.5, 337.5, 337.49, 0.0, 180.0, None]
    assert values(spark, geo.direction_8(F.col("a")), az) == ["North", "Northeast", "Northeast", "North", "Northwest", "North", "South", None]
    d = [49.99, 50.0, 200.0, 500.0, 1000.0, 1000.01, None]
    assert values(spark, geo.dist_level(F.col("a")), d) == ["VeryClose", "Close", "Medium", "Far", "Far", None, None]
    assert values(spark, geo.is_ambiguous(F.col("a")), [19.9, 20.0, 22.4, 22.5, 42.5, None]) == [False, True, True, False, True, False]
    fine = geo.direction_16(F.col("a"), F.lit("Intersection"), F.lit(900.0))
    assert values(spark, fine, [11.25, 11.26, 348.75, 348.74]) == ["North", "NorthNortheast", "North", "NorthNorthwest"]
    assert values(spark, geo.direction_16(F.col("a"), F.lit("Opposite"), F.lit(200.0)), [11.26]) == ["North"]


def test_deviation_and_levels(spark):
    rows = [(350.0, "North"), (5.0, "North"), (22.5, "North"), (100.0, None), (300.0, "Northwest")]
    dev = geo.deviation(F.col("a"), F.col("b"))
    assert values(spark, dev, rows, "a double, b string") == [10, 5, 22.5, None, 15]
    assert values(spark, geo.ambiguity_level(dev), rows, "a double, b string") == ["SLIGHT", "EXACT", "MODERATE", None, "SLIGHT"]
    assert values(spark, geo.ambiguity_level(F.col("a")), [22.51]) == ["CROSS_BOUNDARY"]
    assert values(spark, relations.max_keep(F.col("a")), [199.0, 200.0, 500.0, 1000.0]) == [2, 3, 4, 5]


def test_scenes(spark):
    rows = [("Opposite", "Explicit", "r"), ("SameSide", "Explicit", " "), ("Abutting", "Implicit", None), ("Abutting", "Explicit", None), ("Coincident", "Implicit", None), ("Isolated", "Explicit", None), ("odd", "Explicit", None)]
    args = (F.col("t"), F.col("c"), F.col("r"))
    assert values(spark, geo.scene_code(*args), rows, "t string, c string, r string") == ["SCENE-B", "SCENE-E", "SCENE-C", "SCENE-A", "SCENE-D", "SCENE-C", "SCENE-E"]
    assert values(spark, geo.scene_code(*args, abutting_scene_a=True), rows[2:3], "t string, c string, r string") == ["SCENE-A"]


def test_projections_and_distances(spark):
    x, y = geo.transverse_mercator(F.lit(116.41493967778204), F.lit(39.8988717849168))
    row = spark.range(1).select(x.alias("x"), y.alias("y"), geo.haversine(*map(F.lit, (0.0, 0.0, 0.0, 1.0))).alias("h"), *geo.web_mercator(F.lit(180.0), F.lit(0.0))).first()
    assert row.x == pytest.approx(449985.677, abs=2e-3) and row.y == pytest.approx(4416696.870, abs=2e-3)
    assert row.h == pytest.approx(111_194.93, abs=0.01) and row[3] == pytest.approx(math.pi * 6_378_137) and row[4] == pytest.approx(0, abs=1e-6)


def test_lines(spark):
    pts = "array(struct(0d x, 0d y), struct(10d x, 0d y), struct(10d x, 0d y), struct(10d x, 10d y))"
    segs = lines.segments(F.expr(pts))
    at = lines.located(segs, F.lit(12.0), F.lit(4.0))
    row = spark.range(1).select(F.size(segs), lines.length(segs), at["d"], at["pos"]).first()
    assert tuple(row) == (2, 20, 2, 14)
    crossing = lambda a, b, c, d: F.exists(segs, lambda s: lines.crosses(s, *map(F.lit, (a, b, c, d))))
    assert tuple(spark.range(1).select(crossing(5.0, -1.0, 5.0, 1.0), crossing(5.0, 1.0, 6.0, 2.0), crossing(5.0, 0.0, 5.0, 9.0), crossing(20.0, 0.0, 30.0, 0.0)).first()) == (True, False, True, False)


def test_binned_join_is_the_plain_join(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(150)]
    left = spark.createDataFrame(pts, "l long, lx double, ly double")
    right = spark.createDataFrame(pts, "r long, rx double, ry double")
    want = {(a, b) for a, ax, ay in pts for b, bx, by in pts if math.sqrt((bx - ax) ** 2 + (by - ay) ** 2) <= 120}
    for how in ({}, {"cell": 50.0}, {"cell": 400.0, "salts": 3}):
        assert {(r.l, r.r) for r in spatial.distance_join(left, right, 120.0, **how).collect()} == want


def test_nearest_against_brute_force(spark):
    rng = random.Random(4)
    pts = [(i, rng.choice([0, 0, 1]) * 9000 + rng.uniform(0, 300), rng.uniform(0, 300), "ab"[i % 2]) for i in range(80)] + [(99, 5e5, 5e5, "a"), (100, 0.0, 0.0, "c")]
    df = spark.createDataFrame(pts, "id long, x double, y double, t string")
    got = {}
    for r in spatial.nearest(df, 3, 20.0, "t").collect():
        got.setdefault(r.id, []).append(r.distance)
    for i, x, y, t in pts:
        want = sorted(math.sqrt((x - u) ** 2 + (y - v) ** 2) for j, u, v, s in pts if j != i and s == t)[:3]
        assert sorted(got.get(i, [])) == pytest.approx(want)


def test_percentile_scale(spark):
    scaled = lambda vs: [r.s for r in salience.percentile_scaled(spark.createDataFrame(list(enumerate(vs)), "id long, v double"), "v", "s", "id").orderBy("id").collect()]
    assert scaled([0.0, 10.0, 20.0, 30.0]) == [0, 50, 75, 100]
    assert scaled([-1.0, 5.0]) == [0, 75]
    assert scaled([4.0, 4.0, 4.0]) == [50, 75, 100]


def test_entropy_and_kappa(spark):
    h = lambda ns: stats.entropy(spark.createDataFrame([(n,) for n in ns], "n long"), "n").first().entropy
    assert h([1, 1]) == 1 and h([5]) == 0 and h([]) == 0 and h([3, 1]) == pytest.approx(0.811278, abs=1e-6)
    rated = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (None, 1)], "a int, b int")
    row = stats.kappa(rated, "a", "b").first()
    assert (row.n, row.agreement, row.kappa) == (4, 0.75, 0.5)
    assert stats.kappa(rated, "a", "a").first().kappa == 1
    assert values(spark, stats.upper_tail(F.col("a")), [0.0, 1.959963985]) == pytest.approx([0.5, 0.025], abs=1e-6)


def test_first_longest_type(spark):
    rows = [("ab|cd|e", "x", "y"), ("xx|x", "x", "xx"), (None, "x", "y"), (" | ", "x", "y"), ("Brand long|abc", "x", "y")]
    got = values(spark, clean.specific_type(F.col("a"), F.col("b"), F.col("c"), ["Brand"]), rows, "a string, b string, c string")
    assert got == ["ab", "xx", "未分类", "未分类", "abc"]


def test_precise_distance(spark):
    assert values(spark, textgen.precise_distance(F.col("a")), [487.0, 4.0, 25.0, 1000.0, 1240.0, 0.0]) == ["约490米", "约10米", "约20米", "约1公里", "约1.2公里", "0米（就在此处）"]


def brute_lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


def test_overlap_measures(spark):
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert textmetrics.lcs_length(a, b) == brute_lcs(a, b)
    pairs = spark.createDataFrame([(1, "a b c d".split(), "a c d".split()), (2, [], ["a"]), (3, "a b c d".split(), "a b c d".split())], "key long, hyp array<string>, ref array<string>")
    rouge = {r.key: (r.precision, r.recall, r.f1) for r in textmetrics.rouge_l(pairs).collect()}
    assert rouge[1] == (0.75, 1, pytest.approx(6 / 7)) and rouge[2][2] == 0
    assert {r.key: r.bleu for r in textmetrics.sentence_bleu(pairs).collect()} == {1: 0, 2: 0, 3: 1}


def test_parse_back_and_checks(spark):
    texts = ["往东北走约490米", "在正西1.5 公里", "无", "对面300m"]
    assert values(spark, textgen.first_word(F.col("a"), textgen.DIRECTION_WORDS), texts, "a string") == ["NE", "W", None, None]
    assert values(spark, textgen.parsed_distance(F.col("a")), texts, "a string") == [490, 1500, None, 300]
    rows = [("在东边", "在东边走", "East"), ("在东边", "在旁边", "East"), ("在东边", "某路方向", "East"), ("x", "y", None), ("东北", "北面", "Northeast")]
    assert values(spark, textgen.keeps_direction(F.col("a"), F.col("b"), F.col("c")), rows, "a string, b string, c string") == [True, False, True, True, True]


def test_choices_do_not_depend_on_partitions(spark, sf_dir):
    from waymark.plans import relation_queries, text_queries

    for name, module in (("relations_hash_choice", relation_queries), ("descriptions_hash_choice", text_queries)):
        rows = []
        for n in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows.append(sorted(map(tuple, module.QUERIES[name][0](spark, sf_dir).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert rows[0] == rows[1] and rows[0]


def edges(spark, rows):
    point = lambda v: {"x": float(v), "y": 0.0}
    return spark.createDataFrame([(point(a), point(b), k, float(w)) for k, (a, b, w) in enumerate(rows)], "a struct<x:double,y:double>, b struct<x:double,y:double>, fid long, weight double")


def test_betweenness(spark):
    path = graph.edge_betweenness(edges(spark, [(1, 2, 1), (2, 3, 1)])).collect()
    assert [r.betweenness for r in path] == [pytest.approx(2 / 3)] * 2
    rng = random.Random(6)
    held = {(a, b): rng.choice([1, 1, 2, 3]) for a in range(7) for b in range(a + 1, 7) if rng.random() < 0.6 or b == a + 1}
    near = {}
    for (a, b), w in held.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))

    def every(path, d, end):
        if path[-1] == end:
            yield d, path
            return
        for v, w in near[path[-1]]:
            if v not in path:
                yield from every([*path, v], d + w, end)

    want = dict.fromkeys(held, 0.0)
    for s, t in itertools.permutations(range(7), 2):
        found = sorted(every([s], 0, t))
        best = [p for d, p in found if d == found[0][0]]
        for p in best:
            for u, v in zip(p, p[1:], strict=False):
                want[min(u, v), max(u, v)] += 1 / len(best) / 42
    got = {(r.a.x, r.b.x): r.betweenness for r in graph.edge_betweenness(edges(spark, [(a, b, w) for (a, b), w in held.items()])).collect()}
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    with pytest.raises(ValueError):
        graph.edge_betweenness(edges(spark, [(1, 2, 1)]), most_edges=0)


def test_road_graph(spark, sf_dir):
    pieces = graph_queries.road_pieces(spark, sf_dir)
    whole = graph.edges_of(pieces)
    assert graph.components(whole).select("component").distinct().count() == 2
    assert graph.largest(whole).count() == whole.count() - 1
    bad = spark.createDataFrame([(1, [(0.0, 0.0)]), (2, [(0.0, 0.0), (float("nan"), 1.0)]), (3, None), (4, [(0.0, 0.0), (3.0, 4.0)]), (5, [(3.0, 4.0), (0.0, 0.0)])], "road_id long, points array<struct<x:double,y:double>>")
    assert [(r.fid, r.weight) for r in graph.edges_of(bad).collect()] == [(5, 5.0)]


def test_hull_and_cover(spark):
    square = spark.createDataFrame([(0.0, 0.0), (0.0, 10.0), (10.0, 0.0), (10.0, 10.0), (5.0, 5.0), (2.0, 10.0)], "x double, y double")
    assert spatial.hull_area(square.repartition(3)).first().hull == 100
    one = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    assert spatial.covered_cells(one, 100.0, 1.0).count() == pytest.approx(math.pi * 1e4, rel=1e-2)


def test_service_fallbacks(spark):
    def client(texts):
        if len(texts) > 1:
            return texts[:-1]
        if texts[0] == "bad":
            raise OSError
        return [texts[0].upper()]

    assert refine.answers(client, ["a", "bad", "c"], 3) == ["A", "bad", "C"]
    assert refine.answers(client, ["a", "bad"], 2, fallback=False) == ["A", None]
    df = spark.createDataFrame([(1, "a", True), (2, None, True), (3, "c", False)], "id long, t string, w boolean")
    assert [r.o for r in refine.refined(df, "t", "o", when="w").orderBy("id").collect()] == ["a", None, "c"]


def test_lexicons():
    data = {"suffixes": [{"level_1": ["店"], "level_3": ["分店", "店"]}]}
    assert lexicons.suffixes(data) == ["分店", "店"] and lexicons.prefixes({"stopwords": ["a", "bb"]}) == ["bb", "a"]
    places = {"penalty_levels": {"high": {"factor": 0.1}}, "categories": [{"penalty": "high", "keywords": ["x", "y"]}]}
    assert lexicons.facilities(places) == [("x", 0.1), ("y", 0.1)]
    assert lexicons.proper_nouns({"categories": [{"subcategories": [{"keywords": [{"word": "w", "weight": 0.4}]}]}]}) == {"w": 0.4}
    families = {"A": ["{x}一", "二"]}
    assert lexicons.templates(lexicons.dump_templates(families)) == families


def test_paged_source(spark):
    calls, waits = [], []

    def fetch(code, page):
        calls.append((code, page))
        if code == "000002" and len(calls) < 3:
            raise OSError
        return [json.dumps({"page": page, "k": k}) for k in range(25 if page < 3 else 4)]

    assert len(list(readers.pages(fetch, "000001"))) == 54 and len(calls) == 3
    calls.clear()
    assert len(list(readers.pages(fetch, "000002", wait=waits.append))) == 54 and waits == [10, 20]
    lost = list(readers.pages(lambda c, p: ["r"] * 25 if p < 2 else (_ for _ in ()).throw(OSError("down")), "x", wait=waits.append))
    assert lost == [("r", None)] * 25 + [(None, "page 2 and after: OSError down")]
    assert len(list(readers.pages(lambda c, p: ["r"] * 25, "x"))) == 200
    spark.dataSource.register(readers.paged_source(lambda code, page: [f"{code}-{page}"], ["7", "12", "7"]))
    rows = spark.read.format("waymark_paged").load().collect()
    assert sorted(map(tuple, rows)) == [("000007", "000007-1", None), ("000012", "000012-1", None)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, "c\nd")], "k long, v string")
    sinks.csv(df, f"{tmp_path}/t")
    back = readers.csv(spark, f"{tmp_path}/t", "k long, v string", lineage=True)
    assert sorted((r.k, r.v) for r in back.collect()) == [(1, "a,b"), (2, "c\nd")] and back.first().source_file.endswith(".csv")
    sinks.csv_file(df.orderBy("k"), f"{tmp_path}/one.csv")
    assert open(f"{tmp_path}/one.csv", "rb").read().startswith(b"\xef\xbb\xbfk,v")
    assert json.loads(sinks.report(df.orderBy("k"))) == [{"k": 1, "v": "a,b"}, {"k": 2, "v": "c\nd"}]
    parts = spark.createDataFrame([(1, "x"), (2, "y")], "k long, p string")
    sinks.replace_partitions(parts, f"{tmp_path}/p", "p")
    sinks.replace_partitions(parts.filter("p = 'y'").withColumn("k", F.lit(9).cast("long")), f"{tmp_path}/p", "p")
    assert sorted((r.k, r.p) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [(1, "x"), (9, "y")]
    with sqlite3.connect(f"{tmp_path}/g.gpkg") as con:
        blob = b"GP\x00\x01" + struct.pack("<i", 4326) + b"\x01" + struct.pack("<II4d", 2, 2, 1, 2, 3, 4)
        con.execute("CREATE TABLE roads (geom BLOB, name TEXT)")
        con.executemany("INSERT INTO roads VALUES (?, ?)", [(blob, "r"), (None, "n")])
    rows = readers.geopackage(spark, f"{tmp_path}/g.gpkg", "roads", columns=["name"]).collect()
    assert [[tuple(p) for p in r.points] if r.points else None for r in rows] == [[(1, 2), (3, 4)], None]


def test_pending_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, text string")
    rows.write.parquet(f"{tmp_path}/in")

    def run():
        work = lambda df: df.withColumn("text", F.upper("text"))
        pending.refine_stream(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/check", "id", work).awaitTermination()
        return sorted((r.id, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [(1, "A"), (2, "B")]
    spark.createDataFrame([(2, "again"), (3, "c")], rows.schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == [(1, "A"), (2, "B"), (3, "C")]
