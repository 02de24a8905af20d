"""Phrases and texts in blocks of rows: hand-computed rows, and code that the JVM compiles."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.operators import textgen
from waymark.plans import text_queries

HUGE = 8000  # bytes of a method that HotSpot leaves interpreted


def method_sizes(spark, df):
    plan = df._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    parts = debug.codegenStringSeq(plan)
    return [parts.apply(k)._3().maxMethodCodeSize() for k in range(parts.size())]


@pytest.mark.parametrize("name", ["descriptions", "redundancy_and_triggers", "description_consistency", "descriptions_hash_choice"])
def test_generated_methods_are_small_enough_to_be_compiled(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = method_sizes(spark, text_queries.QUERIES[name][0](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sizes and max(sizes) < HUGE


def rolls(n, **given):
    return {salt: np.array(given.get(f"r{salt}", [0.0] * n)) for salt in textgen._SALTS}


def test_direction_texts():
    direction = pa.array(["North", "East", "South", "West", None, "Up", "Northeast", "North", "North", "East"])
    deviation = pa.array([3.0, 3.1, 0.0, None, 0.0, 0.0, 6.0, 1.0, 1.0, 17.0])
    ambiguity = pa.array(["EXACT", "EXACT", "EXACT", None, "EXACT", "EXACT", "SLIGHT", "EXACT", "EXACT", "MODERATE"])
    road = pa.array([None, "", "  ", None, "R", "R", "R", " R ", "R", "R"])
    drawn = rolls(10, r0=[0.25, 0.1, 0.9, 0.5, 0.9, 0.9, 0.7, 0.71, 0.7, 0.06], r1=[0, 0, 0.9, 0.6, 0, 0, 0.6, 0, 0.4, 0.5], r2=[0, 0, 0, 0.8, 0, 0, 0.79, 0, 0.29, 0.1], r3=[0] * 8 + [0.5, 0], r4=[0] * 7 + [0.5, 0, 0])
    got = textgen.direction_texts(direction, deviation, ambiguity, road, drawn).to_pylist()
    assert got == ["正北", "东偏", "南", "有点西", "附近", "附近", "有点偏东北", "R去的那边", "恰好在北一带", "大幅偏东"]


def test_distance_texts():
    d = [0.0, 0.0, 79.0, 80.0, 3001.0, 30000.0, None, 100.0, 100.0, 12000.0]
    level = ["VeryClose", "VeryClose", "Close", "Close", None, "Far", "Close", "Far", "Medium", "Far"]
    drawn = rolls(
        10, r10=[0.95, 0.5, 0.95, 0.95, 0.95, 0.95, 0.9, 0.6, 0.85, 0.95], r11=[0] * 7 + [0.5, 0, 0], r12=[0.9] * 5 + [0.4, 0.9, 0, 0.4, 0], r13=[0.5] * 10,
        r14=[0, 0, 0, 0, 0, 0.9, 0, 0, 0, 0], r15=[0, 0, 0, 0.5, 0, 0, 0, 0, 0, 0],
    )
    got = textgen.distance_texts(pa.array(d), pa.array(level), drawn).to_pylist()
    assert got == ["就在此处", "0米（就在此处）", "步行不到1分钟", "步行大概1分钟", "开车约8分钟", "估计偏远", "不远", "一大段路", "估计有一段", "开车约30分钟"]


def test_precise_distances_are_those_of_the_column_function(spark):
    d = [0.0, 0.4, 14.9, 15.0, 25.0, 487.0, 994.9, 995.0, 999.9, 1000.0, 1049.9, 1050.0, 1150.0, 1240.0, 1250.0, 1350.0, 1950.0, 123456.0]
    df = spark.createDataFrame([(x,) for x in d], "a double").coalesce(1)
    want = [r[0] for r in df.select(textgen.precise_distance(F.col("a"))).collect()]
    assert textgen.distance_texts(pa.array(d), pa.array(["Far"] * len(d)), rolls(len(d))).to_pylist() == want


def test_filled_as_one_replacement_after_the_other():
    templates = ["{target}:{landmark}{nothing}", "{target}:{landmark}{nothing}", "{{landmark}}x", None, "plain", "{target}:{landmark}{nothing}"]
    values = {"landmark": pa.array(["a", "{target}", "q", "a", "a", ""]), "target": pa.array(["b", "{odd}b", "b", "b", "b", "t"])}
    assert textgen.filled(pa.array(templates), values).to_pylist() == ["b:a", "b:b", "x", None, "plain", "t:"]


def test_families_fall_back_by_parts_of_the_key(spark):
    keys = ["SCENE-B_Opposite_Near_East_EXACT", "SCENE-B_SameSide_x", "SCENE-B", "SCENE-X_Opposite_y", "", None]
    rows = textgen.with_templates(spark.createDataFrame([(k,) for k in keys], "template_key string").coalesce(1), textgen.DEFAULT_TEMPLATES).collect()
    assert [r.family for r in rows] == ["SCENE-B_Opposite", "SCENE-B", "SCENE-B", *["FALLBACK_GENERIC"] * 3]
    assert [tuple(r.templates) for r in rows] == [textgen.DEFAULT_TEMPLATES[r.family] for r in rows]


def test_texts_are_read_back_in_blocks(spark):
    texts = ["东3千米", "7\x0b米 8km", "0012.50m", None, "", "正东与西北", f"{'9' * 400}米", "5 \t\n公里", "12345", "1.米", "北.5M"]
    df = spark.createDataFrame([(t,) for t in texts], "a string").coalesce(1)
    rows = df.select(textgen.first_word(F.col("a"), textgen.DIRECTION_WORDS).alias("d"), textgen.parsed_distance(F.col("a")).alias("m"))
    got = rows.collect()
    assert [r.m for r in got] == [3000, 7, 12.5, None, None, None, float("inf"), 5000, None, None, 5]
    assert [r.d for r in got] == ["E", None, None, None, None, "NW", None, None, None, None, "N"]
    assert "regexp_extract" not in rows._jdf.queryExecution().optimizedPlan().toString() and "ArrowEvalPython" in rows._jdf.queryExecution().optimizedPlan().toString()
