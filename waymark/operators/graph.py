"""Road graph: nodes and edges from lines, components, weighted edge betweenness."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import lines
from waymark.operators.staging import staged

MOST_EDGES = 2_000_000


def edges_of(roads: DataFrame, snap: float | None = None) -> DataFrame:
    """``(a, b, fid, weight)``: a line is an edge between its ends, weighted by its length; of parallel ones the last
    by id counts. Lines of fewer than two points or with an end that isn't finite are skipped. ``snap`` rounds ends
    to a grid, which closes small gaps."""
    ends = roads.select(F.col("road_id").alias("fid"), "points", F.element_at("points", 1).alias("p"), F.element_at("points", -1).alias("q")).filter("size(points) >= 2")
    for end in ("p", "q"):
        for axis in ("x", "y"):
            v = F.col(f"{end}.{axis}")
            ends = ends.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    at = lambda e, axis: F.round(F.col(f"{e}.{axis}") / snap) * snap if snap else F.col(f"{e}.{axis}")
    node = lambda e: F.struct(at(e, "x").alias("x"), at(e, "y").alias("y"))
    each = ends.select("fid", node("p").alias("p"), node("q").alias("q"), lines.length(lines.segments(F.col("points"))).alias("weight"))
    each = each.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "fid", "weight")
    return each.groupBy("a", "b").agg(F.max("fid").alias("fid"), F.max_by("weight", "fid").alias("weight"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, component)``: the smallest node that each reaches. Labels go along edges and then to their label's
    label, so that rounds grow with the logarithm of a path's length."""
    keep = lambda df: staged(df, "labels")
    both = keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(rounds):
        met = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = now.join(met, "node").select("node", F.least("component", "m").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = keep(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = after.withColumnRenamed("component", "c").join(now, "node").filter("c <> component")
        done = changed.isEmpty()
        now = after
        if done:
            return now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def merged_chains(roads: DataFrame) -> DataFrame:
    """``(road_id, parts, points)``: lines that meet end to end where no third line does are one, under their smallest id,
    running from its smaller end. A ring begins at its smallest corner where lines meet. Lines without two points are left out.

    Lines are tied where an end is of two lines only, so that a task holds one chain at a time.
    """
    held = roads.filter("size(points) >= 2").select("road_id", "points")
    ends = held.select("road_id", F.explode(F.array(F.element_at("points", 1), F.element_at("points", -1))).alias("node"))
    ties = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("road_id").alias("a"), F.max("road_id").alias("b")).filter("n = 2 and a <> b")
    groups = components(staged(ties.select("a", "b").distinct(), "chain-ties")).select(F.col("node").alias("road_id"), F.col("component").alias("chain"))
    parts = held.join(groups, "road_id", "left").select(F.coalesce("chain", "road_id").alias("road_id"), F.array(F.transform("points", lambda p: F.array(p["x"], p["y"]))).alias("p"))
    chains = parts.groupBy("road_id").agg(F.flatten(F.collect_list("p")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_chained([[tuple(p) for p in line] for line in lines]) for lines in batch.column(1).to_pylist()]
            points = pa.array([[{"x": x, "y": y} for x, y in line] for line in made], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in batch.column(1)], pa.int32()), points], names=["road_id", "parts", "points"])

    return chains.mapInArrow(run, "road_id long, parts int, points array<struct<x:double,y:double>>")


def _chained(lines: list[list[tuple[float, float]]]) -> list[tuple[float, float]]:
    """One line of several that form a chain or a ring."""
    at: dict[tuple[float, float], list[int]] = {}
    for k, line in enumerate(lines):
        for end in (line[0], line[-1]):
            at.setdefault(end, []).append(k)
    loose = [p for p, held in at.items() if len(held) == 1]
    here = min(loose or at)
    out, left = [here], set(range(len(lines)))
    while step := [k for k in at[here] if k in left]:
        # Of a ring's two ways the one with the smaller next point; else there is one.
        k = min(step, key=lambda k: lines[k][1] if lines[k][0] == here else lines[k][-2])
        left.remove(k)
        line = lines[k] if lines[k][0] == here else lines[k][::-1]
        out += line[1:]
        here = line[-1]
    return out


def largest(edges: DataFrame) -> DataFrame:
    """The edges of the component with most nodes (the smallest label at a tie)."""
    found = components(edges)
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").limit(1)
    nodes = found.join(F.broadcast(top), "component").select(F.col("node").alias("a"))  # one row
    return edges.join(nodes, "a", "left_semi")


def edge_betweenness(edges: DataFrame, normalised: bool = True, most_edges: int = MOST_EDGES) -> DataFrame:
    """``edges`` with ``betweenness``: the summed shares of shortest paths between all pairs that use an edge.

    Sources are dealt to tasks; each runs one shortest-path search over the graph, which every task holds, so the
    graph is checked to be of ``most_edges`` at most. Larger graphs need to be split by region first.
    """
    spark = edges.sparkSession
    n_edges = edges.count()
    if n_edges > most_edges:
        raise ValueError(f"{n_edges} edges; a task can hold {most_edges}")
    numbered = edges.select("a", "b", "weight").toArrow()
    keys = [(r["x"], r["y"]) for c in ("a", "b") for r in numbered.column(c).to_pylist()]
    names = {k: i for i, k in enumerate(sorted(set(keys)))}
    ends = np.array([names[k] for k in keys], np.int64).reshape(2, -1)
    weight = numbered.column("weight").to_numpy()
    n = len(names)
    order = np.argsort(np.r_[ends[0], ends[1]], kind="stable")
    heads = np.searchsorted(np.r_[ends[0], ends[1]][order], np.arange(n + 1))
    other, edge = np.r_[ends[1], ends[0]][order], np.tile(np.arange(n_edges), 2)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_edges)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                _accumulate(source, heads, other, edge, weight, total)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["e", "v"])

    parts = max(1, min(n, spark.sparkContext.defaultParallelism * 4))
    sums = spark.range(0, n, 1, parts).mapInArrow(run, "e long, v double").groupBy("e").agg(F.sum("v").alias("v"))
    scale = 1.0 / (n * (n - 1)) if normalised and n > 1 else 0.5
    place = {i: k for k, i in names.items()}
    listing = spark.createDataFrame(
        [(k, place[a], place[b]) for k, (a, b) in enumerate(ends.T.tolist())], "e long, a struct<x:double,y:double>, b struct<x:double,y:double>"
    )
    scored = listing.join(sums, "e", "left").select("a", "b", (F.coalesce("v", F.lit(0.0)) * scale).alias("betweenness"))
    return edges.join(scored, ["a", "b"], "left")


def _accumulate(source: int, heads: np.ndarray, other: np.ndarray, edge: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
    """Adds one source's dependencies to its shortest-path edges."""
    n = len(heads) - 1
    far, paths, settled = {source: 0.0}, np.zeros(n), np.zeros(n, bool)
    paths[source] = 1.0
    before: dict[int, list[tuple[int, int]]] = {source: []}
    heap, order = [(0.0, source)], []
    while heap:
        d, v = heapq.heappop(heap)
        if settled[v]:
            continue
        settled[v] = True
        order.append(v)
        for k in range(heads[v], heads[v + 1]):
            w, e = int(other[k]), int(edge[k])
            if settled[w]:
                continue
            reach = d + float(weight[e])
            known = far.get(w)
            if known is None or reach < known * (1 - 1e-12):
                far[w], paths[w], before[w] = reach, paths[v], [(v, e)]
                heapq.heappush(heap, (reach, w))
            elif reach <= known * (1 + 1e-12):
                paths[w] += paths[v]
                before[w].append((v, e))
    share = np.zeros(n)
    for w in reversed(order):
        for v, e in before[w]:
            part = paths[v] / paths[w] * (1 + share[w])
            total[e] += part
            share[v] += part


def to_roads(roads: DataFrame, scored: DataFrame) -> DataFrame:
    """Each road with its edge's betweenness, 0 where it is none."""
    return roads.join(scored.select(F.col("fid").alias("road_id"), "betweenness"), "road_id", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
