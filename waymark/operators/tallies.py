"""Numbers and summed distances of all pairs by topology and road, of which only the totals leave the worker.

A row holds landmarks of a square and targets of a tile that their circles may meet. Both sides are laid out in blocks of
neighbours, so that most blocks of pairs are settled by their bounds: wholly within the radius, beyond the distance at
which roads matter, near few roads. Pairs so close that any topology may be are judged one by one, as ``tiles`` does.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import tiles
from waymark.operators.tiles import CLASSES, HOME, INTERSECTION, ISOLATED, ROAD_NEAR, ROAD_PAIR, SAME_SIDE, TILE

ROWS, COLUMNS = 64, 1024  # landmarks (255 at most) and targets of a block
ALONG = 200.0


def _units(places: DataFrame, roads: DataFrame, radius: float) -> DataFrame:
    """``(landmarks, targets, roads)`` in which every pair within ``radius`` is once."""
    left = places.filter("priority > 0").withColumns({f"_c{v}": tiles._tile(F.col(v), HOME) for v in "xy"})
    right = places.filter("priority = 0").withColumns({f"_c{v}": tiles._tile(F.col(v)) for v in "xy"})
    packs = tiles._packed(left, ["id", "x", "y"], tiles.TARGETS, "landmarks").join(tiles._roads_of_tiles(roads, ROAD_PAIR + ROAD_NEAR, HOME), ["_cx", "_cy"], "left")
    ends = {f"_{v}{k}": f(f"landmarks.{v}") for v in "xy" for k, f in enumerate((F.array_min, F.array_max))}
    around = lambda v: F.sequence(tiles._tile(F.col(f"_{v}0") - radius), tiles._tile(F.col(f"_{v}1") + radius))
    gap = lambda v: F.greatest(F.col(f"_c{v}") * TILE - F.col(f"_{v}1"), F.col(f"_{v}0") - (F.col(f"_c{v}") + 1) * TILE, F.lit(0.0))
    met = packs.withColumns(ends).withColumn("_cx", F.explode(around("x"))).withColumn("_cy", F.explode(around("y")))
    met = met.filter(F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")) <= radius)
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    targets = tiles._packed(right, ["id", "x", "y", "junction_t"], tiles.TARGETS, "targets")
    met = met.repartition(n, "_cx", "_cy").join(targets.repartition(n, "_cx", "_cy"), ["_cx", "_cy"])  # told, as small sides make large rows
    return met.select("landmarks", "targets", "roads").repartition(4 * n)  # small batches


def _laid(x: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, list[int]]:
    """An order of places in which up to ``size`` neighbours follow each other, and where these begin."""
    n = len(x)
    if not n:
        return np.zeros(0, int), []
    strips = int(np.ceil(np.sqrt(n / size)))
    strip = np.empty(n, int)
    strip[np.argsort(x)] = np.arange(n) * strips // n
    ends = np.searchsorted(np.sort(strip), np.arange(strips + 1)).tolist()
    starts = [s + (e - s) * k // p for s, e in zip(ends, ends[1:], strict=False) for p in [-(-(e - s) // size)] for k in range(p)]
    return np.lexsort((y, strip)), starts


class _Side(tiles._Places):
    """Places in blocks, with the bounds of each block."""

    def __init__(self, rows: pa.StructArray, order: np.ndarray, starts: list[int]) -> None:
        super().__init__(rows.take(pa.array(order)))
        self.starts = starts
        self.slices = [slice(s, e) for s, e in zip(starts, [*starts[1:], len(order)], strict=True)]
        self.box = [f.reduceat(v, starts) for v in (self.x, self.y) for f in (np.minimum, np.maximum)]

    def locate(self, net: tiles._Roads) -> None:
        """Distances from the roads and places along them, and for each road and block their bounds."""
        self.d, self.pos = net.located(self)
        near = self.d <= ROAD_NEAR
        self.near = np.where(near, self.d, np.inf)
        self.some, self.all = (f.reduceat(near, self.starts, axis=1) for f in (np.logical_or, np.logical_and))
        bounds = [f.reduceat(v, self.starts, axis=1) for v in (self.d, self.pos) for f in (np.minimum, np.maximum)]
        self.d0, self.d1, self.pos0, self.pos1 = bounds


class _Unit:
    def __init__(self, one: pa.StructArray, other: pa.StructArray, ways: pa.StructArray | None, radius: float) -> None:
        a, b = tiles._Places(one), tiles._Places(other)
        corner = other.field("junction_t").is_valid().to_numpy(zero_copy_only=False)
        at, rest = np.flatnonzero(corner), np.flatnonzero(~corner)
        laid, others = _laid(b.x[at], b.y[at], COLUMNS), _laid(b.x[rest], b.y[rest], COLUMNS)
        self.a = _Side(one, *_laid(a.x, a.y, ROWS))
        self.b = _Side(other, np.concatenate([at[laid[0]], rest[others[0]]]), laid[1] + [len(at) + s for s in others[1]])
        self.corners, self.net, self.radius = len(at), tiles._Roads(ways), radius
        # Beyond this any pair is at a junction, on the same side of a road or isolated: see tiles._Stream.
        self.low = max(50.0, 31 + max((w for w in self.net.width.tolist() if w > 0), default=0.0))
        roads = len(self.net.segs)
        self.at_corner = np.zeros(len(b.x), np.int64), np.zeros(len(b.x))
        self.told = np.zeros((len(CLASSES), roads + 1), np.int64), np.zeros((len(CLASSES), roads + 1))  # the last is of no road
        self.close: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0
        most = max(s.stop - s.start for s in self.a.slices) * max(s.stop - s.start for s in self.b.slices)
        self.room = [np.empty(most) for _ in range(3)]

    def tally(self, totals: dict) -> None:
        a, b = self.a, self.b
        (ax0, ax1, ay0, ay1), (bx0, bx1, by0, by1) = ([v[:, None] for v in a.box], b.box)
        gx, gy = (np.maximum(0.0, np.maximum(p, q)) for p, q in ((bx0 - ax1, ax0 - bx1), (by0 - ay1, ay0 - by1)))
        fx, fy = (np.maximum(np.abs(p), np.abs(q)) for p, q in ((bx1 - ax0, ax1 - bx0), (by1 - ay0, ay1 - by0)))
        least, most = np.sqrt(gx * gx + gy * gy), np.sqrt(fx * fx + fy * fy)
        if least.min() <= min(self.radius, max(ROAD_PAIR, self.low)):
            a.locate(self.net)
            b.locate(self.net)
        same = tiles._same(a, b)
        for i, j in np.argwhere(least <= self.radius).tolist():
            self._block(i, j, least[i, j], most[i, j], same)
        self._judge()
        names = [*self.net.names, None]
        for code, name in enumerate(CLASSES):
            for r in np.flatnonzero(self.told[0][code]).tolist():
                _add(totals, (name, names[r]), self.told[0][code, r], self.told[1][code, r])
        at = np.flatnonzero(self.at_corner[0])
        for k, name in zip(at.tolist(), b.rows.field("junction_t").take(pa.array(at)).to_pylist(), strict=True):
            _add(totals, (CLASSES[INTERSECTION], name), self.at_corner[0][k], self.at_corner[1][k])

    def _block(self, i: int, j: int, least: float, most: float, same: np.ndarray | None) -> None:
        rows, cols = self.a.slices[i], self.b.slices[j]
        d, near = tiles._distances(_Cut(self.a, rows), _Cut(self.b, cols), slice(None)), None
        if most > self.radius:
            near = d <= self.radius
        if same is not None:
            near = ~same[rows, cols] if near is None else near & ~same[rows, cols]
        if least <= self.low:
            close = d <= self.low if near is None else near & (d <= self.low)
            li, ti = np.nonzero(close)
            self.close.append((li + rows.start, ti + cols.start, d[li, ti]))
            self.waiting += len(li)
            near = ~close if near is None else near ^ close
            if self.waiting > tiles.BLOCK:
                self._judge()
        if near is not None:
            d *= near
        if cols.start < self.corners:
            self.at_corner[0][cols] += d.shape[0] if near is None else np.add.reduce(near.view(np.uint8), axis=0, dtype=np.uint8)
            self.at_corner[1][cols] += np.add.reduce(d, axis=0)
            return
        n, total = self.told
        n[ISOLATED, -1] += d.size if near is None else np.count_nonzero(near)
        total[ISOLATED, -1] += d.sum()
        road = self._same_side(i, j) if least <= ROAD_PAIR and most > self.low else None
        if road is None:
            return
        for where in (near, None if most <= ROAD_PAIR else d <= ROAD_PAIR):
            if where is not None:
                road *= where
        at = np.flatnonzero(road)
        road, d = road.ravel()[at], d.ravel()[at]
        told, length = (np.bincount(road, weights, minlength=n.shape[1])[1:] for weights in (None, d))
        n[SAME_SIDE, :-1] += told
        total[SAME_SIDE, :-1] += length
        n[ISOLATED, -1] -= told.sum()
        total[ISOLATED, -1] -= length.sum()

    def _same_side(self, i: int, j: int) -> np.ndarray | None:
        """For each pair of a block the road that both are on the same side of, counted from 1; 0 if none."""
        a, b, rows, cols = self.a, self.b, self.a.slices[i], self.b.slices[j]
        low, high = a.d0[:, i] + b.d0[:, j], np.where(a.all[:, i] | b.all[:, j], a.d1[:, i] + b.d1[:, j], np.inf)
        asked = np.flatnonzero((a.some[:, i] | b.some[:, j]) & (low <= high.min(initial=np.inf)))  # others are never the nearest
        meets = (a.pos0[asked, i] - b.pos1[asked, j] <= ALONG) & (b.pos0[asked, j] - a.pos1[asked, i] <= ALONG)
        if not meets.any():
            return None
        shape = (rows.stop - rows.start, cols.stop - cols.start)
        least, total, other = (v[: shape[0] * shape[1]].reshape(shape) for v in self.room)
        out, kind = None, np.uint8 if len(self.net.segs) < 255 else np.int64
        for r, may in zip(asked.tolist(), meets.tolist(), strict=True):
            dl, dt = a.d[r, rows, None], b.d[r, cols]
            now = least if out is None else total
            if a.all[r, i] or b.all[r, j]:
                np.add(dl, dt, out=now)
            elif a.some[r, i]:
                np.add(a.near[r, rows, None], dt, out=now)
                if b.some[r, j]:
                    np.minimum(now, np.add(dl, b.near[r, cols], out=other), out=now)
            else:
                np.add(dl, b.near[r, cols], out=now)
            if may:
                ok = np.abs(np.subtract(a.pos[r, rows, None], b.pos[r, cols], out=other), out=other) <= ALONG
                if a.d0[r, i] <= 1:
                    ok &= dl > 1
                if b.d0[r, j] <= 1:
                    ok &= dt > 1
                if out is None:
                    ok &= now < np.inf
                mine = ok.view(np.uint8) * np.uint8(r + 1) if kind is np.uint8 else ok * kind(r + 1)
            if out is None:
                out = mine if may else np.zeros(shape, kind)
                continue
            less = now < least
            np.minimum(least, now, out=least)
            mask = np.negative(less.view(np.uint8) if kind is np.uint8 else less.astype(kind))  # all bits of those that are nearer
            if may:
                mine ^= out
                mine &= mask
                out ^= mine
            else:
                out &= ~mask
        return out

    def _judge(self) -> None:
        if not self.waiting:
            return
        li, ti, d = (np.concatenate(v) for v in zip(*self.close, strict=True))
        self.close, self.waiting = [], 0
        for at in range(0, len(d), tiles.BLOCK):
            self._judged(*(v[at : at + tiles.BLOCK] for v in (li, ti, d)))

    def _judged(self, li: np.ndarray, ti: np.ndarray, d: np.ndarray) -> None:
        a, b = self.a, self.b
        corner = np.arange(len(b.x)) < self.corners
        topology, road = tiles._judge(a, b, li, ti, d, corner, self.net, (a.d, a.pos), (b.d, b.pos))
        there = topology == INTERSECTION
        width = self.told[0].shape[1]
        key = topology[~there] * width + road[~there] % width  # -1, no road, is the last
        for known, told, weights in zip(self.at_corner, self.told, (None, d), strict=True):
            known += np.bincount(ti[there], None if weights is None else d[there], minlength=len(known))
            told += np.bincount(key, None if weights is None else d[~there], minlength=told.size).reshape(told.shape)


class _Cut:
    def __init__(self, side: _Side, part: slice) -> None:
        self.x, self.y = side.x[part], side.y[part]


def _add(totals: dict, key: tuple, n: int, total: float) -> None:
    held = totals[key]
    held[0] += int(n)
    held[1] += float(total)


def by_topology(places: DataFrame, roads: DataFrame, radius: float) -> DataFrame:
    """``(topology, road_name, n, total_m)`` of the pairs of ``tiles.judged``: their number and summed distance.
    ``places`` have ``junction_t``, the name of a junction near them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = defaultdict(lambda: [0, 0.0])
        for one, other, ways in tiles._rows(batches):
            _Unit(one, other, ways, radius).tally(totals)
        topology, road = ([k[c] for k in totals] for c in (0, 1))
        n, total = ([v[c] for v in totals.values()] for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(topology, pa.string()), pa.array(road, pa.string()), pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=["topology", "road_name", "n", "total_m"])

    known = places.filter("id is not null").filter(" and ".join(f"abs({v}) < double('Infinity')" for v in "xy"))
    parts = _units(known, roads, radius).mapInArrow(run, "topology string, road_name string, n long, total_m double")
    return parts.groupBy("topology", "road_name").agg(F.sum("n").alias("n"), F.sum("total_m").alias("total_m"))
