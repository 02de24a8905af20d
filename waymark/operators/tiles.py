"""Counts and topology of all pairs within a radius, worked off in blocks of packed places.

Places are packed by tiles of the plane: a row holds up to ``LANDMARKS`` landmarks, up to ``TARGETS`` targets of a tile
that their circles may meet, and the roads around the tile. Rows are dealt evenly, so that a crowded tile is work for
many tasks; each is measured by numpy in blocks of ``BLOCK`` pairs, and only results leave the worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo, lines

TILE, HOME = 250.0, 500.0
LANDMARKS, TARGETS, BLOCK = 1024, 4096, 1 << 18
PACK, START = 512, 256  # landmarks of a stream, and targets of its first block
# How far pairs look at roads, and how near to a place these are.
ROAD_PAIR, ROAD_NEAR, ROAD_CLOSE = 500.0, 80.0, 50.0
CLASSES = ("Coincident", "Abutting", "Intersection", "Opposite", "SameSide", "Isolated")
COINCIDENT, ABUTTING, INTERSECTION, OPPOSITE, SAME_SIDE, ISOLATED = range(6)


def _tile(v: Column, size: float = TILE) -> Column:
    return F.floor(v / size).cast("long")


def _packed(rows: DataFrame, columns: list[str], size: int, name: str, keep: bool = False) -> DataFrame:
    """``rows`` as lists of about ``size`` for each tile ``_cx, _cy``."""
    parts = rows.groupBy("_cx", "_cy").agg(F.ceil(F.count("*") / size).alias("_parts"))
    dealt = rows.join(parts, ["_cx", "_cy"]).withColumn("_part", F.pmod(F.xxhash64("id", "x", "y"), "_parts"))
    return dealt.groupBy("_cx", "_cy", "_part").agg(F.collect_list(F.struct(*columns)).alias(name)).drop(*([] if keep else ["_part"]))


def _units(places: DataFrame, radius: float, landmark: list[str], target: list[str], roads: DataFrame | None = None) -> DataFrame:
    """``(landmarks, targets[, roads])`` in which every pair within ``radius`` is once."""
    x, y = F.col("x"), F.col("y")
    span = lambda v: F.sequence(_tile(v - radius), _tile(v + radius))
    gap = lambda v, c: F.greatest(F.col(c) * TILE - v, v - (F.col(c) + 1) * TILE, F.lit(0.0))
    left = places.filter("priority > 0").withColumn("_cx", F.explode(span(x))).withColumn("_cy", F.explode(span(y)))
    left = left.filter(F.sqrt(gap(x, "_cx") * gap(x, "_cx") + gap(y, "_cy") * gap(y, "_cy")) <= radius)
    right = places.filter("priority = 0").withColumns({"_cx": _tile(x), "_cy": _tile(y)})
    met = _packed(left, ["id", "x", "y", *landmark], LANDMARKS, "landmarks").join(_packed(right, ["id", "x", "y", *target], TARGETS, "targets"), ["_cx", "_cy"])
    if roads is not None:
        met = met.join(_roads_of_tiles(roads, ROAD_PAIR + ROAD_NEAR), ["_cx", "_cy"], "left")
    return met.drop("_cx", "_cy").repartition(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _roads_of_tiles(roads: DataFrame, reach: float, size: float = TILE) -> DataFrame:
    """For each tile of ``size`` the roads that may be within ``reach`` of it."""
    held = roads.select("road_id", F.col("name").alias("road"), F.col("width").cast("double").alias("width"), lines.segments(F.col("points")).alias("segs"))
    pieces = held.select("road_id", F.explode("segs").alias("s"))
    cut = pieces.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("s.len") / TILE).cast("int"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda axis, k: F.col(f"s.{axis}1") + (F.col(f"s.{axis}2") - F.col(f"s.{axis}1")) * k / F.col("n")
    cover = lambda axis: F.sequence(
        _tile(F.least(at(axis, F.col("k")), at(axis, F.col("k") + 1)) - reach - 1, size), _tile(F.greatest(at(axis, F.col("k")), at(axis, F.col("k") + 1)) + reach + 1, size)
    )
    cells = cut.withColumn("_cx", F.explode(cover("x"))).withColumn("_cy", F.explode(cover("y"))).select("road_id", "_cx", "_cy").distinct()
    return cells.join(held, "road_id").groupBy("_cx", "_cy").agg(F.collect_list(F.struct("road_id", "road", "width", "segs")).alias("roads"))


def _streams(places: DataFrame, radius: float, roads: DataFrame) -> DataFrame:
    """``(landmarks, roads, id, x, y, junction_t)``: a row with landmarks of a square of ``HOME`` metres and the roads around
    it, then in the same partition rows with the targets of all tiles that their circles may meet, nearer tiles first."""
    axes = {"x": F.col("landmarks.x"), "y": F.col("landmarks.y")}
    left = places.filter("priority > 0").withColumns({"_cx": _tile(F.col("x"), HOME), "_cy": _tile(F.col("y"), HOME)})
    right = places.filter("priority = 0").withColumns({"_cx": _tile(F.col("x")), "_cy": _tile(F.col("y"))})
    pack = F.struct("_cx", "_cy", "_part").alias("_pack")
    packs = _packed(left, ["id", "x", "y"], PACK, "landmarks", keep=True)
    boxes = packs.select(pack, *(f(v).alias(f"_{axis}{k}") for axis, v in axes.items() for k, f in enumerate((F.array_min, F.array_max))))
    around = lambda axis: F.sequence(_tile(F.col(f"_{axis}0") - radius), _tile(F.col(f"_{axis}1") + radius))
    gap = lambda axis: F.greatest(F.col(f"_c{axis}") * TILE - F.col(f"_{axis}1"), F.col(f"_{axis}0") - (F.col(f"_c{axis}") + 1) * TILE, F.lit(0.0))
    met = boxes.withColumn("_cx", F.explode(around("x"))).withColumn("_cy", F.explode(around("y")))
    met = met.withColumn("_gap", F.sqrt(gap("x") * gap("x") + gap("y") * gap("y"))).filter(F.col("_gap") <= radius)
    columns = ["id", "x", "y", "junction_t"]
    tiles = _packed(right, columns, TARGETS, "targets").select("_cx", "_cy", *(F.col(f"targets.{c}").alias(c) for c in columns))
    heads = packs.join(_roads_of_tiles(roads, ROAD_PAIR + ROAD_NEAR, HOME), ["_cx", "_cy"], "left").select(pack, F.lit(-1.0).alias("_gap"), "landmarks", "roads")
    rows = heads.unionByName(met.join(tiles, ["_cx", "_cy"]).select("_pack", "_gap", *columns), allowMissingColumns=True)
    n = 4 * int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few streams each, as their work differs
    return rows.repartition(n, "_pack").sortWithinPartitions("_pack", "_gap").select("landmarks", "roads", *columns)


class _Places:
    def __init__(self, rows: pa.StructArray) -> None:
        self.rows, self.ids = rows, rows.field("id")
        self.x, self.y = (rows.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")


def _same(a: _Places, b: _Places) -> np.ndarray | None:
    """Where both sides of a pair have one id; null if nowhere."""
    if not pc.any(pc.is_in(b.ids, value_set=a.ids), min_count=0).as_py():
        return None
    return np.equal.outer(a.ids.to_numpy(zero_copy_only=False), b.ids.to_numpy(zero_copy_only=False))


def _distances(a: _Places, b: _Places, part: slice) -> np.ndarray:
    dx, dy = b.x[None, :] - a.x[part, None], b.y[None, :] - a.y[part, None]
    dx *= dx
    dy *= dy
    dx += dy
    return np.sqrt(dx, out=dx)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(c)[k].values for c in range(batch.num_columns))


def counted(places: DataFrame, radius: float) -> DataFrame:
    """``(id, n)``: how many targets (priority 0) of another id are within ``radius`` of each landmark (priority over 0)
    that has one. Tiles that lie wholly within are counted unmeasured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, other in _rows(batches):
            a, b = _Places(one), _Places(other)
            most = lambda v, w: np.maximum(np.abs(w.min() - v), np.abs(w.max() - v))
            fx, fy = most(a.x, b.x), most(a.y, b.y)
            same, n = _same(a, b), np.full(len(a.x), len(b.x), np.int64)
            ask = np.flatnonzero(~(np.sqrt(fx * fx + fy * fy) <= radius)) if same is None else np.arange(len(a.x))
            step = max(1, BLOCK // len(b.x))
            for at in range(0, len(ask), step):
                part = ask[at : at + step]
                near = _distances(a, b, part) <= radius
                n[part] = np.count_nonzero(near if same is None else near & ~same[part], axis=1)
            some = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([a.ids.filter(some), pa.array(n).filter(some)], names=["id", "n"])

    kind = places.schema["id"].dataType.simpleString()
    return _units(places, radius, [], []).mapInArrow(run, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))


_EDGES = np.radians([22.5, 67.5, 112.5, 157.5])  # of the sectors, and on the other side of the circle


def directed(places: DataFrame, radius: float) -> DataFrame:
    """``(direction_8, n)``: how many pairs of a landmark and a target of another id within ``radius`` are in a direction
    by ``geo.direction_8``; pairs at one spot have none.

    The line of an edge through a landmark has a target on one side if the target's own distance from that line through
    the origin is larger, so that two neighbouring edges tell the sector; pairs that rounding may move over an edge are
    measured as ``geo.azimuth`` does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(geo.DIRECTIONS_8), np.int64)
        for one, other in _rows(batches):
            a, b = _Places(one), _Places(other)
            past_a, past_b = (np.outer(np.cos(_EDGES), p.x) - np.outer(np.sin(_EDGES), p.y) for p in (a, b))
            unsure = 2.0**-42 * max(np.abs(v).max() for v in (a.x, a.y, b.x, b.y))
            order, same, step = np.argsort(past_b, axis=1), _same(a, b), max(1, _CHUNK // len(b.x))
            for at in range(0, len(a.x), step):
                part = slice(at, at + step)
                near = _distances(a, b, part) <= radius
                if same is not None:
                    near &= ~same[part]
                asked = []
                for mine, theirs, by in zip(past_a[:, part], past_b, order, strict=True):
                    lo, hi = (np.searchsorted(theirs, mine + m, side, sorter=by) for m, side in ((-unsure, "left"), (unsure, "right")))
                    asked += [np.column_stack([np.full(hi[i] - lo[i], i), by[lo[i] : hi[i]]]) for i in np.flatnonzero(lo < hi)]
                if asked:
                    li, ti = np.unique(np.concatenate(asked), axis=0).T
                    li, ti = li[near[li, ti]], ti[near[li, ti]]
                    near[li, ti] = False
                    n += _sectors(b.x[ti] - a.x[li + at], b.y[ti] - a.y[li + at])
                past = [(theirs > mine[:, None]) & near for mine, theirs in zip(past_a[:, part], past_b, strict=True)]
                for k in range(4):  # between an edge and the next one, and opposite
                    one_side, both = np.count_nonzero(past[k]), np.count_nonzero(past[k] & past[(k + 1) % 4])
                    if k < 3:
                        n[k + 1] += one_side - both
                        n[k + 5] += np.count_nonzero(past[k + 1]) - both
                    else:
                        n[4] += both
                        n[0] += np.count_nonzero(near) - one_side - np.count_nonzero(past[0]) + both
        yield pa.RecordBatch.from_arrays([pa.array(geo.DIRECTIONS_8), pa.array(n)], names=["direction_8", "n"])

    known = places.filter("id is not null").filter(" and ".join(f"abs({v}) < double('Infinity')" for v in "xy"))
    return _units(known, radius, [], []).mapInArrow(run, "direction_8 string, n long").groupBy("direction_8").agg(F.sum("n").alias("n")).filter("n > 0")


def _sectors(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """How many are in each of ``geo.DIRECTIONS_8``: an edge belongs to the sector before it, the last edge to north."""
    az = np.degrees(np.arctan2(dx, dy))[(dx != 0) | (dy != 0)]
    az[az < 0] += 360
    k = np.ceil((az - 22.5) / 45).astype(int)
    k[(az >= 337.5) | (az <= 22.5)] = 0
    return np.bincount(k, minlength=len(geo.DIRECTIONS_8))


def measured(places: DataFrame, radius: float) -> DataFrame:
    """``(landmark_id, target_id, distance, azimuth)`` of each landmark and every target of another id within ``radius``;
    the azimuth as by ``geo.azimuth``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, other in _rows(batches):
            a, b = _Places(one), _Places(other)
            same, step = _same(a, b), max(1, BLOCK // len(b.x))
            for at in range(0, len(a.x), step):
                far = _distances(a, b, slice(at, at + step))
                near = far <= radius if same is None else (far <= radius) & ~same[at : at + step]
                li, ti = np.nonzero(near)
                d = far[near]
                li += at
                dx, dy = b.x[ti] - a.x[li], b.y[ti] - a.y[li]
                az = np.degrees(np.arctan2(dx, dy))
                az[az < 0] += 360
                az[az >= 360] = 0
                nowhere = (dx == 0) & (dy == 0)
                columns = [a.ids.take(pa.array(li)), b.ids.take(pa.array(ti)), pa.array(d), pa.array(az, mask=nowhere)]
                yield pa.RecordBatch.from_arrays(columns, names=["landmark_id", "target_id", "distance", "azimuth"])

    kind = places.schema["id"].dataType.simpleString()
    return _units(places, radius, [], []).mapInArrow(run, f"landmark_id {kind}, target_id {kind}, distance double, azimuth double")


class _Roads:
    """The roads of a tile in the order of their ids, with the distance and place along each of some places."""

    def __init__(self, rows: pa.StructArray | None) -> None:
        held = sorted(rows.to_pylist(), key=lambda r: r["road_id"]) if rows is not None else []
        self.names = [r["road"] for r in held]
        self.width = np.array([np.nan if r["width"] is None else r["width"] for r in held], float)
        self.segs = [[tuple(s[c] for c in ("x1", "y1", "x2", "y2", "len", "at")) for s in r["segs"]] for r in held]

    def located(self, p: _Places) -> tuple[np.ndarray, np.ndarray]:
        d, pos = np.full((len(self.segs), len(p.x)), np.inf), np.zeros((len(self.segs), len(p.x)))
        for r, segs in enumerate(self.segs):
            for x1, y1, x2, y2, size, before in segs:
                dx, dy = x2 - x1, y2 - y1
                along = np.minimum(size, np.maximum(0.0, ((p.x - x1) * dx + (p.y - y1) * dy) / size))
                part = along / size
                fx = np.clip(p.x, min(x1, x2), max(x1, x2)) if dy == 0 else x1 + dx * part
                fy = np.clip(p.y, min(y1, y2), max(y1, y2)) if dx == 0 else y1 + dy * part
                far, at = np.sqrt((fx - p.x) * (fx - p.x) + (fy - p.y) * (fy - p.y)), before + along
                less = (far < d[r]) | ((far == d[r]) & (at < pos[r]))
                d[r], pos[r] = np.where(less, far, d[r]), np.where(less, at, pos[r])
        return d, pos

    def crossed(self, r: int, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ax), bool)
        side = lambda px, py, qx, qy, x, y: np.sign((qx - px) * (y - py) - (qy - py) * (x - px))
        for x1, y1, x2, y2, *_ in self.segs[r]:
            box = (min(x1, x2) <= np.maximum(ax, bx)) & (np.minimum(ax, bx) <= max(x1, x2)) & (min(y1, y2) <= np.maximum(ay, by)) & (np.minimum(ay, by) <= max(y1, y2))
            over = (side(x1, y1, x2, y2, ax, ay) * side(x1, y1, x2, y2, bx, by) <= 0) & (side(ax, ay, bx, by, x1, y1) * side(ax, ay, bx, by, x2, y2) <= 0)
            out |= box & over
        return out


def _judge(a: _Places, b: _Places, li: np.ndarray, ti: np.ndarray, d: np.ndarray, corner: np.ndarray, roads: _Roads, of_a: tuple, of_b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Topology of pairs, and the index of their road where one tells it."""
    topology = np.where(d < 1, COINCIDENT, np.where(corner[ti], INTERSECTION, ISOLATED)).astype(np.int8)
    road = np.full(len(d), -1)
    ask = np.flatnonzero((d >= 1) & (d <= ROAD_PAIR) & ((d <= 30) | ~corner[ti]))
    if not len(ask):
        return topology, road
    li, ti, d = li[ask], ti[ask], d[ask]
    (ld, lp), (td, tp) = of_a, of_b
    least = {limit: np.full(len(ask), np.inf) for limit in (ROAD_CLOSE, ROAD_NEAR)}
    best = {limit: np.full(len(ask), -1) for limit in least}
    crossed, short = np.zeros(len(ask), bool), np.flatnonzero(d <= 30)
    for r in range(len(roads.segs)):
        if not ((ld[r] <= ROAD_NEAR).any() or (td[r] <= ROAD_NEAR).any()):
            continue
        dl, dt = ld[r][li], td[r][ti]
        total, nearer = dl + dt, np.minimum(dl, dt)
        for limit in least:
            less = (nearer <= limit) & (total < least[limit])
            np.copyto(least[limit], total, where=less)
            best[limit][less] = r
        at = short[nearer[short] <= ROAD_NEAR]
        if len(at):
            crossed[at] |= roads.crossed(r, a.x[li[at]], a.y[li[at]], b.x[ti[at]], b.y[ti[at]])
    found = np.full(len(ask), ISOLATED, np.int8)
    told = np.full(len(ask), -1)

    def facts(r: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        return ld[r, li[at]], td[r, ti[at]], np.abs(lp[r, li[at]] - tp[r, ti[at]])

    at = np.flatnonzero((best[ROAD_NEAR] >= 0) & (d >= 50))
    r = best[ROAD_NEAR][at]
    dl, dt, along = facts(r, at)
    ok = (along <= 200) & (dl > 1) & (dt > 1)
    found[at[ok]], told[at[ok]] = SAME_SIDE, r[ok]
    at = np.flatnonzero((best[ROAD_CLOSE] >= 0) & (d >= 30))
    r = best[ROAD_CLOSE][at]
    dl, dt, along = facts(r, at)
    ok = (along <= 20) & (np.abs(dl + dt - roads.width[r]) < 10) & (dl > 0) & (dt > 0)
    found[at[ok]], told[at[ok]] = OPPOSITE, r[ok]
    for code, where in ((INTERSECTION, corner[ti]), (ABUTTING, (d <= 30) & ~crossed)):
        found[where], told[where] = code, -1
    topology[ask], road[ask] = found, told
    return topology, road


class _Firsts:
    """The ``most`` least ranks of each key so far."""

    def __init__(self, keys: int, most: int, kind: np.dtype) -> None:
        self.worst = np.inf if kind.kind == "f" else np.iinfo(kind).max
        self.held, self.most = np.full((keys, most), self.worst, kind), most

    def add(self, key: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The rows that are among the first of their key up to now, with all of the last one's rank."""
        at = np.flatnonzero(rank <= self.held[key, -1])
        if not len(at):
            return at
        order = at[np.lexsort((rank[at], key[at]))]
        key, rank = key[order], rank[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
        place = np.arange(len(order)) - starts[group]
        new = np.full((len(starts), self.most), self.worst, self.held.dtype)
        head = place < self.most
        new[group[head], place[head]] = rank[head]
        self.held[key[starts]] = np.sort(np.concatenate([self.held[key[starts]], new], axis=1), axis=1)[:, : self.most]
        return order[rank <= self.held[key, -1]]


_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(np.sin(k + 1)) * 2**32) for k in range(64)]
_CHUNK = 1 << 14  # pairs at once, so that the state stays in the cache


def _md5(words: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The first four bytes of the MD5 digests of ``n`` messages of one block each, whose words of zeros are left out."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    start, f, t = a.copy(), np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        turn = k // 16
        if turn == 0:
            w = k
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            w = (5 * k + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            w = (3 * k + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            w = (7 * k) % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32(_SINES[k])
        if w in words:
            f += words[w]
        by = _TURNS[turn][k % 4]
        np.right_shift(f, np.uint32(32 - by), out=t)
        f <<= np.uint32(by)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return (start + a).byteswap()


def by_md5(seed: int) -> Callable:
    """A rank that rises as ``md5(concat_ws('-', landmark_id, target_id, seed))`` does: the first 32 bits of it."""

    def of(landmarks: pa.Array, targets: pa.Array) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        heads = [b"" if v is None else f"{v}-".encode() for v in landmarks.to_pylist()]
        tails = [f"{seed}".encode() if v is None else f"{v}-{seed}".encode() for v in targets.to_pylist()]
        if max(map(len, heads)) + max(map(len, tails)) > 55:  # more than a block
            from hashlib import md5

            return lambda li, ti: np.array([int.from_bytes(md5(heads[i] + tails[j]).digest()[:4]) for i, j in zip(li, ti, strict=True)], np.uint32)
        sizes = sorted({len(h) for h in heads})
        place = np.array([sizes.index(len(h)) for h in heads]) * len(tails)
        left = np.frombuffer(b"".join(h.ljust(64, b"\0") for h in heads), "<u4").reshape(-1, 16).T.copy()
        ends = b"".join((b"\0" * n + t + b"\x80").ljust(56, b"\0") + ((n + len(t)) * 8).to_bytes(8, "little") for n in sizes for t in tails)
        right = np.frombuffer(ends, "<u4").reshape(-1, 16).T.copy()
        in_left, in_right = left.any(axis=1), right.any(axis=1)

        def ranks(li: np.ndarray, ti: np.ndarray) -> np.ndarray:
            out = np.empty(len(li), np.uint32)
            for at in range(0, len(li), _CHUNK):
                i, j = li[at : at + _CHUNK], ti[at : at + _CHUNK]
                j = j + place[i]
                words = {w: (left[w][i] | right[w][j]) if in_left[w] and in_right[w] else left[w][i] if in_left[w] else right[w][j] for w in range(16) if in_left[w] or in_right[w]}
                out[at : at + _CHUNK] = _md5(words, len(i))
            return out

        return ranks

    return of


def judged(places: DataFrame, roads: DataFrame, radius: float, carry: list[str]) -> DataFrame:
    """Pairs of a landmark and another target within ``radius`` with ``distance``, ``topology`` and ``road_name``, and the
    landmark's columns ``carry``. ``places`` have ``junction_t``, the name of a junction near them.

    The first that fits of coincident, abutting without a road between, at a junction, opposite across the nearest road,
    same side along it, and isolated. A pair's road is the one of least summed distance among those near either place
    (the smaller id at a tie).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, other, ways in _rows(batches):
            corner = other.field("junction_t").is_valid().to_numpy(zero_copy_only=False)
            a, b, net = _Places(one), _Places(other), _Roads(ways)
            same, of_a, of_b = _same(a, b), net.located(a), net.located(b)
            step = max(1, BLOCK // len(b.x))
            for at in range(0, len(a.x), step):
                far = _distances(a, b, slice(at, at + step))
                near = far <= radius if same is None else (far <= radius) & ~same[at : at + step]
                li, ti = np.nonzero(near)
                d = far[near]
                li += at
                columns = _columns(a, b, net, li, ti, d, *_judge(a, b, li, ti, d, corner, net, of_a, of_b))
                yield pa.RecordBatch.from_arrays([*columns, *(one.field(c).take(pa.array(li)) for c in carry)], names=[*_COLUMNS, *carry])

    carried = [f"{c} {places.schema[c].dataType.simpleString()}" for c in carry]
    return _units(places, radius, carry, ["junction_t"], roads).mapInArrow(run, ", ".join([_schema(places), *carried]))


_COLUMNS = ["landmark_id", "target_id", "lx", "ly", "rx", "ry", "distance", "topology", "road_name"]


def _schema(places: DataFrame) -> str:
    kind = places.schema["id"].dataType.simpleString()
    return f"landmark_id {kind}, target_id {kind}, lx double, ly double, rx double, ry double, distance double, topology string, road_name string"


def _columns(a: _Places, b: _Places, net: _Roads, li: np.ndarray, ti: np.ndarray, d: np.ndarray, topology: np.ndarray, road: np.ndarray) -> list[pa.Array]:
    names = pa.concat_arrays([pa.array(net.names, pa.string()), b.rows.field("junction_t").cast(pa.string())])
    name = np.where(topology == INTERSECTION, len(net.names) + ti, road)
    left, right = pa.array(li), pa.array(ti)
    return [
        a.ids.take(left), b.ids.take(right), pa.array(a.x[li]), pa.array(a.y[li]), pa.array(b.x[ti]), pa.array(b.y[ti]), pa.array(d),
        pa.array(CLASSES).take(pa.array(topology)), names.take(pa.array(name, mask=name < 0)),
    ]


class _Stream:
    """Landmarks that meet their targets block by block, and the least ranks so far of each, its topologies and bands."""

    def __init__(self, rows: pa.StructArray, ways: pa.StructArray | None, radius: float, most: int, rank: Callable | None) -> None:
        self.a, self.net, self.radius, self.rank = _Places(rows), _Roads(ways), radius, rank
        self.of_a, self.n = self.net.located(self.a), np.zeros(len(self.a.x), np.int64)
        self.firsts = _Firsts(len(self.a.x) * len(CLASSES) * len(geo.DIST_BANDS), most, np.dtype(float if rank is None else np.uint32))
        self.waiting: list[pa.StructArray] = []
        self.kept: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]] = []
        self.size, self.upto = 0, START
        # Up to here any topology may be; a way over a road is no shorter than the straight one, so none is opposite beyond.
        self.any = 31 + max((w for w in self.net.width.tolist() if w > 0), default=0.0)

    def add(self, targets: pa.StructArray) -> None:
        self.waiting.append(targets)
        self.size += len(targets)
        if self.size >= self.upto:
            self.met()

    def done(self) -> Iterator[pa.RecordBatch]:
        """The pairs that are still among the first at the end."""
        self.met()
        for key, rank, rows in self.kept:
            yield rows.filter(pa.array(rank <= self.firsts.held[key, -1]))

    def met(self) -> None:
        if not self.size:
            return
        other = pa.concat_arrays(self.waiting)
        self.waiting, self.size, self.upto = [], 0, min(TARGETS, 2 * self.upto)
        corner = other.field("junction_t").is_valid().to_numpy(zero_copy_only=False)
        other, corners = other.take(pa.array(np.argsort(~corner, kind="stable"))), int(corner.sum())
        corner = np.arange(len(corner)) < corners
        a, b = self.a, _Places(other)
        same, ranks, of_b = _same(a, b), None if self.rank is None else self.rank(a.ids, b.ids), None
        step = max(1, BLOCK // len(b.x))
        for at in range(0, len(a.x), step):
            part = slice(at, at + step)
            by = far = _distances(a, b, part)
            near = far <= self.radius if same is None else (far <= self.radius) & ~same[part]
            self.n[part] += np.count_nonzero(near, axis=1)
            if ranks is not None:
                li, ti = np.nonzero(near)
                by = np.zeros(far.shape, np.uint32)
                by[li, ti] = ranks(li + at, ti)
            li, ti = np.nonzero(self._asked(part, far if near.all() else np.where(near, far, np.inf), by, corners))
            if not len(li):
                continue
            d, rank = far[li, ti], by[li, ti]
            li += at
            if of_b is None and d.min() <= ROAD_PAIR:
                of_b = self.net.located(b)
            topology, road = _judge(a, b, li, ti, d, corner, self.net, self.of_a, of_b)
            level = np.searchsorted([end for _, end in geo.DIST_BANDS[:-1]], d, side="right")
            key = (li * len(CLASSES) + topology) * len(geo.DIST_BANDS) + level
            kept = self.firsts.add(key, rank)
            if len(kept):
                columns = _columns(a, b, self.net, li[kept], ti[kept], d[kept], topology[kept], road[kept])
                rows = pa.RecordBatch.from_arrays([*columns, pa.nulls(len(kept), pa.int64())], names=[*_COLUMNS, "n"])
                self.kept.append((key[kept], rank[kept], rows))

    def _asked(self, part: slice, far: np.ndarray, by: np.ndarray, corners: int) -> np.ndarray:
        """Pairs in a band that may be among the first of a topology which they can have."""
        worst = self.firsts.held[:, -1].reshape(len(self.a.x), len(CLASSES), len(geo.DIST_BANDS))[part]
        out, least, largest = far <= min(self.any, geo.DIST_BANDS[-1][1]), far.min(), far.max()
        start = 0.0
        for k, (_, end) in enumerate(geo.DIST_BANDS):
            if start <= largest and least <= end:
                band = (far >= start) & (far <= end if k == len(geo.DIST_BANDS) - 1 else far < end)
                isolated, corner = worst[:, ISOLATED, k], worst[:, INTERSECTION, k]
                if start <= ROAD_PAIR and least <= ROAD_PAIR:
                    near = band if end <= ROAD_PAIR else band & (far <= ROAD_PAIR)
                    for columns, limit in ((slice(corners), corner), (slice(corners, None), np.maximum(isolated, worst[:, SAME_SIDE, k]))):
                        out[:, columns] |= near[:, columns] & (by[:, columns] <= limit[:, None])
                if end > ROAD_PAIR and largest > ROAD_PAIR:
                    beyond = band & (far > ROAD_PAIR)
                    for columns, limit in ((slice(corners), corner), (slice(corners, None), isolated)):
                        some = beyond[:, columns] & (by[:, columns] <= limit[:, None])
                        if np.count_nonzero(some) > 8 * self.firsts.most * len(far):  # all of one topology, so that the first of the block are enough
                            ranks = np.where(some, by[:, columns], self.firsts.worst)
                            some &= ranks <= np.partition(ranks, self.firsts.most - 1, axis=1)[:, self.firsts.most - 1 : self.firsts.most]
                        out[:, columns] |= some
            start = end
        return out


def first(places: DataFrame, roads: DataFrame, radius: float, most: int, rank: Callable | None = None) -> DataFrame:
    """The pairs of ``judged`` that can be among the ``most`` nearest of their landmark, topology and band, and a row for each
    landmark with ``n``, how many targets are within ``radius``, and nulls.

    Of pairs in a band some more come, where ties leave them in; pairs in no band don't. ``rank``,
    as ``by_md5`` gives one, puts another order in the place of the distance: it takes the ids of both sides, and gives a
    function from indexes of pairs to numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts(done: _Stream) -> pa.RecordBatch:
            ids, size = done.a.ids, len(done.n)
            told = [pa.nulls(size, kind) for kind in (ids.type, *[pa.float64()] * 5, pa.string(), pa.string())]
            return pa.RecordBatch.from_arrays([ids, *told, pa.array(done.n)], names=[*_COLUMNS, "n"])

        stream = None
        for one, ways, *targets in _rows(batches):
            if one is not None:
                if stream is not None:
                    yield from stream.done()
                    yield counts(stream)
                stream = _Stream(one, ways, radius, most, rank)
            else:
                stream.add(pa.StructArray.from_arrays(targets, ["id", "x", "y", "junction_t"]))
        if stream is not None:
            yield from stream.done()
            yield counts(stream)

    return _streams(places, radius, roads).mapInArrow(run, f"{_schema(places)}, n long")
