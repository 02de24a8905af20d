"""Column functions on polylines held as arrays of points ``struct<x, y>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.geo import distance


def let(value: Column, use) -> Column:  # noqa: ANN001
    """``use`` of a value that is computed once, also where lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def segments(points: Column) -> Column:
    """The pieces of a line: ends, length and the length of the line before them; pieces without length are left out."""

    def pieces(p: Column) -> Column:
        raw = F.transform(
            F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
            lambda b, k: let(F.get(p, k), lambda a: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))),
        )
        empty = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,len:double,at:double>>")

        def add(done: Column, s: Column) -> Column:
            size = distance(s["x1"], s["y1"], s["x2"], s["y2"])
            before = F.when(F.size(done) > 0, F.element_at(done, -1)["at"] + F.element_at(done, -1)["len"]).otherwise(0.0)
            one = F.struct(s["x1"], s["y1"], s["x2"], s["y2"], size.alias("len"), before.alias("at"))
            return F.when(size > 0, F.concat(done, F.array(one))).otherwise(done)

        return F.aggregate(raw, empty, add)

    return let(points, pieces)


def length(segs: Column) -> Column:
    return F.when(F.size(segs) > 0, F.element_at(segs, -1)["at"] + F.element_at(segs, -1)["len"]).otherwise(0.0)


def to_piece(s: Column, x: Column, y: Column) -> Column:
    """Distance to the nearest point of a piece, and how far along the line that point lies, as struct ``(d, pos)``."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    along = F.least(s["len"], F.greatest(F.lit(0.0), ((x - s["x1"]) * dx + (y - s["y1"]) * dy) / s["len"]))

    def foot(v: Column, axis: str, d: Column, across: Column, p: Column) -> Column:
        """Along an axis the place's own coordinate, as steps by shares of the length would leave it by rounding."""
        lo, hi = F.least(s[f"{axis}1"], s[f"{axis}2"]), F.greatest(s[f"{axis}1"], s[f"{axis}2"])
        return F.when(across == 0, F.greatest(lo, F.least(hi, v))).otherwise(s[f"{axis}1"] + d * (p / s["len"]))

    def measured(p: Column) -> Column:
        return F.struct(distance(x, y, foot(x, "x", dx, dy, p), foot(y, "y", dy, dx, p)).alias("d"), (s["at"] + p).alias("pos"))

    return let(along, measured)


def located(segs: Column, x: Column, y: Column) -> Column:
    """Distance to a line and the place of its nearest point (the first at a tie), as struct ``(d, pos)``."""
    return F.array_min(F.transform(segs, lambda s: to_piece(s, x, y)))


def crosses(s: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a piece and the straight between two points share a point, touching included."""

    def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
        return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))

    a = side(s["x1"], s["y1"], s["x2"], s["y2"], x1, y1)
    b = side(s["x1"], s["y1"], s["x2"], s["y2"], x2, y2)
    c = side(x1, y1, x2, y2, s["x1"], s["y1"])
    d = side(x1, y1, x2, y2, s["x2"], s["y2"])
    overlap = lambda u1, u2, v1, v2: (F.least(u1, u2) <= F.greatest(v1, v2)) & (F.least(v1, v2) <= F.greatest(u1, u2))
    boxes = overlap(s["x1"], s["x2"], x1, x2) & overlap(s["y1"], s["y2"], y1, y2)
    return boxes & (a * b <= 0) & (c * d <= 0)


def fraction(segs: Column, x: Column, y: Column) -> Column:
    """How far along a line its nearest point to a place lies, from 0 to 1; null for a line without length."""
    size = length(segs)
    return F.when(size > 0, located(segs, x, y)["pos"] / size)


def merged(parts: Column) -> Column:
    """The lines that a line's parts, arrays of points, make where one goes on from an end of the line before it, turned
    round where need be. Parts that don't touch the line before begin a line of their own."""
    inner = lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
    ends = lambda p: (F.element_at(p, 1), F.element_at(p, -1))

    def add(done: Column, part: Column) -> Column:
        def joined(line: Column) -> Column:
            (a, b), (p, q) = ends(line), ends(part)
            turned = F.reverse(part)
            return (
                F.when(b == p, F.concat(line, inner(part))).when(b == q, F.concat(line, inner(turned)))
                .when(a == q, F.concat(part, inner(line))).when(a == p, F.concat(turned, inner(line)))
            )

        def kept(one: Column) -> Column:
            rest = F.slice(done, 1, F.size(done) - 1)
            return F.when(one.isNull(), F.concat(done, F.array(part))).otherwise(F.concat(rest, F.array(one)))

        return F.when(F.size(done) == 0, F.array(part)).otherwise(let(let(F.element_at(done, -1), joined), kept))

    return F.aggregate(parts, F.array().cast("array<array<struct<x:double,y:double>>>"), add)
