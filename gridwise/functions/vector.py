"""Vectors, planes, lines, segments and polygons as Column expressions.

A vector is a tuple of three Columns; v("n") is (nx, ny, nz).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridwise.functions.numeric import c, clamp

Vec = tuple[Column, Column, Column]


def v(prefix: str = "", suffix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{a}{suffix}") for a in "xyz")


def vec(*values) -> Vec:
    return tuple(map(c, values))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, k) -> Vec:
    return tuple(x * c(k) for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Vec, least: float = 1e-6) -> Vec:
    """Unit vector; null where the length is at most least."""
    n = length(a)
    return tuple(F.when(n > least, x / n) for x in a)


def distance(a: Vec, b: Vec) -> Column:
    return length(sub(a, b))


def as_struct(a: Vec, name: str) -> Column:
    return F.struct(*(x.alias(n) for x, n in zip(a, "xyz", strict=True))).alias(name)


def columns(a: Vec, prefix: str) -> list[Column]:
    return [x.alias(prefix + n) for x, n in zip(a, "xyz", strict=True)]


def tangent_basis(n: Vec) -> tuple[Vec, Vec]:
    """Two unit tangents of a unit normal, from the world axis that it is least along."""
    ax, ay, az = (F.abs(x) for x in n)
    zero, one = F.lit(0.0), F.lit(1.0)
    first, second = (ax <= ay) & (ax <= az), (ay < ax) & (ay <= az)
    axis = (F.when(first, one).otherwise(zero), F.when(second, one).otherwise(zero), F.when(first | second, zero).otherwise(one))
    u = normalized(cross(axis, n))
    return u, cross(n, u)


def to_local(p: Vec, origin: Vec, u: Vec, w: Vec) -> tuple[Column, Column]:
    d = sub(p, origin)
    return dot(d, u), dot(d, w)


def to_world(a: Column, b: Column, origin: Vec, u: Vec, w: Vec) -> Vec:
    return add(origin, add(scale(u, a), scale(w, b)))


def quaternion_angle_degrees(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    d = F.abs(sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0)))
    return F.degrees(F.lit(2.0) * F.acos(F.least(F.lit(1.0), d)))


def plane_residual(p: Vec, n: Vec, constant: Column) -> Column:
    """Signed distance to the plane n.x = constant (n a unit normal)."""
    return dot(p, n) - constant


def normalized_plane(n: Vec, constant: Column) -> tuple[Vec, Column]:
    size = length(n)
    return tuple(F.when(size > 1e-6, x / size) for x in n), F.when(size > 1e-6, constant / size)


def plane_plane_line(n1: Vec, d1: Column, n2: Vec, d2: Column, least: float = 0.001) -> tuple[Vec, Vec]:
    """Origin nearest to zero and unit direction of two planes' line; null if nearly parallel. The direction's
    first component that is not near zero is positive."""
    x = cross(n1, n2)
    size2 = dot(x, x)
    ok = F.sqrt(size2) > least
    a, b = cross(n2, x), cross(x, n1)
    origin = tuple(F.when(ok, (d1 * p + d2 * q) / size2) for p, q in zip(a, b, strict=True))
    unit = normalized(x, least)
    lead = F.when(F.abs(unit[0]) > 1e-9, unit[0]).when(F.abs(unit[1]) > 1e-9, unit[1]).otherwise(unit[2])
    return origin, tuple(F.when(lead < 0, -q).otherwise(q) for q in unit)


def three_plane_point(n1: Vec, d1: Column, n2: Vec, d2: Column, n3: Vec, d3: Column, least: float = 0.001) -> Vec:
    """The planes' common point; null where the determinant is too small."""
    det = dot(n1, cross(n2, n3))
    a, b, k = cross(n2, n3), cross(n3, n1), cross(n1, n2)
    return tuple(F.when(F.abs(det) > least, (d1 * x + d2 * y + d3 * z) / det) for x, y, z in zip(a, b, k, strict=True))


def point_line_distance(p: Vec, origin: Vec, direction: Vec) -> Column:
    d = sub(p, origin)
    return length(sub(d, scale(direction, dot(d, direction))))


def line_invariant_error(n1: Vec, d1: Column, n2: Vec, d2: Column, origin: Vec, direction: Vec) -> Column:
    """The largest distance to either plane of the line's points at t = 0, +-1, +-10."""
    errors = []
    for t in (0.0, 1.0, -1.0, 10.0, -10.0):
        p = add(origin, scale(direction, t))
        errors += [F.abs(plane_residual(p, n1, d1)), F.abs(plane_residual(p, n2, d2))]
    return F.greatest(*errors)


def point_segment(p: Vec, a: Vec, b: Vec) -> tuple[Column, Column, Column]:
    """Distance to a segment, the unclamped parameter, and how far the foot lies beyond an end."""
    d = sub(b, a)
    size2 = dot(d, d)
    t = F.when(size2 > 1e-12, dot(sub(p, a), d) / size2).otherwise(F.lit(0.0))
    k = clamp(t)
    beyond = F.greatest(F.lit(0.0), -t, t - 1.0) * F.sqrt(size2)
    return distance(p, add(a, scale(d, k))), t, beyond


def segment_segment_distance(a: Vec, b: Vec, p: Vec, q: Vec) -> Column:
    """Smallest distance between two segments: at an end of one, or between their inner points."""
    u, w, r = sub(b, a), sub(q, p), sub(a, p)
    uu, uw, ww, ur, wr = dot(u, u), dot(u, w), dot(w, w), dot(u, r), dot(w, r)
    det = uu * ww - uw * uw
    s, t = (uw * wr - ww * ur) / det, (uu * wr - uw * ur) / det
    inner = F.when((det > 1e-12) & s.between(0, 1) & t.between(0, 1), distance(add(a, scale(u, s)), add(p, scale(w, t))))
    ends = [point_segment(a, p, q)[0], point_segment(b, p, q)[0], point_segment(p, a, b)[0], point_segment(q, a, b)[0]]
    return F.least(inner, *ends)


def polygon_status(u: Column, w: Column, polygon: Column) -> tuple[Column, Column]:
    """Even-odd inside test and distance to the nearest edge, for an array of struct<u,v>."""
    n = F.size(polygon)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(polygon, i).alias("a"), F.get(polygon, (i + 1) % n).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["v"] > w) != (b["v"] > w)) & (u < (b["u"] - a["u"]) * (w - a["v"]) / F.when(b["v"] == a["v"], F.lit(None)).otherwise(b["v"] - a["v"]) + a["u"])

    def edge_distance(e: Column) -> Column:
        a, b = e["a"], e["b"]
        du, dv = b["u"] - a["u"], b["v"] - a["v"]
        size2 = du * du + dv * dv
        t = clamp(F.when(size2 > 0, ((u - a["u"]) * du + (w - a["v"]) * dv) / size2).otherwise(F.lit(0.0)))
        return F.sqrt(F.pow(u - (a["u"] + du * t), 2) + F.pow(w - (a["v"] + dv * t), 2))

    inside = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return inside, F.array_min(F.transform(edges, edge_distance))
