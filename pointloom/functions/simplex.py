"""Column functions of points, facets, cells and boxes. A point is a triple of columns; everything is plain arithmetic inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(name: str) -> Vec:
    """The coordinates of a struct column with fields x, y, z."""
    return F.col(f"{name}.x"), F.col(f"{name}.y"), F.col(f"{name}.z")


def columns(prefix: str = "", suffix: str = "") -> Vec:
    return F.col(f"{prefix}x{suffix}"), F.col(f"{prefix}y{suffix}"), F.col(f"{prefix}z{suffix}")


def struct(v: Vec) -> Column:
    return F.struct(*[c.alias(a) for c, a in zip(v, "xyz", strict=True)])


def plus(p: Vec, q: Vec) -> Vec:
    return p[0] + q[0], p[1] + q[1], p[2] + q[2]


def minus(p: Vec, q: Vec) -> Vec:
    return p[0] - q[0], p[1] - q[1], p[2] - q[2]


def times(p: Vec, k: Column | float) -> Vec:
    return p[0] * k, p[1] * k, p[2] * k


def dot(p: Vec, q: Vec) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def cross(p: Vec, q: Vec) -> Vec:
    return p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]


def det(u: Vec, v: Vec, w: Vec) -> Column:
    return dot(u, cross(v, w))


def squared_distance(p: Vec, q: Vec) -> Column:
    d = minus(p, q)
    return dot(d, d)


def projection(a: Vec, c: Vec, axis: Vec) -> Column:
    """The coefficient of ``c`` - ``a`` along ``axis``; null for an axis without length."""
    n = dot(axis, axis)
    return dot(minus(c, a), axis) / F.when(n != 0, n)


def barycentre(*points: Vec) -> Vec:
    return times(reduce(plus, points), F.lit(1.0) / len(points))


def volume(p: Vec, q: Vec, r: Vec, s: Vec) -> Column:
    return F.abs(det(minus(q, p), minus(r, p), minus(s, p))) / 6


def area(p: Vec, q: Vec, r: Vec) -> Column:
    n = cross(minus(q, p), minus(r, p))
    return F.sqrt(dot(n, n)) / 2


def orientation(p: Vec, q: Vec, r: Vec, s: Vec) -> Column:
    """The sign of det(q - p, r - p, s - p) in doubles; exact for whole coordinates whose products stay below 2**53."""
    d = det(minus(q, p), minus(r, p), minus(s, p))
    return F.when(d > 0, 1).when(d < 0, -1).otherwise(0)


def circumoffset(p: Vec, q: Vec, r: Vec, s: Vec) -> Vec:
    """From ``p`` to the centre of the sphere through four points; null for flat cells. For whole coordinates whose products stay below 2**53 each part is rounded once."""
    u, v, w = minus(q, p), minus(r, p), minus(s, p)
    d = 2 * det(u, v, w)
    sum_ = plus(plus(times(cross(v, w), dot(u, u)), times(cross(w, u), dot(v, v))), times(cross(u, v), dot(w, w)))
    return tuple(c / F.when(d != 0, d) for c in sum_)


def circumcentre(p: Vec, q: Vec, r: Vec, s: Vec) -> Vec:
    """The centre of the sphere through four points; null for flat cells."""
    return plus(p, circumoffset(p, q, r, s))


def sphere_inside(centre: Vec, r2: Column, low: Vec, high: Vec) -> Column:
    """Whether a sphere lies wholly in a box."""
    r = F.sqrt(r2)
    return reduce(lambda a, b: a & b, [(c - r >= lo) & (c + r <= hi) for c, lo, hi in zip(centre, low, high, strict=True)])


def sphere_touches(centre: Vec, r2: Column, low: Vec, high: Vec) -> Column:
    """Whether a sphere and a box have a point in common."""
    gap = [F.greatest(lo - c, c - hi, F.lit(0.0)) for c, lo, hi in zip(centre, low, high, strict=True)]
    return reduce(lambda a, b: a + b, [g * g for g in gap]) <= r2


def box_beyond(p: Vec, q: Vec, r: Vec, low: Vec, high: Vec) -> Column:
    """Whether all corners of a box lie strictly on the positive side of a facet's plane."""
    n = cross(minus(q, p), minus(r, p))
    # the corner that reaches least far along the normal decides
    least = [F.least(k * (lo - o), k * (hi - o)) for k, o, lo, hi in zip(n, p, low, high, strict=True)]
    return least[0] + least[1] + least[2] > 0


def angle(a: Vec, c: Vec, b: Vec) -> Column:
    """The angle a-c-b in radians; null if an arm has no length."""
    u, v = minus(a, c), minus(b, c)
    n = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    # least and greatest pass over nulls, so the case is told apart outside
    return F.when(n != 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / F.nullif(n, F.lit(0.0))))))


def in_triangle(p: Vec, q: Vec, r: Vec, s: Column, t: Column) -> Vec:
    """The point of a triangle that two numbers of [0, 1] stand for; uniform numbers give uniform points."""
    over = s + t > 1
    a, b = F.when(over, 1 - s).otherwise(s), F.when(over, 1 - t).otherwise(t)
    return plus(p, plus(times(minus(q, p), a), times(minus(r, p), b)))


def in_tetrahedron(p: Vec, q: Vec, r: Vec, o: Vec, s: Column, t: Column, u: Column) -> Vec:
    """The point of a cell that three numbers of [0, 1] stand for; uniform numbers give uniform points (the unit cube is folded into the simplex)."""
    over = s + t > 1
    a, b = F.when(over, 1 - s).otherwise(s), F.when(over, 1 - t).otherwise(t)
    high, all_ = b + u > 1, a + b + u > 1
    x = F.when(all_ & high, a).when(all_, 1 - b - u).otherwise(a)
    y = F.when(all_ & high, 1 - u).otherwise(b)
    z = F.when(all_ & high, 1 - a - b).when(all_, a + b + u - 1).otherwise(u)
    return plus(p, plus(plus(times(minus(q, p), x), times(minus(r, p), y)), times(minus(o, p), z)))


def shape_prior(p: Vec, q: Vec, r: Vec) -> Column:
    """How far from regular a facet is: the greatest over the least squared edge, at most 10."""
    e = [squared_distance(p, q), squared_distance(q, r), squared_distance(r, p)]
    return F.least(F.greatest(F.greatest(*e) / F.greatest(F.least(*e), F.lit(1e-5)), F.lit(0.0)), F.lit(10.0))


def plane_cosine(centre: Vec, p: Vec, q: Vec, r: Vec) -> Column:
    """The cosine of the angle, at ``p``, between a cell's circumcentre and its projection on the plane of the facet p, q, r."""
    n = cross(minus(q, p), minus(r, p))
    out = minus(centre, p)
    n2, o2 = dot(n, n), dot(out, out)
    along = dot(out, n)
    flat = F.greatest(o2 - along * along / F.nullif(n2, F.lit(0.0)), F.lit(0.0))
    return F.when((n2 != 0) & (o2 != 0), F.sqrt(flat / F.nullif(o2, F.lit(0.0))))


def facet_weight(p: Vec, q: Vec, r: Vec, centre1: Vec, centre2: Vec) -> Column:
    """A facet's area times the lesser of its two cells' plane cosines (0.001 for a negative one)."""
    one, two = plane_cosine(centre1, p, q, r), plane_cosine(centre2, p, q, r)
    c = F.when(one.isNotNull() & two.isNotNull(), F.least(one, two))
    return area(p, q, r) * F.when(c < 0, F.lit(0.001)).otherwise(c)


def inside(p: Vec, low: Vec, high: Vec) -> Column:
    """Whether a point lies in a box, its sides included."""
    return reduce(lambda a, b: a & b, [c.between(lo, hi) for c, lo, hi in zip(p, low, high, strict=True)])


def box_centre(low: Vec, high: Vec) -> Vec:
    return tuple((lo + hi) / 2 for lo, hi in zip(low, high, strict=True))


def tile_box(low: Vec, high: Vec) -> Column:
    """A box as twelve numbers: its centre and three half axes, rounded to 5 digits."""
    c, h = box_centre(low, high), [(hi - lo) / 2 for lo, hi in zip(low, high, strict=True)]
    zero = F.lit(0.0)
    return F.array(*[F.round(v, 5) for v in (*c, h[0], zero, zero, zero, h[1], zero, zero, zero, h[2])])


def corners(low: Vec, high: Vec) -> list[Vec]:
    return [(a, b, c) for a in (low[0], high[0]) for b in (low[1], high[1]) for c in (low[2], high[2])]


def keep(p: list[Vec], low: Vec, high: Vec, strict: bool) -> Column:
    """Whether any (or with ``strict`` every) one of some corners lies strictly inside a box."""
    at = [reduce(lambda a, b: a & b, [(c > lo) & (c < hi) for c, lo, hi in zip(v, low, high, strict=True)]) for v in p]
    return reduce((lambda a, b: a & b) if strict else (lambda a, b: a | b), at)
