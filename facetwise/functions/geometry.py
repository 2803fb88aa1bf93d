"""Geometry of single rows as Columns: everything stays inside whole-stage code generation.

A point is a triple of Columns. Degenerate input has a defined value (given with each function); nothing divides by zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def inf() -> Column:
    return F.lit(float("inf"))


def point(prefix: str) -> Point:
    return F.col(prefix + "x"), F.col(prefix + "y"), F.col(prefix + "z")


def guarded(top: Column, bottom: Column, otherwise: Column | float) -> Column:
    """top / bottom, or `otherwise` where bottom is not positive."""
    return F.when(bottom > 0, top / F.when(bottom > 0, bottom)).otherwise(otherwise)


def cell_of(value: Column, side: Column) -> Column:
    """The number of a value's cell of that side, as a double: no size overflows, and from 2^52 on a double is whole anyway."""
    q = value / side
    return F.when(F.abs(q) < 2.0**52, F.floor(q).cast("double")).otherwise(q)


def add(p: Point, q: Point) -> Point:
    return p[0] + q[0], p[1] + q[1], p[2] + q[2]


def sub(p: Point, q: Point) -> Point:
    return p[0] - q[0], p[1] - q[1], p[2] - q[2]


def scaled(p: Point, k) -> Point:
    return p[0] * k, p[1] * k, p[2] * k


def dot(p: Point, q: Point) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def cross(p: Point, q: Point) -> Point:
    return p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]


def norm(p: Point) -> Column:
    return F.sqrt(dot(p, p))


def unit(p: Point) -> Point:
    """p at length 1; a zero vector stays zero."""
    n = norm(p)
    return tuple(guarded(x, n, 0.0) for x in p)


def area(a: Point, b: Point, c: Point) -> Column:
    """Unsigned area of a triangle."""
    return norm(cross(sub(b, a), sub(c, a))) * 0.5


def normal(a: Point, b: Point, c: Point) -> Point:
    """Unit normal; zero if the triangle is degenerate."""
    return unit(cross(sub(b, a), sub(c, a)))


def edges(a: Point, b: Point, c: Point) -> tuple[Column, Column, Column]:
    """Lengths of ab, bc and ca."""
    return norm(sub(b, a)), norm(sub(c, b)), norm(sub(a, c))


def shape(area_: Column, l1: Column, l2: Column, l3: Column) -> Column:
    """4 sqrt(3) A / (sum of squared edges): 1 for equilateral triangles, 0 for a point."""
    return guarded(area_ * (4 * math.sqrt(3)), l1 * l1 + l2 * l2 + l3 * l3, 0.0)


def radius_ratio(area_: Column, l1: Column, l2: Column, l3: Column) -> Column:
    """Twice the in-radius over the circum-radius; 0 if degenerate."""
    return guarded(area_ * area_ * 8, (l1 + l2 + l3) * 0.5 * (l1 * l2 * l3), 0.0)


def angle(opposite: Column, x: Column, y: Column) -> Column:
    """Degrees between edges x and y by the law of cosines; 90 where an edge is 0."""
    cos = guarded(x * x + y * y - opposite * opposite, x * y * 2, 0.0)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def aspect(area_: Column, l1: Column, l2: Column, l3: Column) -> Column:
    """Longest edge over its height; infinite if degenerate."""
    longest = F.greatest(l1, l2, l3)
    height = guarded(area_ * 2, longest, 0.0)
    return guarded(longest, height, inf())


def element_size(l1: Column, l2: Column, l3: Column) -> Column:
    """Root mean square edge."""
    return F.sqrt((l1 * l1 + l2 * l2 + l3 * l3) / 3)


def size_from_area(area_: Column) -> Column:
    """Edge of the equilateral triangle of this area."""
    return F.sqrt(area_ * 4 / math.sqrt(3))


def centroid(a: Point, b: Point, c: Point) -> Point:
    return tuple((x + y + z) / 3 for x, y, z in zip(a, b, c, strict=True))


def sagitta(radius: Column, chord: Column) -> Column:
    """Height of an arc over its chord; the radius if the chord reaches the diameter."""
    half = chord / 2
    return F.when(half >= radius, radius).otherwise(radius - F.sqrt(F.greatest(radius * radius - half * half, F.lit(0.0))))


def facet_angle_bound(radius: Column, chord: Column) -> Column:
    """Degrees between a facet and the surface under it; 90 if the chord reaches the diameter."""
    half = chord / 2
    return F.when(half >= radius, 90.0).otherwise(F.degrees(F.asin(F.least(guarded(half, radius, 0.0), F.lit(1.0)))))


def circularity(area_: Column, perimeter: Column) -> Column:
    """4 pi A / P^2: 1 for a disc; 0 without perimeter."""
    return guarded(area_ * (4 * math.pi), perimeter * perimeter, 0.0)


def aspect_from_circularity(c: Column) -> Column:
    """Side ratio r >= 1 of the rectangle with circularity pi r / (1 + r)^2; infinite for c <= 0, 1 from pi / 4 on."""
    k = guarded(F.lit(math.pi), c, 0.0) - 2
    return F.when(c <= 0, inf()).when(c >= math.pi / 4, 1.0).otherwise((k + F.sqrt(F.greatest(k * k - 4, F.lit(0.0)))) / 2)


def first_form(du: Point, dv: Point) -> tuple[Column, Column, Column]:
    """E, F, G of the first fundamental form."""
    return dot(du, du), dot(du, dv), dot(dv, dv)


def area_scale(e: Column, f: Column, g: Column) -> Column:
    return F.sqrt(F.greatest(e * g - f * f, F.lit(0.0)))


def eigenvalues(e: Column, f: Column, g: Column) -> tuple[Column, Column]:
    """Smaller and larger eigenvalue of [[e, f], [f, g]], the smaller not under 0."""
    mid, reach = (e + g) / 2, F.sqrt(((e - g) / 2) * ((e - g) / 2) + f * f)
    return F.greatest(mid - reach, F.lit(0.0)), mid + reach


def anisotropy(e: Column, f: Column, g: Column) -> Column:
    """Ratio of the principal stretches; infinite if one vanishes."""
    low, high = eigenvalues(e, f, g)
    return F.sqrt(guarded(high, low, inf()))


def degenerate_metric(e: Column, f: Column, g: Column, rel: float = 1e-8) -> Column:
    low, high = eigenvalues(e, f, g)
    return low <= high * rel


def parametric_size(e: Column, g: Column, h: Column) -> tuple[Column, Column]:
    """Steps in u and v for a length h in space; infinite where the derivative vanishes."""
    return guarded(h, F.sqrt(e), inf()), guarded(h, F.sqrt(g), inf())


def metric_distance(e: Column, f: Column, g: Column, du: Column, dv: Column) -> Column:
    return F.sqrt(F.greatest(e * du * du + f * du * dv * 2 + g * dv * dv, F.lit(0.0)))


def step_for_length(e: Column, f: Column, g: Column, du: Column, dv: Column, length: Column) -> tuple[Column, Column]:
    """The direction (du, dv) scaled to a length in space; zero if the metric vanishes along it."""
    k = guarded(length, metric_distance(e, f, g, du, dv), 0.0)
    return du * k, dv * k


def metric_frame(e: Column, f: Column, g: Column, floor: float = 1e-10) -> tuple[Column, Column, Column, Column]:
    """Entries (l00, l01, l11, det) of the upper triangle L^T of M = L L^T, eigenvalues floored; det is positive."""
    low, high = eigenvalues(e, f, g)
    lift = F.greatest(high * floor - low, F.lit(0.0))
    l00 = F.sqrt(F.greatest(e + lift, high * floor))
    l01 = guarded(f, l00, 0.0)
    l11 = F.sqrt(F.greatest(g + lift - l01 * l01, high * floor))
    return l00, l01, l11, l00 * l11


def curvature_size(radius: Column, chordal: Column, normal_deg: Column, per_turn: Column) -> Column:
    """Least of the sizes that chordal error, turn of the normal and elements per full turn allow; each may be null.

    Infinite for a radius that is not finite and positive, and for terms that are null or not positive.
    """
    theta = F.least(normal_deg, F.lit(90.0))
    terms = F.least(
        F.when(chordal > 0, F.sqrt(radius * chordal * 8)).otherwise(inf()),
        F.when(normal_deg > 0, radius * 2 * F.sin(F.radians(theta))).otherwise(inf()),
        F.when(per_turn > 0, guarded(radius * (2 * math.pi), per_turn, inf())).otherwise(inf()),
    )
    return F.when((radius > 0) & (radius < inf()), terms).otherwise(inf())


def ramp_distance(near: Column, far: Column, growth: Column) -> Column:
    """Length over which sizes grow from near to far at a rate; 0 if they need not."""
    return F.when((far > near) & (growth > 1), guarded(far - near, growth - 1, 0.0)).otherwise(0.0)


def equilateral_count(area_: Column, h: Column) -> Column:
    """Elements of size h on an area, not rounded; 0 unless both are positive and finite."""
    return F.when((area_ > 0) & (h > 0) & (h < inf()), guarded(area_, h * h * (math.sqrt(3) / 4), 0.0)).otherwise(0.0)


def attainment(value: Column, target: Column, maximize: Column) -> Column:
    """How far an objective is met, 0 to 1."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    up = F.when(target <= 0, 1.0).otherwise(clip(guarded(value, target, 0.0)))
    down = F.when(value <= 0, 1.0).when(target <= 0, 0.0).otherwise(clip(guarded(target, value, 0.0)))
    return F.when(maximize, up).otherwise(down)


def margin(measured: Column, threshold: Column) -> Column:
    """measured / threshold; null without a threshold or with a threshold of 0."""
    return F.when(threshold != 0, measured / F.when(threshold != 0, threshold))


def borderline(measured: Column, threshold: Column, factor: float = 2.0) -> Column:
    m = margin(measured, threshold)
    return F.coalesce(m.between(1 / factor, factor), F.lit(False))


#: Bounds of the rounding error of the two determinants in doubles, relative to the sum of their terms.
ORIENT_BOUND, CIRCLE_BOUND = 3.3306690738754716e-16, 1.1102230246251577e-15
#: Splits a double into two halves of 26 bits.
_SPLITTER = float(2**27 + 1)


def _sum_error(a: Column, b: Column) -> Column:
    """What a + b loses to rounding, exactly."""
    x = a + b
    part = x - a
    return (a - (x - part)) + (b - part)


def _halves(a: Column) -> tuple[Column, Column]:
    high = a * _SPLITTER - (a * _SPLITTER - a)
    return high, a - high


def _product(a: Column, b: Column) -> list[Column]:
    """Two doubles whose sum is a b exactly, the smaller first."""
    (ah, al), (bh, bl), x = _halves(a), _halves(b), a * b
    return [al * bl - (((x - ah * bh) - al * bh) - ah * bl), x]


def _exact_sum(terms: Column) -> Column:
    """An array of doubles to an expansion: an array with the same exact sum, whose parts don't overlap, growing in size and
    without zeros."""
    none = F.array().cast("array<double>")

    def grow(e: Column, b: Column) -> Column:
        step = lambda s, x: F.struct((s["q"] + x).alias("q"), F.concat(s["h"], F.array(_sum_error(s["q"], x))).alias("h"))
        done = lambda s: F.filter(F.concat(s["h"], F.array(s["q"])), lambda x: x != 0)
        return F.aggregate(e, F.struct(b.alias("q"), none.alias("h")), step, done)

    return F.aggregate(terms, none, grow)


def _exact_product(e: Column, f: Column) -> Column:
    """The parts of all products of two expansions: an array with the exact product as its sum."""
    return F.flatten(F.transform(e, lambda a: F.flatten(F.transform(f, lambda b: F.array(*_product(a, b))))))


def _sign(expansion: Column) -> Column:
    """The sign of an expansion; null where it overflowed."""
    sign = F.signum(F.coalesce(F.try_element_at(expansion, F.lit(-1)), F.lit(0.0)))
    return F.when(~F.isnan(sign), sign)


def _orient_terms(ax, ay, bx, by, cx, cy) -> Column:
    """Twelve doubles whose exact sum is twice the signed area of abc."""
    pairs = ((ax, by), (-ax, cy), (-cx, by), (-ay, bx), (ay, cx), (cy, bx))
    return F.array(*(x for p, q in pairs for x in _product(p, q)))


def orient2d(ax, ay, bx, by, cx, cy) -> Column:
    """The exact sign of the area of abc: 1 if counter-clockwise, -1 if clockwise, 0 only if in line.

    Doubles decide where their rounding error can't matter; else products and sums without error do. Exact for coordinates
    whose products neither overflow nor vanish (sizes from 1e-140 to 1e150, and 0); null for null coordinates and
    where they overflow.
    """
    left, right = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
    det = left - right
    exact = _sign(_exact_sum(_orient_terms(ax, ay, bx, by, cx, cy)))
    same = ((ax == cx) | (by == cy)) & ((ay == cy) | (bx == cx))  # nothing to compute, as where ends are shared
    return F.when(F.abs(det) > (F.abs(left) + F.abs(right)) * ORIENT_BOUND, F.signum(det)).when(same, 0.0).when(det.isNotNull(), exact).cast("int")


def in_circle(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """1 if d is inside the circle of counter-clockwise abc, -1 if outside, 0 only if on it: exact, as orient2d is.

    Exact for coordinates whose fourth powers neither overflow nor vanish (sizes from 1e-70 to 1e75, and 0).
    """
    (x1, y1), (x2, y2), (x3, y3) = ((px - dx, py - dy) for px, py in ((ax, ay), (bx, by), (cx, cy)))
    lifted = [x * x + y * y for x, y in ((x1, y1), (x2, y2), (x3, y3))]
    minors = [(x2 * y3, x3 * y2), (x3 * y1, x1 * y3), (x1 * y2, x2 * y1)]
    terms = [z * (p - q) for z, (p, q) in zip(lifted, minors, strict=True)]
    sizes = [z * (F.abs(p) + F.abs(q)) for z, (p, q) in zip(lifted, minors, strict=True)]
    det, size = terms[0] + terms[1] + terms[2], sizes[0] + sizes[1] + sizes[2]
    points = {"a": (ax, ay), "b": (bx, by), "c": (cx, cy), "d": (dx, dy)}
    parts = []
    for own, others, sign in (("a", "bcd", 1.0), ("b", "acd", -1.0), ("c", "abd", 1.0), ("d", "abc", -1.0)):
        (px, py), area = points[own], _exact_sum(_orient_terms(*(v for k in others for v in points[k])))
        square = F.array(*(x * sign for v in (px, py) for x in _product(v, v)))
        parts.append(_exact_product(area, square))
    exact = _sign(_exact_sum(F.concat(*parts)))
    return F.when(F.abs(det) > size * CIRCLE_BOUND, F.signum(det)).when(det.isNotNull(), exact).cast("int")


def in_triangle(px, py, ax, ay, bx, by, cx, cy) -> Column:
    """Whether p lies in or on abc, either way round."""
    s = [orient2d(ax, ay, bx, by, px, py), orient2d(bx, by, cx, cy, px, py), orient2d(cx, cy, ax, ay, px, py)]
    return ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether ab and cd cross; sharing an end point is no crossing, touching along a line is one."""
    shared = ((ax == cx) & (ay == cy)) | ((ax == dx) & (ay == dy)) | ((bx == cx) & (by == cy)) | ((bx == dx) & (by == dy))
    o1, o2 = orient2d(ax, ay, bx, by, cx, cy), orient2d(ax, ay, bx, by, dx, dy)
    o3, o4 = orient2d(cx, cy, dx, dy, ax, ay), orient2d(cx, cy, dx, dy, bx, by)
    overlap = (F.greatest(F.least(ax, bx), F.least(cx, dx)) <= F.least(F.greatest(ax, bx), F.greatest(cx, dx))) & (
        F.greatest(F.least(ay, by), F.least(cy, dy)) <= F.least(F.greatest(ay, by), F.greatest(cy, dy))
    )
    # Apart from lines in one: one product of signs a segment, and all four signs are 0 if their absolute sum is.
    apart = F.when(o1 * o2 > 0, True).otherwise(o3 * o4 > 0)
    flat = F.when(o1 != 0, False).when(o2 != 0, False).when(o3 != 0, False).otherwise(o4 == 0)
    return F.when(shared, False).when(apart, False).when(flat, overlap).otherwise(True)


def circumcenter(ax, ay, bx, by, cx, cy) -> tuple[Column, Column]:
    """Centre of the circle through abc; null if they are in line."""
    d = ((ax - cx) * (by - cy) - (bx - cx) * (ay - cy)) * 2
    a2, b2 = (ax - cx) * (ax - cx) + (ay - cy) * (ay - cy), (bx - cx) * (bx - cx) + (by - cy) * (by - cy)
    safe = F.when(d != 0, d)
    return cx + (a2 * (by - cy) - b2 * (ay - cy)) / safe, cy + (b2 * (ax - cx) - a2 * (bx - cx)) / safe


def apex_height(base: Column, target: Column) -> Column:
    """Height of a front triangle with two edges of the target length; at least 0.35 of the base."""
    half = base / 2
    return F.greatest(F.when(target > half, F.sqrt(F.greatest(target * target - half * half, F.lit(0.0)))).otherwise(base * (math.sqrt(3) / 2)), base * 0.35)


def shape_2d(ax, ay, bx, by, cx, cy) -> Column:
    """Signed shape quality in the plane: negative if clockwise."""
    twice = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    squares = sum((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) for x1, y1, x2, y2 in ((ax, ay, bx, by), (bx, by, cx, cy), (cx, cy, ax, ay)))
    return guarded(twice * (2 * math.sqrt(3)), squares, 0.0)


def with_triangle_metrics(tri):
    """Adds area, l1, l2, l3, shape, rr, angles a1, a2, a3, min_angle, max_angle, aspect and size to rows with ax .. cz."""
    a, b, c = point("a"), point("b"), point("c")
    l1, l2, l3 = edges(a, b, c)
    tri = tri.withColumns({"area": area(a, b, c), "l1": l1, "l2": l2, "l3": l3})
    s, l1, l2, l3 = (F.col(x) for x in ("area", "l1", "l2", "l3"))
    tri = tri.withColumns({"a1": angle(l2, l1, l3), "a2": angle(l3, l1, l2), "a3": angle(l1, l2, l3)})
    return tri.withColumns(
        {
            "shape": shape(s, l1, l2, l3),
            "rr": radius_ratio(s, l1, l2, l3),
            "min_angle": F.least("a1", "a2", "a3"),
            "max_angle": F.greatest("a1", "a2", "a3"),
            "aspect": aspect(s, l1, l2, l3),
            "size": element_size(l1, l2, l3),
        }
    )
