"""Analytic surfaces as Columns: plane, sphere and cylinder.

Each has project (space to parameters), point, normal, derivatives, inside and bounds; register() adds kinds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetwise.functions import geometry as G

Vector = tuple[float, float, float]


def _columns(v: Vector) -> G.Point:
    return tuple(F.lit(float(x)) for x in v)


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _unit(a: Vector) -> Vector:
    n = math.sqrt(sum(x * x for x in a))
    return tuple(x / n for x in a) if n else (0.0, 0.0, 0.0)


class Surface:
    """What an operator needs of a surface; parameters (u, v) are Columns."""

    def project(self, p: G.Point) -> tuple[Column, Column]:
        raise NotImplementedError

    def point(self, u: Column, v: Column) -> G.Point:
        raise NotImplementedError

    def normal(self, u: Column, v: Column) -> G.Point:
        raise NotImplementedError

    def derivatives(self, u: Column, v: Column) -> tuple[G.Point, G.Point]:
        raise NotImplementedError

    def inside(self, u: Column, v: Column) -> Column:
        (u0, u1), (v0, v1) = self.bounds()
        return u.between(u0, u1) & v.between(v0, v1)

    def bounds(self) -> tuple[tuple[float, float], tuple[float, float]]:
        return (-math.inf, math.inf), (-math.inf, math.inf)

    def nearest(self, p: G.Point) -> G.Point:
        """Closest point of the surface."""
        return self.point(*self.project(p))


@dataclass(frozen=True)
class Plane(Surface):
    origin: Vector = (0.0, 0.0, 0.0)
    e1: Vector = (1.0, 0.0, 0.0)
    e2: Vector = (0.0, 1.0, 0.0)

    def project(self, p):
        d = G.sub(p, _columns(self.origin))
        return G.dot(d, _columns(self.e1)), G.dot(d, _columns(self.e2))

    def point(self, u, v):
        return tuple(F.lit(o) + u * a + v * b for o, a, b in zip(self.origin, self.e1, self.e2, strict=True))

    def normal(self, u, v):
        return _columns(_unit(_cross(self.e1, self.e2)))

    def derivatives(self, u, v):
        return _columns(self.e1), _columns(self.e2)


@dataclass(frozen=True)
class Sphere(Surface):
    """u is the azimuth, v the angle from the +z pole; the centre projects to the pole."""

    radius: float = 1.0
    centre: Vector = (0.0, 0.0, 0.0)

    def project(self, p):
        d = G.sub(p, _columns(self.centre))
        n = G.norm(d)
        cos = F.when(n > 0, d[2] / F.when(n > 0, n)).otherwise(1.0)
        return F.atan2(d[1], d[0]), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))

    def normal(self, u, v):
        return F.sin(v) * F.cos(u), F.sin(v) * F.sin(u), F.cos(v)

    def point(self, u, v):
        return tuple(F.lit(c) + x * self.radius for c, x in zip(self.centre, self.normal(u, v), strict=True))

    def derivatives(self, u, v):
        r = self.radius
        return (
            (F.sin(v) * F.sin(u) * -r, F.sin(v) * F.cos(u) * r, F.lit(0.0)),
            (F.cos(v) * F.cos(u) * r, F.cos(v) * F.sin(u) * r, F.sin(v) * -r),
        )

    def bounds(self):
        return (-math.pi, math.pi), (0.0, math.pi)

    def nearest(self, p):
        """Along the ray from the centre, without trigonometry."""
        d = G.sub(p, _columns(self.centre))
        n = G.norm(d)
        u = tuple(G.guarded(x, n, z) for x, z in zip(d, (0.0, 0.0, 1.0), strict=True))
        return tuple(F.lit(c) + x * self.radius for c, x in zip(self.centre, u, strict=True))


@dataclass(frozen=True)
class Cylinder(Surface):
    """u is the angle from axis x seed (+y for the z axis), v the height along the axis."""

    radius: float = 1.0
    origin: Vector = (0.0, 0.0, 0.0)
    axis: Vector = (0.0, 0.0, 1.0)

    def frame(self) -> tuple[Vector, Vector, Vector]:
        a = _unit(self.axis)
        seed = (1.0, 0.0, 0.0) if abs(a[0]) < 0.9 else (0.0, 1.0, 0.0)
        e1 = _unit(_cross(a, seed))
        return e1, _cross(a, e1), a

    def project(self, p):
        e1, e2, a = (_columns(x) for x in self.frame())
        d = G.sub(p, _columns(self.origin))
        return F.atan2(G.dot(d, e2), G.dot(d, e1)), G.dot(d, a)

    def normal(self, u, v):
        e1, e2, _ = self.frame()
        return tuple(F.cos(u) * x + F.sin(u) * y for x, y in zip(e1, e2, strict=True))

    def point(self, u, v):
        a = self.frame()[2]
        return tuple(F.lit(o) + n * self.radius + v * x for o, n, x in zip(self.origin, self.normal(u, v), a, strict=True))

    def derivatives(self, u, v):
        e1, e2, a = self.frame()
        return tuple(F.cos(u) * (y * self.radius) - F.sin(u) * (x * self.radius) for x, y in zip(e1, e2, strict=True)), _columns(a)

    def bounds(self):
        return (-math.pi, math.pi), (-math.inf, math.inf)


KINDS: dict[str, type[Surface]] = {"plane": Plane, "sphere": Sphere, "cylinder": Cylinder}


def register(kind: str, surface: type[Surface]) -> None:
    """Make a kind known to surface()."""
    KINDS[kind] = surface


def surface(kind: str, **params) -> Surface:
    if kind not in KINDS:
        raise ValueError(f"no surface kind {kind!r}; known: {', '.join(sorted(KINDS))}")
    return KINDS[kind](**params)
