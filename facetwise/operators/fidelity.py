"""Deviation of triangles from the surface that they approximate."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.functions.surfaces import KINDS, Surface
from facetwise.operators.ranks import with_percentiles, written
from facetwise.operators.rays import ray_hits  # noqa: F401  part of this module's interface

#: Sample points of a triangle, as barycentric weights: centroid, edge middles, interior.
SAMPLES = (
    (1 / 3, 1 / 3, 1 / 3),
    (0.5, 0.5, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5),
    (2 / 3, 1 / 6, 1 / 6), (1 / 6, 2 / 3, 1 / 6), (1 / 6, 1 / 6, 2 / 3),
)


def _subset(tri: DataFrame, most: int | None, seed: int, by: list[str] | None = None) -> DataFrame:
    """At most so many triangles (of each group), chosen by a hash, so that any partitioning gives the same."""
    if most is None:
        return tri
    order = [F.xxhash64("tri", F.lit(seed)), F.col("tri")]
    if not by:
        return tri.orderBy(*order).limit(most)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))  # Spark cuts each task to `most` rows a group first
    return tri.withColumn("hash_rank", rank).where(F.col("hash_rank") <= most).drop("hash_rank")


def _far(surface: Surface, samples=SAMPLES) -> Column:
    """The largest distance of a triangle's sample points to the surface. No explode, no join: one expression."""
    a, b, c = G.point("a"), G.point("b"), G.point("c")
    far = []
    for wa, wb, wc in samples:
        p = G.add(G.add(G.scaled(a, wa), G.scaled(b, wb)), G.scaled(c, wc))
        far.append(G.norm(G.sub(p, surface.nearest(p))))
    return F.greatest(*far)


def _turn(surface: Surface) -> Column:
    """Degrees between a triangle's normal and the surface's under its centroid, either way round."""
    a, b, c = G.point("a"), G.point("b"), G.point("c")
    s = surface.normal(*surface.project(G.centroid(a, b, c)))
    return F.degrees(F.acos(F.least(F.abs(G.dot(G.normal(a, b, c), G.unit(s))), F.lit(1.0))))


def deviations(tri: DataFrame, surface: Surface, samples=SAMPLES) -> DataFrame:
    """tri with `deviation`: the largest distance of its sample points to the surface."""
    return tri.withColumn("deviation", _far(surface, samples))


def chordal_deviation(tri: DataFrame, surface: Surface, *, target: float | None = None, most: int | None = None, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """max, mean and 99th percentile of the deviations; relative to the target size, NaN without one. No triangles: zeros."""
    d = written(deviations(_subset(tri, most, seed, by), surface).select(*(by or []), "deviation"))  # made once, read twice
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    relative = F.lit(float("nan")) if not target else F.col("max_deviation") / target
    out = d.groupBy(*(by or [])).agg(F.count("*").alias("n_triangles"), zero(F.max("deviation")).alias("max_deviation"), zero(F.avg("deviation")).alias("mean_deviation"))
    out = with_percentiles(out, d, by or [], [("p99_deviation", F.col("deviation"), 0.99)])
    return out.withColumns({"p99_deviation": zero(F.col("p99_deviation")), "max_relative": relative})


def normal_angles(tri: DataFrame, surface: Surface) -> DataFrame:
    """tri with area and `angle`: degrees between its normal and the surface's under its centroid, either way round."""
    return tri.withColumns({"area": G.area(G.point("a"), G.point("b"), G.point("c")), "angle": _turn(surface)})


def normal_deviation(tri: DataFrame, surface: Surface, *, limit: float = 15.0, most: int | None = None, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """max, mean and 99th percentile of the angles, their mean by area and the share over the limit. No triangles: zeros."""
    d = written(normal_angles(_subset(tri, most, seed, by), surface).select(*(by or []), "area", "angle"))  # made once, read twice
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = d.groupBy(*(by or [])).agg(
        F.count("*").alias("n_triangles"),
        zero(F.max("angle")).alias("max_deg"),
        zero(F.avg("angle")).alias("mean_deg"),
        G.guarded(F.sum(F.col("angle") * F.col("area")), F.sum("area"), 0.0).alias("area_weighted_mean_deg"),
        zero(F.avg((F.col("angle") > limit).cast("int"))).alias("frac_over"),
    )
    return with_percentiles(out, d, by or [], [("p99_deg", F.col("angle"), 0.99)]).withColumn("p99_deg", zero(F.col("p99_deg")))


def cost(tri: DataFrame, by: list[str], samples=SAMPLES) -> DataFrame:
    """(by, n_triangles, projections, normals): how often the surface is evaluated for deviations and for angles."""
    n = F.count("*")
    return tri.groupBy(*by).agg(n.alias("n_triangles"), (n * len(samples)).alias("projections"), n.alias("normals"))


def with_deviations(tri: DataFrame, faces: DataFrame) -> DataFrame:
    """tri with deviation and angle from the surface of its own face: faces(pid, kind, radius, and mesh_id where pids repeat).

    kind is one of functions.surfaces.KINDS; triangles of faces without a known kind have null.
    """
    on = ["mesh_id", "pid"] if "mesh_id" in faces.columns else ["pid"]
    own = tri.join(faces.select(*on, F.col("kind").alias("face_kind"), F.col("radius").alias("face_radius")), on, "left")
    deviation = angle = F.lit(None).cast("double")
    for kind, cls in KINDS.items():
        s = cls(radius=F.col("face_radius")) if "radius" in {f.name for f in fields(cls)} else cls()
        deviation = F.when(F.col("face_kind") == kind, _far(s)).otherwise(deviation)
        angle = F.when(F.col("face_kind") == kind, _turn(s)).otherwise(angle)
    return own.withColumns({"deviation": deviation, "angle": angle}).drop("face_kind", "face_radius")
