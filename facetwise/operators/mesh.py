"""Meshes as tables: corners, shape statistics, sizes, attribution to faces, selection and export rows.

Triangles with corners have mesh_id, tri and ax .. cz; most operators take the grouping columns as `by`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.operators.ranks import group_percentiles, null_safe, numbered, with_percentiles, written

#: The exact cut for a poor shape and the shares reported.
POOR_SHAPE, LOW_SHARE, HIGH_SHARE = 0.2, 0.01, 0.99


def corners(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """triangles(mesh_id, v0, v1, v2, ...) with the coordinates of their corners; a triangle with an unknown vertex is dropped.

    Vertices are joined once per corner on (mesh_id, v); Spark broadcasts them only when its statistics allow.
    """
    out = triangles
    for corner, v in zip("abc", ("v0", "v1", "v2"), strict=True):
        own = vertices.select(F.col("mesh_id"), F.col("v").alias(v), *(F.col(x).alias(corner + x) for x in "xyz"))
        out = out.join(own, ["mesh_id", v])
    return out


def shape_statistics(tri: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: areas, shape, radius ratio, angles and aspect over its triangles; exact, interpolated percentiles.

    Percentiles are ranked by range partitions, all groups at once: no group needs to fit in a task.
    """
    m = G.with_triangle_metrics(tri)
    out = m.groupBy(*by).agg(
        F.count("*").alias("n_triangles"),
        F.sum("area").alias("total_area"),
        F.min("shape").alias("shape_min"),
        F.avg("shape").alias("shape_mean"),
        F.min("rr").alias("radius_ratio_min"),
        F.min("min_angle").alias("min_angle"),
        F.max("max_angle").alias("max_angle"),
        F.max("aspect").alias("aspect_max"),
        F.count_if(F.col("area") <= 0).alias("n_inverted"),
        F.count_if(F.col("shape") < POOR_SHAPE).alias("n_poor"),
    )
    return with_percentiles(out, m, by, [("shape_p01", F.col("shape"), LOW_SHARE), ("min_angle_p01", F.col("min_angle"), LOW_SHARE)])


def quality_report(tri: DataFrame) -> DataFrame:
    """One row for all triangles; a mesh without any has zeros, an infinite aspect and the note `empty mesh`."""
    out = shape_statistics(tri, [])
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in out.columns if c not in ("n_triangles", "aspect_max", "n_inverted", "n_poor")}
    return out.withColumns({**zero, "aspect_max": F.coalesce("aspect_max", G.inf())}).withColumn(
        "note", F.when(F.col("n_triangles") == 0, "empty mesh").otherwise("")
    )


def worst(rows: DataFrame, value: str, k: int = 20, *, by: list[str] | None = None, largest: bool = False, key: str = "tri") -> DataFrame:
    """The k rows with the least (or largest) value, over all or per group; NaN and null never rank, ties go by key."""
    own = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    order = [F.desc(value) if largest else F.asc(value), F.asc(key)]
    if not by:
        return own.orderBy(*order).limit(k)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k).drop("rank")


def with_requested_size(tri: DataFrame, faces: DataFrame) -> DataFrame:
    """The size asked of each triangle: its own field_size if there is one, else its face's.

    Faces are met by pid, and by mesh_id where faces have one: a pid is a face of one mesh only.
    """
    on = ["mesh_id", "pid"] if "mesh_id" in faces.columns else ["pid"]
    sized = tri.join(faces.select(*on, "requested_size"), on, "left")
    own = F.col("field_size") if "field_size" in tri.columns else F.lit(None).cast("double")
    return sized.withColumn("target", F.coalesce(own, F.col("requested_size")))


def with_target(tri: DataFrame, size) -> DataFrame:
    """tri with target = size(x, y, z), a function of Columns, at the centroid of each triangle."""
    return tri.withColumn("target", size(*G.centroid(G.point("a"), G.point("b"), G.point("c"))).cast("double"))


def size_ratio():
    """Element size over target; null where there is no positive target."""
    return F.when(F.col("target") > 0, F.col("size") / F.when(F.col("target") > 0, F.col("target")))


def in_band(ratio, tolerance: float = 1.5):
    """Whether a ratio is in the band; one that is null is."""
    return ~F.coalesce(ratio > tolerance, F.lit(False)) & ~F.coalesce(ratio < 1 / tolerance, F.lit(False))


def size_adequation(tri: DataFrame, by: list[str], tolerance: float = 1.5) -> DataFrame:
    """Element size over requested size (column target). A target that is null or not positive has no ratio, and the
    triangle counts as in band."""
    m = G.with_triangle_metrics(tri).withColumn("ratio", size_ratio())
    over, under = F.coalesce(F.col("ratio") > tolerance, F.lit(False)), F.coalesce(F.col("ratio") < 1 / tolerance, F.lit(False))
    share = lambda c: F.avg(c.cast("int"))
    out = m.groupBy(*by).agg(
        F.count("*").alias("n_triangles"),
        F.min("ratio").alias("ratio_min"),
        F.max("ratio").alias("ratio_max"),
        F.avg("ratio").alias("ratio_mean"),
        share(under).alias("frac_undersized"),
        share(over).alias("frac_oversized"),
        share(in_band(F.col("ratio"), tolerance)).alias("frac_in_band"),
    )
    return with_percentiles(out, m, by, [("ratio_p01", F.col("ratio"), LOW_SHARE), ("ratio_p99", F.col("ratio"), HIGH_SHARE)])


def attribute_by_face(tri: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scores of each face, worst shape first: what the policy acts on. Needs pid.

    target is optional, as are deviation and angle (fidelity.with_deviations): with them there are chordal_relative, the
    largest deviation over the target (null without a target), and normal_p99_deg.
    """
    keys = [*(by or []), "pid"]
    if "angle" in tri.columns:  # read more than once: the deviations are made once
        tri = written(tri.select(*(c for c in tri.columns if c in {*keys, "tri", "target", "deviation", "angle", *(p + x for p in "abc" for x in "xyz")})))
    m = G.with_triangle_metrics(tri)
    ratio = size_ratio() if "target" in tri.columns else F.lit(None).cast("double")
    more = []
    if "deviation" in tri.columns:
        share = F.when(F.col("target") > 0, F.col("deviation") / F.when(F.col("target") > 0, F.col("target"))) if "target" in tri.columns else F.lit(None).cast("double")
        more.append(F.max(share).alias("chordal_relative"))
    out = m.groupBy(*keys).agg(
        F.count("*").alias("n_triangles"),
        F.min("shape").alias("shape_min"),
        F.avg("shape").alias("shape_mean"),
        F.min("min_angle").alias("min_angle"),
        F.max(ratio).alias("size_ratio_max"),
        *more,
    )
    if "angle" in tri.columns:
        out = null_safe(out, group_percentiles(tri, keys, [("normal_p99_deg", F.col("angle"), HIGH_SHARE)]), keys)
    return out.orderBy("shape_min", *keys)


def pids(tri: DataFrame) -> DataFrame:
    """(pid): the faces of a mesh, in order."""
    return tri.select("pid").where("pid is not null").distinct().orderBy("pid")


def indices_for(tri: DataFrame, pid) -> DataFrame:
    """(mesh_id, tri): the triangles of a face."""
    return tri.where(F.col("pid") == pid).select("mesh_id", "tri")


#: Scores of which more is worse.
HIGHER_IS_WORSE = ("size_ratio_max", "chordal_relative", "normal_p99_deg")


def worst_faces(scores: DataFrame, metric: str, n: int = 5) -> DataFrame:
    """The n worst faces by a metric; unmeasured faces don't rank."""
    down = metric in HIGHER_IS_WORSE
    own = scores.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    return own.orderBy(F.desc(metric) if down else F.asc(metric), F.desc("pid") if down else F.asc("pid")).limit(n)


def signed_volume(tri: DataFrame, by: list[str]) -> DataFrame:
    """Volume by the divergence theorem: negative if a closed surface is inside out."""
    a, b, c = G.point("a"), G.point("b"), G.point("c")
    return tri.groupBy(*by).agg((F.sum(G.dot(a, G.cross(b, c))) / 6).alias("volume"))


def dense_vertices(triangles: DataFrame) -> DataFrame:
    """(mesh_id, v, new_v): used vertices numbered from 0 in their order, per mesh; a mesh may fill many tasks."""
    used = triangles.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("v")).distinct()
    number = numbered(used, ["mesh_id", "v"], "new_v")
    first = number.groupBy("mesh_id").agg(F.min("new_v").alias("first"))
    return number.join(written(first), "mesh_id").select("mesh_id", "v", (F.col("new_v") - F.col("first")).alias("new_v"))


def submesh(triangles: DataFrame, vertices: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """Triangles that meet a condition, with their vertices renumbered from 0."""
    own = triangles.where(keep)
    new = dense_vertices(own)
    for v in ("v0", "v1", "v2"):
        own = own.join(new.select("mesh_id", F.col("v").alias(v), F.col("new_v").alias("n" + v)), ["mesh_id", v]).drop(v).withColumnRenamed("n" + v, v)
    return own, vertices.join(new, ["mesh_id", "v"]).drop("v").withColumnRenamed("new_v", "v")


def duplicate_nodes(vertices: DataFrame, tolerance: float) -> DataFrame:
    """(mesh_id, i, j): pairs of different nodes, i < j, at most tolerance apart; none for a tolerance of 0 or less.

    Nodes are dealt into cells of four tolerances and ask in the cells that the tolerance around them touches, one or two
    along an axis: an equi-join on the cell. Cells are doubles, so coordinates and tolerances of any size have one (where
    cells are finer than the coordinates' own steps, only equal ones can be near). Nodes without coordinates have no pair.
    """
    home = vertices.select("mesh_id", F.col("v").alias("j"), *(F.col(x).alias("j" + x) for x in "xyz"))
    ask = vertices.select("mesh_id", F.col("v").alias("i"), "x", "y", "z")
    if tolerance <= 0:
        return ask.join(home, "mesh_id").where(F.lit(False)).select("mesh_id", "i", "j")
    cell = F.lit(4.0 * tolerance)
    for x in "xyz":
        home = home.withColumn("c" + x, G.cell_of(F.col("j" + x), cell))
        ends = [G.cell_of(F.col(x) + sign * F.lit(tolerance), cell) for sign in (-1, 0, 1)]
        ask = ask.withColumn("c" + x, F.explode(F.array_distinct(F.array(*ends))))
    near = G.norm(tuple(F.col(x) - F.col("j" + x) for x in "xyz")) <= tolerance
    return ask.join(home, ["mesh_id", "cx", "cy", "cz"]).where((F.col("i") < F.col("j")) & near).select("mesh_id", "i", "j")


def msh_tags(tri: DataFrame) -> DataFrame:
    """(pid, tag): physical groups, numbered from 1 in the order of the pids."""
    pids = tri.select("pid").distinct()
    return pids.withColumn("tag", F.dense_rank().over(Window.orderBy("pid")))


def facet_lines(tri: DataFrame) -> DataFrame:
    """(tri, facet): the ASCII facet of each triangle."""
    n = G.normal(G.point("a"), G.point("b"), G.point("c"))
    row = lambda p: F.format_string("%.6e %.6e %.6e", *(x + F.lit(0.0) for x in p))
    body = F.concat(
        F.lit("facet normal "), row(n), F.lit("\n  outer loop\n"),
        *(x for p in "abc" for x in (F.lit("    vertex "), row(G.point(p)), F.lit("\n"))),
        F.lit("  endloop\nendfacet"),
    )
    return tri.select("tri", body.alias("facet"))
