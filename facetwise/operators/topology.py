"""Edges, incidence and adjacency of meshes and of CAD models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.operators.ranks import with_percentiles, written


def directed_edges(triangles: DataFrame, keep: list[str]) -> DataFrame:
    """keep, tri, i, j: the three directed edges of every triangle, in one pass."""
    pairs = F.array(*(F.struct(F.col(i).alias("i"), F.col(j).alias("j")) for i, j in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    return triangles.select(*keep, "tri", F.inline(pairs))


def edge_uses(triangles: DataFrame, by: list[str]) -> DataFrame:
    """One row an undirected edge (a < b): n uses, of which `forward` run from a to b. Aggregated map-side before the shuffle."""
    e = directed_edges(triangles, by)
    return e.groupBy(*by, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(
        F.count("*").alias("n"), F.count_if(F.col("i") < F.col("j")).alias("forward")
    )


def skin(triangles: DataFrame, interface: DataFrame, on: list[str]) -> DataFrame:
    """Triangles that lie on no interface face; Spark broadcasts the list of those if its bytes allow."""
    return triangles.join(interface, on, "left_anti")


def edge_topology(triangles: DataFrame, by: list[str]) -> DataFrame:
    """Boundary edges (1 use), non-manifold edges (over 2), and edges used twice in one direction, per group."""
    uses = edge_uses(triangles, by)
    return uses.groupBy(*by).agg(
        F.count_if(F.col("n") == 1).alias("n_boundary_edges"),
        F.count_if(F.col("n") > 2).alias("n_nonmanifold_edges"),
        F.count_if((F.col("n") == 2) & F.col("forward").isin(0, 2)).alias("n_inconsistent_normals"),
        (F.count_if(F.col("n") != 2) == 0).alias("is_watertight"),
    )


def boundary_length(triangles: DataFrame, vertices: DataFrame, by: list[str]) -> DataFrame:
    """Length of the edges used once, per group; by has mesh_id."""
    once = edge_uses(triangles, by).where("n = 1")
    for v in "ab":
        once = once.join(vertices.select("mesh_id", F.col("v").alias(v), *(F.col(x).alias(v + x) for x in "xyz")), ["mesh_id", v])
    return once.groupBy(*by).agg(F.sum(G.norm(G.sub(G.point("a"), G.point("b")))).alias("boundary_length"), F.count("*").alias("n_boundary_edges"))


def neighbours(triangles: DataFrame, by: list[str]) -> DataFrame:
    """(by, t1, t2), t1 < t2: triangles that share an edge of exactly two uses; no self-join."""
    e = directed_edges(triangles, by)
    pair = e.groupBy(*by, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(
        F.count("*").alias("n"), F.min("tri").alias("t1"), F.max("tri").alias("t2")
    )
    return pair.where("n = 2").select(*by, "t1", "t2")


def gradation(sizes: DataFrame, pairs: DataFrame, by: list[str], limit: float = 1.5) -> DataFrame:
    """Ratios of the larger to the smaller size over neighbouring triangles; infinite if the smaller is 0.

    The mean and the 99th percentile are over finite ratios, the maximum and the share over the limit over all.
    """
    own = lambda k: sizes.select(*by, F.col("tri").alias(f"t{k}"), F.col("size").alias(f"s{k}"))
    both = pairs.join(own(1), [*by, "t1"]).join(own(2), [*by, "t2"])
    small = F.least("s1", "s2")
    both = both.withColumn("ratio", G.guarded(F.greatest("s1", "s2"), small, G.inf()))
    both = written(both.select(*by, "ratio"))  # joined once, read twice
    finite = F.when(F.col("ratio") < G.inf(), F.col("ratio"))
    out = both.groupBy(*by).agg(
        F.count("*").alias("n_pairs"),
        F.max("ratio").alias("max_ratio"),
        F.avg(finite).alias("mean_ratio"),
        F.avg((F.col("ratio") > limit).cast("int")).alias("frac_over"),
    )
    return with_percentiles(out, both, by, [("p99_ratio", finite, 0.99)])


def incidence(face_curves: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """(curve, n_incidences, n_faces, faces): uses of each curve with multiplicity; curves without a face have 0."""
    out = face_curves.groupBy("curve").agg(
        F.count("*").alias("n_incidences"), F.count_distinct("face").alias("n_faces"), F.sort_array(F.collect_set("face")).alias("faces")
    )
    if curves is None:
        return out
    out = curves.select("curve").distinct().join(out, "curve", "left")
    return out.withColumns({"n_incidences": F.coalesce("n_incidences", F.lit(0)), "n_faces": F.coalesce("n_faces", F.lit(0)), "faces": F.coalesce("faces", F.array())})


def edge_class(n_incidences, n_faces, touches_interface=None):
    """Class of a curve: orphan, free, seam, manifold, nonmanifold, or interface where bodies meet."""
    many = F.lit("nonmanifold") if touches_interface is None else F.when(touches_interface, "interface").otherwise("nonmanifold")
    return (
        F.when(n_incidences == 0, "orphan").when(n_incidences == 1, "free").when((n_incidences == 2) & (n_faces == 1), "seam").when(n_incidences == 2, "manifold").otherwise(many)
    )


def face_owners(face_volumes: DataFrame) -> DataFrame:
    """(face, n_volumes, role): exterior with one volume, interface with more."""
    out = face_volumes.groupBy("face").agg(F.count_distinct("volume").alias("n_volumes"))
    return out.withColumn("role", F.when(F.col("n_volumes") > 1, "interface").otherwise("exterior"))


def free_edge_length(face_curves: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: number and length of the curves with a single incidence."""
    free = face_curves.groupBy("curve").agg(F.count("*").alias("n")).where("n = 1").join(lengths, "curve")
    return free.agg(F.count("*").alias("n_free"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("free_length"))


def orphan_faces(faces: DataFrame, face_volumes: DataFrame) -> DataFrame:
    """Faces that bound no volume."""
    return faces.join(face_volumes.select("face").distinct(), "face", "left_anti")


def face_adjacency(face_curves: DataFrame) -> DataFrame:
    """(face, neighbours): faces that share a curve; faces without neighbours keep an empty list.

    A curve of k faces gives k^2 pairs; curves are CAD edges with a handful of faces.
    """
    own = face_curves.select("face", "curve").distinct()
    pairs = own.join(own.select(F.col("face").alias("other"), "curve"), "curve").where("face <> other")
    near = pairs.groupBy("face").agg(F.sort_array(F.collect_set("other")).alias("neighbours"))
    return own.select("face").distinct().join(near, "face", "left").withColumn("neighbours", F.coalesce("neighbours", F.array()))


def seam_curves(face_curves: DataFrame) -> DataFrame:
    """(face, curve): curves that occur more than once in one face's boundary."""
    return face_curves.groupBy("face", "curve").count().where(F.col("count") > 1).select("face", "curve")


def perimeters(face_curves: DataFrame, lengths: DataFrame) -> DataFrame:
    """Perimeter of each face over its different curves."""
    return face_curves.select("face", "curve").distinct().join(lengths, "curve").groupBy("face").agg(F.sum("length").alias("perimeter"))
