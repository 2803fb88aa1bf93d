"""Geometry audit findings, parametrisation classes, thickness guards and threshold calibration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.operators.ranks import with_percentiles


@dataclass(frozen=True)
class Thresholds:
    """Limits of the audit."""

    tiny_curve_frac: float = 1e-4
    degenerate_curve_frac: float = 1e-9
    sliver_circularity: float = 5e-2
    tiny_face_area_frac: float = 1e-7
    param_grid: int = 12
    distortion_ratio_warn: float = 100.0
    anisotropy_warn: float = 20.0
    degenerate_det_rel: float = 1e-12
    reference_size_frac: float = 0.04
    min_segments_per_curve: int = 1
    borderline_factor: float = 2.0
    thickness_size_frac: float = 0.03
    thickness_max_samples: int = 4000
    min_elements_through_thickness: int = 3


def _findings(df: DataFrame, keep: list[str], rows: list[tuple]) -> DataFrame:
    """rows: (condition, code, severity, threshold_name, threshold, measured); one finding for each that holds."""
    made = F.array(
        *(
            F.when(
                test,
                F.struct(
                    F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(name).cast("string").alias("threshold_name"),
                    F.lit(limit).cast("double").alias("threshold"), (F.lit(None) if measured is None else measured).cast("double").alias("measured"),
                ),
            )
            for test, code, severity, name, limit, measured in rows
        )
    )
    return df.select(*keep, F.inline(F.filter(made, lambda x: x.isNotNull())))


def curve_findings(curves: DataFrame, scale: float, th: Thresholds | None = None) -> DataFrame:
    """curves(curve, length): degenerate (INFO) or tiny (WARN) against the model scale."""
    th = th or Thresholds()
    share = F.col("length") / scale
    dead = share <= th.degenerate_curve_frac
    return _findings(curves, ["curve"], [
        (dead, "curve.degenerate", "INFO", "degenerate_curve_frac", th.degenerate_curve_frac, share),
        (~dead & (share < th.tiny_curve_frac), "curve.tiny", "WARN", "tiny_curve_frac", th.tiny_curve_frac, share),
    ])


def face_findings(faces: DataFrame, scale: float, th: Thresholds | None = None) -> DataFrame:
    """faces(face, area, perimeter): slivers by circularity and tiny areas, independently."""
    th = th or Thresholds()
    c, share = G.circularity(F.col("area"), F.col("perimeter")), F.col("area") / (scale * scale)
    return _findings(faces, ["face"], [
        (c < th.sliver_circularity, "face.sliver", "WARN", "sliver_circularity", th.sliver_circularity, c),
        (share < th.tiny_face_area_frac, "face.tiny", "WARN", "tiny_face_area_frac", th.tiny_face_area_frac, share),
    ])


def with_margin(findings: DataFrame, factor: float = 2.0) -> DataFrame:
    """findings with ratio (measured / threshold) and borderline (within the factor of 1)."""
    m, t = F.col("measured"), F.col("threshold")
    return findings.withColumns({"ratio": G.margin(m, t), "borderline": G.borderline(m, t, factor)})


def parametrisation(samples: DataFrame, by: list[str], th: Thresholds | None = None, seams: DataFrame | None = None) -> DataFrame:
    """samples(by, dux .. dvz): class and statistics of each face's parametrisation over its sample points."""
    th = th or Thresholds()
    e, f, g = G.first_form(G.point("du"), G.point("dv"))
    s = samples.withColumns({"E": e, "F": f, "G": g})
    s = s.withColumns({"scale": G.area_scale(F.col("E"), F.col("F"), F.col("G")), "aniso": G.anisotropy(F.col("E"), F.col("F"), F.col("G"))})
    positive = F.when(F.col("scale") > 0, F.col("scale"))
    finite = F.when(F.col("aniso") < G.inf(), F.col("aniso"))
    per = s.groupBy(*by).agg(
        F.count("*").alias("n"), F.median(positive).alias("scale_median"), F.min(positive).alias("scale_min"), F.max(positive).alias("scale_max"),
        F.median(finite).alias("aniso_median"), F.max(finite).alias("aniso_max"),
    )
    low = s.join(per.select(*by, "scale_median"), by).groupBy(*by).agg(
        F.count_if(F.col("scale") <= F.coalesce("scale_median", F.lit(0.0)) * th.degenerate_det_rel).alias("n_degenerate")
    )
    out = per.join(low, by)
    if seams is not None:
        out = out.join(seams.select(*by).distinct().withColumn("seam", F.lit(True)), by, "left")
    seamed = F.coalesce(F.col("seam"), F.lit(False)) if seams is not None else F.lit(False)
    ratio = G.guarded(F.col("scale_max"), F.col("scale_min"), G.inf())
    kind = (
        F.when(F.col("n") < 4, "unparametrizable").when(F.col("n_degenerate") > 0, "degenerate")
        .when((ratio > th.distortion_ratio_warn) | (F.col("aniso_max") > th.anisotropy_warn), "distorted").when(seamed, "seamed").otherwise("clean")
    )
    return out.withColumns({"ratio": ratio, "class": kind}).drop("seam")


def sample_domain(faces: DataFrame, n: int = 12, inside=None) -> DataFrame:
    """(face, i, j, u, v): an n x n grid over the parameter rectangle u0 .. u1, v0 .. v1 of each face, ends included.

    inside(u, v) is a condition on Columns for points within the trim; derivatives outside are not reliable.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda x, i: F.col(x + "0") + (F.col(x + "1") - F.col(x + "0")) * F.col(i) / max(1, n - 1)
    out = faces.withColumn("i", k).withColumn("j", k).withColumns({"u": at("u", "i"), "v": at("v", "j")})
    return (out if inside is None else out.where(inside(F.col("u"), F.col("v")))).select("face", "i", "j", "u", "v")


def face_thickness(hits: DataFrame, by: list[str], most: int = 60, share: float = 0.05) -> DataFrame:
    """hits(by, tri, distance) to (by, thickness, n): a low percentile over at most so many triangles of each face, chosen by
    the digest of their ids; faces without a hit have no row."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.col("tri").cast("string")), "tri"))  # each task keeps `most` a face first
    own = hits.where("distance is not null").withColumn("digest_rank", rank).where(F.col("digest_rank") <= most)
    return own.groupBy(*by).agg(F.percentile("distance", F.lit(share)).alias("thickness"), F.count("*").alias("n"))


def thickness_guard(hits: DataFrame, by: list[str], h: float, elements: int = 3) -> DataFrame:
    """hits(by, tri, distance): the median over a triangle's rays, then median, 1st percentile and least; blocked if the
    percentile is under `elements` sizes h."""
    tri = hits.groupBy(*by, "tri").agg(F.median("distance").alias("t"))
    out = tri.groupBy(*by).agg(F.min("t").alias("least"), F.count("*").alias("n"))
    out = with_percentiles(out, tri, by, [("median", F.col("t"), 0.5), ("p01", F.col("t"), 0.01)])
    return out.withColumn("blocked", F.col("p01") < elements * h)


def counts(entities: DataFrame, by: list[str]) -> DataFrame:
    """entities(by, dim, mass, xlo .. zhi) to one row a model: points, curves, faces and volumes, total volume and the diagonal."""
    span = sum((F.max(x + "hi") - F.min(x + "lo")) * (F.max(x + "hi") - F.min(x + "lo")) for x in "xyz")
    return entities.groupBy(*by).agg(
        *(F.count_if(F.col("dim") == d).alias(n) for d, n in enumerate(("n_points", "n_curves", "n_faces", "n_volumes"))),
        F.coalesce(F.sum(F.when(F.col("dim") == 3, F.col("mass"))), F.lit(0.0)).alias("total_volume"), F.sqrt(span).alias("scale"),
    )


def volume_findings(models: DataFrame, by: list[str]) -> DataFrame:
    """Blocking findings of models without volumes, or whose total volume is not positive."""
    return _findings(models, by, [
        (F.col("n_volumes") == 0, "topology.no_volume", "BLOCK", None, None, None),
        ((F.col("n_volumes") > 0) & (F.col("total_volume") <= 0), "topology.nonpositive_volume", "BLOCK", None, None, F.col("total_volume")),
    ])


def totals(volumes: DataFrame, scale: float) -> DataFrame:
    """volumes(volume): blocking findings of a model without volumes or without positive volume."""
    agg = volumes.agg(F.count("*").alias("n"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("v")).withColumn("scale", F.lit(float(scale)))
    return _findings(agg, ["n"], [
        (F.col("n") == 0, "volume.none", "BLOCK", None, None, None),
        ((F.col("n") > 0) & (F.col("v") <= 0), "volume.nonpositive", "BLOCK", None, None, F.col("v")),
    ])


def imprint_findings(models: DataFrame, face_volumes: DataFrame, by: list[str]) -> DataFrame:
    """Whether the bodies of an assembly share faces: INFO if some do, else WARN; models of one volume have none.

    models has n_volumes, face_volumes(by, face, volume) the imprinted topology; measured is the number of shared faces.
    """
    shared = face_volumes.groupBy(*by, "face").agg(F.count_distinct("volume").alias("n")).where("n > 1").groupBy(*by).agg(F.count("*").alias("n_shared"))
    own = models.where("n_volumes > 1").join(shared, by, "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    return _findings(own, by, [
        (F.col("n_shared") > 0, "assembly.imprinted", "INFO", None, None, F.col("n_shared")),
        (F.col("n_shared") == 0, "assembly.imprinted", "WARN", None, None, F.col("n_shared")),
    ])


def body_kind_inputs(entities: DataFrame, face_curves: DataFrame, face_volumes: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_volumes, n_faces, free_edge_length, interface_faces): what the topology contract is derived from.

    face_curves(by, face, curve) is a bag of boundaries; entities hold the curves' lengths as mass.
    """
    n = entities.groupBy(*by).agg(F.count_if(F.col("dim") == 3).alias("n_volumes"), F.count_if(F.col("dim") == 2).alias("n_faces"))
    lengths = entities.where("dim = 1").select(*by, F.col("tag").alias("curve"), "mass")
    once = face_curves.groupBy(*by, "curve").agg(F.count("*").alias("uses")).where("uses = 1").join(lengths, [*by, "curve"])
    free = once.groupBy(*by).agg(F.sum("mass").alias("free_edge_length"))
    inner = face_volumes.groupBy(*by, "face").agg(F.count_distinct("volume").alias("n")).where("n > 1")
    inner = inner.groupBy(*by).agg(F.sort_array(F.collect_set("face")).alias("interface_faces"))
    out = n.join(free, by, "left").join(inner, by, "left")
    return out.withColumns({"free_edge_length": F.coalesce("free_edge_length", F.lit(0.0)), "interface_faces": F.coalesce("interface_faces", F.array().cast(inner.schema["interface_faces"].dataType))})


def add(findings: DataFrame, more: DataFrame) -> DataFrame:
    """findings with more of them; columns that either lacks are null."""
    return findings.unionByName(more, allowMissingColumns=True)


def proceed(models: DataFrame, findings: DataFrame, by: list[str]) -> DataFrame:
    """The models that no finding blocks: what the audit goes on with."""
    return models.join(findings.where("severity = 'BLOCK'").select(*by).distinct(), by, "left_anti")


def calibration_rows(findings: DataFrame, factor: float = 2.0) -> DataFrame:
    """Findings that have a threshold, with margins, borderline ones first."""
    return with_margin(findings.where("threshold_name is not null"), factor).orderBy(F.desc_nulls_last("borderline"), "threshold_name")


def carry_verdicts(rows: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    """rows with the last non-empty verdict and note of an earlier sheet; previous has ord, its row number."""
    w = Window.partitionBy(*key).orderBy(F.desc("ord"))
    old = previous.where(F.length(F.trim("verdict")) > 0).withColumn("r", F.row_number().over(w)).where("r = 1").select(*key, "verdict", "note")
    return rows.drop("verdict", "note").join(old, key, "left")


def fit(labelled: DataFrame) -> DataFrame:
    """labelled(threshold_name, measured, verdict): whether a cut separates real from false findings, and where.

    A finding fires below its threshold; separable if every real one is under every false one: the cut is their
    geometric mean (half of the upper one if the lower is not positive). Else the overlap and its number of rows.
    """
    v = F.lower(F.trim("verdict"))
    own = labelled.withColumn("v", v).where("v in ('real', 'false')").withColumn("m", F.expr("try_cast(measured as double)")).where("m is not null")
    real, false = F.when(F.col("v") == "real", F.col("m")), F.when(F.col("v") == "false", F.col("m"))
    g = own.groupBy("threshold_name").agg(
        F.count(real).alias("n_real"), F.min(real).alias("real_min"), F.max(real).alias("real_max"),
        F.count(false).alias("n_false"), F.min(false).alias("false_min"), F.max(false).alias("false_max"),
    )
    both = (F.col("n_real") > 0) & (F.col("n_false") > 0)
    g = g.withColumn("separable", F.when(both, F.col("real_max") < F.col("false_min")))
    cut = F.when(F.col("real_max") > 0, F.sqrt(F.greatest(F.col("real_max") * F.col("false_min"), F.lit(0.0)))).otherwise(F.col("false_min") / 2)
    g = g.withColumns({
        "cut": F.when(F.col("separable"), cut),
        "overlap_low": F.when(~F.col("separable"), F.greatest("real_min", "false_min")),
        "overlap_high": F.when(~F.col("separable"), F.least("real_max", "false_max")),
    })
    inside = own.join(g.select("threshold_name", "overlap_low", "overlap_high"), "threshold_name").where("m between overlap_low and overlap_high")
    n = inside.groupBy("threshold_name").agg(F.count("*").alias("n_overlap"))
    return g.join(n, "threshold_name", "left").withColumn("n_overlap", F.coalesce("n_overlap", F.lit(0)))
