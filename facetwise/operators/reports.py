"""Findings of curves and parametrisations, removed faces, tallies, summaries, rays and drawings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetwise.functions import geometry as G

#: Class of a curve to severity and finding; manifold curves have none.
CURVE_SEVERITY = {"free": ("BLOCK", "curve.free_edge"), "seam": ("INFO", "curve.seam"), "interface": ("INFO", "curve.interface"), "nonmanifold": ("WARN", "curve.nonmanifold"), "orphan": ("INFO", "curve.reference")}
PARAM_SEVERITY = {"unparametrizable": "BLOCK", "degenerate": "WARN", "distorted": "WARN"}


def segment_counts(segments: DataFrame) -> DataFrame:
    """segments(curve, length) to (curve, n, least, most)."""
    return segments.groupBy("curve").agg(F.count("*").alias("n"), F.min("length").alias("least"), F.max("length").alias("most"))


def curve_report(curves: DataFrame) -> DataFrame:
    """curves(curve, class, n_segments, degenerate) to findings (curve, severity, code); degenerate curves are skipped."""
    pick = lambda k: F.create_map(*(F.lit(x) for c, v in CURVE_SEVERITY.items() for x in (c, v[k])))
    empty = F.coalesce(F.col("n_segments"), F.lit(0)) == 0
    own = curves.where(~F.col("degenerate"))
    out = own.select(
        "curve",
        F.when(empty, "BLOCK").otherwise(F.try_element_at(pick(0), F.col("class"))).alias("severity"),
        F.when(empty, "curve.empty").otherwise(F.try_element_at(pick(1), F.col("class"))).alias("code"),
    )
    return out.where("code is not null")


def param_report(classes: DataFrame, limit: float = 100.0) -> DataFrame:
    """classes(face, class, ratio) to findings; the threshold named is the ratio's, even if anisotropy tripped it."""
    severity = F.try_element_at(F.create_map(*(F.lit(x) for kv in PARAM_SEVERITY.items() for x in kv)), F.col("class"))
    return classes.where(severity.isNotNull()).select("face", severity.alias("severity"), F.concat(F.lit("param."), "class").alias("code"), F.lit(limit).alias("threshold"), F.col("ratio").alias("measured"))


def removed_faces(entities: DataFrame, provenance: DataFrame) -> DataFrame:
    """Dead faces without children: what a repair took away, the largest area first."""
    dead = entities.where("dim = 2 and not alive")
    return dead.join(provenance.select(F.col("parent").alias("pid")).distinct(), "pid", "left_anti").orderBy(F.desc("area"), "pid")


def fidelity_objectives(scores: DataFrame, by: list[str], chordal: float = 0.05, normal: float = 15.0) -> DataFrame:
    """The worst chordal and normal deviation over the measured faces of each mesh, as objectives; unmeasured ones give none."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    m = scores.groupBy(*by).agg(F.max(clean("chordal_relative")).alias("chordal"), F.max(clean("normal_p99_deg")).alias("normal"))
    row = lambda name, value, target: F.struct(F.lit(name).alias("name"), F.col(value).alias("value"), F.lit(target).alias("target"))
    rows = F.array(row("chordal", "chordal", chordal), row("normal_deviation", "normal", normal))
    return m.select(*by, F.inline(rows)).where("value is not null").withColumn("satisfied", F.col("value") <= F.col("target"))


def summary(findings: DataFrame, most: int = 15) -> tuple[DataFrame, DataFrame]:
    """(severity, n, n_borderline) and the first findings of each severity; INFO is never borderline."""
    count = findings.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.col("borderline") & (F.col("severity") != "INFO")).alias("n_borderline"))
    w = Window.partitionBy("severity").orderBy("code", "tag")
    return count, findings.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def tally(jobs: DataFrame, slow: float = 60.0) -> DataFrame:
    """jobs(rc, seconds) by status: 124 and 142 are time-outs, -1 a crash, 0 a pass (slow beyond a limit)."""
    status = F.when(F.col("rc").isin(124, 142), "timeout").when(F.col("rc") == -1, "crash").when(F.col("rc") != 0, "fail").when(F.col("seconds") > slow, "slow").otherwise("pass")
    return jobs.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))


def import_diagnosis(counts: DataFrame) -> DataFrame:
    """counts(model, mode, n_volumes) for modes plain, healed and memory: where volumes are lost."""
    p = counts.groupBy("model").pivot("mode", ["plain", "healed", "memory"]).agg(F.max("n_volumes"))
    cause = F.when(F.col("plain") == F.col("memory"), "none").when(F.col("healed") == F.col("memory"), "import without healing").when(F.col("plain") > F.col("healed"), "healing").otherwise("other")
    return p.withColumn("cause", cause)


def fair(boundaries: DataFrame) -> DataFrame:
    """(face, fair): whether all methods meshed the same boundary (one fingerprint a face)."""
    return boundaries.groupBy("face").agg((F.count_distinct("fingerprint") == 1).alias("fair"))


def local_sizes(sizes: DataFrame, background: float) -> DataFrame:
    """Faces that need a size source of their own: those under 0.999 of the background size."""
    return sizes.where(F.col("size") < 0.999 * background)


def signatures(samples: DataFrame) -> DataFrame:
    """samples(face, k1, k2, nx, ny, nz): mean and largest absolute curvature, and the mean unit normal (null if it cancels)."""
    k = F.greatest(F.abs("k1"), F.abs("k2"))
    m = samples.groupBy("face").agg(F.avg(k).alias("curvature_mean"), F.max(k).alias("curvature_max"), *(F.avg(c).alias(c) for c in ("nx", "ny", "nz")))
    n = G.norm(tuple(F.col(c) for c in ("nx", "ny", "nz")))
    return m.withColumn("normal", F.when(n > 1e-9, F.array(*(F.col(c) / F.when(n > 1e-9, n) for c in ("nx", "ny", "nz"))))).drop("nx", "ny", "nz")


def cone_rays(triangles: DataFrame, half_angle: float = 0.12, offset: float = 0.0) -> DataFrame:
    """(mesh_id, tri, ray, ox .. oz, dx .. dz): five rays into the body from each centroid, the axis and four around it."""
    a, b, c = G.point("a"), G.point("b"), G.point("c")
    put = lambda df, name, v: df.withColumns({f"{name}{k}": x for k, x in zip("xyz", v, strict=True)})
    # One frame after the other, so that each is computed once: the inward normal, an edge, and what is across both.
    t = put(triangles, "_w", G.cross(G.sub(c, a), G.sub(b, a)))
    t = put(put(t, "_n", G.unit(G.point("_w"))), "_e", G.unit(G.sub(b, a)))
    t = put(put(t, "_f", G.cross(G.point("_n"), G.point("_e"))), "_g", G.centroid(a, b, c))
    n, e1, e2, g = (G.point(k) for k in ("_n", "_e", "_f", "_g"))
    cos, sin = math.cos(half_angle), math.sin(half_angle)
    origin = tuple(p + q * offset for p, q in zip(g, n, strict=True))
    rows = []
    for k in range(5):
        x, y = (math.cos(k * math.pi / 2) * sin, math.sin(k * math.pi / 2) * sin) if k else (0.0, 0.0)
        d = n if k == 0 else tuple(p * cos + q * x + r * y for p, q, r in zip(n, e1, e2, strict=True))
        rows.append(F.struct(F.lit(k).alias("k"), *(v.alias(m) for v, m in zip((*origin, *d), ("ox", "oy", "oz", "dx", "dy", "dz"), strict=True))))
    return t.select("mesh_id", "tri", F.inline(F.array(*rows))).withColumn("ray", F.col("tri") * 5 + F.col("k")).drop("k")


def uv_drawing(triangles: DataFrame, width: int = 900) -> DataFrame:
    """(tri, polygon): an SVG polygon for each triangle (ax .. cy in the plane), shaded from red to green by its shape."""
    box = triangles.agg(F.least(F.min("ax"), F.min("bx"), F.min("cx")).alias("x0"), F.greatest(F.max("ax"), F.max("bx"), F.max("cx")).alias("x1"), F.greatest(F.max("ay"), F.max("by"), F.max("cy")).alias("y1")).first()
    scale = width / max((box["x1"] or 0) - (box["x0"] or 0), 1e-12)
    at = lambda p: F.format_string("%.2f,%.2f", (F.col(p + "x") - box["x0"]) * scale, (F.lit(box["y1"]) - F.col(p + "y")) * scale)
    flat = triangles.withColumns({f"{p}z": F.lit(0.0) for p in "abc"})
    q = G.with_triangle_metrics(flat).withColumn("hue", F.round(F.least(F.greatest("shape", F.lit(0.0)), F.lit(1.0)) * 120).cast("int"))
    return q.select("tri", F.concat(F.lit('<polygon points="'), F.concat_ws(" ", *(at(p) for p in "abc")), F.lit('" fill="hsl('), F.col("hue").cast("string"), F.lit(',70%,60%)"/>')).alias("polygon"))


def run_lines(iterations: DataFrame) -> DataFrame:
    """(run, idx, line): one line of text an iteration."""
    state = F.when(F.col("ready"), "READY").when(F.col("is_valid"), "valid").otherwise("INVALID")
    return iterations.select("run", "idx", F.format_string("[%d] %d tris %s score %.3f", F.col("idx").cast("int"), F.col("n_tri"), state, "score").alias("line"))


def removal_lines(removals: DataFrame) -> DataFrame:
    """(pid, line): each removal in words."""
    c = G.circularity(F.col("area"), F.col("perimeter"))
    return removals.select("pid", F.format_string("%s: area %.3g, about %.0f to 1", F.col("pid").cast("string"), "area", F.least(G.aspect_from_circularity(c), F.lit(1e9))).alias("line"))


def verdict_lines(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, line): each verdict of verdict.scored in words: the state, the score, and what failed or is missed most."""
    state = F.when(F.col("ready"), "READY").when(F.col("is_valid"), "valid").otherwise("INVALID")
    why = F.when(~F.col("is_valid"), F.concat(F.lit(": "), F.array_join("codes", ", "))).when(F.col("worst").isNotNull(), F.concat(F.lit(": worst is "), "worst")).otherwise("")
    return scored.select(*by, F.concat(F.format_string("%-7s score %.3f", state, "score"), why).alias("line"))


def finding_lines(findings: DataFrame) -> DataFrame:
    """(severity, code, line): findings counted by severity and code in words, with the least and the largest value measured."""
    g = findings.groupBy("severity", "code").agg(F.count("*").alias("n"), F.min("measured").alias("low"), F.max("measured").alias("high"))
    values = F.when(F.col("low").isNull(), "").otherwise(F.format_string(" (%.2f to %.2f)", "low", "high"))
    return g.select("severity", "code", F.concat(F.format_string("%-5s %s: %d", "severity", "code", "n"), values).alias("line"))
