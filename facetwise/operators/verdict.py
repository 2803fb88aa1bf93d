"""Validity gate, objectives and score of meshes, and the contracts between a mesh and its CAD model."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwise.functions import geometry as G


@dataclass(frozen=True)
class Criteria:
    """What makes a mesh fit for simulation."""

    require_watertight: bool = False
    shape_floor: float = 0.05
    duplicate_tolerance: float = 0.0
    min_shape: float = 0.30
    min_angle: float = 20.0
    max_angle: float = 130.0
    size_tolerance: float = 1.5
    size_in_band: float = 0.90
    gradation: float = 1.5
    chordal: float = 0.05
    normal_deviation: float = 15.0
    weights: dict[str, float] = field(
        default_factory=lambda: {
            "min_shape": 2.0, "min_angle": 2.0, "max_angle": 1.0, "size_in_band": 1.5, "gradation": 1.0, "chordal": 1.5, "normal_deviation": 1.5,
        }
    )

    def objectives(self) -> list[tuple[str, float, bool, float]]:
        """(name, target, maximise, weight)"""
        up = {"min_shape": True, "min_angle": True, "size_in_band": True}
        return [(n, getattr(self, n), up.get(n, False), w) for n, w in self.weights.items()]


def _failed(measures: DataFrame, c: Criteria):
    """Array of the hard failures (code, count) of a row of measures."""
    has = set(measures.columns)
    n = F.col("n_triangles")
    checks = [("mesh.empty", n == 0, F.lit(1))]
    for code, column in (
        ("validity.inverted", "n_inverted"),
        ("validity.nonmanifold", "n_nonmanifold_edges"),
        ("validity.orientation", "n_inconsistent_normals"),
        ("validity.degenerate_shape", "n_degenerate"),
    ):
        if column in has:
            checks.append((code, (n > 0) & (F.col(column) > 0), F.col(column)))
    if c.require_watertight and "is_watertight" in has:
        checks.append(("validity.not_watertight", (n > 0) & ~F.col("is_watertight"), F.col("n_boundary_edges")))
    if c.duplicate_tolerance > 0 and "n_duplicates" in has:
        checks.append(("validity.duplicate_nodes", (n > 0) & (F.col("n_duplicates") > 0), F.col("n_duplicates")))
    found = F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), count.cast("long").alias("count"))) for code, test, count in checks))
    return F.filter(found, lambda x: x.isNotNull())


def _goals(measures: DataFrame, c: Criteria):
    """Array of the objectives of a row of measures that were measured."""

    def one(k: int, name: str, target: float, up: bool, weight: float):
        value = F.col(name).cast("double")
        met = value >= target if up else value <= target
        return F.when(
            (F.col("n_triangles") > 0) & value.isNotNull() & ~F.isnan(value),
            F.struct(
                F.lit(k).alias("ord"), F.lit(name).alias("name"), value.alias("value"), F.lit(float(target)).alias("target"), F.lit(float(weight)).alias("weight"),
                met.alias("satisfied"), G.attainment(value, F.lit(float(target)), F.lit(up)).alias("attainment"),
            ),
        )

    return F.filter(F.array(*(one(k, *o) for k, o in enumerate(c.objectives()) if o[0] in measures.columns)), lambda x: x.isNotNull())


def failures(measures: DataFrame, by: list[str], criteria: Criteria | None = None) -> DataFrame:
    """(by, code, count): the hard failures of each mesh, from one row of measures each.

    Reads n_triangles, n_inverted, n_degenerate and, where there, n_nonmanifold_edges, n_inconsistent_normals,
    n_boundary_edges, is_watertight and n_duplicates. An empty mesh has mesh.empty and nothing else.
    """
    return measures.select(*by, F.inline(_failed(measures, criteria or Criteria())))


def objectives(measures: DataFrame, by: list[str], criteria: Criteria | None = None) -> DataFrame:
    """(by, ord, name, value, target, weight, satisfied, attainment): one row an objective that was measured."""
    return measures.select(*by, F.inline(_goals(measures, criteria or Criteria())))


def scored(measures: DataFrame, by: list[str], criteria: Criteria | None = None, more: DataFrame | None = None) -> DataFrame:
    """(by, is_valid, ready, score, n_failures, codes, worst) of each row of measures, in one pass over them.

    worst is the unsatisfied objective with the least attainment, codes the sorted codes of failures. more holds further
    hard failures (by, code, count), as those of contracts.
    """
    c = criteria or Criteria()
    m = measures.withColumns({"failed": _failed(measures, c), "goals": _goals(measures, c)}).select(*by, "failed", "goals")
    if more is not None:
        extra = more.groupBy(*by).agg(F.collect_list(F.struct("code", F.col("count").cast("long").alias("count"))).alias("more"))  # a mesh has a handful of codes
        m = m.join(extra, by, "left").withColumn("failed", F.concat("failed", F.coalesce("more", F.array().cast("array<struct<code:string,count:bigint>>"))))
    missed = F.filter("goals", lambda g: ~g["satisfied"])
    total = lambda value: F.aggregate("goals", F.lit(0.0), lambda s, g: s + value(g))
    raw = G.guarded(total(lambda g: g["attainment"] * g["weight"]), total(lambda g: g["weight"]), 0.0)
    valid = F.size("failed") == 0
    return m.select(
        *by, valid.alias("is_valid"), (valid & (F.size(missed) == 0)).alias("ready"), F.when(valid, raw).otherwise(0.0).alias("score"),
        F.size("failed").cast("long").alias("n_failures"), F.array_sort(F.transform("failed", lambda f: f["code"])).alias("codes"),
        F.array_min(F.transform(missed, lambda g: F.struct(g["attainment"], g["ord"], g["name"].alias("name"))))["name"].alias("worst"),
    )


def verdicts(meshes: DataFrame, fails: DataFrame, goals: DataFrame, by: list[str]) -> DataFrame:
    """(by, is_valid, ready, score, n_failures, worst): worst is the unsatisfied objective with the least attainment."""
    f = fails.groupBy(*by).agg(F.count("*").alias("n_failures"))
    missed = F.when(~F.col("satisfied"), F.struct("attainment", "ord", "name"))
    o = goals.groupBy(*by).agg(
        F.bool_and("satisfied").alias("all_met"),
        G.guarded(F.sum(F.col("attainment") * F.col("weight")), F.sum("weight"), 0.0).alias("raw"),
        F.min(missed)["name"].alias("worst"),
    )
    out = meshes.select(*by).join(f, by, "left").join(o, by, "left")
    valid = F.coalesce(F.col("n_failures"), F.lit(0)) == 0
    return out.select(
        *by, valid.alias("is_valid"), (valid & F.coalesce("all_met", F.lit(True))).alias("ready"),
        F.when(valid, F.coalesce("raw", F.lit(0.0))).otherwise(0.0).alias("score"), F.coalesce("n_failures", F.lit(0)).alias("n_failures"), "worst",
    )


def body_kind(n_volumes, n_faces):
    """assembly, solid, sheet or unknown."""
    return F.when(n_volumes >= 2, "assembly").when(n_volumes == 1, "solid").when(n_faces > 0, "sheet").otherwise("unknown")


def topology_contract(models: DataFrame) -> DataFrame:
    """models(n_volumes, n_faces, free_edge_length) with body_kind, require_closed and expected_length."""
    kind = body_kind(F.col("n_volumes"), F.col("n_faces"))
    closed = kind.isin("assembly", "solid")
    return models.withColumns({"body_kind": kind, "require_closed": closed, "expected_length": F.when(closed, 0.0).otherwise(F.col("free_edge_length"))})


def approve_removals(removals: DataFrame, *, area_frac: float = 1e-6, circularity: float = 1e-2, explicit: list[str] = ()) -> DataFrame:
    """removals(pid, area, area_frac, perimeter) with circularity, aspect, approved_by and approved.

    An explicit approval counts first, then slivers (with a perimeter), then areas under the cut.
    """
    c = G.circularity(F.col("area"), F.col("perimeter"))
    named = F.col("pid").isin(*explicit) if explicit else F.lit(False)
    if "approved" in removals.columns:
        named = named | F.coalesce(F.col("approved"), F.lit(False))
    out = removals.withColumns({"circularity": c, "aspect": G.aspect_from_circularity(c)})
    why = F.when(named, "operator").when((F.col("perimeter") > 0) & (F.col("circularity") <= circularity), "auto: sliver").when(F.col("area_frac") <= area_frac, "auto: area").otherwise("")
    return out.withColumn("approved_by", why).withColumn("approved", F.col("approved_by") != "")


def missing(required: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Required keys that are not present."""
    return required.select(*on).distinct().join(present.select(*on).distinct(), on, "left_anti")


def contract_violations(contracts: DataFrame, missing_faces: DataFrame, unapproved: DataFrame, unmeshed: DataFrame, *, tolerance: float = 0.05) -> DataFrame:
    """(model, code, count): contracts has one row a model with body_kind, require_closed, expected_length, boundary_length,
    n_nonmanifold and n_inconsistent; the others are (model, pid) lists of offending faces."""
    expect, actual = F.col("expected_length"), F.col("boundary_length")
    off = G.guarded(F.abs(actual - expect), expect, 0.0)
    sheet = ~F.col("require_closed") & F.when(expect > 0, off > tolerance).otherwise(actual <= 0)
    one = lambda test, code: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(1).cast("long").alias("count")))
    rows = F.array(
        one(F.col("require_closed") & (actual > 0), "contract.unexpected_boundary"),
        one(sheet, "contract.boundary_mismatch"),
        one(F.col("n_nonmanifold") > 0, "contract.nonmanifold_skin"),
        one(F.col("n_inconsistent") > 0, "contract.inconsistent_orientation"),
    )
    own = contracts.select("model", F.inline(F.filter(rows, lambda x: x.isNotNull())))
    listed = [(missing_faces, "contract.missing_face"), (unapproved, "contract.unapproved_removal")]
    assemblies = contracts.where("body_kind = 'assembly'").select("model")
    listed.append((unmeshed.join(assemblies, "model", "left_semi"), "contract.interface_not_conformal"))
    parts = [x.groupBy("model").agg(F.count("*").alias("count")).select("model", F.lit(code).alias("code"), "count") for x, code in listed]
    return reduce(DataFrame.unionByName, parts, own)


def as_failures(violations: DataFrame) -> DataFrame:
    """Violations of contracts (model, code, count) as hard failures: a mesh of the wrong part is not a poorer mesh."""
    return violations.select("model", "code", F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)).cast("long").alias("count"))
