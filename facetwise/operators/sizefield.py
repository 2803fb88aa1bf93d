"""Declarative size fields: rules resolved to a size per face, compared, and costed before meshing.

rules has ord, kind, params (map of doubles) and scope (array of face ids; empty means all).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.operators.ranks import written
from facetwise.scratch import Scratch

RULES = "ord int, kind string, params map<string,double>, scope array<string>, note string"


def base(h: float) -> tuple:
    return "base", {"h": h}, []


def curvature(chordal: float, normal_deg: float, per_turn: float = 12.0, scope: list[str] = ()) -> tuple:
    return "curvature", {"chordal_tol": chordal, "normal_tol_deg": normal_deg, "min_per_2pi": per_turn}, list(scope)


def thickness(elements: int = 3, scope: list[str] = ()) -> tuple:
    return "thickness", {"min_elements_through": float(elements)}, list(scope)


def feature(h: float, scope: list[str] = ()) -> tuple:
    return "feature", {"h": h}, list(scope)


def clamp(low: float, high: float) -> tuple:
    return "clamp", {"h_min": low, "h_max": high}, []


def gradation(growth: float = 1.4) -> tuple:
    return "gradation", {"max_growth": growth}, []


def default(scale: float, base_frac: float = 0.05) -> list[tuple]:
    """The rules to start from, by model scale."""
    h = base_frac * scale
    return [base(h), curvature(0.02 * h, 12.0, 12.0), thickness(3), clamp(0.02 * h, 4 * h), gradation(1.4)]


def frame(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(k, kind, {a: float(b) for a, b in params.items()}, list(scope), "") for k, (kind, params, scope) in enumerate(rules)], RULES)


def resolve(faces: DataFrame, rules: list[tuple], scale: float = 1.0) -> DataFrame:
    """faces(pid, curvature_max, thickness, ...) with size: the base, cut down by every rule in scope, then clamped.

    Rules are a handful, so each is a Column; their minimum does not depend on their order, and faces are not shuffled.
    """
    h0 = next((p["h"] for k, p, s in rules if k == "base" and not s), 0.05 * scale)
    sizes = [F.lit(float(h0))]
    for kind, p, scope in rules:
        if kind == "curvature":
            k = F.coalesce(F.col("curvature_max"), F.lit(0.0))
            size = G.curvature_size(G.guarded(F.lit(1.0), k, G.inf()), F.lit(p["chordal_tol"]), F.lit(p["normal_tol_deg"]), F.lit(p["min_per_2pi"]))
        elif kind == "thickness":
            t = F.coalesce(F.col("thickness"), F.lit(0.0))
            size = F.when(t != 0, t / max(1, int(p["min_elements_through"])))
        elif kind == "feature":
            size = F.lit(float(p["h"]))
        else:
            continue
        if scope:
            size = F.when(F.col("pid").isin(*scope), size)
        sizes.append(F.coalesce(size, G.inf()))
    out = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    c = next((p for k, p, s in rules if k == "clamp" and not s), None)
    if c:
        out = F.least(F.greatest(out, F.lit(float(c["h_min"]))), F.lit(float(c["h_max"])))
    return faces.withColumn("size", out)


def element_estimate(faces: DataFrame, by: list[str], size: str = "size", area: str = "area") -> DataFrame:
    """Elements that sizes imply on the areas, rounded half to even."""
    return faces.groupBy(*by).agg(F.bround(F.sum(G.equilateral_count(F.col(area), F.col(size)))).cast("long").alias("estimate"))


def within_budget(faces: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """Groups whose estimate is not over the budget."""
    return element_estimate(faces, by).where(F.col("estimate") <= budget)


def smooth(faces: DataFrame, adjacency: DataFrame, growth: float, *, extents: bool = True, passes: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """faces(model, pid, size, area) with sizes cut where a neighbour is much smaller; adjacency(model, pid, nbr).

    The limit that a face of size h and extent L (the root of its area) puts on its neighbours is h g^max(min(L / h, 40), 1),
    or h g without extents. A pass takes the least limit over the sizes that it began with, so no order of faces matters;
    passes end when no size changes, or at `passes`. Each is a join and a minimum over (model, pid): a model fills many
    tasks. Only faces that the last pass changed are asked again, as the limits of all others hold already.

    A growth of 1 or less changes nothing; a size that is null or not positive limits nobody; a null size stays null;
    unknown neighbours and repeated links do no harm; no faces give no rows.
    """
    own = faces.select("model", "pid", F.col("size").cast("double").alias("size"), F.sqrt(F.greatest(F.coalesce("area", F.lit(0.0)), F.lit(0.0))).alias("extent"))
    if growth <= 1:
        return own.select("model", "pid", "size")
    scratch = scratch or Scratch(faces.sparkSession)
    links = scratch.cut(adjacency.select("model", "pid", "nbr").distinct())
    now = scratch.cut(own.withColumn("changed", F.lit(True)))
    h = F.col("size")
    steps = F.greatest(F.least(F.col("extent") / h, F.lit(40.0)), F.lit(1.0)) if extents else F.lit(1.0)
    for _ in range(passes):
        asked = now.where(F.col("changed") & (h > 0)).select("model", "pid", (h * F.pow(F.lit(float(growth)), steps)).alias("most"))
        limits = asked.join(links, ["model", "pid"]).groupBy("model", F.col("nbr").alias("pid")).agg(F.min("most").alias("most"))
        after = now.drop("changed").join(limits, ["model", "pid"], "left").withColumn("changed", F.coalesce(F.col("most") < h, F.lit(False)))
        after = scratch.cut(after.select("model", "pid", F.when(F.col("changed"), F.col("most")).otherwise(h).alias("size"), "extent", "changed"))
        scratch.drop(now)
        now = after
        if now.where("changed").isEmpty():
            break
    return now.select("model", "pid", "size")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, kind, scope, param, old, new): rules added (+), removed (-) and parameters changed (~); the last of equal keys counts."""
    last = lambda d, x: d.groupBy("kind", F.array_join(F.array_sort("scope"), ",").alias("scope")).agg(F.max_by("params", "ord").alias(x))
    both = last(old, "a").join(last(new, "b"), ["kind", "scope"], "full_outer")
    op = F.when(F.col("a").isNull(), "+").when(F.col("b").isNull(), "-").otherwise("~")
    zipped = F.map_zip_with(F.coalesce("a", F.expr("cast(map() as map<string,double>)")), F.coalesce("b", F.expr("cast(map() as map<string,double>)")), lambda k, x, y: F.struct(x.alias("old"), y.alias("new")))
    rows = both.select(op.alias("op"), "kind", "scope", F.explode(zipped).alias("param", "v"))
    return rows.where("op <> '~' or not (v.old <=> v.new)").select("op", "kind", "scope", "param", "v.old", "v.new")


def fingerprint(rules: DataFrame) -> DataFrame:
    """One row: a digest of the rules that does not depend on row order or on the order of parameters."""
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    line = F.concat_ws("|", F.format_string("%06d", "ord"), "kind", entries, F.array_join(F.array_sort("scope"), ","))
    return rules.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256), 1, 16).alias("fingerprint"))


def to_json(rules: DataFrame, by: list[str]) -> DataFrame:
    """(by, spec): the rules of each specification as a JSON list in their order; a specification has a handful of rules."""
    row = F.struct("ord", "kind", "params", "scope")
    return rules.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), F.to_json(row).alias("rule"))))["rule"]).alias("spec"))


def from_json(specs: DataFrame, by: list[str]) -> DataFrame:
    """(by, ord, kind, params, scope): the rules back from to_json; text that is no such list gives no rules."""
    texts = F.explode(F.from_json("spec", "array<string>"))
    rule = "struct<ord:int,kind:string,params:map<string,double>,scope:array<string>>"
    return specs.select(*by, texts.alias("rule")).select(*by, F.from_json("rule", rule).alias("r")).where("r.kind is not null").select(*by, "r.*")


#: Points of a mesh are cut into cells, halved along each axis from level to level, DEPTH levels at most; cells with so few
#: points, or so few sources that may be the least, are not cut any more.
DEPTH, FEW_POINTS, FEW_SOURCES = 30, 8, 16


def size_at(points: DataFrame, sources: DataFrame, base_size: float, scratch: Scratch | None = None) -> DataFrame:
    """points(mesh_id, point, x, y, z) with the ramped size: over sources (mesh_id, x, y, z, h, ramp) the least of
    h + (base - h) clip(distance / ramp, 0, 1), and at most the base.

    Cells of points go down a tree with the sources that may be the least somewhere in them: a source leaves when the least
    that it can ask for in the box around a cell's points is above what another asks for at most, or is the base. So a cell
    holds the sources around it, however many a ramp reaches, and rows grow with points and sources. Points at one place,
    and equal sources, are looked at once. Sources of the base size or more, or without a ramp, ask for nothing; points
    without coordinates or sources get the base; sources without coordinates reach nobody.
    """
    scratch = scratch or Scratch(points.sparkSession)
    xyz, base = list("xyz"), F.lit(float(base_size))
    known = F.expr(" and ".join(f"abs({c}) < double('infinity')" for c in xyz))
    place = ["mesh_id", *xyz]
    s = sources.where((F.col("ramp") > 0) & ~F.isnan("ramp") & (F.col("h") < base)).where(known)
    s = s.select("mesh_id", *(F.col(c).cast("double").alias("s" + c) for c in xyz), "h", "ramp").distinct()
    p = points.where(known).select("mesh_id", *(F.col(c).cast("double").alias(c) for c in xyz)).distinct()
    frame = written(p.groupBy("mesh_id").agg(*(f(c).alias(n + c) for n, f in (("g", F.min), ("w", F.max)) for c in xyz)))  # a row a mesh
    last = 2**DEPTH - 1
    at = lambda c: F.when(F.col("w" + c) > F.col("g" + c), F.floor((F.col(c) / 2 - F.col("g" + c) / 2) / (F.col("w" + c) / 2 - F.col("g" + c) / 2) * last)).otherwise(0)
    p = scratch.cut(p.join(frame, "mesh_id").select(*place, *(F.least(F.greatest(at(c), F.lit(0)), F.lit(last)).cast("long").alias("i" + c) for c in xyz)))
    cell = ["mesh_id", *("c" + c for c in xyz)]

    def cells(level: int) -> DataFrame:
        return p.select(*place, *(F.shiftright("i" + c, DEPTH - level).alias("c" + c) for c in xyz))

    def asked(d: Column) -> Column:
        return F.col("h") + (base - F.col("h")) * F.least(F.lit(1.0), d / F.col("ramp"))

    gap = lambda c: F.greatest(F.col("low" + c) - F.col("s" + c), F.col("s" + c) - F.col("high" + c), F.lit(0.0))
    reach = lambda c: F.greatest(F.abs(F.col("s" + c) - F.col("low" + c)), F.abs(F.col("s" + c) - F.col("high" + c)))
    slack = (F.abs(base) + F.abs("h")) * 1e-12  # more than rounding makes of a bound
    near, now = None, s
    for level in range(DEPTH + 1):
        boxes = cells(level).groupBy(*cell).agg(*(f(c).alias(n + c) for n, f in (("low", F.min), ("high", F.max)) for c in xyz), F.count("*").alias("n"))
        if level:
            boxes = boxes.select("*", *(F.shiftright("c" + c, 1).alias("u" + c) for c in xyz))
            boxes = boxes.join(now.drop("n", "least", "met").withColumnsRenamed({"c" + c: "u" + c for c in xyz}), ["mesh_id", *("u" + c for c in xyz)]).drop(*("u" + c for c in xyz))
        else:
            boxes = boxes.join(now, "mesh_id")
        met = boxes.withColumns({"from": asked(G.norm(tuple(gap(c) for c in xyz))) - slack, "to": asked(G.norm(tuple(reach(c) for c in xyz))) + slack})
        met = scratch.cut(met.where(F.col("from") < base).select(*cell, "n", *("s" + c for c in xyz), "h", "ramp", "from", "to"))
        bounds = scratch.cut(met.groupBy(*cell).agg(F.min("to").alias("least"), F.count("*").alias("met")))
        kept = met.join(bounds, cell).where(F.col("from") <= F.col("least")).drop("from", "to")
        closed = (F.col("n") <= FEW_POINTS) | (F.col("met") <= FEW_SOURCES) if level < DEPTH else F.lit(True)
        d = G.norm(tuple(F.col(c) - F.col("s" + c) for c in xyz))
        found = cells(level).join(kept.where(closed), cell).groupBy(*place).agg(F.min(asked(d)).alias("near"))
        near = found if near is None else near.unionByName(found)
        now = kept.where(~closed)
        if now.isEmpty():
            break
    own = points.select("mesh_id", "point", *(F.col(c).cast("double").alias(c) for c in xyz)).join(scratch.cut(near), place)
    own = own.groupBy("mesh_id", "point").agg(F.min("near").alias("near"))
    return points.join(own, ["mesh_id", "point"], "left").withColumn("size", F.coalesce(F.least("near", base), base)).drop("near")
