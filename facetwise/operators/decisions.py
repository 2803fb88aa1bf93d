"""The rules of the policy as Columns, for many runs at once: candidates for failures, for missed objectives, within a budget.

policy.strategy_actions and policy.objective_actions judge one run on the driver; these give the same candidates for tables
of runs, without Python on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.operators.policy import ALGORITHMS, MAX_HEAL_FRAC

#: Faces that an action is scoped to at most.
FACES = 5
_ALWAYS = "true"
_ESCALATE = lambda priority: (_ALWAYS, "escalate", priority, {})
#: Triggers in order. Each has the codes that pull it, what a mesher's message must be about, and steps of which
#: the first whose condition holds acts: condition, kind, priority, numbers that it sets. Conditions and numbers are SQL over
#: the facts of a run.
TRIGGERS = [
    (("validity.nonmanifold", "validity.duplicate_nodes"), None, [("not imprint", "reimprint", 0, {}), ("tightened < 2", "tighten_tolerance", 1, {"tolerance": "tolerance * 0.1D"})]),
    (("validity.degenerate_shape",), None, [
        ("not heal", "enable_healing", 0, {}), (f"heal_tolerance_frac * 10 <= {MAX_HEAL_FRAC}D", "increase_heal_tolerance", 1, {"heal_tolerance_frac": "heal_tolerance_frac * 10"}), _ESCALATE(90),
    ]),
    (("validity.inverted",), None, [("optimize_passes < 3", "increase_optimization", 2, {}), ("next_algorithm is not null", "switch_algorithm", 3, {})]),
    (("mesher.failed",), "periodic", [("algorithm <> 'meshadapt'", "switch_algorithm", 0, {}), ("not heal", "enable_healing", 1, {}), _ESCALATE(94)]),
    (("mesher.failed",), "loop", [("not heal", "enable_healing", 0, {}), ("tightened < 2", "tighten_tolerance", 1, {"tolerance": "tolerance * 10"}), _ESCALATE(94)]),
    (("mesher.failed",), "other", [("next_algorithm is not null", "switch_algorithm", 2, {}), _ESCALATE(95)]),
    (("validity.orientation", "validity.not_watertight"), None, [_ESCALATE(95)]),
    (("contract.missing_face",), None, [_ESCALATE(92)]),
    (("contract.unapproved_removal",), None, [_ESCALATE(91)]),
    (("contract.interface_not_conformal",), None, [(_ALWAYS, "reimprint", 1, {})]),
    *(((c,), None, [_ESCALATE(93)]) for c in ("contract.unexpected_boundary", "contract.boundary_mismatch", "contract.nonmanifold_skin", "contract.inconsistent_orientation")),
]
#: What messages are about, the first that they hold counts.
MESSAGES = (("periodic", ("periodic surface",)), ("loop", ("closed loop", "1d mesh")))


def _action(kind: str, priority: Column, evidence: Column, params: dict[str, Column] | None = None, scope: Column | None = None, algorithm: Column | None = None) -> Column:
    pairs = [x for k, v in sorted((params or {}).items()) for x in (F.lit(k), v.cast("double"))]
    made = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,double>)")
    return F.struct(
        F.lit(kind).alias("kind"), priority.cast("int").alias("priority"), evidence.alias("evidence"), made.alias("params"),
        (F.array().cast("array<string>") if scope is None else scope).alias("scope"), (F.lit(None).cast("string") if algorithm is None else algorithm).alias("algorithm"),
    )


def _facts(evidence: DataFrame) -> DataFrame:
    """evidence with defaults for nulls and absent columns, and what the rules derive from it."""
    defaults = {
        "imprint": F.lit(True), "heal": F.lit(False), "heal_tolerance_frac": F.lit(1e-4), "optimize_passes": F.lit(1), "algorithm": F.lit("default"), "exception": F.lit(""), "scale": F.lit(1.0),
        "history": F.array().cast("array<string>"), "algorithms": F.array().cast("array<string>"), "missing": F.array().cast("array<string>"), "codes": F.array().cast("array<string>"), "geometry_tolerance": None,
    }
    cols = {}
    for name, value in defaults.items():
        if name not in evidence.columns:
            cols[name] = F.lit(None).cast("double") if value is None else value
        elif value is not None:
            given = F.when(~F.isnan(name), F.col(name)) if dict(evidence.dtypes)[name] in ("double", "float") else F.col(name)
            cols[name] = F.coalesce(given, value)
    e = evidence.select("case_id", *(cols[n].alias(n) if n in cols else F.col(n) for n in defaults))
    said = F.lower("exception")
    about = F.lit("other")
    for name, parts in reversed(MESSAGES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | said.contains(p)
        about = F.when(hit, name).otherwise(about)
    left = F.filter(F.array(*map(F.lit, ALGORITHMS)), lambda a: (a != F.col("algorithm")) & ~F.array_contains(F.coalesce("algorithms", F.array().cast("array<string>")), a))
    own = F.coalesce(F.nullif(F.col("geometry_tolerance"), F.lit(0.0)), F.col("scale") * 1e-4)
    return e.withColumns({
        "about": about, "tightened": F.size(F.filter("history", lambda k: k == "tighten_tolerance")), "next_algorithm": F.get(left, F.lit(0)), "tolerance": own,
    })


def strategy_actions(evidence: DataFrame) -> DataFrame:
    """(case_id, place, kind, priority, evidence, params, scope, algorithm): actions for the failures of each case, the best
    first, as policy.strategy_actions has them for one.

    evidence has case_id, codes (array of failure codes) and, where they are known, exception (of the mesher), the
    strategy's imprint, heal, heal_tolerance_frac, geometry_tolerance, optimize_passes and algorithm, history (array of
    kinds applied before), algorithms (switched to before), missing (faces lost) and scale. Nulls and absent columns stand
    for the defaults of a strategy. Cases whose codes pull nothing, or that have none, escalate.
    """
    e = _facts(evidence)
    found = []
    for codes, about, steps in TRIGGERS:
        pulled = F.get(F.filter(F.array(*map(F.lit, codes)), lambda c: F.array_contains(F.col("codes"), c)), F.lit(0))
        on = pulled.isNotNull() if about is None else pulled.isNotNull() & (F.col("about") == about)
        if codes == ("contract.missing_face",):
            refine = _action("refine_faces", F.lit(4), pulled, {"h": F.col("scale") * 1e-3}, F.slice("missing", 1, FACES))
            found.append(F.when(on & (F.size("missing") > 0), refine))
        act = None
        for test, kind, priority, numbers in steps:
            target = F.when(F.col("about") == "periodic", "meshadapt").otherwise(F.col("next_algorithm")) if about == "periodic" else F.col("next_algorithm")
            made = _action(kind, F.lit(priority), pulled, {k: F.expr(v) for k, v in numbers.items()}, algorithm=target if kind == "switch_algorithm" else None)
            act = F.when(F.expr(test), made) if act is None else act.when(F.expr(test), made)
        found.append(F.when(on, act))
    candidates = F.filter(F.array(*found), lambda a: a.isNotNull())
    last = _action("escalate", F.lit(99), F.array_join(F.array_sort("codes"), ","))
    candidates = F.when(F.size(candidates) > 0, candidates).otherwise(F.array(last))
    # Stable: by priority, then by the order of the triggers.
    keyed = F.array_sort(F.transform(candidates, lambda a, k: F.struct(a["priority"].alias("p"), k.alias("k"), F.struct(a["kind"], a["evidence"], F.map_entries(a["params"]), a["scope"], a["algorithm"]).alias("a"))))
    out = e.select("case_id", F.posexplode(keyed).alias("place", "x"))
    a = F.col("x.a")
    return out.select("case_id", "place", a["kind"].alias("kind"), F.col("x.p").alias("priority"), a["evidence"].alias("evidence"), F.map_from_entries(a["col3"]).alias("params"), a["scope"].alias("scope"), a["algorithm"].alias("algorithm"))


#: Metrics of faces by which actions are scoped; of the first two more is worse.
METRICS = ("chordal_relative", "normal_p99_deg", "shape_min")


def worst_scopes(faces: DataFrame) -> DataFrame:
    """(case_id, chordal_relative, normal_p99_deg, shape_min): the FACES worst faces of each case by each metric, worst first;
    NaN and null don't rank. Every task keeps a few rows a case and metric before the shuffle."""
    out = None
    for metric in METRICS:
        down = metric != "shape_min"
        order = (F.desc(metric), F.desc("pid")) if down else (F.asc(metric), F.asc("pid"))
        own = faces.where(F.col(metric).isNotNull() & ~F.isnan(metric)).withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).where(F.col("r") <= FACES)
        own = own.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "pid"))), lambda x: x["pid"]).alias(metric))
        out = own if out is None else out.join(own, "case_id", "full_outer")
    return out


def budgeted(faces: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, h, estimate, affordable): what it takes to mesh each case if the faces in its scope get size h.

    cases has case_id, h, budget and scope (array of pids, FACES at most; null for all faces); faces has case_id, pid, area
    and size. Faces without an area, or with a size that is not positive, take none; a case without faces takes 0.
    """
    met = faces.select("case_id", "pid", "area", "size").join(cases, "case_id", "right")
    size = F.when(F.col("scope").isNull() | F.array_contains("scope", F.col("pid")), F.col("h")).otherwise(F.col("size"))
    count = F.coalesce(F.sum(G.equilateral_count(F.col("area"), size)), F.lit(0.0))
    out = met.groupBy("case_id").agg(F.first("h").alias("h"), F.first("budget").alias("budget"), F.bround(count).cast("long").alias("estimate"))
    return out.select("case_id", "h", "estimate", (F.col("estimate") <= F.col("budget")).alias("affordable"))


def objective_actions(cases: DataFrame, faces: DataFrame) -> DataFrame:
    """(case_id, place, kind, priority, evidence, params, scope): actions for missed objectives, the best first, as
    policy.objective_actions has them for one case.

    cases has case_id, missed (array of objectives by attainment, the worst first: name, frac_oversized, frac_undersized),
    optimize_passes, refined (whether faces were refined before), scale, budget, and the numbers of the specification where
    it has them: chordal_tol, normal_tol_deg, max_growth, h, h_min (null for defaults by scale). faces has case_id, pid,
    area, size and METRICS. Objectives without a rule give no action; cases without missed ones have no rows.
    """
    c = cases.withColumns({
        "chordal_tol": F.coalesce("chordal_tol", F.col("scale") * 0.02), "normal_tol_deg": F.coalesce("normal_tol_deg", F.lit(12.0)), "max_growth": F.coalesce("max_growth", F.lit(1.4)),
        "h": F.coalesce("h", F.col("scale") * 0.05), "h_min": F.coalesce("h_min", F.col("scale") * 0.001),
    })
    scopes = worst_scopes(faces)
    c = c.join(scopes, "case_id", "left")
    least = faces.join(scopes.select("case_id", F.explode("shape_min").alias("pid")), ["case_id", "pid"]).join(cases.select("case_id", "scale"), "case_id")
    least = least.groupBy("case_id").agg((F.min(F.coalesce("size", F.col("scale"))) * 0.6).alias("fine"))
    c = c.join(least, "case_id", "left")
    whole = budgeted(faces, c.select("case_id", (F.col("h") * 0.7).alias("h"), "budget", F.lit(None).cast(scopes.schema["shape_min"].dataType).alias("scope")))
    some = budgeted(faces, c.where("fine is not null").select("case_id", F.col("fine").alias("h"), "budget", F.col("shape_min").alias("scope")))
    c = c.join(whole.select("case_id", F.col("affordable").alias("all_fit")), "case_id", "left").join(some.select("case_id", F.col("affordable").alias("some_fit")), "case_id", "left")
    rows = c.select("*", F.posexplode("missed").alias("turn", "o"))
    name, at = F.col("o.name"), F.col("turn") + 10
    text = lambda scope: F.coalesce(F.transform(scope, lambda x: x.cast("string")), F.array().cast("array<string>"))
    shape = name.isin("min_shape", "min_angle", "max_angle")
    coarse = F.coalesce(F.col("o.frac_oversized") > F.coalesce(F.col("o.frac_undersized"), F.lit(0.0)), F.lit(False))
    found = [
        F.when(name == "chordal", _action("tighten_curvature", at, name, {"chordal_tol": F.col("chordal_tol") * 0.5, "normal_tol_deg": F.col("normal_tol_deg")}, text(F.col("chordal_relative")))),
        F.when(name == "normal_deviation", _action("tighten_curvature", at, name, {"chordal_tol": F.col("chordal_tol"), "normal_tol_deg": F.greatest(F.col("normal_tol_deg") * 0.6, F.lit(1.0))}, text(F.col("normal_p99_deg")))),
        F.when(name == "gradation", _action("tighten_gradation", at, name, {"max_growth": F.greatest(F.lit(1.05), (F.col("max_growth") - 1) * 0.6 + 1)})),
        F.when(shape & (F.col("optimize_passes") < 3), _action("increase_optimization", at, name)),
        F.when(shape & F.col("refined") & F.coalesce("all_fit", F.lit(True)), _action("refine_global", at, name, {"h": F.col("h") * 0.7})),
        F.when(shape & F.coalesce("some_fit", F.lit(False)), _action("refine_faces", at + 1, name, {"h": F.col("fine")}, text(F.col("shape_min")))),
        F.when((name == "size_in_band") & coarse, _action("coarsen_global", at, name, {"h": F.col("h") * 0.8})),
        F.when((name == "size_in_band") & ~coarse, _action("raise_floor", at, name, {"h_min": F.col("h_min") * 2})),
    ]
    each = rows.select("case_id", "turn", F.posexplode(F.array(*found)).alias("step", "a")).where("a is not null")
    order = Window.partitionBy("case_id").orderBy("a.priority", "turn", "step")  # a case has a handful of objectives
    return each.select("case_id", (F.row_number().over(order) - 1).alias("place"), "a.kind", "a.priority", "a.evidence", "a.params", "a.scope")
