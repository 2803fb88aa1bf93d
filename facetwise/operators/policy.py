"""From evidence to actions: a table of rules, ranked candidates, and the choice among them.

Rules are data (RULES); the state of a run (strategy, history, specification) is a small driver-side object.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetwise.operators import sizefield

#: Actions, the order of meshing algorithms, and the ceiling of the healing tolerance.
STRATEGY_KINDS = ("reimprint", "tighten_tolerance", "enable_healing", "increase_heal_tolerance", "increase_optimization", "switch_algorithm", "escalate")
ALGORITHMS = ("frontal", "delaunay", "meshadapt")
MAX_HEAL_FRAC = 1e-2


@dataclass(frozen=True)
class Strategy:
    """How a model is loaded and meshed unless the policy says otherwise."""

    algorithm: str = "default"
    imprint: bool = True
    heal: bool = False
    heal_tolerance_frac: float = 1e-4
    geometry_tolerance: float | None = None
    optimize_passes: int = 1
    smooth_passes: int = 1


@dataclass(frozen=True)
class Action:
    kind: str
    params: tuple[tuple[str, object], ...] = ()
    scope: tuple[str, ...] = ()
    priority: int = 50
    evidence: str = ""

    @property
    def key(self) -> tuple:
        return self.kind, tuple(sorted(self.scope)), tuple(sorted(self.params))

    @property
    def is_strategy(self) -> bool:
        return self.kind in STRATEGY_KINDS

    @property
    def is_terminal(self) -> bool:
        return self.kind == "escalate"

    def describe(self) -> str:
        args = ", ".join(f"{k}={v:.4g}" if isinstance(v, float) else f"{k}={v}" for k, v in self.params)
        return f"{self.kind}({args})" + (f" on {len(self.scope)} faces" if self.scope else "")


@dataclass
class State:
    """What the rules read."""

    strategy: Strategy = field(default_factory=Strategy)
    rules: list[tuple] = field(default_factory=list)
    history: list[Action] = field(default_factory=list)
    scale: float = 1.0
    areas: dict[str, float] = field(default_factory=dict)
    sizes: dict[str, float] = field(default_factory=dict)
    budget: int = 250_000

    def tried(self, kind: str) -> int:
        return sum(a.kind == kind for a in self.history)

    def param(self, kind: str, name: str, otherwise: float) -> float:
        return next((float(p[name]) for k, p, s in self.rules if k == kind and not s), otherwise)

    def next_algorithm(self) -> str | None:
        used = {self.strategy.algorithm, *(dict(a.params).get("algorithm") for a in self.history if a.kind == "switch_algorithm")}
        return next((x for x in ALGORITHMS if x not in used), None)


def _make(kind: str, priority: int, scope=(), evidence: str = "", **params) -> Action:
    return Action(kind, tuple(sorted(params.items())), tuple(scope), priority, evidence)


def _tolerance(s: State, factor: float) -> float:
    return (s.strategy.geometry_tolerance or 1e-4 * s.scale) * factor


#: Triggers in order; each has the codes that pull it, and steps (condition, action) of which the first that holds acts.
#: The message of a mesher's failure picks between the three mesher triggers.
RULES: list[tuple[tuple[str, ...], str | None, list[tuple]]] = [
    (("validity.nonmanifold", "validity.duplicate_nodes"), None, [
        (lambda s: not s.strategy.imprint, lambda s: _make("reimprint", 0)),
        (lambda s: s.tried("tighten_tolerance") < 2, lambda s: _make("tighten_tolerance", 1, tolerance=_tolerance(s, 0.1))),
    ]),
    (("validity.degenerate_shape",), None, [
        (lambda s: not s.strategy.heal, lambda s: _make("enable_healing", 0)),
        (lambda s: s.strategy.heal_tolerance_frac * 10 <= MAX_HEAL_FRAC, lambda s: _make("increase_heal_tolerance", 1, heal_tolerance_frac=s.strategy.heal_tolerance_frac * 10)),
        (lambda s: True, lambda s: _make("escalate", 90)),
    ]),
    (("validity.inverted",), None, [
        (lambda s: s.strategy.optimize_passes < 3, lambda s: _make("increase_optimization", 2)),
        (lambda s: s.next_algorithm(), lambda s: _make("switch_algorithm", 3, algorithm=s.next_algorithm())),
    ]),
    (("mesher.failed",), "periodic surface", [
        (lambda s: s.strategy.algorithm != "meshadapt", lambda s: _make("switch_algorithm", 0, algorithm="meshadapt")),
        (lambda s: not s.strategy.heal, lambda s: _make("enable_healing", 1)),
        (lambda s: True, lambda s: _make("escalate", 94)),
    ]),
    (("mesher.failed",), "closed loop|1d mesh", [
        (lambda s: not s.strategy.heal, lambda s: _make("enable_healing", 0)),
        (lambda s: s.tried("tighten_tolerance") < 2, lambda s: _make("tighten_tolerance", 1, tolerance=_tolerance(s, 10.0))),
        (lambda s: True, lambda s: _make("escalate", 94)),
    ]),
    (("mesher.failed",), "", [
        (lambda s: s.next_algorithm(), lambda s: _make("switch_algorithm", 2, algorithm=s.next_algorithm())),
        (lambda s: True, lambda s: _make("escalate", 95)),
    ]),
    (("validity.orientation", "validity.not_watertight"), None, [(lambda s: True, lambda s: _make("escalate", 95))]),
    (("contract.missing_face",), None, [(lambda s: True, lambda s: _make("escalate", 92))]),
    (("contract.unapproved_removal",), None, [(lambda s: True, lambda s: _make("escalate", 91))]),
    (("contract.interface_not_conformal",), None, [(lambda s: True, lambda s: _make("reimprint", 1))]),
    *[
        ((c,), None, [(lambda s: True, lambda s: _make("escalate", 93))])
        for c in ("contract.unexpected_boundary", "contract.boundary_mismatch", "contract.nonmanifold_skin", "contract.inconsistent_orientation")
    ],
]


def strategy_actions(failures: dict[str, dict], state: State) -> list[Action]:
    """Actions for hard failures; failures maps a code to its detail (pids, exception)."""
    out = []
    said = str(failures.get("mesher.failed", {}).get("exception", "")).lower()
    spoken = next((m for _, m, _ in RULES if m and any(x in said for x in m.split("|"))), "")
    for codes, message, steps in RULES:
        pulled = next((c for c in codes if c in failures), None)
        if pulled is None or (message is not None and message != spoken):
            continue
        if pulled == "contract.missing_face" and (lost := tuple(failures[pulled].get("pids", ()))[:5]):
            out.append(_make("refine_faces", 4, lost, pulled, h=state.scale * 1e-3))
        act = next((make for test, make in steps if test(state)), None)
        if act:
            out.append(replace(act(state), evidence=pulled))
    return sorted(out or [_make("escalate", 99, evidence=",".join(sorted(failures)))], key=lambda a: a.priority)


def estimate(sizes: dict[str, float], areas: dict[str, float]) -> int:
    """Elements that sizes imply on areas; the driver-side twin of the size field's estimate, for a handful of faces."""
    return round(sum(areas[p] / (3**0.5 / 4 * h * h) for p, h in sizes.items() if 0 < h < float("inf") and areas.get(p, 0) > 0))


def _affordable(state: State, scope: tuple[str, ...], h: float, action: Action) -> list[Action]:
    """The action, unless the sizes it implies are over the budget."""
    return [action] if estimate({**state.sizes, **dict.fromkeys(scope, h)}, state.areas) <= state.budget else []


def objective_actions(unsatisfied: list[dict], worst: dict[str, list[str]], state: State) -> list[Action]:
    """Actions for missed objectives (dicts with name and detail, worst attainment first); worst maps a metric to faces."""
    out: list[Action] = []
    for rank, o in enumerate(unsatisfied):
        name, at = o["name"], 10 + rank
        if name in ("chordal", "normal_deviation"):
            chord, normal = state.param("curvature", "chordal_tol", 0.02 * state.scale), state.param("curvature", "normal_tol_deg", 12.0)
            chord, normal = (chord * 0.5, normal) if name == "chordal" else (chord, max(normal * 0.6, 1.0))
            faces = worst.get("chordal_relative" if name == "chordal" else "normal_p99_deg", [])[:5]
            out.append(_make("tighten_curvature", at, faces, name, chordal_tol=chord, normal_tol_deg=normal))
        elif name == "gradation":
            g = state.param("gradation", "max_growth", 1.4)
            out.append(_make("tighten_gradation", at, (), name, max_growth=max(1.05, 1 + (g - 1) * 0.6)))
        elif name in ("min_shape", "min_angle", "max_angle"):
            faces = tuple(worst.get("shape_min", [])[:5])
            if state.strategy.optimize_passes < 3:
                out.append(_make("increase_optimization", at, (), name))
            if state.tried("refine_faces"):
                h = state.param("base", "h", 0.05 * state.scale) * 0.7
                out += _affordable(state, tuple(state.areas), h, _make("refine_global", at, (), name, h=h))
            if faces:
                h = min(state.sizes.get(p, state.scale) for p in faces) * 0.6
                out += _affordable(state, faces, h, _make("refine_faces", at + 1, faces, name, h=h))
        elif name == "size_in_band":
            d = o.get("detail") or {}
            if d.get("frac_oversized", 0) > d.get("frac_undersized", 0):
                out.append(_make("coarsen_global", at, (), name, h=state.param("base", "h", 0.05 * state.scale) * 0.8))
            else:
                out.append(_make("raise_floor", at, (), name, h_min=state.param("clamp", "h_min", 0.001 * state.scale) * 2))
    return sorted(out, key=lambda a: a.priority)


def propose(failures: dict[str, dict], unsatisfied: list[dict], worst: dict[str, list[str]], state: State) -> list[Action]:
    """Hard failures first: a mesh that is not valid gets strategy actions only."""
    return strategy_actions(failures, state) if failures else objective_actions(unsatisfied, worst, state)


def choose(candidates: DataFrame, history: DataFrame, by: list[str]) -> DataFrame:
    """Of candidates(by, kind, scope, params, priority, place) the first by priority that history(by, kind, scope, params) does
    not hold, one row a group; groups whose candidates were all applied have none."""
    key = [*by, "kind", "scope", "params"]
    new = candidates.join(history.select(*key).distinct(), key, "left_anti")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("priority", "place", "kind"))
    return new.withColumn("r", rank).where("r = 1").drop("r")


class Selector:
    """Chooses among candidates; a subclass may ask anyone, but only among them."""

    name = "selector"

    def select(self, candidates: list[Action], history: list[Action]) -> Action | None:
        raise NotImplementedError


class Deterministic(Selector):
    """The first by priority that was not applied before."""

    name = "deterministic"

    def select(self, candidates, history):
        seen = {a.key for a in history}
        return next((a for a in sorted(candidates, key=lambda a: a.priority) if a.key not in seen), None)


class External(Selector):
    """The seam for a chooser outside; there is none here."""

    name = "external"

    def select(self, candidates, history):
        raise NotImplementedError("no external chooser is connected")


def apply(action: Action, rules: list[tuple], strategy: Strategy) -> tuple[list[tuple], Strategy]:
    """The specification and strategy after an action. Neither argument changes; an unknown kind is an error."""
    p, scope = dict(action.params), list(action.scope)

    def put(rule: tuple) -> list[tuple]:
        """rules with the rule of the same kind and scope replaced, or with it added."""
        at = next((k for k, (kind, _, s) in enumerate(rules) if kind == rule[0] and list(s) == list(rule[2])), None)
        return [*rules, rule] if at is None else [*rules[:at], rule, *rules[at + 1 :]]

    if action.kind == "reimprint":
        return rules, replace(strategy, imprint=True)
    if action.kind == "tighten_tolerance":
        return rules, replace(strategy, geometry_tolerance=p["tolerance"])
    if action.kind == "enable_healing":
        return rules, replace(strategy, heal=True)
    if action.kind == "increase_heal_tolerance":
        return rules, replace(strategy, heal=True, heal_tolerance_frac=p["heal_tolerance_frac"])
    if action.kind == "increase_optimization":
        return rules, replace(strategy, optimize_passes=strategy.optimize_passes + 1, smooth_passes=strategy.smooth_passes + 1)
    if action.kind == "switch_algorithm":
        return rules, replace(strategy, algorithm=p["algorithm"])
    if action.kind == "refine_faces":
        return [*rules, sizefield.feature(p["h"], scope)], strategy
    if action.kind in ("refine_global", "coarsen_global"):
        return put(sizefield.base(p["h"])), strategy
    if action.kind == "tighten_curvature":
        turn = next((q.get("min_per_2pi", 12.0) for k, q, s in rules if k == "curvature"), 12.0)
        return put(sizefield.curvature(p["chordal_tol"], p["normal_tol_deg"], turn, scope)), strategy
    if action.kind == "tighten_gradation":
        return put(sizefield.gradation(p["max_growth"])), strategy
    if action.kind == "raise_floor":
        high = next((q["h_max"] for k, q, s in rules if k == "clamp" and not s), p["h_min"] * 100)
        return put(sizefield.clamp(p["h_min"], high)), strategy
    if action.kind == "escalate":
        return rules, strategy
    raise ValueError(f"no such action: {action.kind}")
