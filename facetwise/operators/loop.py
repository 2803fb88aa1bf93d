"""The adaptive loop: mesh, assess, choose an action, repeat. A driver program; each assessment is a Spark job.

A backend has load(path, strategy), faces() -> {pid: {area, curvature_max, thickness}}, scale(), mesh(rules, strategy)
-> Assessment. Optional: measure_thickness(); rebuild_contracts(), called whenever the geometry was loaded, and
violations(mesh) -> {code: detail} of the contracts, which are hard failures of a mesh.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field
from typing import Protocol

from facetwise.operators import policy
from facetwise.operators.entities import spec_digest

OUTCOMES = ("accepted", "plateau", "budget_exhausted", "no_action_available", "escalated", "oscillation_detected", "max_iterations", "backend_error")


@dataclass
class Assessment:
    """What a mesh was found to be; failures map a code to its detail."""

    n_triangles: int = 0
    ready: bool = False
    score: float = 0.0
    failures: dict[str, dict] = field(default_factory=dict)
    unsatisfied: list[dict] = field(default_factory=list)
    worst: dict[str, list[str]] = field(default_factory=dict)
    mesh: object = None

    @property
    def is_valid(self) -> bool:
        return not self.failures


class Backend(Protocol):
    def load(self, path: str, strategy: policy.Strategy) -> None: ...
    def scale(self) -> float: ...
    def faces(self) -> dict[str, dict]: ...
    def mesh(self, rules: list[tuple], strategy: policy.Strategy) -> Assessment: ...


@dataclass
class Iteration:
    index: int
    fingerprint: str
    estimate: int = 0
    n_triangles: int = 0
    is_valid: bool = False
    ready: bool = False
    score: float = 0.0
    codes: tuple[str, ...] = ()
    action: policy.Action | None = None
    over_budget: bool = False
    ineffective: bool = False
    changes: tuple[str, ...] = ()
    seconds: float = 0.0


@dataclass
class Run:
    iterations: list[Iteration] = field(default_factory=list)
    outcome: str = "max_iterations"
    best: Iteration | None = None
    best_mesh: object = None
    notes: list[str] = field(default_factory=list)
    began: float = field(default_factory=time.monotonic)

    @property
    def elapsed(self) -> float:
        """Seconds since the run began."""
        return time.monotonic() - self.began

    def add(self, it: Iteration, mesh: object = None) -> None:
        self.iterations.append(it)
        if it.is_valid and (self.best is None or (it.ready, it.score) > (self.best.ready, self.best.score)):
            self.best, self.best_mesh = it, mesh

    def plateaued(self, window: int = 2, eps: float = 1e-3) -> bool:
        s = [i.score for i in self.iterations]
        return len(s) > window and max(s[-window:]) - s[-window - 1] < eps


def changes(before: list[tuple] | None, after: list[tuple]) -> tuple[str, ...]:
    """What a specification changed against the one before: + and - rules, ~ parameters; nothing for the first."""
    if before is None:
        return ()
    key = lambda rules: {(k, ",".join(sorted(s))): p for k, p, s in rules}
    old, new = key(before), key(after)
    out = [f"+ {k} {s}".rstrip() for k, s in new if (k, s) not in old] + [f"- {k} {s}".rstrip() for k, s in old if (k, s) not in new]
    for k, s in new.keys() & old.keys():
        out += [f"~ {k} {s}".rstrip() + f" {p}: {old[k, s].get(p)} to {v}" for p, v in new[k, s].items() if old[k, s].get(p) != v]
    return tuple(sorted(out))


def face_size(face: dict, pid: str, rules: list[tuple], scale: float) -> float:
    """Resolved size of one face: the scalar twin of sizefield.resolve, for the cost check on the driver."""
    size = next((p["h"] for k, p, s in rules if k == "base" and not s), 0.05 * scale)
    for kind, p, scope in rules:
        if scope and pid not in scope:
            continue
        if kind == "curvature" and (k := face.get("curvature_max") or 0.0) > 0:
            r = 1 / k
            terms = []
            if p["chordal_tol"] > 0:
                terms.append(math.sqrt(8 * r * p["chordal_tol"]))
            if p["normal_tol_deg"] > 0:
                terms.append(2 * r * math.sin(math.radians(min(p["normal_tol_deg"], 90.0))))
            if p["min_per_2pi"] > 0:
                terms.append(2 * math.pi * r / p["min_per_2pi"])
            size = min([size, *terms])
        elif kind == "thickness" and face.get("thickness"):
            size = min(size, face["thickness"] / max(1, int(p["min_elements_through"])))
        elif kind == "feature":
            size = min(size, p["h"])
    c = next((p for k, p, s in rules if k == "clamp" and not s), None)
    return min(max(size, c["h_min"]), c["h_max"]) if c else size


def run(
    backend: Backend, path: str, rules: list[tuple] | None = None, strategy: policy.Strategy | None = None, *,
    selector: policy.Selector | None = None, budget: int = 250_000, max_iterations: int = 8,
) -> Run:
    """Iterate until a mesh is ready, or one of the other outcomes. The best valid mesh is kept."""
    from facetwise.operators import sizefield

    strategy, selector, out = strategy or policy.Strategy(), selector or policy.Deterministic(), Run()

    def load() -> bool:
        try:
            backend.load(path, strategy)
        except Exception as e:  # a backend may fail in any way; the run records it
            out.outcome = "backend_error"
            out.notes.append(f"the model could not be loaded ({type(e).__name__}: {e})")
            return False
        try:  # sizes by thickness are left out without it
            getattr(backend, "measure_thickness", lambda: None)()
        except Exception as e:
            out.notes.append(f"no thickness was measured ({type(e).__name__}: {e})")
        getattr(backend, "rebuild_contracts", lambda: None)()
        return True

    if not load():
        return out
    scale = backend.scale()
    rules = sizefield.default(scale) if rules is None else rules
    history: list[policy.Action] = []
    seen: set[str] = set()
    before_rules: list[tuple] | None = None
    for index in range(max_iterations):
        key = spec_digest([*rules, ("strategy", vars(strategy), [])])
        if key in seen:
            out.outcome = "oscillation_detected"
            return out
        seen.add(key)
        faces = backend.faces()
        sizes = {p: face_size(f, p, rules, scale) for p, f in faces.items()}
        areas = {p: float(f.get("area") or 0.0) for p, f in faces.items()}
        it = Iteration(index, key, policy.estimate(sizes, areas), changes=changes(before_rules, rules))
        before_rules, began = rules, time.monotonic()
        if it.estimate > budget:
            it.over_budget = True
            out.add(it)
            out.outcome = "budget_exhausted"
            return out
        try:
            got = backend.mesh(rules, strategy)
            if got.n_triangles == 0 and not got.failures:
                got.failures = {"mesh.empty": {}}
            if got.n_triangles:
                got.failures = {**got.failures, **getattr(backend, "violations", lambda mesh: {})(got.mesh)}
        except Exception as e:  # a failure that the policy can act on
            got = Assessment(failures={"mesher.failed": {"exception": f"{type(e).__name__}: {e}"}})
        it.seconds = time.monotonic() - began
        it.n_triangles, it.is_valid, it.codes = got.n_triangles, got.is_valid, tuple(sorted(got.failures))
        it.ready, it.score = got.ready and got.is_valid, got.score if got.is_valid else 0.0
        before = out.iterations[-1] if out.iterations else None
        it.ineffective = before is not None and 0 < it.n_triangles == before.n_triangles and it.codes == before.codes and abs(it.score - before.score) < 1e-9
        out.add(it, got.mesh)
        if it.ready:
            out.outcome = "accepted"
            return out
        if out.plateaued():
            out.outcome = "plateau"
            return out
        state = policy.State(strategy, rules, history, scale, areas, sizes, budget)
        it.action = selector.select(policy.propose(got.failures, got.unsatisfied, got.worst, state), history)
        if it.action is None:
            out.outcome = "no_action_available"
            return out
        if it.action.is_terminal:
            out.outcome = "escalated"
            return out
        history.append(it.action)
        rules, strategy = policy.apply(it.action, rules, strategy)
        if it.action.is_strategy and it.action.kind != "increase_optimization" and not load():
            return out
    return out
