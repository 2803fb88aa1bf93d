"""Entities, size fields, policy, loop, records, sources and the stream."""

import json
import math

import pytest
from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.operators import audit, entities, loop, mesh, policy, records, sizefield, verdict
from facetwise.sources import meshes
from facetwise.sources import records as src
from facetwise.streaming import runs


# ---- entities ----

BOX = "model string, pid string, tag long, fp string, dim int, mass double, xlo double, ylo double, zlo double, xhi double, yhi double, zhi double"


def box(tag, lo, hi, mass=None, fp=None, pid=None):
    size = [h - low for low, h in zip(lo, hi, strict=True)]
    area = mass if mass is not None else max(size[0] * size[1], size[1] * size[2], size[0] * size[2])
    return ("m", pid or f"p{tag}", tag, fp or f"{lo}{hi}{round(area, 3)}", 2, float(area), *map(float, lo), *map(float, hi))


def matched(spark, old, new, scale=76.0):
    frames = spark.createDataFrame([("m", scale)], "model string, scale double")
    got = entities.match_snapshots(spark.createDataFrame(old, BOX), spark.createDataFrame(new, BOX).drop("pid"), frames).collect()
    return sorted((r["relation"], tuple(r["new_tags"]), tuple(r["old_pids"]), round(r["mass_ratio"], 6)) for r in got)


def test_reimport_is_same(spark):
    old = [box(k, (k * 10, 0, 0), (k * 10 + 5, 5, 0)) for k in range(3)]
    assert [r for r, *_ in matched(spark, old, [box(100 + k, (k * 10, 0, 0), (k * 10 + 5, 5, 0)) for k in range(3)])] == ["same"] * 3


def test_merge_of_coincident_faces(spark):
    old = [box(1, (30, 0, 0), (30, 30, 20), fp="a"), box(2, (30, 0, 0), (30, 30, 20), fp="b")]
    assert matched(spark, old, [box(9, (30, 0, 0), (30, 30, 20), fp="a")]) == [("merge", (9,), ("p1", "p2"), 0.5)]
    assert [r for r, *_ in matched(spark, old, [box(9, (30, 0, 0), (30, 30, 20), fp="a"), box(8, (30, 0, 0), (30, 30, 20), fp="b")])] == ["same", "same"]


def test_split_created_deleted_and_lossy(spark):
    old = [box(1, (0, 0, 0), (30, 30, 0))]
    assert matched(spark, old, [box(5, (0, 0, 0), (10, 30, 0)), box(6, (10, 0, 0), (30, 30, 0))]) == [("split", (5, 6), ("p1",), 1.0)]
    assert matched(spark, old, [box(7, (0, 0, 0), (30, 15, 0))]) == [("same", (7,), ("p1",), 0.5)]
    far = matched(spark, old, [box(77, (500, 0, 0), (510, 5, 0))])
    assert [r for r, *_ in far] == ["created", "deleted"]
    assert matched(spark, [box(1, (0, 0, 0), (10, 10, 0)), box(2, (10, 0, 0), (30, 10, 0))], [box(3, (0, 0, 0), (30, 10, 0))])[0][:3] == ("merge", (3,), ("p1", "p2"))


def test_register_and_provenance(spark):
    cols = BOX + ", cx double, cy double, cz double"
    old = spark.createDataFrame([(*box(1, (0, 0, 0), (30, 30, 0), pid="f1", fp="f0"), 0.0, 0.0, 0.0)], cols).withColumns({"alive": F.lit(True)})
    new = spark.createDataFrame([(*box(t, lo, hi, fp=fp), float(t), 0.0, 0.0) for t, lo, hi, fp in ((5, (0, 0, 0), (10, 30, 0), "f2"), (6, (10, 0, 0), (30, 30, 0), "f1"))], cols).drop("pid")
    frames = spark.createDataFrame([("m", 76.0)], "model string, scale double")
    now, edges = entities.register(old, new, entities.match_snapshots(old, new, frames), "s2")
    assert {(r["pid"], r["alive"], r["relation"]) for r in now.collect()} == {("f1", False, "created"), ("f2", True, "split"), ("f1~1", True, "split")}
    below = entities.descendants(edges.select("parent", "child"), now.where("alive").select("pid"))
    assert {tuple(r) for r in below.where("node = 'f1'").collect()} == {("f1", "f2"), ("f1", "f1~1")}


def test_fingerprint_and_pids(spark):
    schema = "tag long, dim int, mass double, cx double, cy double, cz double, xlo double, ylo double, zlo double, xhi double, yhi double, zhi double, n_boundary int, curvature_sig array<double>, normal_sig array<double>"
    row = lambda tag, n, x=0.0: (tag, 2, 100.0, x, 0.0, 0.0, x, 0.0, 0.0, x + 10, 10.0, 0.0, 4, [0.1], n)
    df = spark.createDataFrame([row(1, [0.0, 0.0, 1.0]), row(2, [0.0, 0.0, 1.0]), row(3, [0.0, 0.0, -1.0]), row(4, [0.0, 0.0, 1.0], 0.5)], schema)
    df = df.withColumn("fp", entities.fingerprint((F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(20.0)))).withColumn("model", F.lit("m"))
    got = {r["tag"]: r["pid"] for r in entities.new_pids(entities.canonical_order(df, ["model"]), ["model"]).collect()}
    assert got[2] == got[1] + "~1" and len(set(got.values())) == 4 and len(got[1]) == 16
    frame = entities.model_frame(df).first()
    assert (frame["ox"], frame["scale"]) == (0.0, pytest.approx(math.hypot(10.5, 10)))


# ---- size fields ----

FACES = [("m", "a", 100.0, 0.0, None), ("m", "b", 100.0, 0.1, None), ("m", "c", 100.0, 0.0, 0.9)]


def faces(spark):
    return spark.createDataFrame(FACES, "model string, pid string, area double, curvature_max double, thickness double")


def test_resolve(spark):
    rules = [sizefield.base(2.0), sizefield.curvature(0.01, 5.0), sizefield.thickness(3), sizefield.feature(0.5, ["c"]), sizefield.clamp(0.35, 1.5)]
    got = {r["pid"]: r["size"] for r in sizefield.resolve(faces(spark), rules).collect()}
    assert got["a"] == 1.5 and got["c"] == 0.35 and got["b"] == pytest.approx(min(math.sqrt(8 * 10 * 0.01), 20 * math.sin(math.radians(5))))
    for _, pid, area, k, t in FACES:
        assert loop.face_size({"area": area, "curvature_max": k, "thickness": t}, pid, rules, 1.0) == pytest.approx(got[pid])
    assert sizefield.element_estimate(sizefield.resolve(faces(spark), [sizefield.base(0.5)]), ["pid"]).where("pid = 'a'").first()["estimate"] == round(100 / (math.sqrt(3) / 4 * 0.25))
    assert sizefield.within_budget(sizefield.resolve(faces(spark), [sizefield.base(0.5)]), 10, ["model"]).count() == 0


def test_smoothing(spark):
    f = spark.createDataFrame([("m", "rail", 0.0768, 0.25), ("m", "x", 3.841, 2500.0), ("m", "y", 3.841, 1500.0)], "model string, pid string, size double, area double")
    near = spark.createDataFrame([("m", "rail", "x"), ("m", "x", "rail"), ("m", "x", "y"), ("m", "y", "x")], "model string, pid string, nbr string")
    wide = {r["pid"]: r["size"] for r in sizefield.smooth(f, near, 1.4).collect()}
    assert wide["rail"] == 0.0768 and wide["x"] == pytest.approx(min(3.841, 0.0768 * 1.4 ** (0.5 / 0.0768))) and wide["y"] == 3.841
    hops = {r["pid"]: r["size"] for r in sizefield.smooth(f, near, 1.4, extents=False).collect()}
    assert hops["x"] == pytest.approx(0.0768 * 1.4) and hops["y"] == pytest.approx(0.0768 * 1.4**2)


def test_spec_fingerprint_ignores_order(spark):
    a = sizefield.frame(spark, sizefield.default(10.0))
    assert sizefield.fingerprint(a).first() == sizefield.fingerprint(a.orderBy(F.desc("ord"))).first()
    assert sizefield.fingerprint(a).first() != sizefield.fingerprint(sizefield.frame(spark, sizefield.default(11.0))).first()


# ---- policy and loop ----


def test_optimisation_is_chosen_once_only():
    state = policy.State(scale=100.0)
    first = policy.strategy_actions({"validity.inverted": {}}, state)[0]
    state.history.append(first)
    assert policy.Deterministic().select(policy.strategy_actions({"validity.inverted": {}}, state), state.history) is None


def test_objective_rules():
    state = policy.State(scale=100.0, rules=sizefield.default(100.0), areas={"a": 100.0}, sizes={"a": 5.0}, strategy=policy.Strategy(optimize_passes=3))
    act = lambda name, **d: policy.objective_actions([{"name": name, "detail": d}], {"chordal_relative": ["a"], "shape_min": ["a"], "normal_p99_deg": []}, state)
    assert dict(act("chordal")[0].params)["chordal_tol"] == pytest.approx(0.05) and act("chordal")[0].scope == ("a",)
    assert dict(act("normal_deviation")[0].params)["normal_tol_deg"] == pytest.approx(7.2)
    assert dict(act("gradation")[0].params)["max_growth"] == pytest.approx(1.24)
    assert dict(act("size_in_band", frac_oversized=0.3)[0].params)["h"] == pytest.approx(4.0) and act("size_in_band")[0].kind == "raise_floor"
    assert act("min_shape")[0].kind == "refine_faces"
    state.budget = 1
    assert act("min_shape") == []
    with pytest.raises(ValueError):
        policy.apply(policy.Action("dance"), [], policy.Strategy())
    with pytest.raises(NotImplementedError):
        policy.External().select([], [])


class Scripted:
    """A backend that plays assessments; exceptions are raised."""

    def __init__(self, steps, load_fails=False):
        self.steps, self.loads, self.load_fails = list(steps), 0, load_fails

    def load(self, path, strategy):
        self.loads += 1
        if self.load_fails:
            raise OSError("no such part")

    def scale(self):
        return 100.0

    def faces(self):
        return {"a": {"area": 100.0, "curvature_max": 0.0, "thickness": None}}

    def measure_thickness(self):
        raise RuntimeError("thickness")

    def mesh(self, rules, strategy):
        step = self.steps.pop(0) if len(self.steps) > 1 else self.steps[0]
        if isinstance(step, Exception):
            raise step
        return step


def good(score, ready=False, name="gradation"):
    return loop.Assessment(10, ready, score, {}, [] if ready else [{"name": name}])


def test_loop_outcomes():
    assert loop.run(Scripted([good(0.5), good(1.0, True)]), "p").outcome == "accepted"
    plate = loop.run(Scripted([good(0.5), good(0.8), good(0.801), good(0.8012)]), "p", max_iterations=9)
    assert plate.outcome == "plateau" and plate.best.index == 3
    assert loop.run(Scripted([good(0.5)]), "p", budget=1).outcome == "budget_exhausted"
    assert loop.run(Scripted([good(0.5)], load_fails=True), "p").outcome == "backend_error"
    assert loop.run(Scripted([loop.Assessment(5, failures={"validity.orientation": {}})]), "p").outcome == "escalated"
    assert loop.run(Scripted([good(0.2), good(0.4), good(0.6)]), "p", max_iterations=3).outcome == "max_iterations"
    assert loop.run(Scripted([good(0.5, name="other")]), "p").outcome == "no_action_available"
    r = loop.run(Scripted([RuntimeError("periodic surface"), good(1.0, True)]), "p")
    assert r.outcome == "accepted" and r.iterations[0].action.kind == "switch_algorithm" and "thickness" in r.notes[0]
    empty = loop.run(Scripted([loop.Assessment()]), "p")
    assert empty.iterations[0].codes == ("mesh.empty",) and empty.outcome == "escalated"


class Bound(Scripted):
    """A backend with contracts: the first two meshes violate one."""

    rebuilt = 0

    def rebuild_contracts(self):
        self.rebuilt += 1

    def violations(self, mesh):
        return {"contract.interface_not_conformal": {"pids": ["a"]}} if self.rebuilt < 2 else {}


def test_contracts_fail_a_mesh():
    """A violation is a hard failure, whatever the score; contracts are made anew after the geometry changed."""
    backend = Bound([good(1.0, True), good(1.0, True)])
    r = loop.run(backend, "p", strategy=policy.Strategy(imprint=False))
    assert r.outcome == "accepted" and len(r.iterations) == 2 and backend.rebuilt == 2
    first = r.iterations[0]
    assert first.codes == ("contract.interface_not_conformal",) and first.score == 0 and not first.ready and first.action.kind == "reimprint"
    assert r.elapsed >= sum(i.seconds for i in r.iterations) >= 0
    changed = loop.run(Scripted([good(0.2), good(0.4), good(0.6)]), "p", max_iterations=3)
    assert changed.iterations[0].changes == () and changed.iterations[1].changes == ("~ gradation max_growth: 1.4 to 1.24",)


def test_best_is_not_last():
    r = loop.Run()
    for k, (s, ready) in enumerate([(0.6, False), (0.99, False), (0.8, True), (0.3, False)]):
        r.add(loop.Iteration(k, "", is_valid=True, ready=ready, score=s))
    assert r.best.index == 2


# ---- contracts, audit, records ----


def test_contracts(spark):
    models = spark.createDataFrame([("s", 1, 6, 0.0), ("a", 2, 11, 0.0), ("sh", 0, 3, 4.0), ("u", 0, 0, 0.0)], "model string, n_volumes int, n_faces int, free_edge_length double")
    c = {r["model"]: r for r in verdict.topology_contract(models).collect()}
    assert [c[k]["body_kind"] for k in ("s", "a", "sh", "u")] == ["solid", "assembly", "sheet", "unknown"] and c["sh"]["expected_length"] == 4
    rm = spark.createDataFrame([("rail", 0.25, 4e-5, 100.01), ("patch", 1e-6, 1e-10, 0.004), ("fillet", 45.0, 7e-3, 63.0)], "pid string, area double, area_frac double, perimeter double")
    why = {r["pid"]: r["approved_by"] for r in verdict.approve_removals(rm).collect()}
    assert why == {"rail": "auto: sliver", "patch": "auto: area", "fillet": ""}
    assert verdict.approve_removals(rm, explicit=["fillet"]).where("pid = 'fillet'").first()["approved"]


def test_calibration(spark):
    rows = [("t", 0.01, "real"), ("t", 0.02, "Real "), ("t", 0.08, "false"), ("u", 0.5, "real"), ("u", 0.3, "real"), ("u", 0.4, "false"), ("u", 0.6, "false"), ("u", 0.45, ""), ("v", 1.0, "real")]
    got = {r["threshold_name"]: r for r in audit.fit(spark.createDataFrame(rows, "threshold_name string, measured double, verdict string")).collect()}
    assert got["t"]["separable"] and got["t"]["cut"] == pytest.approx(0.04)
    assert not got["u"]["separable"] and got["u"]["n_overlap"] == 2 and got["v"]["separable"] is None
    assert src.thresholds("[thresholds]\nparam_grid = 9").param_grid == 9
    with pytest.raises(ValueError):
        src.thresholds("[thresholds]\nspeed = 1")


def test_audit(spark):
    v = spark.createDataFrame([], "volume double")
    assert audit.totals(v, 1.0).first()["code"] == "volume.none"
    hits = spark.createDataFrame([("m", 1, 1.0), ("m", 1, 3.0), ("m", 2, 4.0)], "mesh string, tri long, distance double")
    g = audit.thickness_guard(hits, ["mesh"], 1.0).first()
    assert g["median"] == 3 and g["least"] == 2 and g["blocked"]


def test_record_readers(spark, tmp_path):
    it = {"index": 0, "n_triangles": 7, "score": 0.5, "is_valid": True, "ready": False, "failures": [{"code": "x", "count": 1, "message": ""}], "objectives": [{"name": "min_shape", "value": 0.1, "target": 0.3, "satisfied": False, "attainment": 0.3}]}
    run = {"model": "a.step", "outcome": "plateau", "best_index": 0, "elapsed_seconds": 2.0, "iterations": [it]}
    (tmp_path / "1.json").write_text(json.dumps([run, {"findings": []}]))
    (tmp_path / "2.json").write_text(json.dumps({**run, "elapsed_seconds": 9.0}))
    (tmp_path / "3.json").write_text("{not json")
    (tmp_path / "4.json").write_text(json.dumps({"source_path": "/x/part7.step", "findings": [{"code": "face.sliver", "severity": "WARN", "threshold_name": "s", "threshold": 0.05, "measured": 0.04}]}))
    r = src.run_records(spark, str(tmp_path))
    assert [(x["model"], x["elapsed_seconds"]) for x in r.collect()] == [("a.step", 2.0)]
    agg = records.aggregate(r)
    assert agg["failures"].first() == ("x", 1) and agg["missed"].first() == ("min_shape", 1) and agg["parts"].first()["best_triangles"] == 7
    assert src.findings(spark, str(tmp_path)).first()["part"] == "part7"
    ok = spark.createDataFrame([("A/b.STEP",), ("x.stl",), ("y.sldprt",), ("z",)], "p string").select(src.format_verdict(F.col("p"))).collect()
    assert [x[0].split(":")[0] for x in ok] == ["ok", "mesh", "native", "unknown format"]
    (tmp_path / "cad").mkdir()
    (tmp_path / "cad" / "p.step").write_text("x")
    assert src.discover(spark, str(tmp_path / "cad")).count() == 1
    with pytest.raises(src.UnsupportedKernel):
        src.import_cad("p.step")


def test_record_files_grow_with_bytes(spark):
    from facetwise.plans import source_queries
    from facetwise.scratch import Scratch

    runs = spark.range(600).selectExpr("concat('p', id) as name", "concat('/parts/p', id, '.step') as model", "if(id % 2 = 0, 'accepted', 'plateau') as outcome", "array(named_struct('index', 0, 'score', id / 2)) as iterations")
    path = source_queries._files(runs, "name", Scratch(spark), file_bytes=20_000)
    got = src.run_records(spark, path, "*.txt")
    assert {(r["model"], r["outcome"], r["iterations"][0]["score"]) for r in got.collect()} == {(f"/parts/p{k}.step", "plateau" if k % 2 else "accepted", k / 2) for k in range(600)}
    files = spark.read.format("binaryFile").load(path.removeprefix("file://")).select("length").collect()
    assert 2 <= len(files) <= 10 and max(r["length"] for r in files) < 60_000  # not a file a record
    assert src.run_records(spark, source_queries._files(runs.limit(0), "name", Scratch(spark)), "*.txt").count() == 0


def test_findings_of_a_large_part(spark, monkeypatch):
    """A part's findings are dealt to reports, and reports to files, of a bounded size."""
    from facetwise.plans import source_queries

    found = spark.range(3000).selectExpr("if(id < 2900, 'big', 'small') as part", "'face.sliver' as code", "'WARN' as severity", "id as tag", "id / 2 as measured")
    monkeypatch.setattr(source_queries, "_found", lambda spark, sf_dir: found)
    sizes, files = [], source_queries._files
    monkeypatch.setattr(source_queries, "_files", lambda df, *more: sizes.extend(r[0] for r in df.select(F.size("findings")).collect()) or files(df, *more))
    got = source_queries.finding_files(spark, "").collect()
    assert sorted((r["tag"], r["part"], r["measured"]) for r in got) == [(k, "big" if k < 2900 else "small", k / 2) for k in range(3000)]
    assert sum(sizes) == 3000 and max(sizes) < 2 * source_queries.REPORT_ROWS


def test_sheet_in_parts(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, 'yes', '') as borderline", "concat('p', lpad(pmod(id * 7919, 40000), 5, '0')) as part", "'c' as code", "'t' as threshold_name", "0.05D as threshold", "id / 4 as measured")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    try:
        for k in before:
            spark.conf.set(k, "10k")
        src.write_sheet(rows, str(tmp_path / "s"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    parts = sorted((tmp_path / "s").glob("part-*"))
    lines = [line for p in parts for line in p.read_text().splitlines()[1:]]
    assert len(parts) > 1 and len({p.read_text().split("\n")[0] for p in parts}) == 1  # no task holds the sheet
    assert [(x.split(",")[0] != "yes", x.split(",")[1]) for x in lines] == sorted((k % 2 == 1, f"p{k * 7919 % 40000:05d}") for k in range(40_000))
    assert src.read_sheet(spark, str(tmp_path / "s")).count() == 40_000


def test_sheet_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("", "p", "c", "t", 0.05, 0.2), ("yes", "q", "c", "t", 0.05, 0.06)], "borderline string, part string, code string, threshold_name string, threshold double, measured double")
    src.write_sheet(rows, str(tmp_path / "s"))
    assert [r["part"] for r in src.read_sheet(spark, str(tmp_path / "s")).collect()] == ["q", "p"]


def test_msh_round_trip(spark, tmp_path):
    tri = spark.createDataFrame([(0, 10, 11, 12, "faceB"), (1, 10, 12, 13, "faceA")], "tri long, v0 long, v1 long, v2 long, pid string")
    vert = spark.createDataFrame([(10, 0.0, 0.0, 0.0), (11, 1.0, 0.0, 0.0), (12, 1.0, 1.0, 0.0), (13, 0.0, 1.0, 0.1)], "v long, x double, y double, z double")
    assert meshes.write_msh(tri, vert, str(tmp_path / "m")) == {1: "faceA", 2: "faceB"}
    back = meshes.read_msh(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in back["groups"].collect()} == {(1, "faceA"), (2, "faceB")}
    assert sorted(tuple(r) for r in back["triangles"].collect()) == [(1, 2, 1, 2, 3), (2, 1, 1, 3, 4)]
    assert back["nodes"].where("v = 4").first()["z"] == 0.1
    own = mesh.corners(tri.withColumn("mesh_id", F.lit("m")), vert.withColumn("mesh_id", F.lit("m")))
    meshes.write_stl(own, str(tmp_path / "s"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "s")).collect())
    assert text.startswith("solid mesh") and text.count("facet normal") == 2
    assert len(meshes.export({"outcome": "accepted"}, tri, vert, own, str(tmp_path / "out"), "part")) == 4


def test_stream(spark, tmp_path):
    rows = [{"run": 1, "idx": k, "ts": f"2024-01-01T0{k}:10:00", "score": s, "code": "x", "is_valid": v, "ready": False} for k, (s, v) in enumerate([(0.2, True), (0.9, False), (0.5, True)])]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = runs.best_so_far(runs.stream(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("best").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select run, idx, score from best").collect()] == [(1, 2, 0.5)]
    w = runs.code_counts(runs.stream(spark, str(tmp_path)), late="30 minutes").writeStream.outputMode("append").format("memory").queryName("codes").start()
    w.processAllAvailable()
    w.stop()
    assert spark.sql("select count(*) from codes").first()[0] == 1  # the only window that has closed


def test_geometry_guard(spark):
    assert spark.range(1).select(G.guarded(F.lit(1.0), F.lit(0.0), 7.0)).first()[0] == 7.0


def test_closure_of_deep_and_wide_graphs(spark):
    """A chain of 1,000, stacked diamonds with very many paths, a cycle, and no edges."""
    pairs = lambda edges, up=False: entities.closure(spark.createDataFrame(edges, "parent long, child long"), up=up)
    chain = pairs([(k, k + 1) for k in range(1000)])
    assert chain.count() == 1000 * 1001 // 2 and chain.where("reached <= node").count() == 0
    diamonds = [e for k in range(25) for e in ((3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 3), (3 * k + 2, 3 * k + 3))]
    assert pairs(diamonds).where("node = 0").count() == 75 and pairs(diamonds, up=True).where("node = 75").count() == 75
    assert sorted(map(tuple, pairs([(1, 2), (2, 3), (3, 1)]).collect())) == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]
    assert pairs([]).count() == 0
