"""Closed forms, convergence and invariants of the mesh operators."""

import math

import pytest
from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.functions.surfaces import Cylinder, Plane, Sphere, surface
from facetwise.operators import fidelity, mesh, meshers, topology, verdict

SQUARE = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 0.0, 1.0, 0.0)]


def tables(spark, triangles, vertices=SQUARE, pids=None):
    pids = pids or ["A"] * len(triangles)
    tri = spark.createDataFrame([("m", k, *t, p) for k, (t, p) in enumerate(zip(triangles, pids, strict=True))], "mesh_id string, tri long, v0 long, v1 long, v2 long, pid string")
    return tri, spark.createDataFrame([("m", *v) for v in vertices], "mesh_id string, v long, x double, y double, z double")


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(cols))).first()


def test_reference_triangles(spark):
    rows = [("equilateral", 0, 0, 1, 0, 0.5, math.sqrt(3) / 2), ("right", 0, 0, 1, 0, 0, 1), ("sliver", 0, 0, 1, 0, 0.5, 1e-3), ("point", 0, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame([(n, *map(float, x)) for n, *x in rows], "n string, ax double, ay double, bx double, by double, cx double, cy double")
    m = {r["n"]: r for r in G.with_triangle_metrics(df.withColumns({c: F.lit(0.0) for c in ("az", "bz", "cz")})).collect()}
    assert m["equilateral"]["shape"] == pytest.approx(1) and m["equilateral"]["min_angle"] == pytest.approx(60)
    assert m["equilateral"]["rr"] == pytest.approx(1) and m["equilateral"]["aspect"] == pytest.approx(2 / math.sqrt(3))
    assert m["right"]["shape"] == pytest.approx(math.sqrt(3) / 2) and m["right"]["max_angle"] == pytest.approx(90) and m["right"]["area"] == 0.5
    assert m["sliver"]["shape"] < 0.01
    assert m["point"]["shape"] == 0 and m["point"]["aspect"] == math.inf and m["point"]["a1"] == pytest.approx(90)


def test_scalar_formulas(spark):
    lit = F.lit
    r = one(
        spark, G.sagitta(lit(10.0), lit(2.0)), G.sagitta(lit(1.0), lit(5.0)), G.facet_angle_bound(lit(1.0), lit(1.0)), G.circularity(lit(math.pi), lit(2 * math.pi)),
        G.aspect_from_circularity(G.circularity(lit(10.0), lit(22.0))), G.aspect_from_circularity(lit(0.0)), G.aspect_from_circularity(lit(0.9)),
        G.curvature_size(lit(10.0), lit(0.01), lit(None).cast("double"), lit(None).cast("double")), G.curvature_size(lit(-1.0), lit(0.01), lit(5.0), lit(12.0)),
        G.attainment(lit(5.0), lit(10.0), lit(True)), G.attainment(lit(20.0), lit(10.0), lit(False)), G.attainment(lit(0.0), lit(10.0), lit(False)),
        G.borderline(lit(4.574e-2), lit(5e-2)), G.borderline(lit(3e-4), lit(5e-2)), G.borderline(lit(1.0), lit(0.0)), G.ramp_distance(lit(1.56), lit(3.82), lit(1.4)),
    )
    assert r.c0 == pytest.approx(10 - math.sqrt(99)) and r.c1 == 1.0 and r.c2 == pytest.approx(30) and r.c3 == pytest.approx(1)
    assert r.c4 == pytest.approx(10) and r.c5 == math.inf and r.c6 == 1
    assert r.c7 == pytest.approx(math.sqrt(0.8)) and r.c8 == math.inf
    assert (r.c9, r.c10, r.c11) == (0.5, 0.5, 1.0) and (r.c12, r.c13, r.c14) == (True, False, False) and r.c15 == pytest.approx(2.26 / 0.4)


def test_metric(spark):
    lit = F.lit
    e, f, g = lit(4.0), lit(0.0), lit(1.0)
    l00, l01, l11, det = G.metric_frame(lit(2.0), lit(1.0), lit(2.0))
    r = one(spark, G.area_scale(e, f, g), G.anisotropy(e, f, g), G.degenerate_metric(e, f, lit(0.0)), *G.parametric_size(e, g, lit(1.0)), *G.step_for_length(e, f, g, lit(1.0), lit(0.0), lit(6.0)), l00 * l00, l00 * l01, l01 * l01 + l11 * l11, det)
    assert tuple(r)[:7] == (2.0, 2.0, True, 0.5, 1.0, 3.0, 0.0) and tuple(r)[7:10] == pytest.approx((2, 1, 2)) and r.c10 > 0


def test_predicates(spark):
    p = lambda *x: [F.lit(float(v)) for v in x]
    r = one(
        spark, G.orient2d(*p(0, 0, 1, 0, 0, 1)), G.orient2d(*p(0, 0, 1, 1, 2, 2)), G.segments_cross(*p(0, 0, 2, 2, 0, 2, 2, 0)), G.segments_cross(*p(0, 0, 1, 0, 1, 0, 2, 5)),
        G.segments_cross(*p(0, 0, 2, 0, 1, 0, 3, 0)), G.in_triangle(*p(0, 0, 0, 0, 1, 0, 0, 1)), G.in_triangle(*p(1, 1, 0, 0, 1, 0, 0, 1)), *G.circumcenter(*p(0, 0, 2, 0, 0, 2)), G.shape_2d(*p(0, 0, 0, 1, 1, 0)),
    )
    assert tuple(r)[:9] == (1, 0, True, False, True, True, False, 1.0, 1.0) and r.c9 < 0
    assert meshers.orient((0.1, 0.1), (0.3, 0.3), (0.2, 0.2)) in (-1, 0, 1) and meshers.orient((0, 0), (1, 1), (2, 2)) == 0
    assert meshers.in_circle((0, 0), (1, 0), (0, 1), (1, 1)) == 0 and meshers.in_circle((0, 0), (1, 0), (0, 1), (0.5, 0.5)) == 1


def test_topology(spark):
    good, _ = tables(spark, [(0, 1, 2), (0, 2, 3)])
    t = topology.edge_topology(good, ["mesh_id"]).first()
    assert (t["n_boundary_edges"], t["n_nonmanifold_edges"], t["n_inconsistent_normals"], t["is_watertight"]) == (4, 0, 0, False)
    flipped, _ = tables(spark, [(0, 1, 2), (0, 3, 2)])
    assert topology.edge_topology(flipped, ["mesh_id"]).first()["n_inconsistent_normals"] == 1
    closed, _ = tables(spark, [(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)])
    assert topology.edge_topology(closed, ["mesh_id"]).first()["is_watertight"]
    fan, _ = tables(spark, [(0, 1, 2), (1, 0, 3), (0, 1, 4)])
    assert topology.edge_topology(fan, ["mesh_id"]).first()["n_nonmanifold_edges"] == 1


def test_boundary_gradation_and_submesh(spark):
    tri, vert = tables(spark, [(0, 1, 2), (0, 2, 3)])
    assert topology.boundary_length(tri, vert, ["mesh_id"]).first()["boundary_length"] == pytest.approx(4)
    sized = G.with_triangle_metrics(mesh.corners(tri, vert)).select("mesh_id", "tri", "size")
    g = topology.gradation(sized, topology.neighbours(tri, ["mesh_id"]), ["mesh_id"]).first()
    assert (g["n_pairs"], g["max_ratio"], g["frac_over"]) == (1, pytest.approx(1), 0)
    own, nodes = mesh.submesh(tri, vert, F.col("tri") == 1)
    assert own.select("v0", "v1", "v2").first() == (0, 1, 2) and nodes.count() == 3


def test_edge_classes(spark):
    fc = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 7), (11, 27), (11, 27), (1, 9), (2, 9), (3, 9)], "face long, curve long")
    curves = spark.createDataFrame([(c,) for c in (5, 6, 7, 9, 27, 99)], "curve long")
    cls = topology.edge_class(F.col("n_incidences"), F.col("n_faces"), F.arrays_overlap("faces", F.array(F.lit(77).cast("long"))))
    got = {r["curve"]: r["c"] for r in topology.incidence(fc, curves).select("curve", cls.alias("c")).collect()}
    assert got == {5: "manifold", 6: "free", 7: "free", 9: "nonmanifold", 27: "seam", 99: "orphan"}
    assert topology.seam_curves(fc).first() == (11, 27)


def test_duplicate_nodes(spark):
    _, vert = tables(spark, [(0, 1, 2)], [*SQUARE, (4, 1.0, 1.0, 1e-10), (5, -1e-10, 0.0, 0.0)])
    assert {(r["i"], r["j"]) for r in mesh.duplicate_nodes(vert, 1e-9).collect()} == {(2, 4), (0, 5)}


def test_size_adequation_keeps_unsized_in_band(spark):
    tri, vert = tables(spark, [(0, 1, 2), (0, 2, 3)])
    t = mesh.corners(tri, vert).withColumn("target", F.when(F.col("tri") == 0, F.lit(0.01)))
    r = mesh.size_adequation(t, ["mesh_id"]).first()
    assert r["frac_oversized"] == 0.5 and r["frac_in_band"] == 0.5 and r["ratio_max"] == pytest.approx(math.sqrt(4 / 3) / 0.01)


def test_empty_mesh(spark):
    tri, vert = tables(spark, [(0, 1, 2)])
    empty = mesh.corners(tri.limit(0), vert)
    r = mesh.quality_report(empty).first()
    assert (r["n_triangles"], r["shape_min"], r["aspect_max"], r["note"]) == (0, 0.0, math.inf, "empty mesh")
    assert fidelity.chordal_deviation(empty, Plane()).first()["max_deviation"] == 0


def test_fidelity_converges(spark):
    def facets(n, r=10.0):
        at = [2 * math.pi * k / n for k in range(n)]
        return [(k, -r * math.sin(a), r * math.cos(a), 0.0, -r * math.sin(b), r * math.cos(b), 0.0, -r * math.sin(b), r * math.cos(b), 1.0) for k, (a, b) in enumerate(zip(at, at[1:] + [2 * math.pi], strict=True))]

    schema = "tri long, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz")
    dev, ang = [], []
    for n in (16, 32):
        tri = spark.createDataFrame(facets(n), schema)
        dev.append(fidelity.chordal_deviation(tri, Cylinder(10.0)).first()["max_deviation"])
        ang.append(fidelity.normal_deviation(tri, Cylinder(10.0)).first()["max_deg"])
    assert dev[0] / dev[1] == pytest.approx(4, rel=0.05) and ang[0] / ang[1] == pytest.approx(2, rel=0.05)


def test_surfaces_round_trip(spark):
    for s in (Plane((1.0, 2.0, 3.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), Sphere(2.0, (1.0, 0.0, 0.0)), Cylinder(3.0), Cylinder(1.0, (0.0, 0.0, 1.0), (1.0, 1.0, 0.0)), surface("sphere", radius=5.0)):
        u, v = s.project(s.point(F.lit(0.4), F.lit(0.7)))
        du, dv = s.derivatives(F.lit(0.4), F.lit(0.7))
        n = s.normal(F.lit(0.4), F.lit(0.7))
        r = one(spark, u, v, G.dot(du, n), G.dot(dv, n), G.norm(n))
        assert tuple(r) == pytest.approx((0.4, 0.7, 0, 0, 1), abs=1e-9)
    r = one(spark, *Cylinder(1.0).point(F.lit(0.0), F.lit(0.0)))
    assert tuple(r) == pytest.approx((0, 1, 0))
    with pytest.raises(ValueError):
        surface("torus")


def test_verdicts(spark):
    rows = [("ok", 10, 0, 0, 0.8, 40.0, 100.0), ("bad", 10, 1, 0, 0.8, 40.0, 100.0), ("poor", 10, 0, 0, 0.15, 10.0, 100.0), ("empty", 0, 0, 0, None, None, None)]
    m = spark.createDataFrame(rows, "mesh string, n_triangles long, n_degenerate long, n_nonmanifold_edges long, min_shape double, min_angle double, max_angle double")
    v = {r["mesh"]: r for r in verdict.verdicts(m, verdict.failures(m, ["mesh"]), verdict.objectives(m, ["mesh"]), ["mesh"]).collect()}
    assert v["ok"]["ready"] and v["ok"]["score"] == 1 and not v["bad"]["is_valid"] and v["bad"]["score"] == 0
    assert v["poor"]["is_valid"] and not v["poor"]["ready"] and v["poor"]["score"] == pytest.approx((0.5 * 2 + 0.5 * 2 + 1) / 5)
    assert not v["empty"]["is_valid"] and v["empty"]["n_failures"] == 1


@pytest.mark.parametrize("method", ["cdt", "front", "front3d"])
def test_meshers_cover_the_face(spark, method):
    cases = meshers.cases(spark)
    tri = meshers.mesh(cases, method).cache()
    for r in meshers.scores(tri, cases).collect():
        assert abs(r["area_error"]) < 1.0 and r["shape_min"] > 0.25 and 0.6 < r["n_triangles"] / r["ideal"] < 1.3, r
    topo = {r["face"]: r for r in topology.edge_topology(tri, ["face"]).collect()}
    assert all(t["n_nonmanifold_edges"] == 0 and t["n_inconsistent_normals"] == 0 for t in topo.values())
    bnd = {r["face"]: r["n_boundary_edges"] for r in topo.values()}
    nodes, edges = meshers._boundary(meshers.Patch("plane", 0.0, [[(0, 0), (1, 0), (1, 1), (0, 1)]]), [[(0, 0), (1, 0), (1, 1), (0, 1)]], 0.15)
    assert bnd["plane"] == len(edges)


def test_delaunay_is_empty_circle():
    import random

    rng = random.Random(4)
    pts = [(rng.random(), rng.random()) for _ in range(40)]
    d = meshers.Delaunay(pts)
    inner = [t for t in d.triangles() if min(t) >= 3]
    for a, b, c in inner:
        assert all(meshers.in_circle(d.p[a], d.p[b], d.p[c], d.p[k]) <= 0 for k in range(3, 43) if k not in (a, b, c))


def test_loops(spark):
    rows = [("f", 0, k, u, v) for k, (u, v) in enumerate([(0.0, 0.0), (0.0, 3.0), (3.0, 3.0), (3.0, 0.0)])] + [("f", 1, k, u, v) for k, (u, v) in enumerate([(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)])]
    nodes = spark.createDataFrame(rows, "face string, loop int, ord int, u double, v double")
    turned = meshers.orient_loops(nodes, ["face"])
    area = {r["loop"]: r["area"] for r in meshers.loop_measures(turned, ["face", "loop"]).collect()}
    assert area == {0: 9.0, 1: -1.0}
    p = spark.createDataFrame([("f", 1, 0.5, 0.5), ("f", 2, 1.5, 1.5), ("f", 3, 9.0, 9.0)], "face string, point int, pu double, pv double")
    assert {r["point"]: r["winding"] for r in meshers.winding(p, turned, ["face"]).collect()} == {1: 1, 2: 0, 3: 0}
    assert meshers.resample(nodes, ["face"], 1.0).count() == 16 and meshers.self_crossings(nodes, ["face"]).count() == 0
    assert {r["loop"]: r["offset"] for r in meshers.loop_offsets(nodes, ["face"]).collect()} == {0: 0, 1: 4}


def test_msh_of_many_partitions(spark, tmp_path):
    """Nothing is lost where adaptive execution merges the partitions of ranks and of sizes differently."""
    from facetwise.sources import meshes

    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "40"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 40_000
        vertices = spark.range(n).selectExpr("id * 3 as v", "cast(id as double) as x", "cast(id % 7 as double) as y", "0D as z")
        tri = spark.range(n - 2).selectExpr("id as tri", "id * 3 as v0", "id * 3 + 3 as v1", "id * 3 + 6 as v2", "cast(id % 5 as string) as pid")
        meshes.write_msh(tri, vertices, str(tmp_path / "big.msh"))
        back = meshes.read_msh(spark, str(tmp_path / "big.msh"))
        assert back["nodes"].count() == n and back["nodes"].agg(F.min("v"), F.max("v"), F.count_distinct("v")).first() == (1, n, n)
        assert back["triangles"].count() == n - 2 and back["triangles"].where("v1 <> v0 + 1 or v2 <> v0 + 2 or tri <> v0").count() == 0
        dense = mesh.dense_vertices(tri.withColumn("mesh_id", F.lit("m")).unionByName(tri.where("tri < 100").withColumn("mesh_id", F.lit("k"))))
        assert dense.groupBy("mesh_id").agg(F.min("new_v").alias("a"), F.max("new_v").alias("b")).orderBy("mesh_id").collect() == [("k", 0, 101), ("m", 0, n - 1)]
        assert dense.where("new_v * 3 <> v").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_sizes_of_two_meshes_with_one_pid(spark):
    tri = spark.createDataFrame([("a", 0, "p"), ("b", 0, "p"), ("b", 1, "q")], "mesh_id string, tri long, pid string")
    faces = spark.createDataFrame([("a", "p", 1.0), ("b", "p", 2.0)], "mesh_id string, pid string, requested_size double")
    got = mesh.with_requested_size(tri, faces).select("mesh_id", "tri", "target").collect()
    assert sorted(map(tuple, got), key=str) == [("a", 0, 1.0), ("b", 0, 2.0), ("b", 1, None)]
    assert mesh.with_requested_size(tri, faces.where("mesh_id = 'a'").drop("mesh_id")).where("target = 1").count() == 2


def test_percentiles_and_subsets(spark):
    from facetwise.operators import ranks

    df = spark.range(1001).selectExpr("cast(id * 37 % 1001 as double) as x", "if(id % 2 = 0, null, cast(id as double)) as y", "double('NaN') as z")
    got = spark.range(1).select(*(c.alias(n) for n, c in ranks.percentiles(df, [("a", F.col("x"), 0.01), ("b", F.col("x"), 0.5), ("c", F.col("y"), 0.25), ("d", F.col("z"), 0.5)]).items())).first()
    assert tuple(got) == (10.0, 500.0, 250.5, None) or got["a"] == 10 and got["b"] == 500 and got["c"] == df.agg(F.percentile("y", F.lit(0.25))).first()[0] and got["d"] is None
    tri = spark.range(100).selectExpr("id as tri", "cast(id % 3 as string) as mesh_id")
    assert {r["n"] for r in fidelity._subset(tri, 5, 0, ["mesh_id"]).groupBy("mesh_id").agg(F.count("*").alias("n")).collect()} == {5}


def test_rays_by_grid_and_by_brute_force(spark):
    """Rays of any direction against a mesh of many small triangles and some large ones, and against plain loops."""
    import random

    rng = random.Random(4)
    tri, rays = [], []
    for m in ("a", "b"):
        for k in range(150):
            c = [rng.uniform(-1, 1) for _ in range(3)]
            w = 1.2 if k % 30 == 0 else 0.4
            tri.append((m, k, *(x + rng.uniform(-w, w) for _ in range(3) for x in c)))
        for k in range(200):
            d = [rng.uniform(-1, 1) for _ in range(3)]
            if k % 5 == 0:
                d = [0.0, 0.0, 0.0]
                d[k // 5 % 3] = rng.choice([-1.0, 1.0])
            rays.append((m, k, k, *(rng.uniform(-1.5, 1.5) for _ in range(3)), *d))
    rays.append(("a", 999, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    t = spark.createDataFrame(tri, "mesh_id string, tri long, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz"))
    r = spark.createDataFrame(rays, "mesh_id string, ray long, own long, ox double, oy double, oz double, dx double, dy double, dz double")
    cross = lambda p, q: (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    dot = lambda p, q: sum(x * y for x, y in zip(p, q, strict=True))
    want = {}
    for m, k, own, *od in rays:
        o, d = od[:3], od[3:]
        for n, j, *abc in tri:
            if n == m and j != own:
                a, b, c = abc[:3], abc[3:6], abc[6:]
                e1, e2 = [y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)]
                h = cross(d, e2)
                det = dot(e1, h)
                if abs(det) > 1e-14:
                    s = [y - x for x, y in zip(a, o, strict=True)]
                    q = cross(s, e1)
                    u, v, dist = dot(s, h) / det, dot(d, q) / det, dot(e2, q) / det
                    if u >= 0 and v >= 0 and u + v <= 1 and dist > 1e-9:
                        want[m, k] = min(dist, want.get((m, k), math.inf))
    got = {(x["mesh_id"], x["ray"]): x["distance"] for x in fidelity.ray_hits(t, r, own="own").collect()}
    assert len(want) > 40 and got == pytest.approx(want)


@pytest.mark.parametrize("h", [0.09, 0.035])
def test_front_of_many_triangles_closes(h):
    """Every edge inside has two triangles, the boundary one; a node on an edge cuts the triangle behind it."""
    loops = [[(0, 0), (1, 0), (1, 1), (0, 1)]]
    patch = meshers.Patch("plane", 0.0, loops)
    p, tri, stats = meshers.advancing_front(patch, loops, h)
    edges = [e for t in tri for e in zip(t, (*t[1:], t[0]), strict=True)]
    rim = [e for e in edges if e[::-1] not in set(edges)]
    assert stats.closed and stats.new_nodes + stats.reused_nodes <= len(tri) and len(set(edges)) == len(edges)
    assert sum(math.dist(p[a], p[b]) for a, b in rim) == pytest.approx(4) and meshers._facing(patch, p, tri)
    assert sum(meshers.orient(*(p[k] for k in t)) for t in tri) == len(tri) and len(tri) > 1 / (h * h * 0.433) * 0.8


def test_front_that_cannot_close(spark):
    bow = spark.createDataFrame([("bow", "plane", 0.0, 0.2, 1.0, [[(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)]])], meshers.FACE)
    assert not meshers.front_statistics(bow, "front").first()["closed"]
    with pytest.raises(Exception, match="did not close"):
        meshers.mesh(bow, "front").collect()


def test_ramped_sizes_by_brute_force(spark):
    import random

    from facetwise.operators import sizefield

    rng = random.Random(2)
    pts = [("m" if k % 4 else "n", k, *(rng.uniform(-3, 3) for _ in range(3))) for k in range(200)]
    src = [("m", *(rng.uniform(-3, 3) for _ in range(3)), rng.uniform(0.1, 2.5), rng.choice([0.0, 0.5, 1.5])) for _ in range(30)]
    p = spark.createDataFrame(pts, "mesh_id string, point long, x double, y double, z double")
    s = spark.createDataFrame(src, "mesh_id string, x double, y double, z double, h double, ramp double")
    want = {}
    for m, k, *x in pts:
        own = [h + (2 - h) * (min(1.0, math.dist(x, y) / ramp) if ramp > 0 else 1.0) for n, *y, h, ramp in src if n == m]
        want[k] = min([2.0, *own])
    assert {r["point"]: r["size"] for r in sizefield.size_at(p, s, 2.0).collect()} == pytest.approx(want)
    assert sizefield.size_at(p, s.limit(0), 2.0).where("size <> 2").count() == 0
