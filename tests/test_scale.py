"""Operators that were rebuilt for scale, against brute force: percentiles of groups, smoothing, rays, ramps, matching."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetwise.operators import entities, fidelity, mesh, ranks, sizefield
from facetwise.scratch import Scratch

TRI = "mesh_id string, tri long, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz")
RAY = "mesh_id string, ray long, own long, ox double, oy double, oz double, dx double, dy double, dz double"


# ---- percentiles ----


def test_group_percentiles_over_many_partitions(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"g": ["big"] * 20_000 + ["even"] * 7_000 + [None] * 300 + ["one"], "k": 1, "a": rng.normal(size=27_301), "b": rng.integers(0, 3, 27_301).astype(float)})
    rows.loc[20_000:26_999, "a"] = 0.5  # all equal
    rows.loc[::11, "b"] = np.nan
    df = spark.createDataFrame(rows).repartition(9).withColumn("b", F.when(~F.isnan("b"), F.col("b"))).withColumn("none", F.lit(None).cast("double"))
    wanted = [("p1", F.col("a"), 0.01), ("p99", F.col("a"), 0.99), ("mid", F.col("a"), 0.5), ("b_mid", F.col("b"), 0.5), ("upper", F.col("a"), "upper"), ("none", F.col("none"), 0.5)]
    from facetwise.scratch import Scratch

    scratch = Scratch(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["g"]: r for r in ranks.group_percentiles(df, ["g", "k"], wanted, scratch).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, own in rows.groupby("g", dropna=False):
        r = got[None if g is None or g != g else g]
        a, b = own["a"].to_numpy(), own["b"].dropna().to_numpy()
        want = [np.quantile(a, 0.01), np.quantile(a, 0.99), np.quantile(a, 0.5), np.quantile(b, 0.5) if len(b) else None, np.sort(a)[len(a) // 2]]
        assert [r[c] for c in ("p1", "p99", "mid", "b_mid", "upper")] == pytest.approx(want) and r["none"] is None
    cut = spark.read.parquet(f"{scratch.root}/1")
    assert cut.where("by_0 = 'big' and w = 0").select(F.shiftright("place", 33)).distinct().count() > 1  # one group in many tasks
    assert cut.where("by_0 = 'even' and w = 0").select(F.shiftright("place", 33)).distinct().count() > 1  # even one value
    assert ranks.group_percentiles(df.limit(0), ["g", "k"], wanted).count() == 0


# ---- sizes ----


def smoothed(size, area, near, g, extents=True):
    size = dict(size)
    for _ in range(50):
        before = dict(size)
        for p, h in before.items():
            if h is not None and h > 0:
                limit = h * g ** (max(min(math.sqrt(max(area[p] or 0, 0)) / h, 40.0), 1.0) if extents else 1.0)
                for q in near.get(p, ()):
                    if size.get(q) is not None and size[q] > limit:
                        size[q] = limit
        if size == before:
            break
    return size


@pytest.mark.parametrize("extents", [True, False])
def test_smoothing_by_brute_force(spark, extents):
    rng = random.Random(4)
    ids = [f"f{k}" for k in range(120)]
    size = {p: rng.choice([0.0, -1.0, None, *(10 ** rng.uniform(-2, 1) for _ in range(30))]) for p in ids}
    area = {p: rng.choice([None, 0.0, rng.uniform(0, 4)]) for p in ids}
    pairs = [(rng.choice(ids), rng.choice([*ids, "unknown"])) for _ in range(260)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    f = spark.createDataFrame([("m", p, size[p], area[p]) for p in ids] + [("n", p, 1.0, 1.0) for p in ids], "model string, pid string, size double, area double")
    links = spark.createDataFrame([("m", *p) for p in pairs + pairs[:20]], "model string, pid string, nbr string")
    got = {(r["model"], r["pid"]): r["size"] for r in sizefield.smooth(f, links, 1.3, extents=extents).collect()}
    want = smoothed(size, area, near, 1.3, extents)
    assert len(got) == 240 and {p: got["m", p] for p in ids} == pytest.approx(want) and all(got["n", p] == 1.0 for p in ids)
    assert want != size and {r["size"] for r in sizefield.smooth(f, links, 1.0).where("model = 'n'").collect()} == {1.0}
    assert sizefield.smooth(f.limit(0), links, 1.3).count() == 0


def test_ramps_of_many_lengths(spark):
    rng = random.Random(6)
    pts = [("m", k, *(rng.uniform(-5, 5) for _ in range(3))) for k in range(400)] + [("n", 400, 0.0, 0.0, 0.0), ("m", 401, None, 0.0, 0.0)]
    src = [("m", *(rng.uniform(-5, 5) for _ in range(3)), rng.uniform(0.1, 1.9), 10 ** rng.uniform(-2, 2)) for _ in range(150)] + [("m", 0.0, 0.0, 0.0, 1.99, math.inf), ("m", 1.0, 1.0, 1.0, 0.1, 1e-310)]
    src += [("m", *p[2:], 0.05, 0.01) for p in pts[:20]]
    p = spark.createDataFrame(pts, "mesh_id string, point long, x double, y double, z double")
    s = spark.createDataFrame(src, "mesh_id string, x double, y double, z double, h double, ramp double")
    want = {k: min([2.0, *(h + (2 - h) * min(1.0, math.dist(x, y) / ramp) for n, *y, h, ramp in src if n == m and None not in x)]) for m, k, *x in pts}
    assert {r["point"]: r["size"] for r in sizefield.size_at(p, s, 2.0).collect()} == pytest.approx(want)


def test_ramps_that_reach_all_points(spark):
    rng = random.Random(16)
    pts = [("m", k, rng.uniform(0, 10), float(k % 17), 0.0) for k in range(3000)]
    src = [("m", rng.uniform(0, 10), float(k % 17), 0.0, 0.1 + k % 7 / 10, 30.0) for k in range(3000)]
    p = spark.createDataFrame(pts, "mesh_id string, point long, x double, y double, z double")
    s = spark.createDataFrame(src, "mesh_id string, x double, y double, z double, h double, ramp double")
    scratch = Scratch(spark)
    got = {r["point"]: r["size"] for r in sizefield.size_at(p, s, 2.0, scratch=scratch).collect()}
    want = {k: min(h + (2 - h) * min(1.0, math.dist(x, y) / ramp) for _, *y, h, ramp in src) for _, k, *x in pts}
    assert got == pytest.approx(want)
    # All sources reach all points, so pairs would be nine million.
    assert sum(spark.read.parquet(f"{scratch.root}/{k}").count() for k in range(1, scratch.n + 1)) < 600_000


def test_neighbours_by_number(spark):
    from facetwise.plans.run_queries import _neighbours

    faces = spark.createDataFrame([("ab"[k % 3 % 2], str(k)) for k in range(0, 400, 2)], "model string, pid string")
    want = {(m, p, q) for m, p in ((r[0], r[1]) for r in faces.collect()) for q in map(str, range(0, 400, 2)) if q != p and abs(int(p) - int(q)) <= 5 and "ab"[int(q) % 3 % 2] == m}
    met = _neighbours(faces, 5)
    assert {(r["model"], r["pid"], r["nbr"]) for r in met.collect()} == want and met.count() == len(want)
    assert "abs(" not in met._jdf.queryExecution().optimizedPlan().toString()  # the number is a key of the join, no condition on pairs


def test_parents_of_copies(spark, monkeypatch):
    """Equal boxes meet once, whatever their number."""
    from facetwise.operators import boxes

    box = lambda side, k: ("m", k, float(k % 50), *([-side, side] * 3))
    old = spark.createDataFrame([box(5.0, k) for k in range(500)] + [box(3.0, k) for k in range(500, 1000)], "model string, pid long, mass double, xlo double, xhi double, ylo double, yhi double, zlo double, zhi double")
    new = spark.createDataFrame([box(4.0, k) for k in range(400)] + [box(1.0, k) for k in range(400, 800)] + [box(9.0, 800)], old.schema).withColumnRenamed("pid", "tag")
    met, around = [], boxes.around
    monkeypatch.setattr(boxes, "around", lambda *args: met.append(around(*args)) or met[-1])
    got = {r["n_tag"]: r["o_pid"] for r in entities.tightest_parent(old, new, ["model"], F.lit(0.0)).collect()}
    assert got == {k: 0 if k < 400 else min((k % 50, k) for k in range(1000))[1] for k in range(800)}
    assert met[0].count() == 3  # 600,000 pairs of copies


def test_one_crossing_is_enough(spark, monkeypatch):
    """Only loops without a crossing of near edges are looked at in full."""
    from facetwise.operators import meshers

    ring = [(math.cos(k / 10), math.sin(k / 10)) for k in range(60)]
    bow = [*ring[:30], (5.0, 5.0), (-5.0, 5.1), (5.0, 5.2), (-6.0, 4.9), *ring[30:]]  # crosses near by
    far = [(0.0, 0.0), *((10.0 + k / 10, (k % 2) / 10) for k in range(40)), (30.0, 5.0), (10.0, -5.0), (0.0, 9.0)]  # crosses far apart
    loops = {"ring": ring, "bow": bow, "far": far, "two": ring[:2]}
    nodes = spark.createDataFrame([(f, 0, k, *p) for f, own in loops.items() for k, p in enumerate(own)], "face string, loop int, ord int, u double, v double")
    full, crossings = [], meshers.self_crossings
    monkeypatch.setattr(meshers, "self_crossings", lambda n, by: full.append(n) or crossings(n, by))
    got = {r["face"]: r["is_simple"] for r in meshers.loop_is_simple(nodes, ["face"]).collect()}
    assert got == {"ring": True, "bow": False, "far": False, "two": False}
    assert {r["face"] for r in full[0].collect()} == {"ring", "far"}


def test_duplicate_nodes_of_any_magnitude(spark):
    pts = [(0, 1e11), (1, 1e11), (2, 1e11 + 1), (3, 1e7), (4, 1e300), (5, 1e300), (6, 0.0), (7, 9e-10), (8, -5e-10), (9, None), (10, math.nan), (11, math.nan)]
    vert = spark.createDataFrame([("m", k, x, 0.0, -1e11) for k, x in pts], "mesh_id string, v long, x double, y double, z double")
    found = lambda tol: {(r["i"], r["j"]) for r in mesh.duplicate_nodes(vert, tol).collect()}
    assert found(1e-9) == {(0, 1), (4, 5), (6, 7), (6, 8)} and found(0.0) == found(-1.0) == set()
    assert found(2.0) == {(0, 1), (0, 2), (1, 2), (4, 5), (6, 7), (6, 8), (7, 8)}


# ---- rays ----


def first_hits(tri, rays):
    abc = {}
    for m, k, *p in tri:
        abc.setdefault(m, []).append((k, p))
    want = {}
    for m, ray, own, *od in rays:
        o, d = np.array(od[:3]), np.array(od[3:])
        k = np.array([x for x, _ in abc[m]])
        p = np.array([x for _, x in abc[m]])
        a, e1, e2 = p[:, :3], p[:, 3:6] - p[:, :3], p[:, 6:] - p[:, :3]
        h = np.cross(d, e2)
        det = (e1 * h).sum(1)
        with np.errstate(all="ignore"):
            s = o - a
            q = np.cross(s, e1)
            u, v, t = (s * h).sum(1) / det, (q @ d) / det, (e2 * q).sum(1) / det
        ok = (abs(det) > 1e-14) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > 1e-9) & (k != (-1 if own is None else own))
        if ok.any():
            want[m, ray] = t[ok].min()
    return want


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_rays_on_triangles_of_mixed_sizes(spark, shift):
    rng = np.random.default_rng(3)
    tri, rays = [], []
    for m in ("a", "b"):
        for k in range(1200):
            c, w = rng.uniform(-500, 500, 3), 10 ** rng.uniform(0, 3) if k % 10 == 0 else rng.uniform(1, 30)
            tri.append((m, k, *(shift + c[j % 3] + rng.uniform(-w, w) / 2 for j in range(9))))
        tri.append((m, 1200, *([shift - 1000.0] * 3), *([shift + 1000.0] * 3), shift - 1000.0, shift + 1000.0, shift))  # across the whole mesh
        tri.append((m, 1201, *([shift] * 9)))  # a point
        for k in range(300):
            d = rng.uniform(-1, 1, 3) if k % 4 else np.eye(3)[k // 4 % 3] * rng.choice([-2.0, 2.0])
            rays.append((m, k, k if k % 2 else None, *(shift + rng.uniform(-900, 900, 3)), *d))
    tri, rays = [tuple(map(lambda v: v.item() if hasattr(v, "item") else v, r)) for r in tri], [tuple(map(lambda v: v.item() if hasattr(v, "item") else v, r)) for r in rays]
    want = first_hits(tri, rays)
    odd = [("a", 900, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("a", 901, None, None, 0.0, 0.0, 0.0, 0.0, 1.0), ("z", 902, None, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    t = spark.createDataFrame([*tri, ("a", 9999, *([math.nan] * 9))], TRI)
    got = {(r["mesh_id"], r["ray"]): r["distance"] for r in fidelity.ray_hits(t, spark.createDataFrame(rays + odd, RAY), own="own").collect()}
    assert len(want) > 100 and got == pytest.approx(want, rel=1e-9, abs=1e-6)
    assert fidelity.ray_hits(t.limit(0), spark.createDataFrame(rays, RAY)).count() == 0


def test_cells_of_a_triangle_are_few(spark):
    from facetwise.operators import rays

    tri = [("m", k, *(float(x + d) for d in (0, 1, 2) for x in (k % 50, k // 50, 0))) for k in range(2000)] + [("m", 2000, 0.0, 0.0, 0.0, 50.0, 50.0, 1.0, 50.0, 0.0, 40.0)]
    t = spark.createDataFrame(tri, TRI)
    per = rays._cells(t, rays._frames(t)).groupBy("tri").count().collect()
    assert len(per) == 2001 and max(r["count"] for r in per if r["tri"] < 2000) <= 8 and max(r["count"] for r in per) <= 64


def test_rays_in_a_soup_of_large_triangles_meet_few(spark, monkeypatch):
    from facetwise.operators import rays

    rng = np.random.default_rng(8)
    tri = [("m", k, *map(float, p)) for k, p in enumerate(rng.uniform(-1, 1, (3000, 9)))]
    ray = [("m", k, k, *(sum(p[x::3]) / 3 for x in range(3)), 0.0, 0.0, 1.0) for _, k, *p in tri]
    t, r = spark.createDataFrame(tri, TRI), spark.createDataFrame(ray, RAY)

    def met(frames):
        """Triangles in the cells of the rays' origins."""
        (f,), near = frames.collect(), {}
        for x in rays._cells(t, frames).where("level = %d" % f["least"]).collect():
            near.setdefault((x["ix"], x["iy"], x["iz"]), set()).add(x["tri"])
        at = [tuple(int((o - f[g]) // (f["w"] / 4 ** f["least"])) for o, g in zip(x[3:6], ("gx", "gy", "gz"), strict=True)) for x in ray]
        assert all(k in near[c] for k, c in enumerate(at))
        return sum(len(near[c]) for c in at)

    fitted, before = met(rays._fitted(rays._frames(t), t, r)), met(rays._frames(t))
    assert 2 * fitted < before
    monkeypatch.setattr(rays, "BLOCK", 500)
    got = {(x["mesh_id"], x["ray"]): x["distance"] for x in fidelity.ray_hits(t, r, own="own").collect()}
    assert got == pytest.approx(first_hits(tri, ray), rel=1e-9, abs=1e-9)


# ---- matching ----

ENTITY = "model string, pid string, tag long, fp string, dim int, mass double, xlo double, ylo double, zlo double, xhi double, yhi double, zhi double"


class _Box:
    """An entity as the greedy passes need it."""

    def __init__(self, row):
        self.key = row["pid"] if "pid" in row and row["pid"] is not None else int(row["tag"])
        self.tag = int(row["tag"]) if row.get("tag") is not None and not pd.isna(row["tag"]) else None
        self.dim, self.mass, self.fp = int(row["dim"]), float(row["mass"]), row["fp"]
        self.low = [float(row[x + "lo"]) for x in "xyz"]
        self.high = [float(row[x + "hi"]) for x in "xyz"]

    def holds(self, other: "_Box", tol: float) -> bool:
        return all(o >= s - tol for s, o in zip(self.low, other.low, strict=True)) and all(o <= s + tol for s, o in zip(self.high, other.high, strict=True))


def _match_dimension(olds: list[_Box], news: list[_Box], tol: float, rel: float) -> list[tuple]:
    """(relation, new tags, old pids, mass ratio) of one dimension of one model."""
    out: list[tuple] = []
    free_old, free_new = {o.key: o for o in olds}, {n.tag: n for n in news}

    def take(relation: str, ns: list[_Box], os: list[_Box], ratio: float, *, each: bool = False) -> None:
        for tags in ([n.tag] for n in ns) if each else [[n.tag for n in ns]]:
            out.append((relation, tags, [o.key for o in os], ratio))
        for n in ns:
            free_new.pop(n.tag, None)
        for o in os:
            free_old.pop(o.key, None)

    def equal(a: _Box, b: _Box) -> bool:
        big = max(a.mass, b.mass)
        return a.holds(b, tol) and b.holds(a, tol) and (big <= 0 or abs(a.mass - b.mass) / big <= rel)

    def share(top: float, bottom: float) -> float:
        return top / bottom if bottom else 0.0

    # Coincident old entities of which fewer are left have merged; this must come before exact matches.
    seen: set = set()
    for o in olds:
        if o.key in seen:
            continue
        cluster = [o] + [x for x in olds if x is not o and x.key not in seen and equal(o, x)]
        seen.update(x.key for x in cluster)
        here = [n for n in news if n.tag in free_new and any(equal(n, x) for x in cluster)]
        if len(cluster) > 1 and 0 < len(here) < len(cluster):
            take("merge", here, cluster, share(sum(n.mass for n in here), sum(x.mass for x in cluster)), each=True)
    # Equal fingerprints, if old and new have as many of them.
    by_fp: dict[str, list[_Box]] = {}
    for n in free_new.values():
        by_fp.setdefault(n.fp, []).append(n)
    for fp, group in by_fp.items():
        bucket = sorted((o for o in free_old.values() if o.fp == fp), key=lambda o: o.key)
        if len(bucket) == len(group):
            for n, o in zip(sorted(group, key=lambda x: x.tag), bucket, strict=True):
                take("same", [n], [o], 1.0)
    # The same region of space: one old entity is the same, several have merged.
    for n in sorted(free_new.values(), key=lambda x: x.tag):
        there = [o for o in olds if o.key in free_old and n.holds(o, tol) and o.holds(n, tol)]
        if there:
            many = len(there) > 1
            take("merge" if many else "same", [n], there, share(n.mass, sum(o.mass for o in there)) if many else 1.0)
    # Inside the tightest old entity: several are a split, a single one is the same, whatever mass it lost.
    children: dict[str, list[_Box]] = {}
    for n in news:
        if n.tag in free_new and (around := [o for o in olds if o.key in free_old and o.holds(n, tol)]):
            children.setdefault(min(around, key=lambda o: o.mass).key, []).append(n)
    for key, ns in children.items():
        o = free_old[key]
        take("same" if len(ns) == 1 else "split", ns, [o], share(sum(n.mass for n in ns), o.mass))
    # Around at least two old entities.
    for n in [x for x in news if x.tag in free_new]:
        covered = [o for o in olds if o.key in free_old and n.holds(o, tol)]
        if len(covered) > 1:
            take("merge", [n], covered, share(n.mass, sum(o.mass for o in covered)))
    out += [("created", [n.tag], [], 1.0) for n in news if n.tag in free_new]
    out += [("deleted", [], [o.key], 0.0) for o in olds if o.key in free_old]
    return out


def greedy(old, new, scale, rel):
    """The passes one entity after the other: rows of (relation, dim, new tags, old pids, ratio) of one model."""
    names = ENTITY.replace(" string", "").replace(" long", "").replace(" int", "").replace(" double", "").split(", ")
    olds = sorted((_Box(dict(zip(names, r, strict=True))) for r in old), key=lambda x: x.key)
    news = sorted((_Box({**dict(zip(names, r, strict=True)), "pid": None}) for r in new), key=lambda x: x.tag)
    rows = []
    for dim in sorted({x.dim for x in olds + news}):
        found = _match_dimension([x for x in olds if x.dim == dim], [x for x in news if x.dim == dim], rel * scale, rel)
        rows += [(r, dim, tuple(tags), tuple(pids), round(ratio, 9)) for r, tags, pids, ratio in found]
    return sorted(rows)


def _random_model(rng, name, n):
    """Boxes of a few places and sizes, many of them nearly equal, inside each other or cut in two."""
    old, new = [], []
    for k in range(n):
        lo = [rng.choice([0, 0, 5, 10, 20]) + rng.choice([0, 0.1, 0.3, -0.3]) for _ in range(3)]
        hi = [x + rng.choice([0, 1, 5, 10, 40]) + rng.choice([0, 0.2]) for x in lo]
        row = lambda lo, hi, mass: (name, f"p{k:03d}", 1000 - k, f"fp{rng.randrange(n // 2)}", rng.choice([1, 2, 2]), mass, *map(float, lo), *map(float, hi))  # noqa: E731, B023
        mass = rng.choice([0.0, 10.0, 10.1, round(rng.uniform(1, 50), 3)])
        (old if rng.random() < 0.5 else new).append(row(lo, hi, mass))
        if rng.random() < 0.2:  # coincident copies, of which the new snapshot has fewer
            copies = [row(lo, hi, mass)[:1] + (f"c{k:03d}{j}", 8000 + 10 * k + j) + row(lo, hi, mass)[3:] for j in range(3)]
            old += copies[: rng.choice([1, 2])]
            new += copies[2:]
        if rng.random() < 0.3:
            (new if rng.random() < 0.7 else old).append(row([x + rng.choice([0, 0.1]) for x in lo], hi, mass)[:1] + (f"q{k:03d}", 5000 + k) + row(lo, hi, mass)[3:])
    return old, new


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_by_rounds_equals_the_greedy_order(spark, seed):
    rng = random.Random(seed)
    models = {f"m{k}": _random_model(rng, f"m{k}", n) for k, n in enumerate((60, 25, 25, 8, 120))}
    models["only_old"] = ([("only_old", *r[1:]) for r in models["m1"][0]], [])
    models["only_new"] = ([], [("only_new", *r[1:]) for r in models["m1"][1]])
    old, new = ([r for own in models.values() for r in own[k]] for k in (0, 1))
    frames = spark.createDataFrame([(m, 25.0) for m in models], "model string, scale double")
    got = entities.match_snapshots(spark.createDataFrame(old, ENTITY), spark.createDataFrame(new, ENTITY).drop("pid"), frames).collect()
    seen = {}
    for m, own in models.items():
        mine = sorted((r["relation"], r["dim"], tuple(r["new_tags"]), tuple(r["old_pids"]), round(r["mass_ratio"], 9)) for r in got if r["model"] == m)
        want = greedy(*own, 25.0, 0.02)
        assert mine == want
        for r, *_ in want:
            seen[r] = seen.get(r, 0) + 1
    assert set(seen) == {"same", "split", "merge", "created", "deleted"} and min(seen.values()) > 2


def test_copies_of_a_box_are_no_pairs(spark, monkeypatch):
    from facetwise.operators import boxes

    met, equal, around = [], boxes.equal, boxes.around

    def counted(f):
        def run(*a):
            out = f(*a)
            met.append(out.count())
            return out

        return run

    monkeypatch.setattr(boxes, "equal", counted(equal))
    monkeypatch.setattr(boxes, "around", counted(around))
    place = lambda k: (float(k % 3), 0.0, 0.0, float(k % 3) + 10.0 - k % 2, 5.0, 1.0)
    mass = [5.0, 5.05, 30.0, 0.0]
    old = [("m", f"p{k * 7 % 240:03d}", k, f"o{k}", 2, mass[k % 4], *place(k)) for k in range(240)]
    new = [("m", None, 1000 - k, f"n{k}", 2, mass[k % 5 % 4], *place(k)) for k in range(200)] + [("m", None, 2000 + k, "n", 2, 1.0, -5.0, -5.0, -5.0, 50.0, 50.0, 50.0) for k in range(100)]
    frames = spark.createDataFrame([("m", 25.0)], "model string, scale double")
    got = entities.match_snapshots(spark.createDataFrame(old, ENTITY), spark.createDataFrame(new, ENTITY).drop("pid"), frames).collect()
    mine = sorted((r["relation"], r["dim"], tuple(r["new_tags"]), tuple(r["old_pids"]), round(r["mass_ratio"], 9)) for r in got)
    assert mine == greedy(old, new, 25.0, 0.02) and {r[0] for r in mine} >= {"merge", "created"}
    assert max(met) < 240


def test_boxes_meet_by_cells_as_by_brute_force(spark):
    from facetwise.operators import boxes

    rng = random.Random(8)
    rows = []
    for k in range(160):
        lo = [rng.choice([0.0, 3.0, rng.uniform(-50, 50)]) for _ in range(3)]
        rows.append(("m", k, *lo, *(x + rng.choice([0.0, 0.5, 10 ** rng.uniform(-2, 2)]) for x in lo)))
    names = ["xlo", "ylo", "zlo", "xhi", "yhi", "zhi"]
    for tol in (0.0, 0.5):
        df = spark.createDataFrame(rows, "model string, k long, " + ", ".join(f"{c} double" for c in names)).withColumn("tol", F.lit(tol))
        inside = {(a[1], b[1]) for a in rows for b in rows if all(b[2 + i] >= a[2 + i] - tol and b[5 + i] <= a[5 + i] + tol for i in range(3))}
        assert {(r["o_k"], r["i_k"]) for r in boxes.around(df, df, ["model"]).collect()} == inside
        assert {(r["l_k"], r["r_k"]) for r in boxes.equal(df, df, ["model"]).collect()} == {p for p in inside if p[::-1] in inside}


# ---- policy ----


def test_failures_of_many_runs_as_of_one(spark):
    from facetwise.operators import decisions, policy

    rng = random.Random(5)
    codes = [c for own, _, _ in decisions.TRIGGERS for c in own] + ["other.code"]
    rows, want = [], []
    for case in range(400):
        own = rng.sample(codes, rng.choice([0, 1, 1, 2, 3, 5]))
        said = rng.choice([None, "", "PERIODIC surface of", "1D mesh; periodic surface", "no closed loop", "boom"])
        given = {"imprint": rng.choice([None, True, False]), "heal": rng.choice([None, True, False]), "heal_tolerance_frac": rng.choice([None, 1e-4, 1e-3, 1e-2]), "geometry_tolerance": rng.choice([None, 0.0, 0.5]), "optimize_passes": rng.choice([None, 1, 3]), "algorithm": rng.choice([None, "frontal", "delaunay", "meshadapt"])}
        history, used, lost = ["tighten_tolerance"] * rng.randrange(3), rng.sample(policy.ALGORITHMS, rng.randrange(4)), [f"f{k}" for k in range(rng.choice([0, 2, 7]))]
        rows.append((case, own, said, *given.values(), history, used, lost, 50.0))
        done = [policy.Action(k) for k in history] + [policy.Action("switch_algorithm", (("algorithm", a),)) for a in used]
        state = policy.State(policy.Strategy(**{k: v for k, v in given.items() if v is not None}), history=done, scale=50.0)
        failures = {c: {"exception": said, "pids": lost} if c == "mesher.failed" else {"pids": lost} for c in own}
        for place, a in enumerate(policy.strategy_actions(failures, state)):
            params = dict(a.params)
            want.append((case, place, a.kind, a.priority, a.evidence, params.pop("algorithm", None), {k: pytest.approx(v) for k, v in params.items()}, list(a.scope)))
    schema = "case_id long, codes array<string>, exception string, imprint boolean, heal boolean, heal_tolerance_frac double, geometry_tolerance double, optimize_passes int, algorithm string, history array<string>, algorithms array<string>, missing array<string>, scale double"
    got = sorted((r["case_id"], r["place"], r["kind"], r["priority"], r["evidence"], r["algorithm"], r["params"], r["scope"]) for r in decisions.strategy_actions(spark.createDataFrame(rows, schema)).collect())
    assert got == want and {w[2] for w in want} >= {"escalate", "refine_faces", "switch_algorithm", "increase_heal_tolerance", "tighten_tolerance"}
    bare = decisions.strategy_actions(spark.createDataFrame([(1, ["validity.inverted"])], "case_id long, codes array<string>")).collect()
    assert [(r["kind"], r["evidence"]) for r in bare] == [("increase_optimization", "validity.inverted")]


def test_objectives_of_many_runs_as_of_one(spark):
    from facetwise.operators import decisions, policy

    rng = random.Random(7)
    names = ["chordal", "normal_deviation", "gradation", "min_shape", "min_angle", "max_angle", "size_in_band", "unknown"]
    cases, faces, want = [], [], []
    for case in range(80):
        own = [(f"f{k:02d}", rng.choice([None, rng.uniform(0, 50)]), rng.choice([None, rng.uniform(0.1, 5)]), *(rng.choice([None, math.nan, rng.uniform(0, 1), 0.5]) for _ in range(3))) for k in range(rng.choice([0, 1, 12]))]
        faces += [(case, *f) for f in own]
        missed = [(n, rng.random(), 0.5) for n in rng.sample(names, rng.randrange(5))]
        spec = [rng.choice([None, rng.uniform(0.1, 2)]) for _ in range(5)]
        cases.append((case, missed, rng.choice([1, 3]), rng.random() < 0.5, 20.0, rng.choice([10, 500, 10**9]), *spec))
        rules = [(k, {p: v}, []) for (k, p), v in zip((("curvature", "chordal_tol"), ("gradation", "max_growth"), ("base", "h"), ("clamp", "h_min")), (spec[0], *spec[2:]), strict=True) if v is not None]
        state = policy.State(policy.Strategy(optimize_passes=cases[-1][2]), scale=20.0, budget=cases[-1][5], areas={f[0]: f[1] or 0.0 for f in own}, sizes={f[0]: f[2] for f in own if f[2] is not None}, history=[policy.Action("refine_faces")] * cases[-1][3])
        state.param = lambda kind, name, otherwise, rules=rules, spec=spec: spec[1] if name == "normal_tol_deg" and spec[1] is not None else next((p[name] for k, p, _ in rules if k == kind and name in p), otherwise)
        worst = {}
        for j, m in enumerate(decisions.METRICS):
            ranked = sorted((f for f in own if f[3 + j] is not None and f[3 + j] == f[3 + j]), key=lambda f: (f[3 + j], f[0]), reverse=m != "shape_min")
            worst[m] = [f[0] for f in ranked]
        found = policy.objective_actions([{"name": n, "detail": {"frac_oversized": a, "frac_undersized": b}} for n, a, b in missed], worst, state)
        want += [(case, place, a.kind, a.priority, a.evidence, {k: pytest.approx(v) for k, v in a.params}, list(a.scope)) for place, a in enumerate(found)]
    c = spark.createDataFrame(cases, "case_id long, missed array<struct<name:string,frac_oversized:double,frac_undersized:double>>, optimize_passes int, refined boolean, scale double, budget long, chordal_tol double, normal_tol_deg double, max_growth double, h double, h_min double")
    f = spark.createDataFrame(faces, "case_id long, pid string, area double, size double, chordal_relative double, normal_p99_deg double, shape_min double")
    got = sorted((r["case_id"], r["place"], r["kind"], r["priority"], r["evidence"], r["params"], r["scope"]) for r in decisions.objective_actions(c, f).collect())
    assert got == want and len({w[2] for w in want}) >= 6


# ---- predicates and loops ----


def _near_degenerate(rng, n):
    """Points nearly in line or on one circle, off by some units in the last place."""
    bump = lambda x: math.nextafter(x, rng.choice([-math.inf, math.inf]), steps=rng.randrange(4))
    for k in range(n):
        if k % 10 == 1:  # in line
            a, d = [rng.randrange(-99, 99) for _ in range(2)], [rng.randrange(-99, 99) for _ in range(2)]
            pts = [[x + t * y for x, y in zip(a, d, strict=True)] for t in (rng.randrange(-9, 9) for _ in range(4))]
        elif k % 2:
            a, d, scale = [rng.uniform(-1, 1) for _ in range(2)], [rng.uniform(-1, 1) for _ in range(2)], 10 ** rng.uniform(-3, 6)
            pts = [[bump((x + t * y) * scale) for x, y in zip(a, d, strict=True)] for t in (rng.uniform(-2, 2) for _ in range(4))]
        else:
            grid = rng.choice([(5, 0), (3, 4), (-4, 3), (0, -5)]), rng.choice([(4, 3), (-3, -4)]), (-5, 0), (3, -4)
            pts = [[bump(x * 0.1 + 12.0) if k % 4 else x + 1e7 for x in p] for p in grid]
        yield [x for p in pts for x in p]


def test_predicates_have_exact_signs(spark):
    from fractions import Fraction

    from facetwise.functions import geometry as G

    rows = list(_near_degenerate(random.Random(3), 4000)) + [[0.0] * 8, [1e150, 0, 0, 1e140, 1e-100, 1e-120, 3.0, 4.0]]
    names = ["ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"]
    cols = [F.col(n) for n in names]
    df = spark.createDataFrame([[float(x) for x in r] for r in rows] + [[None] * 8], ", ".join(f"{n} double" for n in names)).repartition(4)
    got = {tuple(r[n] for n in names): (r["side"], r["circle"]) for r in df.select("*", G.orient2d(*cols[:6]).alias("side"), G.in_circle(*cols).alias("circle")).collect()}
    sign = lambda x: (x > 0) - (x < 0)
    zeros = uncertain = 0
    for r in rows:
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = [(Fraction(r[k]), Fraction(r[k + 1])) for k in range(0, 8, 2)]
        side = sign((ax - cx) * (by - cy) - (ay - cy) * (bx - cx))
        m = [(x - dx, y - dy, (x - dx) ** 2 + (y - dy) ** 2) for x, y in ((ax, ay), (bx, by), (cx, cy))]
        circle = sign(sum(m[i][2] * (m[(i + 1) % 3][0] * m[(i + 2) % 3][1] - m[(i + 2) % 3][0] * m[(i + 1) % 3][1]) for i in range(3)))
        mine = got[tuple(map(float, r))]
        assert mine[0] == side
        if max(map(abs, r)) < 1e70:
            assert mine[1] == circle
        f = [float(x) for x in r]
        zeros += side == 0
        uncertain += abs((f[0] - f[4]) * (f[3] - f[5]) - (f[1] - f[5]) * (f[2] - f[4])) <= 1e-12 * (abs((f[0] - f[4]) * (f[3] - f[5])) + abs((f[1] - f[5]) * (f[2] - f[4]))) and side != 0
    assert got[(None,) * 8] == (None, None) and zeros > 100 and uncertain > 500  # where doubles alone gave 0


def test_loops_of_many_edges(spark):
    """Crossings and turns by bands and cells as by all pairs; one long loop is simple."""
    from facetwise.functions import geometry as G
    from facetwise.operators import meshers

    rng = random.Random(9)
    rows = []
    for face in range(6):
        for k in range(60):
            r, t = 10 ** rng.uniform(-2, 2) if face % 2 else 5 + rng.random(), k / 60 * 2 * math.pi + (rng.random() * 0.3 if face > 3 else 0)
            rows.append((face, 0, k, r * math.cos(t), r * math.sin(t)))
    rows += [(6, 0, 0, 0.0, 0.0), (6, 0, 1, 1.0, 0.0), (7, 0, 0, 0.0, 0.0), (7, 0, 1, 4.0, 0.0), (7, 0, 2, 4.0, 4.0), (7, 0, 3, 2.0, 0.0)]
    nodes = spark.createDataFrame(rows, "face long, loop int, ord int, u double, v double")
    n = meshers.next_nodes(nodes, ["face"])
    pairs = n.alias("a").join(n.alias("b"), (F.col("a.face") == F.col("b.face")) & (F.col("a.ord") < F.col("b.ord")))
    cross = G.segments_cross(*(F.col(f"{p}.{c}") for p in "ab" for c in ("u", "v", "u1", "v1")))
    want = {r["face"]: r["n"] for r in pairs.where(cross).groupBy("a.face").agg(F.count("*").alias("n")).collect()}
    assert {r["face"]: r["n"] for r in meshers.self_crossings(nodes, ["face"]).collect()} == want and len(want) > 2
    simple = {r["face"]: r["is_simple"] for r in meshers.loop_is_simple(nodes, ["face"]).collect()}
    assert simple == {f: f not in want and f != 6 for f in range(8)} and simple[0] and not simple[7]
    pts = [(f, k, rng.uniform(-8, 8), rng.choice([rng.uniform(-8, 8), 0.0])) for f in range(9) for k in range(40)] + [(7, 99, 3.0, 0.0)]
    points = spark.createDataFrame(pts, "face long, point long, pu double, pv double")
    loops = {}
    for f, _, k, u, v in rows:
        loops.setdefault(f, []).append((u, v))
    turns = {}
    for f, k, pu, pv in pts:
        for (u, v), (u1, v1) in zip(loops.get(f, []), loops.get(f, [])[1:] + loops.get(f, [])[:1], strict=True):
            left = (u1 - u) * (pv - v) - (pu - u) * (v1 - v)
            turns[f, k] = turns.get((f, k), 0) + (v <= pv < v1 and left > 0) - (v1 <= pv < v and left < 0)
    assert {(r["face"], r["point"]): r["winding"] for r in meshers.winding(points, nodes, ["face"]).collect()} == turns
    ring = spark.range(100_000).select(F.lit(1).alias("face"), F.lit(0).alias("loop"), F.col("id").alias("ord"), F.cos(F.col("id") * (2 * math.pi / 1e5)).alias("u"), F.sin(F.col("id") * (2 * math.pi / 1e5)).alias("v"))
    assert meshers.loop_is_simple(ring, ["face"]).first()["is_simple"]


def test_boundaries_are_canonical(spark):
    from facetwise.operators import meshers

    loop = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0), (0.0, 1.0)]
    rows = [(f"t{k}", 0, j, *p) for k in range(5) for j, p in enumerate(loop[k:] + loop[:k])] + [("back", 0, j, *p) for j, p in enumerate(loop[::-1])] + [("near", 0, j, p[0] + 1e-14, p[1] - 1e-14) for j, p in enumerate(loop)]
    nodes = spark.createDataFrame(rows, "face string, loop int, ord int, u double, v double")
    got = {r["face"]: r["fingerprint"] for r in meshers.boundary_fingerprint(nodes, ["face"]).collect()}
    assert len({got[f"t{k}"] for k in range(5)} | {got["near"]}) == 1 and got["back"] != got["t0"]
    chain = [(0.0, 0.0), (0.6, 0.0), (1.2, 0.0), (1.8, 0.0), (3.0, 0.0), (3.0, 2.0), (0.5, 0.5)]  # steps under the tolerance of 1
    rep = spark.createDataFrame([("a", 0, j, *p) for j, p in enumerate(chain)] + [("b", 0, j, 0.0, 0.0) for j in range(3)], "face string, loop int, ord int, u double, v double")
    kept = {}
    for r in meshers.drop_repeats(rep, ["face"], 1.0).orderBy("face", "ord").collect():
        kept.setdefault(r["face"], []).append((r["u"], r["v"]))
    assert kept == {"a": [(0.0, 0.0), (1.2, 0.0), (3.0, 0.0), (3.0, 2.0)], "b": [(0.0, 0.0)]}
    edges = spark.createDataFrame([("a", l, j, 0.0, 0.0) for l, n in ((0, 3), (1, 2)) for j in range(n)], "face string, loop int, ord int, u double, v double")
    assert sorted((r["a"], r["b"]) for r in meshers.constrained_edges(edges, ["face"]).collect()) == [(0, 1), (1, 2), (2, 0), (3, 4), (4, 3)]


# ---- files ----


def test_mesh_files_by_ranges_of_bytes(spark, tmp_path):
    """One long file is read by many tasks; parts in order are one mesh; damaged ones are errors."""
    from facetwise.sources import meshes

    n = 20_000
    text = ["$MeshFormat", "2.2 0 8", "$EndMeshFormat", "$PhysicalNames", "2", '2 1 "face one"', '2 2 "b"', "$EndPhysicalNames", "$Nodes", str(n)]
    text += [f"{k} {k * 0.1!r} {k / 3!r}  -1e-3 " for k in range(1, n + 1)] + ["$EndNodes", "$Elements", str(n + 1), "7 15 2 0 1 5"]
    text += [f"{k + 8} 2 2 {k % 2 + 1} {k % 2 + 1} {k} {k % n + 1} {(k + 1) % n + 1}" for k in range(1, n + 1)] + ["$EndElements", ""]
    (tmp_path / "one.msh").write_text("\r\n".join(text))
    (tmp_path / "parts").mkdir()
    for k in range(4):
        (tmp_path / f"parts/part-{k:05d}").write_text("\n".join(text[k * 11_000 : (k + 1) * 11_000]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for where in ("one.msh", "parts"):
            got = meshes.read_msh(spark, str(tmp_path / where))
            assert got["nodes"].rdd.getNumPartitions() > 8
            assert {tuple(r) for r in got["nodes"].collect()} == {(k, k * 0.1, k / 3, -1e-3) for k in range(1, n + 1)}
            assert sorted(tuple(r) for r in got["triangles"].collect()) == sorted((k + 8, k % 2 + 1, k, k % n + 1, (k + 1) % n + 1) for k in range(1, n + 1))
            assert {tuple(r) for r in got["groups"].collect()} == {(1, "face one"), (2, "b")}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "cut.msh").write_text("\n".join(text[:500]))
    with pytest.raises(ValueError, match="Nodes has no end"):
        meshes.read_msh(spark, str(tmp_path / "cut.msh"))
    (tmp_path / "empty.msh").write_text("$MeshFormat\n2.2 0 8\n$EndMeshFormat\n")
    assert all(t.count() == 0 for t in meshes.read_msh(spark, str(tmp_path / "empty.msh")).values())
