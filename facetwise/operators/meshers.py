"""Mesh generation per face, and the loops that bound faces.

Generators are sequential inside a face, so a face is a group and faces are the parallelism. They work in the parameter
plane stretched by a constant metric (lengths on the surface near the face's middle), with exact predicates.

  cdt      constrained Delaunay triangulation of the boundary and of a triangular lattice of the target size inside
  front    advancing front: the shortest front edge is closed by the best of nearby nodes or a new one
  front3d  as front, with new nodes placed in space and projected to the surface
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.operators.ranks import written

FACE = "face string, kind string, radius double, h double, exact_area double, loops array<array<struct<u:double,v:double>>>"
TRIANGLE = "face string, tri long, v0 long, v1 long, v2 long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"


def next_nodes(nodes: DataFrame, by: list[str]) -> DataFrame:
    """nodes(by, loop, ord, u, v) with u1, v1: the next node of the loop, cyclically."""
    w = Window.partitionBy(*by, "loop").orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumns({f"{c}1": F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in "uv"})


def loop_measures(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Signed area (counter-clockwise is positive) and length of the loops of each face."""
    n = next_nodes(nodes, by)
    du, dv = F.col("u1") - F.col("u"), F.col("v1") - F.col("v")
    return n.groupBy(*by).agg((F.sum(F.col("u") * F.col("v1") - F.col("u1") * F.col("v")) / 2).alias("area"), F.sum(F.sqrt(du * du + dv * dv)).alias("length"))


def orient_loops(nodes: DataFrame, by: list[str]) -> DataFrame:
    """nodes with is_outer (the loop of the largest area) and ord such that outer loops run counter-clockwise, inner ones clockwise."""
    area = loop_measures(nodes, [*by, "loop"]).select(*by, "loop", "area")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs("area")), "loop"))
    area = area.withColumn("is_outer", rank == 1)
    flip = (F.col("area") > 0) != F.col("is_outer")
    last = F.max("ord").over(Window.partitionBy(*by, "loop"))
    return nodes.join(area, [*by, "loop"]).withColumn("ord", F.when(flip, last - F.col("ord")).otherwise(F.col("ord"))).drop("area")


def loop_offsets(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, loop, n, offset): how many nodes the loops before have."""
    n = nodes.groupBy(*by, "loop").agg(F.count("*").alias("n"))
    return n.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("loop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def resample(nodes: DataFrame, by: list[str], target: float) -> DataFrame:
    """Each edge cut into max(1, round(length / target)) parts; nodes renumbered along the loop."""
    n = next_nodes(nodes, by)
    du, dv = F.col("u1") - F.col("u"), F.col("v1") - F.col("v")
    parts = F.greatest(F.lit(1), F.round(F.sqrt(du * du + dv * dv) / target)).cast("int")
    cut = n.withColumn("parts", parts).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    at = F.col("k") / F.col("parts")
    cut = cut.withColumns({"u": F.col("u") + du * at, "v": F.col("v") + dv * at})
    return cut.withColumn("ord", F.row_number().over(Window.partitionBy(*by, "loop").orderBy("ord", "k")) - 1).select(*by, "loop", "ord", "u", "v")


def _corners(low: Column, high: Column) -> Column:
    """The one or two cells from low to high, three at most where rounding adds one."""
    return F.array_distinct(F.array(low, F.least(low + 1, high), high))


def self_crossings(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, loop, n): pairs of edges of a loop that cross; a simple loop has no row.

    Edges meet in the cells of grids whose sides are powers of two: an edge is in at most two cells an axis of the grid of
    its own size, and asks there and in the grids of longer edges, so rows grow with the edges and the sizes that occur. A
    pair that shares several cells is looked at in the first of them only.
    """
    n = next_nodes(nodes, by)
    box = {c: (F.least(c, f"{c}1"), F.greatest(c, f"{c}1")) for c in "uv"}
    extent = F.greatest(*(high - low for low, high in box.values()), F.lit(1e-300))
    e = n.select(*by, "loop", "ord", "u", "v", "u1", "v1", F.ceil(F.log2(extent)).cast("int").alias("level"))

    def dealt(rows: DataFrame, prefix: str) -> DataFrame:
        side = F.pow(F.lit(2.0), F.col("at").cast("double"))
        for c in "uv":
            low, high = (G.cell_of(x, side) for x in box[c])
            rows = rows.withColumn(f"{prefix}low_{c}", low).withColumn(f"cell_{c}", F.explode(_corners(low, high)))
        return rows.select(*by, "loop", "at", "cell_u", "cell_v", *(F.col(c).alias(prefix + c) for c in ("ord", "level", "u", "v", "u1", "v1")), *(prefix + f"low_{c}" for c in "uv"))

    levels = written(e.select(*by, "loop", F.col("level").alias("at")).distinct())  # a row a loop and power of two
    home = dealt(e.withColumn("at", F.col("level")), "p")
    ask = dealt(e.join(levels, [*by, "loop"]).where(F.col("at") >= F.col("level")), "q")
    met = home.join(ask, [*by, "loop", "at", "cell_u", "cell_v"])
    met = met.where((F.col("qlevel") < F.col("plevel")) | ((F.col("qlevel") == F.col("plevel")) & (F.col("pord") < F.col("qord"))))
    met = met.where((F.col("cell_u") == F.greatest("plow_u", "qlow_u")) & (F.col("cell_v") == F.greatest("plow_v", "qlow_v")))
    cross = G.segments_cross(*(F.col(p + c) for p in "pq" for c in ("u", "v", "u1", "v1")))
    return met.where(cross).groupBy(*by, "loop").agg(F.count("*").alias("n"))


#: Edges that follow an edge and are looked at first: most loops that are not simple cross there.
NEXT_EDGES = 8


def _near_crossings(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, loop, crossed): whether an edge of the loop crosses one of the few that follow it."""
    n = next_nodes(nodes, by)
    of = Window.partitionBy(*by, "loop").orderBy("ord")
    ends = ("u", "v", "u1", "v1")
    # One array a node of the edges to come: nothing is dealt to cells.
    ahead = F.collect_list(F.struct(*ends)).over(of.rowsBetween(1, NEXT_EDGES))
    cross = F.exists("ahead", lambda q: G.segments_cross(*(F.col(c) for c in ends), *(q[c] for c in ends)))
    return n.withColumn("ahead", ahead).groupBy(*by, "loop").agg(F.max(F.coalesce(cross, F.lit(False))).alias("crossed"), F.count("*").alias("nodes"))


def loop_is_simple(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, loop, is_simple): whether no edges of a loop cross; a loop of fewer than three nodes is not simple.

    One crossing is enough, so all edges of a loop meet each other only where edges next to each other don't cross.
    """
    seen = written(_near_crossings(nodes, by))  # a row a loop
    rest = nodes.join(seen.where("nodes >= 3 and not crossed").select(*by, "loop"), [*by, "loop"], "left_semi")
    out = seen.join(self_crossings(rest, by), [*by, "loop"], "left")
    return out.select(*by, "loop", ((F.col("nodes") >= 3) & ~F.col("crossed") & F.col("n").isNull()).alias("is_simple"))


def winding(points: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, point, winding): turns of the face's loops around points(by, point, pu, pv); point is an id inside its face.

    An edge is in one or two bands of v whose height is the power of two above its own, and a point asks in its band of
    each height that its face has: rows grow with points and edges, not with their product. Points of faces without loops
    have no row; level edges turn nothing.
    """
    height = F.abs(F.col("v1") - F.col("v"))
    n = next_nodes(nodes, by).where(height > 0).withColumn("at", F.ceil(F.log2(height)).cast("int"))
    side = F.pow(F.lit(2.0), F.col("at").cast("double"))
    levels = written(n.select(*by, "at").distinct())  # a row a face and power of two
    low, high = (G.cell_of(x, side) for x in (F.least("v", "v1"), F.greatest("v", "v1")))
    n = n.withColumn("band", F.explode(_corners(low, high)))
    own = points.join(nodes.select(*by).distinct(), by, "left_semi")
    ask = own.select(*by, "point", "pu", "pv").join(levels, by).withColumn("band", G.cell_of(F.col("pv"), side))
    left = (F.col("u1") - F.col("u")) * (F.col("pv") - F.col("v")) - (F.col("pu") - F.col("u")) * (F.col("v1") - F.col("v"))
    up = (F.col("v") <= F.col("pv")) & (F.col("v1") > F.col("pv")) & (left > 0)
    down = (F.col("v") > F.col("pv")) & (F.col("v1") <= F.col("pv")) & (left < 0)
    turns = ask.join(n.select(*by, "at", "band", "u", "v", "u1", "v1"), [*by, "at", "band"]).groupBy(*by, "point").agg(F.sum(F.when(up, 1).when(down, -1).otherwise(0)).alias("winding"))
    return own.select(*by, "point").join(turns, [*by, "point"], "left").withColumn("winding", F.coalesce("winding", F.lit(0).cast("long")))


def constrained_edges(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b): the edges of all loops that a mesh must have, by node numbers that run on from loop to loop."""
    place = F.row_number().over(Window.partitionBy(*by, "loop").orderBy("ord")) - 1
    own = nodes.withColumn("place", place).join(loop_offsets(nodes, by), [*by, "loop"])
    return own.select(*by, (F.col("offset") + F.col("place")).alias("a"), (F.col("offset") + (F.col("place") + 1) % F.col("n")).alias("b"))


def _loop_rows(nodes: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, loop, seq): the nodes of each loop in order, as an array; a loop is one boundary of one face."""
    return nodes.groupBy(*by, "loop").agg(F.array_sort(F.collect_list(F.struct("ord", *columns))).alias("seq"))


def drop_repeats(nodes: DataFrame, by: list[str], tol: float = 1e-12) -> DataFrame:
    """nodes(by, loop, ord, u, v, ..) without those within tol of the last one kept, and, if more than two are left, without a
    last one within tol of the first. A fold along each loop: a chain of near nodes loses only what is near to the one kept."""
    rest = [c for c in nodes.columns if c not in (*by, "loop", "ord")]
    loops = _loop_rows(nodes, by, rest)
    gap = lambda p, q: F.sqrt((p["u"] - q["u"]) * (p["u"] - q["u"]) + (p["v"] - q["v"]) * (p["v"] - q["v"]))
    keep = lambda s, x: F.when(gap(x, F.element_at(s, -1)) > tol, F.concat(s, F.array(x))).otherwise(s)
    kept = loops.withColumn("kept", F.aggregate(F.expr("slice(seq, 2, size(seq))"), F.slice("seq", 1, 1), keep))
    size, last, first = F.size("kept"), F.element_at("kept", -1), F.element_at("kept", 1)
    closed = F.when((size > 2) & (gap(last, first) <= tol), F.slice("kept", F.lit(1), size - 1)).otherwise(F.col("kept"))
    return kept.select(*by, "loop", F.explode(closed).alias("n")).select(*by, "loop", "n.*")


def boundary_fingerprint(nodes: DataFrame, by: list[str], target: Column | None = None, digits: int = 12) -> DataFrame:
    """(by, fingerprint): 16 hex digits of a face's boundary, equal for equal loops whatever node each begins with.

    A loop is turned to its least rotation: of all nodes with the least rounded coordinates the begin that gives the least
    sequence. Loops count in their order; target, a Column over by, is part of the boundary, so are the signs of turns: a
    loop run backwards is another one.
    """
    xyz = [c for c in ("u", "v", "x", "y", "z") if c in nodes.columns]
    text = F.concat_ws(",", *(F.format_string(f"%.{digits}f", F.bround(c, digits) + 0.0) for c in xyz))
    loops = _loop_rows(nodes.withColumn("text", text), by, ["text"]).withColumn("texts", F.transform("seq", lambda n: n["text"]))
    n = F.size("texts")
    least = F.array_min("texts")
    begins = F.filter(F.sequence(F.lit(1), n), lambda k: F.element_at(F.col("texts"), k) == least)
    turned = lambda k: F.array_join(F.concat(F.slice("texts", k, n), F.slice("texts", F.lit(1), k - 1)), ";")
    loops = loops.select(*by, "loop", F.array_min(F.transform(begins, turned)).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("loop", "line"))), lambda x: x["line"]), "|")
    out = loops.groupBy(*by).agg(lines.alias("lines"))
    head = F.lit("") if target is None else F.format_string("%.12f", target.cast("double"))
    return out.select(*by, F.substring(F.sha2(F.concat_ws("#", head, "lines"), 256), 1, 16).alias("fingerprint"))


def grid(specs: DataFrame) -> DataFrame:
    """specs(face, n, size, skew): n x n squares cut in two, rows shifted by skew; the scripted mesh of tests."""
    cells = specs.withColumn("i", F.explode(F.expr("sequence(0, n - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, n - 1)"))).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    node = lambda di, dj: (F.col("j") + dj) * (F.col("n") + 1) + F.col("i") + di
    x = lambda di, dj: (F.col("i") + di + F.col("skew") * (F.col("j") + dj)) * F.col("size") / F.col("n")
    y = lambda dj: (F.col("j") + dj) * F.col("size") / F.col("n")
    first, second = ((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1))
    pick = lambda f, k: F.when(F.col("half") == 0, f(*first[k])).otherwise(f(*second[k]))
    cols = [((F.col("j") * F.col("n") + F.col("i")) * 2 + F.col("half")).cast("long").alias("tri")]
    cols += [pick(node, k).cast("long").alias(f"v{k}") for k in range(3)]
    for k, c in enumerate("abc"):
        cols += [pick(x, k).cast("double").alias(c + "x"), pick(lambda di, dj: y(dj), k).cast("double").alias(c + "y"), F.lit(0.0).alias(c + "z")]
    return cells.select("face", *cols)


def cases(spark: SparkSession) -> DataFrame:
    """Six analytic faces with known areas."""
    box = lambda u0, u1, v0, v1: [(u0, v0), (u1, v0), (u1, v1), (u0, v1)]
    band = lambda a, b: 100 * 1.2 * (math.cos(a) - math.cos(b))
    rows = [
        ("plane", "plane", 0.0, 0.15, 1.0, [box(0, 1, 0, 1)]),
        ("lshape", "plane", 0.0, 0.3, 3.0, [[(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]]),
        ("hole", "plane", 0.0, 0.25, 8.0, [box(0, 3, 0, 3), box(1, 2, 1, 2)[::-1]]),
        ("cylinder", "cylinder", 10.0, 1.0, 50.0, [box(0, 1, 0, 5)]),
        ("sphere_band", "sphere", 10.0, 1.5, band(0.9, 2.2), [box(0, 1.2, 0.9, 2.2)]),
        ("sphere_pole", "sphere", 10.0, 1.5, band(0.05, 1.2), [box(0, 1.2, 0.05, 1.2)]),
    ]
    return spark.createDataFrame([(*r[:5], [[(float(u), float(v)) for u, v in loop] for loop in r[5]]) for r in rows], FACE)


def scores(triangles: DataFrame, faces: DataFrame) -> DataFrame:
    """Triangles, ideal number, area error in percent, shape and least angle of each meshed face."""
    m = G.with_triangle_metrics(triangles)
    s = m.groupBy("face").agg(
        F.count("*").alias("n_triangles"), F.sum("area").alias("area"), F.min("shape").alias("shape_min"), F.avg("shape").alias("shape_mean"),
        F.min("min_angle").alias("min_angle"), F.max(F.greatest("l1", "l2", "l3")).alias("longest"),
    )
    out = s.join(faces.select("face", "h", "exact_area"), "face")
    return out.select(
        "face", "n_triangles", (F.col("exact_area") / (F.col("h") * F.col("h") * (math.sqrt(3) / 4))).alias("ideal"),
        ((F.col("area") / F.col("exact_area") - 1) * 100).alias("area_error"), "shape_min", "shape_mean", "min_angle", (F.col("longest") / F.col("h")).alias("max_length"),
    )


# ---- inside a face -------------------------------------------------------------------------------------------------

Pt = tuple[float, float]


def orient(a: Pt, b: Pt, c: Pt) -> int:
    """Sign of the area of abc, exact."""
    left, right = (a[0] - c[0]) * (b[1] - c[1]), (a[1] - c[1]) * (b[0] - c[0])
    det = left - right
    if abs(det) > 1e-12 * (abs(left) + abs(right)):
        return (det > 0) - (det < 0)
    fa, fb, fc = ([Fraction(x) for x in p] for p in (a, b, c))
    det = (fa[0] - fc[0]) * (fb[1] - fc[1]) - (fa[1] - fc[1]) * (fb[0] - fc[0])
    return (det > 0) - (det < 0)


def in_circle(a: Pt, b: Pt, c: Pt, d: Pt) -> int:
    """1 if d is inside the circle of counter-clockwise abc, -1 outside, 0 on it; exact."""

    def det(p: list[list]) -> tuple:
        rows = [(x, y, x * x + y * y) for x, y in ((q[0] - p[3][0], q[1] - p[3][1]) for q in p[:3])]
        (x1, y1, z1), (x2, y2, z2), (x3, y3, z3) = rows
        terms = (x1 * (y2 * z3 - y3 * z2), -y1 * (x2 * z3 - x3 * z2), z1 * (x2 * y3 - x3 * y2))
        return sum(terms), sum(map(abs, terms))

    value, size = det([a, b, c, d])
    if abs(value) <= 1e-11 * size:
        value, _ = det([[Fraction(x) for x in p] for p in (a, b, c, d)])
    return (value > 0) - (value < 0)


def crosses(p: Pt, q: Pt, r: Pt, s: Pt) -> bool:
    """Whether segments without a common end cross or touch."""
    o1, o2, o3, o4 = orient(p, q, r), orient(p, q, s), orient(r, s, p), orient(r, s, q)
    if o1 * o2 < 0 and o3 * o4 < 0:
        return True
    on = lambda a, b, c: min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    return (o1 == 0 and on(p, q, r)) or (o2 == 0 and on(p, q, s)) or (o3 == 0 and on(r, s, p)) or (o4 == 0 and on(r, s, q))


class Patch:
    """A surface of a kind, and the stretched parameter plane of a face."""

    def __init__(self, kind: str, radius: float, loops: list[list[Pt]]):
        self.kind, self.r = kind, radius
        us, vs = [u for x in loops for u, _ in x], [v for x in loops for _, v in x]
        mid = (min(vs) + max(vs)) / 2
        self.su, self.sv = {"plane": (1.0, 1.0), "cylinder": (radius, 1.0), "sphere": (radius * max(math.sin(mid), 0.05), radius)}[kind]
        if kind != "plane" and max(us) - min(us) >= 2 * math.pi - 1e-9:
            raise ValueError("a face that closes on itself has to be cut at its seam first")

    def space(self, p: Pt) -> tuple[float, float, float]:
        u, v = p[0] / self.su, p[1] / self.sv
        if self.kind == "plane":
            return u, v, 0.0
        if self.kind == "cylinder":
            return -self.r * math.sin(u), self.r * math.cos(u), v
        return self.r * math.sin(v) * math.cos(u), self.r * math.sin(v) * math.sin(u), self.r * math.cos(v)

    def normal(self, p: Pt) -> tuple[float, float, float]:
        """Along du x dv."""
        if self.kind == "plane":
            return 0.0, 0.0, 1.0
        x, y, z = self.space(p)
        return (-x / self.r, -y / self.r, -z / self.r) if self.kind == "sphere" else (x / self.r, y / self.r, 0.0)

    def plane(self, x: tuple[float, float, float], near: Pt) -> Pt:
        """Projection to the surface, in the stretched plane, on the turn nearest to a point."""
        if self.kind == "plane":
            return x[0], x[1]
        if self.kind == "cylinder":
            u, v = math.atan2(-x[0], x[1]), x[2]
        else:
            n = math.sqrt(sum(c * c for c in x)) or 1.0
            u, v = math.atan2(x[1], x[0]), math.acos(max(-1.0, min(1.0, x[2] / n)))
        u += 2 * math.pi * round((near[0] / self.su - u) / (2 * math.pi))
        return u * self.su, v * self.sv

    def stretch(self, v: float) -> float:
        """Length on the surface of a step in x at y = v, over that in the plane."""
        return max(math.sin(v / self.sv), 1e-3) * self.r / self.su if self.kind == "sphere" else 1.0

    def length(self, p: Pt, q: Pt) -> float:
        return math.dist(self.space(p), self.space(q))


def _boundary(patch: Patch, loops: list[list[Pt]], h: float) -> tuple[list[Pt], list[tuple[int, int]]]:
    """Nodes of the size h along the loops, outer counter-clockwise and inner clockwise, and their edges."""
    nodes: list[Pt] = []
    edges: list[tuple[int, int]] = []
    area = lambda x: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(x, x[1:] + x[:1], strict=True)) / 2
    stretched = [[(u * patch.su, v * patch.sv) for u, v in loop] for loop in loops]
    outer = max(range(len(loops)), key=lambda k: abs(area(stretched[k])))
    for k, loop in enumerate(stretched):
        loop = loop if (area(loop) > 0) == (k == outer) else loop[::-1]
        first = len(nodes)
        for p, q in zip(loop, loop[1:] + loop[:1], strict=True):
            steps = [(p[0] + (q[0] - p[0]) * t / 8, p[1] + (q[1] - p[1]) * t / 8) for t in range(9)]
            n = max(1, round(sum(patch.length(a, b) for a, b in zip(steps, steps[1:], strict=False)) / h))
            nodes += [(p[0] + (q[0] - p[0]) * t / n, p[1] + (q[1] - p[1]) * t / n) for t in range(n)]
        edges += [(i, i + 1 if i + 1 < len(nodes) else first) for i in range(first, len(nodes))]
    return nodes, edges


def _turns(p: Pt, nodes: list[Pt], edges: list[tuple[int, int]]) -> int:
    n = 0
    for i, j in edges:
        a, b = nodes[i], nodes[j]
        if (a[1] <= p[1]) != (b[1] <= p[1]):
            side = orient(a, b, p)
            n += (side > 0) if b[1] > p[1] else -(side < 0)
    return n


class Delaunay:
    """Incremental Delaunay triangulation as a map from directed edges to the opposite vertex."""

    def __init__(self, points: list[Pt]):
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        cx, cy, w = (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2, 20 * max(max(xs) - min(xs), max(ys) - min(ys), 1e-9)
        self.p = [(cx - w, cy - w), (cx + w, cy - w), (cx, cy + w)]
        self.apex: dict[tuple[int, int], int] = {}
        self._add(0, 1, 2)
        self.last = (0, 1)
        for q in points:
            self.insert(q)

    def _add(self, a: int, b: int, c: int) -> None:
        self.apex[a, b], self.apex[b, c], self.apex[c, a] = c, a, b
        self.last = (a, b)

    def _remove(self, a: int, b: int, c: int) -> None:
        for e in ((a, b), (b, c), (c, a)):
            self.apex.pop(e, None)

    def _locate(self, q: Pt) -> tuple[int, int, int]:
        """A triangle that has q in or on it, by walking from the last one."""
        a, b = self.last if self.last in self.apex else next(iter(self.apex))
        for _ in range(4 * len(self.apex) + 16):
            c = self.apex[a, b]
            for x, y in ((a, b), (b, c), (c, a)):
                if orient(self.p[x], self.p[y], q) < 0:
                    if (y, x) not in self.apex:
                        break
                    a, b = y, x
                    break
            else:
                return a, b, c
        return next((a, b, c) for (a, b), c in self.apex.items() if all(orient(self.p[x], self.p[y], q) >= 0 for x, y in ((a, b), (b, c), (c, a))))

    def insert(self, q: Pt) -> int:
        k = len(self.p)
        self.p.append(q)
        first = self._locate(q)
        cavity, todo, rim = set(), [first], []
        while todo:
            t = todo.pop()
            key = frozenset(t)
            if key in cavity:
                continue
            cavity.add(key)
            for x, y in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                z = self.apex.get((y, x))
                if z is not None and frozenset((x, y, z)) not in cavity:
                    if in_circle(self.p[y], self.p[x], self.p[z], q) > 0 or orient(self.p[x], self.p[y], q) == 0:
                        todo.append((y, x, z))
                    else:
                        rim.append((x, y))
                elif z is None:
                    rim.append((x, y))
        inner = [tuple(c) for c in cavity]
        gone = set()
        for c in inner:
            s = set(c)
            gone |= {(x, y) for x in s for y in s if x != y and self.apex.get((x, y)) in s}
        rim = [(x, y) for x, y in rim if (x, y) in gone and not ((y, x) in gone)]
        for e in gone:
            self.apex.pop(e, None)
        for x, y in rim:
            if orient(self.p[x], self.p[y], q) > 0:
                self._add(x, y, k)
        return k

    def recover(self, i: int, j: int) -> bool:
        """Make ij an edge by flipping the edges that cross it."""
        for _ in range(400):
            if (i, j) in self.apex or (j, i) in self.apex:
                return True
            crossing = [(a, b) for (a, b), c in self.apex.items() if a < b and i not in (a, b) and j not in (a, b) and (b, a) in self.apex and crosses(self.p[a], self.p[b], self.p[i], self.p[j])]
            flipped = False
            for a, b in crossing:
                if (a, b) not in self.apex or (b, a) not in self.apex:
                    continue
                c, d = self.apex[a, b], self.apex[b, a]
                if orient(self.p[c], self.p[d], self.p[b]) > 0 and orient(self.p[d], self.p[c], self.p[a]) > 0:
                    self._remove(a, b, c)
                    self._remove(b, a, d)
                    self._add(c, d, b)
                    self._add(d, c, a)
                    flipped = True
            if not flipped:
                return False
        return False

    def triangles(self) -> list[tuple[int, int, int]]:
        return [(a, b, c) for (a, b), c in self.apex.items() if a < b and a < c]


def _lattice(patch: Patch, nodes: list[Pt], edges: list[tuple[int, int]], h: float) -> list[Pt]:
    """Interior nodes: rows of the height of equilateral triangles, every other one shifted, clear of the boundary."""
    y0, y1 = min(p[1] for p in nodes), max(p[1] for p in nodes)
    x0, x1 = min(p[0] for p in nodes), max(p[0] for p in nodes)
    out, row = [], h * math.sqrt(3) / 2
    n = max(1, round((y1 - y0) / row))
    for k in range(1, n):
        y = y0 + (y1 - y0) * k / n
        step = h / patch.stretch(y)
        m = max(1, round((x1 - x0) / step))
        for i in range(m + 1):
            p = (x0 + (x1 - x0) * (i + (0.5 if k % 2 else 0.0)) / m, y)
            if _turns(p, nodes, edges) > 0 and all(_gap(patch, p, nodes[a], nodes[b]) > 0.55 * h for a, b in edges):
                out.append(p)
    return out


def _gap(patch: Patch, p: Pt, a: Pt, b: Pt) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy or 1.0)))
    return patch.length(p, (a[0] + dx * t, a[1] + dy * t))


def constrained_delaunay(patch: Patch, loops: list[list[Pt]], h: float) -> tuple[list[Pt], list[tuple[int, int, int]]]:
    nodes, edges = _boundary(patch, loops, h)
    points = nodes + _lattice(patch, nodes, edges, h)
    d = Delaunay(points)
    for i, j in edges:
        if not d.recover(i + 3, j + 3):
            raise ValueError("a boundary edge can't be recovered: the boundary crosses itself")
    keep = []
    for a, b, c in d.triangles():
        if min(a, b, c) >= 3:
            centre = tuple(sum(d.p[x][k] for x in (a, b, c)) / 3 for k in (0, 1))
            if _turns(centre, nodes, edges) > 0:
                keep.append((a - 3, b - 3, c - 3))
    return points, keep


class _Grid:
    """Edges of the front by the cells that their boxes touch."""

    def __init__(self, p: list[Pt], size: float):
        self.p, self.size, self.cells = p, size, {}

    def _box(self, x0: float, y0: float, x1: float, y1: float):
        s = self.size
        return ((i, j) for i in range(math.floor(x0 / s), math.floor(x1 / s) + 1) for j in range(math.floor(y0 / s), math.floor(y1 / s) + 1))

    def _of(self, e: tuple[int, int]):
        (ax, ay), (bx, by) = self.p[e[0]], self.p[e[1]]
        return self._box(min(ax, bx), min(ay, by), max(ax, bx), max(ay, by))

    def add(self, e: tuple[int, int]) -> None:
        for c in self._of(e):
            self.cells.setdefault(c, set()).add(e)

    def remove(self, e: tuple[int, int]) -> None:
        for c in self._of(e):
            self.cells[c].discard(e)

    def near(self, x0: float, y0: float, x1: float, y1: float) -> set[tuple[int, int]]:
        """Edges whose boxes may touch a box."""
        if (x1 - x0) * (y1 - y0) > self.size * self.size * 4 * len(self.cells):  # more cells than there are
            return set().union(*self.cells.values())
        out: set[tuple[int, int]] = set()
        for c in self._box(x0, y0, x1, y1):
            out |= self.cells.get(c, set())
        return out


@dataclass
class FrontStats:
    """What an advancing front did: triangles on new nodes and on nodes that were there, edges put back for want of an apex,
    and edges left open."""

    new_nodes: int = 0
    reused_nodes: int = 0
    stalls: int = 0
    open_edges: int = 0

    @property
    def closed(self) -> bool:
        return self.open_edges == 0


def advancing_front(patch: Patch, loops: list[list[Pt]], h: float, *, in_space: bool = False) -> tuple[list[Pt], list[tuple[int, int, int]], FrontStats]:
    """Nodes, triangles grown from the boundary, and what happened; a front that can't close with good shapes is closed with
    poorer ones. Candidates are compared with the edges and nodes of the front near them only."""
    p, edges = _boundary(patch, loops, h)
    p, boundary, stats = list(p), (list(p), list(edges)), FrontStats()
    front, heap, out, grid = set(edges), [], [], _Grid(p, 1.5 * h)
    push = lambda e: heapq.heappush(heap, (patch.length(p[e[0]], p[e[1]]), e))
    for e in edges:
        push(e)
        grid.add(e)

    def around(q: Pt, far: float) -> set[tuple[int, int]]:
        """Edges of the front with a point within a distance (on the surface) of q, and maybe more."""
        far *= 1.3  # chords are shorter than arcs
        narrow = min(patch.stretch(q[1] + k * far) for k in (-1, 0, 1))
        return grid.near(q[0] - far / narrow, q[1] - far, q[0] + far / narrow, q[1] + far)

    def quality(i: int, j: int, q: Pt) -> float:
        if orient(p[i], p[j], q) <= 0:
            return -1.0
        a, b, c = patch.space(p[i]), patch.space(p[j]), patch.space(q)
        l1, l2, l3 = math.dist(a, b), math.dist(b, c), math.dist(c, a)
        s = (l1 + l2 + l3) / 2
        return 4 * math.sqrt(3) * math.sqrt(max(s * (s - l1) * (s - l2) * (s - l3), 0.0)) / (l1 * l1 + l2 * l2 + l3 * l3)

    def apex(i: int, j: int) -> Pt:
        base = patch.length(p[i], p[j])
        height = max(math.sqrt(max(h * h - base * base / 4, 0.0)) if h > base / 2 else base * math.sqrt(3) / 2, 0.35 * base)
        mid = ((p[i][0] + p[j][0]) / 2, (p[i][1] + p[j][1]) / 2)
        if in_space:
            a, b, n = patch.space(p[i]), patch.space(p[j]), patch.normal(mid)
            e = [(y - x) / base for x, y in zip(a, b, strict=True)]
            up = (n[1] * e[2] - n[2] * e[1], n[2] * e[0] - n[0] * e[2], n[0] * e[1] - n[1] * e[0])
            return patch.plane(tuple((x + y) / 2 + u * height for x, y, u in zip(a, b, up, strict=True)), mid)
        s = patch.stretch(mid[1])
        dx, dy = (p[j][0] - p[i][0]) * s, p[j][1] - p[i][1]
        n = math.hypot(dx, dy) or 1.0
        return mid[0] - dy / n * height / s, mid[1] + dx / n * height

    def fits(i: int, j: int, k: int | None, q: Pt, floor: float) -> bool:
        if quality(i, j, q) < floor:
            return False
        ends = {i, j, k}
        xs, ys = (p[i][0], p[j][0], q[0]), (p[i][1], p[j][1], q[1])
        for a, b in grid.near(min(xs), min(ys), max(xs), max(ys)):
            if (a, b) == (i, j):
                continue
            for x in (i, j):
                if k is not None and ((a, b) in ((x, k), (k, x))):
                    continue
                common = {a, b} & {x, k}
                if not common:
                    if crosses(p[a], p[b], p[x], q):
                        return False
                elif len(common) == 1 and orient(p[a], p[b], q) == 0 and orient(p[a], p[b], p[x]) == 0:
                    return False
            for x in (a, b):
                if x not in ends and orient(p[i], p[j], p[x]) >= 0 and orient(p[j], q, p[x]) >= 0 and orient(q, p[i], p[x]) >= 0:
                    return False
        if k is None:
            close = around(q, 0.7 * h)
            return _turns(q, *boundary) > 0 and all(patch.length(p[x], q) > 0.6 * h for e in close for x in e) and all(_gap(patch, q, p[a], p[b]) > 0.4 * h for a, b in close if (a, b) != (i, j))
        return True

    for floor, reach in ((0.3, 1.6), (0.05, 2.5), (1e-6, 6.0)):
        stalled: list = []
        while heap:
            size, (i, j) = heapq.heappop(heap)
            if (i, j) not in front:
                continue
            ideal = apex(i, j)
            near = sorted((k for k in {x for e in around(ideal, reach * h) for x in e} - {i, j} if patch.length(p[k], ideal) < reach * h), key=lambda k: (-quality(i, j, p[k]), k))
            close = [k for k in near if patch.length(p[k], ideal) < 0.75 * h]
            k = next((k for k in close if fits(i, j, k, p[k], floor)), None)
            if k is None and fits(i, j, None, ideal, floor):
                p.append(ideal)
                k = len(p) - 1
                stats.new_nodes += 1
                stats.reused_nodes -= 1
            if k is None:
                k = next((k for k in near if fits(i, j, k, p[k], floor)), None)
            if k is None:
                stalled.append((size, (i, j)))
                stats.stalls += 1
                continue
            stats.reused_nodes += 1
            out.append((i, j, k))
            front.discard((i, j))
            grid.remove((i, j))
            for a, b in ((i, k), (k, j)):
                if (b, a) in front:
                    front.discard((b, a))
                    grid.remove((b, a))
                else:
                    front.add((a, b))
                    grid.add((a, b))
                    push((a, b))
            far = 1.3 * (reach + 2) * h  # an edge put back is tried again once the front has changed near it
            again = [x for x in stalled if patch.length(p[x[1][0]], p[k]) < far]
            stalled = [x for x in stalled if patch.length(p[x[1][0]], p[k]) >= far]
            for x in again:
                heapq.heappush(heap, x)
        heap = stalled
    _split_flat(patch, p, out, front)
    stats.open_edges = len(front)
    return p, out, stats


def _split_flat(patch: Patch, p: list[Pt], tri: list[tuple[int, int, int]], front: set[tuple[int, int]]) -> None:
    """Close holes of three edges without area: the triangle behind the longest edge is cut at the node that lies on it."""
    for a, b in list(front):
        c = next((y for x, y in front if x == b and (y, a) in front), None)
        if (a, b) not in front or c is None:
            continue
        x, y = max(((a, b), (b, c), (c, a)), key=lambda e: patch.length(p[e[0]], p[e[1]]))
        middle = ({a, b, c} - {x, y}).pop()
        for k, t in enumerate(tri):
            turned = next((t[n:] + t[:n] for n in range(3) if (t[n], t[(n + 1) % 3]) == (y, x)), None)
            if turned:
                halves = [(y, middle, turned[2]), (middle, x, turned[2])]
                if all(orient(*(p[i] for i in h)) > 0 for h in halves):
                    tri[k : k + 1] = halves
                    front -= {(a, b), (b, c), (c, a)}
                break


def _facing(patch: Patch, p: list[Pt], tri: list[tuple[int, int, int]]) -> bool:
    """Whether all triangles face along the surface's normal."""
    for t in tri:
        a, b, c = (patch.space(p[k]) for k in t)
        u, v = [y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)]
        n = patch.normal((sum(p[k][0] for k in t) / 3, sum(p[k][1] for k in t) / 3))
        if n[0] * (u[1] * v[2] - u[2] * v[1]) + n[1] * (u[2] * v[0] - u[0] * v[2]) + n[2] * (u[0] * v[1] - u[1] * v[0]) <= 0:
            return False
    return True


def mesh(faces: DataFrame, method: str) -> DataFrame:
    """Triangles of every face of faces (FACE columns) by a method.

    A face that can't be meshed fails its task with the reason: a boundary that crosses itself, a front that doesn't close,
    triangles turned over.
    """
    if method not in ("cdt", "front", "front3d"):
        raise ValueError(f"no mesher {method!r}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for f in pdf.to_dict("records"):
            loops = [[(n["u"], n["v"]) for n in loop] for loop in f["loops"]]
            patch = Patch(f["kind"], f["radius"], loops)
            if method == "cdt":
                p, tri = constrained_delaunay(patch, loops, f["h"])
            else:
                p, tri, stats = advancing_front(patch, loops, f["h"], in_space=method == "front3d")
                if not stats.closed:
                    raise ValueError(f"face {f['face']}: the front did not close, {stats.open_edges} edges are open")
            if not _facing(patch, p, tri):
                raise ValueError(f"face {f['face']}: triangles are turned over")
            x = [patch.space(q) for q in p]
            rows += [(f["face"], k, *t, *x[t[0]], *x[t[1]], *x[t[2]]) for k, t in enumerate(tri)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TRIANGLE.split(", ")])

    return faces.groupBy("face").applyInPandas(run, TRIANGLE)


def front_statistics(faces: DataFrame, method: str) -> DataFrame:
    """(face, n_triangles, new_nodes, reused_nodes, stalls, open_edges, closed) of the advancing front on every face."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for f in pdf.to_dict("records"):
            loops = [[(n["u"], n["v"]) for n in loop] for loop in f["loops"]]
            _, tri, s = advancing_front(Patch(f["kind"], f["radius"], loops), loops, f["h"], in_space=method == "front3d")
            rows.append((f["face"], len(tri), s.new_nodes, s.reused_nodes, s.stalls, s.open_edges, s.closed))
        return pd.DataFrame(rows, columns=["face", "n_triangles", "new_nodes", "reused_nodes", "stalls", "open_edges", "closed"])

    return faces.groupBy("face").applyInPandas(run, "face string, n_triangles long, new_nodes long, reused_nodes long, stalls long, open_edges long, closed boolean")
