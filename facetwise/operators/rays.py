"""First hits of rays on meshes, by a tree of cells over each mesh.

A level has cells a quarter as long as the one above. A triangle lives at the level of its own extent, so it is in two
cells an axis there, however small or large it is among the others. Many large triangles with many rays live at a finer
level, chosen by the counts: a ray meets few of them in its first cells, for more cells a triangle. Rays go down the tree
through the cells that they pass and that hold something, level by level: empty space costs nothing. What is left is a list
of cells a ray, by the distance at which it enters; these are tested front to back, in rounds, until a hit is nearer than the
next cell. A round deals the rays of a cell to blocks by the number of tests, not by bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.operators.ranks import written
from facetwise.scratch import Scratch

#: The finest level: triangles under 4^-LEVELS of a mesh's width live there. Cells of a ray in the first round, and the
#: factor by which there are more in each.
LEVELS, FIRST_CELLS, MORE_CELLS = 10, 1, 4
#: Cost of a triangle in a cell, in tests; how much fuller than the mean cells are where rays are; halvings of a mesh's width
#: that large triangles are dealt at, at most; tests of a block of a cell's rays, and of a task.
ENTRY, FULLER, HALVINGS, BLOCK, TASK = 8, 4, 9, 1_000_000, 4_000_000
CELL = ["mesh_id", "level", "ix", "iy", "iz"]


def _frames(tri: DataFrame) -> DataFrame:
    """(mesh_id, gx, gy, gz, w, far, least): corner and width of the cube around each mesh, its largest coordinate, and the
    least level of a triangle."""
    low = {x: F.min(F.least(*(F.col(p + x) for p in "abc"))) for x in "xyz"}
    high = {x: F.max(F.greatest(*(F.col(p + x) for p in "abc"))) for x in "xyz"}
    box = tri.groupBy("mesh_id").agg(*(low[x].alias("g" + x) for x in "xyz"), *(high[x].alias("h" + x) for x in "xyz"))
    width = F.greatest(*(F.col("h" + x) - F.col("g" + x) for x in "xyz"), F.lit(1e-300))
    return box.select("mesh_id", "gx", "gy", "gz", (width * (1 + 1e-9)).alias("w"), F.greatest(*(F.abs(p + x) for p in "gh" for x in "xyz")).alias("far"), F.lit(1).alias("least"))


def _extent() -> Column:
    return F.greatest(*(F.greatest(*(F.col(p + x) for p in "abc")) - F.least(*(F.col(p + x) for p in "abc")) for x in "xyz"))


def _fitted(frames: DataFrame, tri: DataFrame, rays: DataFrame) -> DataFrame:
    """frames with the least level and the width at which entries in cells and tests of rays cost least together.

    A side of w / 2^k is level k / 2 of the cube, or of a cube twice as wide. Triangles of an extent over the side are in about
    (extent / side + 1)^2 cells of it, of 8^k.
    """
    halvings = range(2, HALVINGS + 1)
    parts = F.col("extent") / F.col("w")
    entries = (F.sum(F.when(parts * 2**k > 1, (parts * 2**k + 1) * (parts * 2**k + 1)).otherwise(0.0)).alias(f"e{k}") for k in halvings)
    of = tri.select("mesh_id", _extent().alias("extent")).join(frames.select("mesh_id", "w"), "mesh_id").groupBy("mesh_id").agg(*entries)
    of = of.join(rays.groupBy("mesh_id").agg(F.count("*").alias("n_rays")), "mesh_id", "left")
    costs = (F.struct((F.col(f"e{k}") * (ENTRY + FULLER * F.coalesce("n_rays", F.lit(0)) / 8**k)).alias("c"), F.lit(k).alias("k")) for k in halvings)
    k = of.select("mesh_id", F.array_min(F.array(*costs))["k"].alias("k"))
    out = frames.drop("least").join(k, "mesh_id").withColumn("least", F.ceil(F.col("k") / 2).cast("int"))
    return out.withColumn("w", F.when(F.col("k") % 2 == 1, F.col("w") * 2).otherwise(F.col("w"))).drop("k")


def _side(level: Column) -> Column:
    return F.col("w") * F.pow(F.lit(0.25), level.cast("double"))


def _overlaps(x: str, y: str, reach: Column) -> Column:
    """If no edge of a triangle keeps it from the cell around (mx, my, mz), in the projection on two axes."""
    out = F.lit(True)
    for p, q, r in ("abc", "bca", "cab"):
        dx, dy = F.col(q + x) - F.col(p + x), F.col(q + y) - F.col(p + y)
        side = lambda u, v: dx * (v - F.col(p + y)) - dy * (u - F.col(p + x))  # noqa: E731, B023
        third, middle = side(F.col(r + x), F.col(r + y)), side(F.col("m" + x), F.col("m" + y))
        most = reach * (F.abs(dx) + F.abs(dy)) * (1 + 1e-6)
        out = out & (middle + most >= F.least(third, F.lit(0.0))) & (middle - most <= F.greatest(third, F.lit(0.0)))
    return out


def _cells(tri: DataFrame, frames: DataFrame) -> DataFrame:
    """tri with the cells that each triangle touches: at its own level at most two an axis (four if it is larger than a
    quarter of the mesh), more only where the mesh has a finer least level. Columns of cells are cut by the triangle's
    outline, what is left of them by its plane, so the rows made grow with the cells touched."""
    low = {x: F.least(*(F.col(p + x) for p in "abc")) for x in "xyz"}
    high = {x: F.greatest(*(F.col(p + x) for p in "abc")) for x in "xyz"}
    t = tri.join(frames, "mesh_id").withColumn("extent", _extent())
    level = F.when(F.col("extent") > F.col("w") * 0.25**LEVELS, F.floor(F.log2(F.col("w") / F.when(F.col("extent") > 0, F.col("extent"))) / 2)).otherwise(LEVELS)
    t = t.withColumn("level", F.least(F.greatest(level, "least"), F.lit(LEVELS)).cast("int"))
    t = t.withColumn("s", _side(F.col("level"))).withColumn("eps", F.col("s") * 1e-6 + F.col("far") * 1e-15)
    last = F.expr("shiftleft(1L, level * 2) - 1")
    at = lambda v, x: F.least(F.greatest(F.floor((v - F.col("g" + x)) / F.col("s")), F.lit(0).cast("long")), last)
    reach = F.col("s") / 2 + F.col("eps")
    a, b, c = G.point("a"), G.point("b"), G.point("c")
    t = t.withColumns(dict(zip(("nx", "ny", "nz"), G.cross(G.sub(b, a), G.sub(c, a)), strict=True)))
    for x in "xy":
        t = t.withColumn("i" + x, F.explode(F.sequence(at(low[x] - F.col("eps"), x), at(high[x] + F.col("eps"), x))))
    t = t.withColumns({"m" + x: F.col("g" + x) + (F.col("i" + x) + 0.5) * F.col("s") for x in "xy"}).where(_overlaps("x", "y", reach))
    # The plane over a column of cells: between these two, unless it is steep.
    flat = F.abs("nz") > (F.abs("nx") + F.abs("ny")) * 1e-3
    over = F.col("az") - (F.col("nx") * (F.col("mx") - F.col("ax")) + F.col("ny") * (F.col("my") - F.col("ay"))) / F.when(flat, F.col("nz"))
    about = (F.abs("nx") + F.abs("ny")) * reach * (1 + 1e-6) / F.when(flat, F.abs("nz")) + F.col("eps")
    t = t.withColumns({"over": over, "about": about})
    t = t.withColumn("from", F.greatest(low["z"] - F.col("eps"), F.col("over") - F.col("about"))).withColumn("to", F.least(high["z"] + F.col("eps"), F.col("over") + F.col("about"))).where("`from` <= `to`")
    t = t.withColumn("iz", F.explode(F.sequence(at(F.col("from"), "z"), at(F.col("to"), "z"))))
    t = t.withColumn("mz", F.col("gz") + (F.col("iz") + 0.5) * F.col("s"))
    n, middle = (F.col("nx"), F.col("ny"), F.col("nz")), (F.col("mx"), F.col("my"), F.col("mz"))
    meets = F.abs(G.dot(n, G.sub(middle, a))) <= reach * (F.abs(n[0]) + F.abs(n[1]) + F.abs(n[2])) * (1 + 1e-6)
    return t.where(meets & _overlaps("x", "z", reach) & _overlaps("y", "z", reach)).select(*CELL, "tri", *(p + x for p in "abc" for x in "xyz"))


def _tree(cells: DataFrame) -> DataFrame:
    """(mesh_id, level, ix, iy, iz, has, more): cells with triangles of their own level (has) or of finer ones (more)."""
    own = cells.select(*CELL).distinct()
    above = own.where("level > 1").withColumn("up", F.explode(F.expr("sequence(1, level - 1)")))
    shifted = above.select("mesh_id", (F.col("level") - F.col("up")).alias("level"), *(F.expr(f"shiftright({i}, 2 * up)").alias(i) for i in CELL[2:]), F.lit(False).alias("has"), F.lit(True).alias("more"))
    return own.withColumns({"has": F.lit(True), "more": F.lit(False)}).unionByName(shifted).groupBy(*CELL).agg(F.max("has").alias("has"), F.max("more").alias("more"))


def _passed(rows: DataFrame, level: int) -> DataFrame:
    """rows (a ray in a cell ix, iy, iz of the level above) to the cells of this level that the ray passes, with the place
    `enter` where it does, in units of its direction."""
    child = {x: F.shiftleft("i" + x, 2) + F.shiftright("k", 2 * n).bitwiseAND(F.lit(3)) for n, x in enumerate("xyz")}
    below = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumns({"i" + x: child[x] for x in "xyz"}).drop("k")
    s, slack = F.col("w") * 0.25**level, F.col("w") * 0.25**level * 1e-6 + (F.col("far") + F.greatest(*(F.abs("o" + x) for x in "xyz"))) * 1e-15
    first, last, inside = [F.lit(0.0)], [G.inf()], F.lit(True)
    for x in "xyz":
        o, d = F.col("o" + x), F.col("d" + x)
        low = F.col("g" + x) + F.col("i" + x) * s - slack
        high = low + s + slack * 2
        ends = [(v - o) / F.when(d != 0, d) for v in (low, high)]
        first.append(F.coalesce(F.least(*ends), F.lit(0.0)))
        last.append(F.coalesce(F.greatest(*ends), G.inf()))
        inside = inside & ((d != 0) | o.between(low, high))
    below = below.withColumns({"enter": F.greatest(*first), "leave": F.least(*last)})
    return below.where(inside & (F.col("enter") <= F.col("leave"))).drop("leave")


def _met(rows: DataFrame) -> DataFrame:
    """rows with t, where a ray meets a triangle, in units of its direction; null if it does not. In steps, so that each part
    is computed once."""
    a, o, d = G.point("a"), G.point("o"), G.point("d")
    e1, e2 = G.sub(G.point("b"), a), G.sub(G.point("c"), a)
    h, s = G.cross(d, e2), G.sub(o, a)
    rows = rows.withColumns({f"{n}{x}": v for n, p in (("h", h), ("q", G.cross(s, e1))) for x, v in zip("xyz", p, strict=True)})
    h, q, det = G.point("h"), G.point("q"), F.col("det")
    rows = rows.withColumn("det", G.dot(e1, h)).withColumn("det", F.when(F.abs(det) > 1e-14, det))
    rows = rows.withColumns({"u": G.dot(s, h) / det, "v": G.dot(d, q) / det, "t": G.dot(e2, q) / det})
    return rows.withColumn("t", F.expr("if(u >= 0 and v >= 0 and u + v <= 1 and t > 1e-9, t, null)"))


def _nearest(asked: DataFrame, cells: DataFrame, held: DataFrame, scratch: Scratch) -> DataFrame:
    """(mesh_id, ray, distance): the nearest hits of rays in the cells that asked names. held has the triangles of a cell
    (n_tri). The rays of a cell are dealt to blocks of about BLOCK tests, and tasks get about TASK."""
    sizes = asked.groupBy(*CELL).agg(F.count("*").alias("n_asks")).join(held, CELL)
    tests = F.col("n_asks") * F.col("n_tri")
    sizes = scratch.cut(sizes.select(*CELL, tests.alias("tests"), F.least(F.col("n_asks"), F.ceil(tests / F.lit(BLOCK))).cast("int").alias("blocks")))
    total = sizes.agg(F.sum("tests")).first()[0] or 0
    spark = asked.sparkSession
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK)), 20_000)
    rays = asked.join(sizes, CELL).withColumn("block", F.pmod(F.xxhash64("ray"), F.col("blocks")).cast("int")).drop("tests", "blocks")
    tris = cells.join(sizes, CELL).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("tests", "blocks")
    key = [*CELL, "block"]
    pairs = rays.repartition(n, *key).join(tris.repartition(n, *key).hint("merge"), key)
    pairs = _met(pairs.where(F.col("own_tri").isNull() | (F.col("own_tri") != F.col("tri"))))
    out = scratch.cut(pairs.groupBy("mesh_id", "ray").agg(F.min("t").alias("distance")).where("distance is not null"))
    scratch.drop(sizes)
    return out


def ray_hits(tri: DataFrame, rays: DataFrame, own: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(mesh_id, ray, distance): the nearest triangle of the mesh in front of each ray (ox .. oz, dx .. dz), if any.

    own names a column of rays with the triangle that a ray starts from, which it does not meet. Distances are in units of
    the direction; a triangle at which a ray only starts is not met. Rays without a direction, without coordinates or on
    unknown meshes hit nothing, triangles without coordinates are met by none; rays that share an id share a result.
    """
    scratch = scratch or Scratch(tri.sparkSession)
    known = lambda df, names: df.where(F.expr(" and ".join(f"{c} is not null and not isnan({c})" for c in names)))
    t = known(tri, [p + x for p in "abc" for x in "xyz"])
    r = known(rays, [p + x for p in "od" for x in "xyz"]).where(F.greatest(*(F.abs("d" + x) for x in "xyz")) > 0)
    r = r.select("mesh_id", "ray", *(p + x for p in "od" for x in "xyz"), (F.col(own) if own else F.lit(None).cast("long")).alias("own_tri"))
    frames = written(_fitted(written(_frames(t)), t, r))  # a row a mesh
    cells = scratch.cut(_cells(t, frames))
    tree = scratch.cut(_tree(cells))
    held = scratch.cut(cells.groupBy(*CELL).agg(F.count("*").alias("n_tri")))
    deepest = cells.agg(F.max("level")).first()[0] or 0
    now = r.join(frames, "mesh_id").withColumns({i: F.lit(0).cast("long") for i in CELL[2:]})
    found = None
    for level in range(1, deepest + 1):
        here = tree.where(F.col("level") == level).drop("level")
        met = scratch.cut(_passed(now, level).join(here, ["mesh_id", *CELL[2:]]))
        leaves = met.where("has").select("mesh_id", "ray", "own_tri", F.lit(level).alias("level"), *CELL[2:], "enter", *(p + x for p in "od" for x in "xyz"))
        found = leaves if found is None else found.unionByName(leaves)
        now = met.where("more").drop("has", "more", "enter")
    if found is None:
        return r.select("mesh_id", "ray", F.lit(None).cast("double").alias("distance")).limit(0)
    turn = Window.partitionBy("mesh_id", "ray").orderBy("enter", "level", *CELL[2:])
    open_ = scratch.cut(found.withColumn("turn", F.row_number().over(turn)))
    best, upto = [], FIRST_CELLS
    while True:
        best.append(_nearest(open_.where(F.col("turn") <= upto), cells, held, scratch))
        so_far = best[0]
        for more in best[1:]:
            so_far = so_far.unionByName(more)
        so_far = so_far.groupBy("mesh_id", "ray").agg(F.min("distance").alias("distance"))
        # Cells that a ray enters behind its hit are not asked any more.
        rest = scratch.cut(open_.where(F.col("turn") > upto).join(so_far, ["mesh_id", "ray"], "left").where(F.col("distance").isNull() | (F.col("distance") >= F.col("enter"))).drop("distance"))
        scratch.drop(open_)
        if rest.isEmpty():
            return so_far
        open_, upto = rest, upto * MORE_CELLS
