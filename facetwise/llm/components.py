"""Connected components by alternating large-star and small-star contraction.

A round joins the links with the least neighbour of each vertex. A vertex with more than its share of the links (over
HEAVY_LEAST and over 1 / HEAVY of all) is joined by broadcast, so that no hub lands in one task; there are at most
2 HEAVY of them, whatever the input. The number of rounds is logarithmic in practice. Only links are moved, never
vertices without links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwise.scratch import Scratch

HEAVY, HEAVY_LEAST = 50_000, 64


def to_own(rows: DataFrame, own: DataFrame, key: str, total: int, scratch: Scratch) -> DataFrame:
    """rows joined with own on key; own has one row a key with `rows_of`, the number of rows that have it.

    total bounds the sum of rows_of. Keys with over total / HEAVY rows (HEAVY_LEAST at least) are broadcast if there are
    any: fewer than HEAVY of them. The rows of all other keys are shuffled, at every size.
    """
    cap = max(HEAVY_LEAST, total // HEAVY)
    own = scratch.cut(own)
    heavy = own.where(F.col("rows_of") > cap).drop("rows_of")
    if heavy.isEmpty():
        return rows.join(own.drop("rows_of").hint("merge"), key)
    heavy = F.broadcast(heavy)
    light = rows.join(heavy.select(key), key, "left_anti").join(own.where(F.col("rows_of") <= cap).drop("rows_of").hint("merge"), key)
    return rows.join(heavy, key).unionByName(light)


def _star(edges: DataFrame, n: int, small: bool, scratch: Scratch) -> DataFrame:
    """n edges(a, b) with a > b. Re-hang the larger (or smaller) neighbours of each vertex on its least neighbour."""
    out = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    if not small:
        out = out.unionAll(edges.select("b", "a"))
    least = out.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("rows_of")).withColumn("m", F.least("v", "m"))
    moved = to_own(out, least, "v", 2 * n, scratch)
    if small:
        hung = moved.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    else:
        hung = moved.where("u > v").select(F.col("u").alias("a"), F.col("m").alias("b"))
    return hung.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root) for every vertex of edges(a, b): root is the least vertex that it reaches.

    Self-links and nulls are ignored; either order and repeats of a link are allowed; no edges give no rows.
    """
    cur = scratch.cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    for _ in range(rounds):
        sign = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if sign["n"] == 0 or sign == before:
            break
        before = sign
        half = scratch.cut(_star(cur, sign["n"], False, scratch))
        nxt = scratch.cut(_star(half, sign["n"], True, scratch))
        scratch.drop(half)
        scratch.drop(cur)
        cur = nxt
    else:
        raise RuntimeError(f"components: no fixed point in {rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
