"""Joins of boxes (xlo .. zhi) by cells in all three axes: equal boxes, and boxes around boxes.

Both sides carry `tol`, the tolerance of their group. A group may fill many tasks: what meets in a cell is a few boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.operators.ranks import written

#: Grids of boxes differ by this power of two in the side of their cells.
STEP_BITS = 3


def contains(a: str, b: str, tol: Column) -> Column:
    """Whether box a contains box b to a tolerance; a and b are column prefixes."""
    test = F.lit(True)
    for x in "xyz":
        test = test & (F.col(f"{b}{x}lo") >= F.col(f"{a}{x}lo") - tol) & (F.col(f"{b}{x}hi") <= F.col(f"{a}{x}hi") + tol)
    return test


def prefixed(rows: DataFrame, prefix: str, by: list[str]) -> DataFrame:
    """rows with a prefix before all columns but by."""
    return rows.select(*by, *(F.col(c).alias(prefix + c) for c in rows.columns if c not in by))


def equal(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (l_.., r_..) of boxes that contain each other to the tolerance of their group.

    All six ends of equal boxes agree to tol, so left boxes are dealt by the cells of their ends (16 tol wide) and right
    ones ask in the one or two cells an end may be in. With a tolerance of 0 the ends must be equal.
    """
    l, r = prefixed(left, "l_", by), prefixed(right, "r_", by)
    on = list(by)
    for c in (x + e for x in "xyz" for e in ("lo", "hi")):
        cell = lambda v, tol: F.when(tol > 0, G.cell_of(v, F.when(tol > 0, tol * 16))).otherwise(v)
        l = l.withColumn("c_" + c, cell(F.col("l_" + c), F.col("l_tol")))
        ends = [cell(F.col("r_" + c) + sign * F.col("r_tol"), F.col("r_tol")) for sign in (-1, 0, 1)]
        r = r.withColumn("c_" + c, F.explode(F.array_distinct(F.array(*ends))))
        on.append("c_" + c)
    met = l.join(r, on).where(contains("l_", "r_", F.col("l_tol")) & contains("r_", "l_", F.col("l_tol")))
    return met.drop(*(c for c in on if c not in by))


def around(outer: DataFrame, inner: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (o_.., i_..) where the outer box contains the inner one to the tolerance of their group.

    The middle of an inner box is in the outer one, to tol. Every outer box is dealt into the cells that it touches of a
    grid for boxes of its own kind: along each axis a cell is at least as long as the box with its tolerance, and less than
    2^STEP_BITS times that, so it touches two cells an axis at most. Inner boxes ask in the cell of their middle in every
    grid that outer boxes of their group are in; thin and long boxes have grids of their own.
    """
    o, i = prefixed(outer, "o_", by), prefixed(inner, "i_", by)
    on = list(by)
    for x in "xyz":
        span = F.greatest(F.col(f"o_{x}hi") - F.col(f"o_{x}lo") + F.col("o_tol") * 2, F.lit(1e-300))
        o = o.withColumn("g_" + x, (F.ceil(F.log2(span) / STEP_BITS) * STEP_BITS).cast("int"))
    side = {x: F.pow(F.lit(2.0), F.col("g_" + x).cast("double")) for x in "xyz"}
    grids = written(o.select(*by, *("g_" + x for x in "xyz")).distinct())  # some tens a group: a row a kind of box
    i = i.join(grids, by)
    for x in "xyz":
        low, high = G.cell_of(F.col(f"o_{x}lo") - F.col("o_tol"), side[x]), G.cell_of(F.col(f"o_{x}hi") + F.col("o_tol"), side[x])
        o = o.withColumn("c_" + x, F.explode(F.array_distinct(F.array(low, F.least(low + 1, high), high))))
        i = i.withColumn("c_" + x, G.cell_of((F.col(f"i_{x}lo") + F.col(f"i_{x}hi")) / 2, side[x]))
        on += ["g_" + x, "c_" + x]
    return i.join(o, on).where(contains("o_", "i_", F.col("o_tol"))).drop(*(c for c in on if c not in by))


def tightest(outer: DataFrame, inner: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """inner with `o`, the least struct of the columns key of the outer boxes that contain it (see around); none, no row.

    Of equal outer boxes the least key counts, and equal inner boxes are asked for once, so copies are no pairs.
    """
    ends = [x + e for x in "xyz" for e in ("lo", "hi")]
    own = outer.groupBy(*by, *ends, "tol").agg(F.min(F.struct(*key)).alias("key"))
    asks = inner.select(*by, *ends, "tol").distinct()
    found = around(own, asks, by).groupBy(*by, *(F.col("i_" + e).alias(e) for e in ends)).agg(F.min("o_key").alias("o"))
    return inner.join(found, [*by, *ends])
