"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors at cosine >= t are at squared distance <= D = 2 - 2t. After a fixed random rotation (sign flips and
Walsh-Hadamard transforms) the coordinates are cut into blocks of about BLOCK_DIM, and block b gets the budget D_b,
proportional to its dimension. A pair within D is within D_b in some block, so range joins of all blocks find it.

The range join of a block deals vectors into cells by the signs of their first `bits` coordinates. If x and y are in
range and their signs differ in the coordinates F, then |x_F|^2 + |y_F|^2 <= D_b; so the one with the smaller |.|_F^2 has
it at most D_b / 2 and asks in the other's cell: each vector asks exactly the cells it reaches within that budget. A
pair is counted once: in its first block in range, by the cheaper asker. Every candidate is verified by its cosine in
double precision.

How many bits pay is estimated for each block on SAMPLE vectors: more bits compare fewer pairs but send every vector to
more cells. Vectors without any structure (independent coordinates) reach most cells whatever the cut, so on them the
exact join stays close to comparing all; on clustered ones the cells separate.

Equal vectors are one class throughout. Cells with more than CELL_CAP vectors or askers are split, so a task holds about
that many of each at most, whatever the input, and tasks return sums and spanning links, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.llm.common import Scratch
from facetwise.llm.components import components

THRESHOLD = 0.9
BLOCK_DIM = 16
CELL_CAP = 16_384
SAMPLE = 256
#: Relative costs of sending a vector to a cell and of comparing a pair there.
SEND, COMPARE = 2000.0, 1.0
#: Cells that are split are broadcast up to so many; beyond, they are joined by shuffle.
HOT_BROADCAST = 500_000
SLACK = 1e-9


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, padded to a power of two and rotated; element by element, so rows don't depend on each other."""
    n, d = x.shape
    width = 1 << max(0, (d - 1).bit_length())
    y = np.zeros((n, width))
    y[:, :d] = x / np.abs(x).max(1, keepdims=True)
    y /= np.sqrt(np.add.reduce(y * y, axis=1))[:, None]
    signs = np.random.default_rng(20).choice([-1.0, 1.0], (2, width))
    for s in signs:
        y *= s
        h = 1
        while h < width:
            z = y.reshape(n, width // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(n, width)
            h *= 2
        y /= math.sqrt(width)
    return y


class Plan:
    """Blocks, budgets and cells for vectors of one dimension."""

    def __init__(self, dim: int, n: int, sample: np.ndarray, threshold: float):
        """n vectors, of which sample are some, rotated."""
        width = 1 << max(0, (dim - 1).bit_length())
        self.cuts = [c for c in np.array_split(np.arange(width), max(1, round(width / BLOCK_DIM)))]
        self.budget = [(2 - 2 * threshold) * len(c) / width + SLACK for c in self.cuts]
        self.bits = [0] * len(self.cuts)
        for b, cut in enumerate(self.cuts):
            cost = []
            for bits in range(min(len(cut), max(0, math.ceil(math.log2(max(1, n))))) + 1):
                self.bits[b] = bits
                if bits > 12 and cost[-1] > cost[-2]:
                    break
                asks = len(self.asks(sample, b)[0]) / max(1, len(sample))
                cost.append(n * asks * SEND + n * n * asks / 2**bits * COMPARE)
            self.bits[b] = int(np.argmin(cost))

    def lead(self, y: np.ndarray, b: int) -> np.ndarray:
        return y[:, self.cuts[b][: self.bits[b]]]

    def home(self, y: np.ndarray, b: int) -> np.ndarray:
        return ((self.lead(y, b) < 0) << np.arange(self.bits[b])).sum(1).astype(np.int64)

    def asks(self, y: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): every cell that a row reaches by sign changes within half the budget."""
        z = self.lead(y, b) ** 2
        row, flips, cost = np.arange(len(y)), np.zeros(len(y), np.int64), np.zeros(len(y))
        for i in range(self.bits[b]):
            more = cost + z[row, i] <= self.budget[b] / 2 + SLACK
            row, flips, cost = (
                np.concatenate([row, row[more]]),
                np.concatenate([flips, flips[more] | (1 << i)]),
                np.concatenate([cost, cost[more] + z[row[more], i]]),
            )
        return row, self.home(y, b)[row] ^ flips

    def pairs(self, p: np.ndarray, h: np.ndarray, pid: np.ndarray, hid: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(asker, vector) of a cell that are in range first in block b and fall to this asker."""
        cut = self.cuts[b]
        ps, hs = p[:, cut].astype(np.float32), h[:, cut].astype(np.float32)
        # |p|^2 + |h|^2 - 2 p h <= budget, in one product; rounding is far under the margin
        near = np.hstack([ps, np.ones((len(ps), 1), np.float32)]) @ np.hstack([hs, -0.5 * (hs**2).sum(1, keepdims=True)]).T
        i, j = np.nonzero(near >= (0.5 * ((ps**2).sum(1) - self.budget[b]) - 1e-4)[:, None])
        keep = pid[i] != hid[j]
        i, j = i[keep], j[keep]
        for c in range(b + 1):
            d = np.add.reduce((p[i][:, self.cuts[c]] - h[j][:, self.cuts[c]]) ** 2, axis=1)
            keep = d <= self.budget[c] if c == b else d > self.budget[c]
            i, j = i[keep], j[keep]
        x, y = self.lead(p, b)[i], self.lead(h, b)[j]
        differ = (x < 0) != (y < 0)
        own, other = np.add.reduce(x * x * differ, axis=1), np.add.reduce(y * y * differ, axis=1)
        keep = (own < other) | ((own == other) & (pid[i] < hid[j]))
        return i[keep], j[keep]


def _counted(plans: dict[int, Plan]):
    """Class rows (vec) to counts of cells: dim, block, cell, vectors and askers."""

    def run(batches):
        for batch in batches:
            vec = batch.column(0)
            size = np.diff(vec.offsets.to_numpy())
            for dim in np.unique(size):
                own = batch.filter(pa.array(size == dim))
                y, plan = rotated(own.column(0).flatten().to_numpy().astype(np.float64).reshape(-1, dim)), plans[int(dim)]
                for b in range(len(plan.cuts)):
                    n = 1 << plan.bits[b]
                    h, p = np.bincount(plan.home(y, b), minlength=n), np.bincount(plan.asks(y, b)[1], minlength=n)
                    full = np.flatnonzero(h + p)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(full), dim, np.int32)), pa.array(np.full(len(full), b, np.int32)), pa.array(full), pa.array(h[full]), pa.array(p[full])],
                        ["dim", "b", "cell", "h", "p"],
                    )

    return run


def _spread(plans: dict[int, Plan]):
    """Class rows (cls, n, vec) to rows of cells: dim, block, cell, asks, cls, n, vec."""

    def run(batches):
        for batch in batches:
            vec = batch.column(2)
            size = np.diff(vec.offsets.to_numpy())
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                own = batch.take(pa.array(rows))
                y = rotated(own.column(2).flatten().to_numpy().astype(np.float64).reshape(-1, dim))
                plan = plans[int(dim)]
                for b in range(len(plan.cuts)):
                    asker, cell = plan.asks(y, b)
                    row = np.concatenate([np.arange(len(y)), asker])
                    cells = np.concatenate([plan.home(y, b), cell])
                    asks = np.arange(len(row)) >= len(y)
                    for at in range(0, len(row), 20_000):
                        part = own.take(pa.array(row[at : at + 20_000]))
                        m = part.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(m, dim, np.int32)),
                                pa.array(np.full(m, b, np.int32)),
                                pa.array(cells[at : at + 20_000]),
                                pa.array(asks[at : at + 20_000]),
                                *part.columns,
                            ],
                            ["dim", "b", "cell", "asks", "cls", "n", "vec"],
                        )

    return run


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cell(plan: Plan, b: int, t: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(class, links to rows of other classes, least class reached) for the linked classes of one cell."""
    asks = t.column("asks").to_numpy()
    if asks.all() or not asks.any():
        return None
    cls, n = t.column("cls").to_numpy(), t.column("n").to_numpy()
    x = t.column("vec").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(cls), -1)
    y = rotated(x)
    p, h = np.flatnonzero(asks), np.flatnonzero(~asks)
    left, right = [], []
    for at in range(0, len(p), 1024):
        part = p[at : at + 1024]
        i, j = plan.pairs(y[part], y[h], cls[part], cls[h], b)
        i, j = part[i], h[j]
        u, v = x[i] / np.abs(x[i]).max(1, keepdims=True), x[j] / np.abs(x[j]).max(1, keepdims=True)
        cos = np.add.reduce(u * v, axis=1) / np.sqrt(np.add.reduce(u * u, axis=1) * np.add.reduce(v * v, axis=1))
        left.append(i[cos >= threshold])
        right.append(j[cos >= threshold])
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return None
    ids, at = np.unique(cls, return_inverse=True)
    i, j, ni, nj = at[i], at[j], n[i], n[j]
    add = np.zeros(len(ids), np.int64)
    np.add.at(add, i, nj)
    np.add.at(add, j, ni)
    label = _least(len(ids), i, j)
    own = np.flatnonzero(add)
    return ids[own], add[own], ids[label[own]]


def _join(plans: dict[int, Plan], threshold: float):
    """Rows sorted by cell to (cls, links, root); a cell may go over several batches."""
    key = ["dim", "b", "cell", "hb", "pb"]

    def run(batches):
        held: pa.Table | None = None

        def flush(t: pa.Table):
            cells = np.stack([t.column(k).to_numpy() for k in key])
            cut = np.concatenate([[0], np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(0)) + 1, [t.num_rows]])
            out = []
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if z - a > 1:
                    dim, b = int(cells[0, a]), int(cells[1, a])
                    if got := _cell(plans[dim], b, t.slice(a, z - a), threshold):
                        out.append(got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["cls", "links", "root"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            last = [held.column(k)[-1].as_py() for k in key]
            same = np.ones(held.num_rows, bool)
            for k, v in zip(key, last, strict=True):
                same &= held.column(k).to_numpy() == v
            at = int(np.argmax(same))
            if at:
                yield from flush(held.slice(0, at).combine_chunks())
                held = held.slice(at).combine_chunks()
        if held is not None and held.num_rows:
            yield from flush(held)

    return run


def _samples(classes: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """About 4 SAMPLE vectors of each dimension by their hashes, in one job, of which the first SAMPLE are used."""
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, 4 * SAMPLE / n))))
    picked = classes.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < F.try_element_at(share, F.size("vec")) * (1 << 30))
    found: dict[int, list] = {d: [] for d in sizes}
    for r in picked.select("vec", F.xxhash64("vec").alias("h")).orderBy("h").toLocalIterator():
        if len(found[len(r["vec"])]) < SAMPLE:
            found[len(r["vec"])].append(r["vec"])
    return {d: np.array(rows, float).reshape(len(rows), d) for d, rows in found.items()}


def near_duplicates(
    vectors: DataFrame, spark: SparkSession, *, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None
) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors link at cosine >= threshold (over 0) in double precision, whatever their labels; rows with equal vectors link.
    Null, empty and zero vectors and those with null or non-finite components link with nothing and are their own
    component; vectors of different dimension never link. Repeated ids are rows of their own; a null id takes part, and
    is a component_id only if nothing else is there. Other columns are not read; an empty table gives no rows.
    """
    scratch = scratch or Scratch(spark)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vec"))
    ok = F.expr("coalesce(size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0), false)")
    classes = rows.where(ok).groupBy("vec").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    classes = scratch.cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    sizes = {r["d"]: r["count"] for r in classes.groupBy(F.size("vec").alias("d")).count().collect()}
    some = _samples(classes, sizes)
    plans = {d: Plan(d, n, rotated(some[d]), threshold) for d, n in sizes.items()}
    kind = classes.schema["vec"].dataType.simpleString()
    dealt = classes.select("cls", "n", "vec").mapInArrow(_spread(plans), f"dim int, b int, cell long, asks boolean, cls long, n long, vec {kind}")
    at = ["dim", "b", "cell"]
    counts = classes.select("vec").mapInArrow(_counted(plans), "dim int, b int, cell long, h long, p long")
    counts = scratch.cut(counts.groupBy(*at).agg(F.sum("h").alias("h"), F.sum("p").alias("p")))
    if sizes:
        hot = counts.where(f"h > {CELL_CAP} or p > {CELL_CAP}").select(*at, *(F.ceil(F.col(c) / CELL_CAP).cast("int").alias(c + "s") for c in "hp"))
        hot = scratch.cut(hot)
        dealt = dealt.join(F.broadcast(hot) if hot.count() <= HOT_BROADCAST else hot, at, "left")
        part = "cast(pmod(xxhash64(cls), {0}) as int)".format
        split = "if({0}, array({1}), sequence(0, {2} - 1))".format
        dealt = dealt.withColumn("hs", F.greatest(F.coalesce("hs", F.lit(1)), F.lit(1))).withColumn("ps", F.greatest(F.coalesce("ps", F.lit(1)), F.lit(1)))
        dealt = dealt.withColumn("hb", F.explode(F.expr(split("not asks", part("hs"), "hs"))))
        dealt = dealt.withColumn("pb", F.explode(F.expr(split("asks", part("ps"), "ps"))))
    else:
        dealt = dealt.withColumn("hb", F.lit(0)).withColumn("pb", F.lit(0))
    cells = [*at, "hb", "pb"]
    dealt = dealt.select(*cells, "asks", "cls", "n", "vec").repartition(*cells).sortWithinPartitions(*cells)
    found = scratch.cut(dealt.mapInArrow(_join(plans, threshold), "cls long, links long, root long"))
    comp = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.join(comp, classes["cls"] == comp["node"], "left").drop("node").withColumn("root", F.coalesce("root", "cls"))
    low = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = known.join(links, "cls", "left").join(low, "root").select("vec", "n", "links", "component_id")
    joined = rows.withColumn("ok", ok).join(known.withColumnRenamed("vec", "v"), F.col("ok") & (F.col("vec") == F.col("v")), "left")
    n_links = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long")
    component = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(key), n_links.alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
