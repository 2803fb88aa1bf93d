"""Links of candidates proved by the exact similarity (Jaccard) of their sets of shingles.

Candidates come as groups that may hold a link. A group is dealt into blocks of bounded bytes, and everything in a block
is compared: with all of the block if it is the group's only one, so that small groups are finished in one pass. Blocks
of larger groups all hold the group's first member too. What that pass does not join with the first member is then
compared with all members, one block of the rest with one block of all at a time. A row that is joined already is not
compared again, and a block returns spanning links, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwise.llm.components import components, to_own
from facetwise.scratch import Scratch

#: Rows and hashes (8 bytes each) of a block.
ROWS, HASHES = 2048, 1_000_000


def _spanning(g: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], share: tuple[int, int]) -> list[tuple[int, int]]:
    """Links (values of g) that join all rows with a similarity of share, one row of each link being one that asks."""
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)])
    label = np.unique(g, return_inverse=True)[1]
    mine, out, (part, whole) = np.zeros(len(code), bool), [], share
    for p in np.flatnonzero(asks):
        near = (whole * np.minimum(size, size[p]) >= part * np.maximum(size, size[p])) & (label != label[p])
        rest = np.flatnonzero(near)
        if not len(rest):
            continue
        own = code[first[p] : first[p + 1]]
        mine[own] = True
        if len(rest) < 64:
            common = np.array([np.count_nonzero(mine[code[first[r] : first[r + 1]]]) for r in rest])
        else:
            common = np.add.reduceat(mine[code], first[:-1], dtype=np.int64)[rest]
        mine[own] = False
        for r in rest[(whole + part) * common >= part * (size[p] + size[rest])]:
            if label[r] != label[p]:
                label[label == label[r]] = label[p]
                out.append((int(g[p]), int(g[r])))
    return out


def _block_links(dealt: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): spanning links of every block of dealt(root, i, j, g, asks, s); a block may go over several batches."""

    def run(batches):
        block, g, asks, sets = None, [], [], []

        def flush():
            found = _spanning(np.array(g), np.array(asks), sets, share) if len(set(g)) > 1 else []
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

        for batch in batches:
            for root, i, j, own, ask, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, i, j) != block:
                    if block is not None:
                        yield flush()
                    block, g, asks, sets = (root, i, j), [], [], []
                g.append(own)
                asks.append(ask)
                sets.append(np.frombuffer(s, np.uint64))
        if block is not None:
            yield flush()

    block = ["root", "i", "j"]
    dealt = dealt.select(*block, "g", "asks", "s").repartition(*block).sortWithinPartitions(*block)
    return dealt.mapInArrow(run, "a long, b long")


def _blocks(rows, hashes):
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(ROWS)), F.ceil(hashes / F.lit(HASHES))).cast("int")


def proved(sets: DataFrame, n: int, share: tuple[int, int], scratch: Scratch) -> DataFrame:
    """(node, root) for every row of sets(v, root, n, s) that is joined with another one of its root.

    v is unique; s holds n distinct hashes (8 bytes each, one at least); two rows of a root are linked if part / whole of
    the hashes of both are common, share being (part, whole). n bounds the number of rows. No rows give none.
    """
    sizes = sets.groupBy("root").agg(F.count("*").alias("rows_of"), _blocks(F.count("*"), F.sum("n")).alias("nb"), F.min("v").alias("p"))
    own = scratch.cut(sizes)
    every = to_own(sets, own, "root", n, scratch)
    part = "cast(pmod(xxhash64(v), nb) as int)"
    dealt = every.select("root", F.explode(F.expr(f"if(v = p, sequence(0, nb - 1), array({part}))")).alias("i"), F.lit(0).alias("j"), F.col("v").alias("g"), F.lit(True).alias("asks"), "s")
    found = scratch.cut(_block_links(dealt, share))
    large = own.where("nb > 1")
    if large.isEmpty():
        return components(found, scratch)
    joined = components(found, scratch)
    every = to_own(sets, large, "root", n, scratch).join(joined.withColumnRenamed("root", "g").hint("merge"), F.col("v") == F.col("node"), "left")
    every = scratch.cut(every.withColumn("g", F.coalesce("g", "v")).drop("node"))
    with_first = every.where("v = p").select("root", F.col("g").alias("gp"))
    every = to_own(every, with_first.join(own.select("root", "rows_of"), "root"), "root", n, scratch).withColumn("rest", F.col("g") != F.col("gp"))
    asking = every.where("rest").groupBy("root").agg(F.count("*").alias("rows_of"), _blocks(F.count("*"), F.sum("n")).alias("nr"))
    asking = asking.drop("rows_of").join(own.select("root", "rows_of"), "root")
    every = to_own(every, asking, "root", n, scratch)
    ask = every.where("rest").select("root", F.explode(F.expr("sequence(0, nb - 1)")).alias("i"), F.expr("cast(pmod(xxhash64(v, 1), nr) as int)").alias("j"), "g", F.lit(True).alias("asks"), "s")
    told = every.select("root", F.expr(part).alias("i"), F.explode(F.expr("sequence(0, nr - 1)")).alias("j"), "g", F.lit(False).alias("asks"), "s")
    return components(found.unionAll(_block_links(ask.unionAll(told), share)), scratch)
