"""Mixing sources to target weights by Poisson replication, with DataFrame and SQL functions only.

Source s with share c_s of the rows and target weight w_s gets the mean repetition rate size * w_s / c_s. Each document
draws its number of copies by inverting the Poisson distribution at a uniform number hashed from seed and doc_id, is
exploded by that number (never collected), and the copies are dealt out and sorted by another hash: a global shuffle that
does not depend on the input order. A rate over PART is the sum of equal parts up to PART, drawn from hashes of their own:
a sum of independent Poisson numbers is Poisson with the sum of their means, and no exp(-rate) underflows. Rates are one
row a source; they are broadcast up to BROADCAST_DOUBLES numbers. Beyond, rates and documents meet by shuffle: every
rate is repeated SALTS times and documents go to them in turn, so no source is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = "mix-1"
#: Tabulated probabilities that are broadcast (8 bytes each), and the parts of a source where they are too many.
BROADCAST_DOUBLES = 2_000_000
SALTS = 64
#: Larger means are drawn in parts.
PART = 700
#: The distribution is tabulated so far beyond the mean; beyond, the probability is under 1e-18.
TAIL = "cast(ceil(part + 12 * sqrt(part) + 24) as int)"
#: Copies are numbered in blocks, so that no array grows with the rate.
COPIES = 4096


def uniform(seed: str, *parts: str) -> str:
    """SQL for a number in [0, 1) with 52 bits hashed from the seed and the parts."""
    text = ", ':', ".join([f"'{seed}'", *[f"coalesce(cast({p} as string), '')" for p in parts]])
    return f"cast(conv(substr(md5(concat({text})), 1, 13), 16, 10) as bigint) / 4503599627370496.0D"


def rates(docs: DataFrame, weights: dict[str, float] | None = None, *, size: float = 1.0) -> tuple[DataFrame, int]:
    """(mix_source, n, rate, parts, cdf) and how many numbers the cdfs have in all: sources get the share that weights give
    them, or equal shares, of size * rows.

    cdf is the distribution of one of `parts` draws with equal means. Sources without a weight get none; null is a source
    of its own, named '' like the empty one. Weights need not sum to 1. No documents give no rows.
    """
    counts = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is not None:
        pairs = [F.lit(x) for k, w in weights.items() for x in (k, float(w))]
        table = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
        counts = counts.withColumn("w", F.coalesce(F.try_element_at(table, F.col("mix_source")), F.lit(0.0)))
    else:
        counts = counts.withColumn("w", F.lit(1.0))
    whole = counts.agg(F.sum("n").alias("total"), F.sum("w").alias("weight")).first()
    total, weight = whole["total"] or 0, whole["weight"] or 0.0
    if weight > 0:
        rate = F.lit(float(size)) * F.lit(float(total)) * (F.col("w") / F.lit(float(weight))) / F.col("n")
    else:
        rate = F.lit(0.0)
    rated = counts.withColumn("rate", rate).withColumn("parts", F.expr(f"greatest(1L, cast(ceil(rate / {PART}) as bigint))"))
    rated = rated.withColumn("part", F.expr("rate / parts")).withColumn("top", F.expr(TAIL))
    first = "named_struct('p', exp(-part), 'c', array(exp(-part)))"
    step = "named_struct('p', s.p * part / i, 'c', concat(s.c, array(s.p * part / i + element_at(s.c, -1))))"
    cdf = f"aggregate(sequence(1, top), {first}, (s, i) -> {step}, s -> s.c)"
    numbers = rated.agg(F.coalesce(F.sum(F.col("top").cast("long") + 1), F.lit(0))).first()[0]
    return rated.select("mix_source", "n", "rate", "parts", F.expr(cdf).alias("cdf")), numbers


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, *, size: float = 1.0, seed: str = SEED) -> DataFrame:
    """docs with every row repeated by its draw, in a globally shuffled order; a column mix_copy counts from 1.

    Rows with equal doc_id draw alike (null doc_id draws as the empty text). No rows, or weights that match no source,
    give no rows. A column named mix_copy is replaced; all others stay, whatever their names. Any rate is drawn exactly;
    mix_copy is an int, so a row has at most 2^31 - 1 copies.
    """
    docs = docs.drop("mix_copy")
    rate, numbers = rates(docs, weights, size=size)
    # The row is one struct, so that its columns can't clash with those of the draw.
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.coalesce(docs["source"], F.lit("")).alias("mix_source"), docs["doc_id"].alias("doc_id"))
    table = rate.select("mix_source", "parts", "cdf")
    on = ["mix_source"]
    if numbers <= BROADCAST_DOUBLES:
        table = F.broadcast(table)
    else:
        table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        on.append("salt")
    several = f"aggregate(sequence(1L, parts), 0L, (n, j) -> n + size(filter(cdf, c -> c <= {uniform(seed + '/part', 'j', 'doc_id')})))"
    drawn = (
        rows.join(table, on)
        .withColumn("u", F.expr(uniform(seed, "doc_id")))
        .withColumn("n", F.expr(f"if(parts = 1, cast(size(filter(cdf, c -> c <= u)) as bigint), {several})"))
        .where("n > 0")
        .withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")))
        .withColumn("mix_copy", F.explode(F.expr(f"sequence(cast(block * {COPIES} + 1 as int), cast(least(n, (block + 1) * {COPIES}) as int))")))
    )
    order = F.md5(F.concat(F.lit(seed + "/order:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("mix_copy").cast("string")))
    out = drawn.select("row", "mix_copy", order.alias("place")).repartition("place").sortWithinPartitions("place")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns), "mix_copy")
