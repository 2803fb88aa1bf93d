"""Audit of sources: how far the terms of a source lie from those of its language and of the other sources.

Every source of a language gives each of the language's V kept terms a share p = 1 + floor(UNIT (n + 1) / (N + V)); its
distance from a share q is floor((p - q)^2 / q). Nearly all counts are 0, so only what occurs is stored. A term that
neither of two sources has adds the same to their distance, whatever the term: V times this baseline, corrected by what
the terms of one, of the other and of both add beyond it, is the whole sum. The corrections by one source alone depend
only on the count of the term, so they are made from a histogram of counts. The first terms of a source are found by
radix select (`ranking`).
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetwise.llm import ranking
from facetwise.llm.common import Scratch, texts

#: Documents of a language that a kept term is in at least, the unit of shares, terms reported of a source.
LEAST_DOCS, UNIT, TOP = 3, 1_000_000_000, 200
#: Different (source, term) pairs that a task holds before it hands them on.
HELD = 400_000
#: A-Z become a-z; what belongs to no term becomes a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Texts are cut into terms in stretches of so many bytes, or up to the next space.
CHUNK = 1 << 22
_SPACE = re.compile(b" ")


def _terms(text: bytes):
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        gap = _SPACE.search(text, at + CHUNK)
        end = gap.end() if gap else len(text)
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences of a term and documents that have it, as partial sums by task."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def full():
            for (lang, source), (n, d) in held.items():
                if n:
                    size, keys = len(n), pa.array(list(n), pa.binary()).cast(pa.string())
                    counts = pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), keys, *counts], schema=schema)
            held.clear()

        size = 0
        for b in batches:
            for text, lang, source in zip(texts(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for terms in _terms(text):
                    n.update(terms)
                    own.update(terms)
                d.update(own)
                size += len(n) - before
                if size >= HELD:
                    yield from full()
                    size = 0
        yield from full()

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, d long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (n + 1) / (total + kept)), exact: two long divisions whose products stay in 64 bits.

    That holds for up to 9e13 occurrences of kept terms in a language.
    """
    of = total + kept
    high = (n + 1) * F.lit(100_000).cast("long")
    rest = (high % of) * F.lit(10_000).cast("long")
    return F.lit(1).cast("long") + _div(high, of) * F.lit(10_000).cast("long") + _div(rest, of)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): shares are 10^9 + 1 at most, so the square has 60 bits."""
    return _div((p - q) * (p - q), q)


def audit(docs: DataFrame, spark: SparkSession, *, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) by language and source.

    Part `pair`: item is another source of the language, value the distances of this source's shares from that one's,
    summed over all kept terms. Part `term`: item is a kept term that the source has, at a share above the language's;
    value is the distance, only the first `top` are kept. Ranks go by value descending, then by the bytes of the item;
    items are different, so no ranks tie.

    Null texts, languages and sources count as ''. A group (lang, source) without terms takes part with baseline shares;
    a language without kept terms has only pairs of value 0; texts of any length are read whole; repeated rows count
    each; no documents give no rows; other columns are not read.
    """
    scratch = Scratch(spark)
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    # All that is needed of a term meets in one task: a row a source and task, each a partial sum.
    met = term_counts(own).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of = Window.partitionBy("lang", "term")
    cells = met.select("*", F.sum("n").over(of).alias("ln"), F.sum("d").over(of).alias("ld"), (F.min("source").over(of) == F.col("source")).alias("is_first"))
    cells = scratch.cut(cells.where(F.col("ld") >= LEAST_DOCS).select("lang", "source", "term", "n", "ln", "is_first"))
    langs = cells.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("is_first").cast("long")).alias("kept"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("lang_total", zero).alias("lang_total"), F.coalesce("kept", zero).alias("kept"))
    # Without kept terms there is no share; 1 stands for it and is multiplied by none.
    base = F.when(F.col("kept") == 0, F.lit(1).cast("long")).otherwise(share(zero, F.col("total"), F.greatest("kept", F.lit(1))))
    groups = scratch.cut(groups.withColumn("base", base).withColumn("gid", F.monotonically_increasing_id()))
    shares = cells.join(groups, ["lang", "source"]).select("lang", "source", "gid", "term", "base", "n", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("ln"), F.col("lang_total"), F.col("kept")).alias("q"))
    shares = scratch.cut(shares)
    terms = scratch.cut(shares.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value")))
    first = ranking.top(terms, ["lang", "source"], "value", "item", top, scratch).withColumn("part", F.lit("term"))
    pairs = _pairs(groups, shares, scratch)
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranks)).withColumn("part", F.lit("pair"))
    columns = "lang", "source", "part", "item", "value", "rank"
    return pairs.select(*columns).unionByName(first.select(*columns))


def _pairs(groups: DataFrame, shares: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language: V times the baseline and corrections."""
    a = groups.select("lang", "source", F.col("gid").alias("a"), F.col("base").alias("ab"), "kept")
    b = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"), F.col("base").alias("bb"))
    ab, bb, p, q = (F.col(c) for c in ("ab", "bb", "p", "q"))
    both = scratch.cut(a.join(b, "lang").where("a <> b").withColumn("rest", distance(ab, bb)))
    # Terms of one source against the baseline of another: a histogram of the shares, so a row a different share and pair.
    seen = shares.groupBy("gid", "p").agg(F.count("*").alias("c"))
    alone = both.select("a", "b", "ab", "bb", "rest")
    of_a = seen.withColumnRenamed("gid", "a").join(alone, "a").select("a", "b", (F.col("c") * (distance(p, bb) - F.col("rest"))).alias("v"))
    of_b = seen.withColumnRenamed("gid", "b").join(alone, "b").select("a", "b", (F.col("c") * (distance(ab, p) - F.col("rest"))).alias("v"))
    # Terms of both, each pair of sources once: what the two histograms added is taken back.
    left = shares.select("lang", "term", F.col("gid").alias("x"), F.col("p").alias("xp"), F.col("base").alias("xb"))
    right = shares.select("lang", "term", F.col("gid").alias("y"), F.col("p").alias("yp"), F.col("base").alias("yb"))
    xp, xb, yp, yb = (F.col(c) for c in ("xp", "xb", "yp", "yb"))

    def beyond(p, pb, q, qb):
        return distance(p, q) - distance(p, qb) - distance(pb, q) + distance(pb, qb)

    met = left.join(right, ["lang", "term"]).where("x < y").groupBy("x", "y").agg(F.sum(beyond(xp, xb, yp, yb)).alias("xy"), F.sum(beyond(yp, yb, xp, xb)).alias("yx"))
    of_both = met.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b"), F.col("xy").alias("v")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"), F.col("yx").alias("v")))).alias("e")).select("e.*")
    corrections = of_a.unionByName(of_b).unionByName(of_both).groupBy("a", "b").agg(F.sum("v").alias("v"))
    value = F.col("kept") * F.col("rest") + F.coalesce("v", F.lit(0).cast("long"))
    return both.join(corrections, ["a", "b"], "left").select("lang", "source", "item", value.alias("value"))
