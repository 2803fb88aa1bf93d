"""The first k rows of every group by radix select: histograms over the bits of a value, then over the bytes of an item.

A round counts, for every group, the rows by the next digit of the value, among those that share the digits found so far;
the digit at which the counts from the top reach k is the next one. So the k-th value of every group is known after
VALUE_BITS / DIGIT_BITS counts that are combined before the shuffle, and no group is ever sorted. Rows that tie at the
k-th value are told apart the same way by the bytes of their item. Then at most k rows a group are left to be ranked.
"""

from __future__ import annotations

import os.path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from facetwise.llm.common import Scratch

#: Values are 0 .. 2^VALUE_BITS - 1. A count has at most 2^DIGIT_BITS rows a group.
VALUE_BITS, DIGIT_BITS = 64, 16
#: Bytes of an item that tell tied rows apart in a round, after those that all of a group share.
ITEM_BYTES = 4


@F.pandas_udf(IntegerType())
def _shared(low: pd.Series, high: pd.Series) -> pd.Series:
    """The number of bytes with which the least and the greatest item, and so all between them, begin alike."""
    return pd.Series([len(os.path.commonprefix([bytes(a), bytes(b)])) for a, b in zip(low, high, strict=True)], dtype="int32")


def _reached(counts: DataFrame, by: list[str], digit: str, down: bool) -> DataFrame:
    """(by, digit, need, n): the digit at which the counts reach `need`, with what is needed of its n rows.

    counts has one row a group and digit: by, digit, n, need. A group whose counts don't reach need has no row.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(digit) if down else F.asc(digit)).rowsBetween(Window.unboundedPreceding, 0)
    total = counts.withColumn("upto", F.sum("n").over(order))
    found = total.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    return found.select(*by, digit, (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "n")


def top(rows: DataFrame, by: list[str], value: str, item: str, k: int, scratch: Scratch) -> DataFrame:
    """The first k rows of every group `by`, with `rank` from 1: by value descending, then by item in the order of its bytes.

    rows are read several times and so should be written; by, value (0 or more, not null) and item (a string) are not
    null, and an item occurs once in a group. Groups of k rows or fewer are returned whole; no rows give none. Columns
    with names of this function's own (need, n, upto, digit, head, tied) must not be among those of rows.
    """
    found = None  # (by, digit, need, n): digits of the k-th value so far
    for shift in range(VALUE_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        head = F.shiftrightunsigned(value, shift)
        if found is None:
            left = rows.withColumn("head", head).withColumn("need", F.lit(k).cast("long"))
        else:
            left = rows.withColumn("head", head).join(found.select(*by, F.col("head").alias("above"), "need"), by).where(F.shiftrightunsigned("head", DIGIT_BITS) == F.col("above")).drop("above")
        counts = left.groupBy(*by, "head").agg(F.count("*").alias("n"), F.first("need").alias("need"))
        found = scratch.cut(_reached(counts, by, "head", down=True))
    least = found.select(*by, F.col("head").alias("kth"), "need", F.col("n").alias("tied"))
    # A group with fewer than k rows has no k-th value: all of its rows are taken.
    marked = rows.join(least, by, "left")
    taken = marked.where(F.col("kth").isNull() | (F.col(value) > F.col("kth")) | ((F.col(value) == F.col("kth")) & (F.col("need") == F.col("tied")))).select(*rows.columns)
    ties = scratch.cut(marked.where((F.col(value) == F.col("kth")) & (F.col("need") < F.col("tied"))).select(*rows.columns, "need"))
    parts = [taken]
    while not ties.isEmpty():
        raw = F.col(item).cast("binary")
        span = ties.groupBy(*by).agg(F.min(raw).alias("low"), F.max(raw).alias("high")).withColumn("at", _shared("low", "high")).drop("low", "high")
        digits = scratch.cut(ties.join(span, by).withColumn("digit", F.expr(f"substring(cast({item} as binary), at + 1, {ITEM_BYTES})")).drop("at"))
        counts = digits.groupBy(*by, "digit").agg(F.count("*").alias("n"), F.first("need").alias("need"))
        found = scratch.cut(_reached(counts, by, "digit", down=False))
        here = digits.drop("need").join(found.withColumnRenamed("digit", "edge"), by)
        inside = (F.col("digit") < F.col("edge")) | ((F.col("digit") == F.col("edge")) & (F.col("need") == F.col("n")))
        parts.append(here.where(inside).select(*rows.columns))
        ties = scratch.cut(here.where((F.col("digit") == F.col("edge")) & (F.col("need") < F.col("n"))).select(*rows.columns, "need"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.asc(item))))
