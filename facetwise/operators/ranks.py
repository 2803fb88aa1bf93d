"""Ranks and exact percentiles of tables and of groups of any size, without a task that holds a table or a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwise.scratch import Scratch


def written(df: DataFrame) -> DataFrame:
    """A summary that joins a large table, written once: its plan runs once, and Spark broadcasts it if its bytes allow."""
    return Scratch(df.sparkSession).cut(df)


def numbered(df: DataFrame, keys: list[str], name: str = "number", scratch: Scratch | None = None) -> DataFrame:
    """df with `name`, 1 .. n in the order of keys (null first).

    Range partitions, ranks inside, and offsets from their sizes. The partitions are written once with their numbers:
    were they made anew for ranks and for sizes, their bounds could differ between the two.
    """
    part = "part"
    while part in df.columns:
        part += "_"
    cut = (scratch or Scratch(df.sparkSession)).cut(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))
    inside = cut.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*keys)))
    sizes = cut.groupBy(part).agg(F.count("*").alias("c"))  # one row a partition
    before = F.coalesce(F.sum("c").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(part, before.alias("before"))
    return inside.join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col("before")).drop(part, "before")


def percentiles(df: DataFrame, wanted: list[tuple[str, Column, float]]) -> dict[str, Column]:
    """Exact, interpolated percentiles over all rows, as constant Columns by name: wanted has (name, value, share).

    Nulls and NaN don't count; null where nothing counts. Values are ranked by range partitions, so no task sees them
    all; two ranks of each are found by their numbers, and one row comes to the driver.
    """
    rows = F.array(*(F.struct(F.lit(k).alias("w"), value.cast("double").alias("x")) for k, (_, value, _) in enumerate(wanted)))
    ranked = numbered(df.select(F.inline(rows)).where("x is not null and not isnan(x)"), ["w", "x"])
    first = ranked.groupBy("w").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    share = F.element_at(F.array(*(F.lit(float(s)) for _, _, s in wanted)), F.col("w") + 1)
    at = F.col("first") + share * (F.col("n") - 1)
    need = first.select("w", at.alias("at"), F.explode(F.array(F.floor(at), F.ceil(at))).alias("number")).distinct()
    got = ranked.join(F.broadcast(need), ["w", "number"])
    low, high = F.min("x"), F.max("x")
    per = got.groupBy("w").agg((low + (high - low) * (F.first("at") - F.floor(F.first("at")))).alias("x"))
    found = {r["w"]: r["x"] for r in per.collect()}
    return {name: F.lit(found.get(k)).cast("double") for k, (name, _, _) in enumerate(wanted)}


def null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """left joined with right on by, where null groups are groups like others; right's other columns are appended."""
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    more = [F.col(f"r.{c}") for c in right.columns if c not in by]
    return left.alias("l").join(right.alias("r"), on, how).select("l.*", *more)


#: Bits of a place for the row inside its partition, as monotonically_increasing_id() has them.
_ROW_BITS = 33


def group_percentiles(df: DataFrame, by: list[str], wanted: list[tuple[str, Column, float | str]], scratch: Scratch | None = None) -> DataFrame:
    """One row a group: exact, interpolated percentiles by name. wanted has (name, value, share); share `upper` is the
    value at place n // 2 of the sorted ones, from 0.

    Nulls and NaN don't count; a group where none of its values counts has no row, a value that none counts for is null. All
    groups and values are ranked at once: rows are dealt by ranges of (group, value's number, value), with a tie-breaker
    so that not even equal values must be in one task, sorted there and written with their places. The runs of a group in
    the partitions, with their lengths, then tell at which places its ranks are; only these rows are fetched.
    """
    scratch = scratch or Scratch(df.sparkSession)
    own = [f"by_{k}" for k in range(len(by))]
    values: dict[str, tuple[int, Column]] = {}
    for _, value, _ in wanted:
        values.setdefault(str(value), (len(values), value))
    entries = F.array(*(F.struct(F.lit(k).alias("w"), value.cast("double").alias("x")) for k, value in values.values()))
    rows = df.select(*(F.col(c).alias(o) for c, o in zip(by, own, strict=True)), F.inline(entries)).where("x is not null and not isnan(x)")
    keys = [*own, "w", "x"]
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "tie").sortWithinPartitions(*keys).drop("tie")
    cut = scratch.cut(placed.withColumn("place", F.monotonically_increasing_id()))
    runs = cut.groupBy(*own, "w", F.shiftright("place", _ROW_BITS).alias("part")).agg(F.min("place").alias("begin"), F.count("*").alias("c"))
    group = Window.partitionBy(*own, "w")  # a row a partition that the group is in
    runs = runs.withColumn("n", F.sum("c").over(group)).withColumn("before", F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    asked = []
    for j, (_, value, share) in enumerate(wanted):
        at = F.floor(F.col("n") / 2).cast("double") if share == "upper" else F.lit(float(share)) * (F.col("n") - 1)
        asked += [F.struct(F.lit(values[str(value)][0]).alias("of"), F.lit(j).alias("j"), (at - F.floor(at)).alias("rest"), r(at).cast("long").alias("r")) for r in (F.floor, F.ceil)]
    need = runs.select(*own, "w", "before", "begin", "c", F.inline(F.array(*asked))).where("of = w and r >= before and r < before + c")
    got = need.select(*own, "j", "rest", (F.col("begin") + F.col("r") - F.col("before")).alias("place")).join(cut.select("place", "x"), "place")
    per = got.groupBy(*own, "j").agg((F.min("x") + (F.max("x") - F.min("x")) * F.first("rest")).alias("p"))
    out = per.groupBy(*own).agg(*(F.max(F.when(F.col("j") == j, F.col("p"))).alias(name) for j, (name, _, _) in enumerate(wanted)))
    return out.select(*(F.col(o).alias(c) for c, o in zip(by, own, strict=True)), *(name for name, _, _ in wanted))


def with_percentiles(statistics: DataFrame, df: DataFrame, by: list[str], wanted: list[tuple[str, Column, float]]) -> DataFrame:
    """statistics, a row a group of df (one row without by), with exact percentiles of df's values; see group_percentiles."""
    if not by:
        return statistics.withColumns(percentiles(df, wanted))
    return null_safe(statistics, group_percentiles(df, by, wanted), by)
