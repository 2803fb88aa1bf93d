"""Analytics of meshing runs: iterations as rows, outcomes, best iterations, plateaus and oscillation.

Iterations have run, idx and what is asked for; every window is over one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetwise.operators.ranks import numbered


def _order(lower: int | None = None, upper: int = 0):
    """Window over the iterations of a run, in order; with a frame if lower is given."""
    w = Window.partitionBy("run").orderBy("idx")
    return w if lower is None else w.rowsBetween(lower, upper)


def best_iteration(it: DataFrame) -> DataFrame:
    """The best valid iteration of each run: ready before not, then the score; the earliest of equals."""
    w = Window.partitionBy("run").orderBy(F.desc("ready"), F.desc("score"), "idx")
    return it.where("is_valid").withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def plateau(it: DataFrame, eps: float = 1e-3) -> DataFrame:
    """it with `plateau`: the last two scores gained under eps on the one before them. False before the third."""
    gain = F.max("score").over(_order(-1)) - F.lag("score", 2).over(_order())
    return it.withColumn("plateau", F.coalesce(gain < eps, F.lit(False)))


def ineffective(it: DataFrame) -> DataFrame:
    """it with `ineffective`: same non-zero triangle count, same codes and the same score (to 1e-9) as the iteration before."""
    prev = lambda c: F.lag(c).over(_order())
    same = (F.col("n_tri") == prev("n_tri")) & (F.col("n_tri") > 0) & (F.col("code") == prev("code")) & (F.abs(F.col("score") - prev("score")) < 1e-9)
    return it.withColumn("ineffective", F.coalesce(same, F.lit(False)))


def oscillation(it: DataFrame, key: str) -> DataFrame:
    """(run, idx): the first iteration of each run that repeats an earlier request."""
    seen = Window.partitionBy("run", key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    again = it.withColumn("n", F.count("*").over(seen)).where("n > 1")
    return again.groupBy("run").agg(F.min("idx").alias("idx"))


def prior_attempts(it: DataFrame, code: str) -> DataFrame:
    """it with `prior`: earlier iterations of the run with this code."""
    return it.withColumn("prior", F.coalesce(F.count_if(F.col("code") == code).over(_order(Window.unboundedPreceding, -1)), F.lit(0)))


def running_best(it: DataFrame) -> DataFrame:
    """it with `best_so_far`, the largest valid score up to here (null before the first)."""
    return it.withColumn("best_so_far", F.max(F.when(F.col("is_valid"), F.col("score"))).over(_order(Window.unboundedPreceding)))


def outcome_counts(runs: DataFrame) -> DataFrame:
    """(outcome, n, share)"""
    out = runs.groupBy("outcome").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def last_iterations(it: DataFrame) -> DataFrame:
    w = Window.partitionBy("run").orderBy(F.desc("idx"))
    return it.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def upper_median(df: DataFrame, column: str, by: list[str] | None = None, name: str = "median") -> DataFrame:
    """The element at n // 2 of the sorted values: not an interpolation. Ranked in a window per group, over whole tables by
    range partitions; never collected."""
    if not by:
        ranked = numbered(df.where(F.col(column).isNotNull()).select(column), [column], "r")
        return ranked.where(F.col("r") == ranked.count() // 2 + 1).select(F.col(column).alias(name))
    w = Window.partitionBy(*by).orderBy(column)
    n = Window.partitionBy(*by)
    own = df.where(F.col(column).isNotNull()).withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(n))
    return own.where("r = floor(n / 2) + 1").select(*by, F.col(column).alias(name))


def dedup(records: DataFrame) -> DataFrame:
    """Of records with one (model, outcome, n_iterations) the first by file and place."""
    w = Window.partitionBy("model", "outcome", "n_iterations").orderBy("file", "place")
    return records.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def to_do(files: DataFrame, outcomes: DataFrame, *, force: bool = False, only: str | None = None) -> DataFrame:
    """Files to run: those not accepted yet, those with one outcome (`only`), or all (force)."""
    own = files.join(outcomes, "file", "left")
    if force:
        return own
    if only is not None:
        return own.where(F.col("outcome") == only)
    return own.where(F.coalesce(F.col("outcome") != "accepted", F.lit(True)))


def exploded(records: DataFrame) -> DataFrame:
    """Nested records as iterations: model, outcome, index, n_triangles, score, codes and missed objectives."""
    it = records.select("model", "outcome", F.posexplode_outer("iterations").alias("pos", "i"))
    return it.select(
        "model", "outcome", "pos", "i.index", "i.n_triangles", "i.score", "i.is_valid", "i.ready",
        F.transform("i.failures", lambda f: f["code"]).alias("codes"),
        F.transform(F.filter("i.objectives", lambda o: ~o["satisfied"]), lambda o: o["name"]).alias("missed"),
    )


def aggregate(records: DataFrame) -> dict[str, DataFrame]:
    """Outcomes, failure codes (all iterations), missed objectives (last iteration of runs neither accepted nor escalated),
    and a row per part with its best mesh."""
    it = exploded(records)
    last = F.element_at("iterations", -1)
    open_ = records.where(~F.col("outcome").isin("accepted", "escalated") & (F.size("iterations") > 0))
    missed = open_.select(F.explode(F.filter(last["objectives"], lambda o: ~o["satisfied"])).alias("o")).groupBy(F.col("o.name").alias("name"))
    best = F.filter("iterations", lambda i: i["index"] == F.col("best_index"))
    part = records.select(
        "model", "outcome", F.size("iterations").alias("n_iterations"), (F.size("iterations") > 1).alias("adapted"), "elapsed_seconds",
        F.when(F.size(best) > 0, F.get(best, F.lit(0))["n_triangles"]).alias("best_triangles"),
    )
    return {
        "outcomes": outcome_counts(records),
        "failures": it.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")),
        "missed": missed.agg(F.count("*").alias("n")),
        "parts": part,
    }


def stem_of(path):
    """The name of a file without its folders and its last suffix."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def elapsed(it: DataFrame, at: str = "ts") -> DataFrame:
    """it with `elapsed`: seconds since the first iteration of its run."""
    seconds = F.col(at).cast("timestamp").cast("double")
    return it.withColumn("elapsed", seconds - F.first(seconds).over(_order(Window.unboundedPreceding)))


def spec_changes(rules: DataFrame) -> DataFrame:
    """rules(run, idx, kind, scope, params) to (run, idx, op, kind, scope, param, old, new): what each iteration changed
    against the one before: rules added (+), removed (-), parameters changed (~). The first iteration changes nothing."""
    now = rules.select("run", "idx", "kind", "scope", F.col("params").alias("b"))
    was = rules.select("run", (F.col("idx") + 1).alias("idx"), "kind", "scope", F.col("params").alias("a"))
    known = rules.select("run", "idx").distinct()
    both = was.join(known, ["run", "idx"], "left_semi").join(now.where("idx > 0"), ["run", "idx", "kind", "scope"], "full_outer")
    op = F.when(F.col("a").isNull(), "+").when(F.col("b").isNull(), "-").otherwise("~")
    none = F.expr("cast(map() as map<string,double>)")
    zipped = F.map_zip_with(F.coalesce("a", none), F.coalesce("b", none), lambda k, x, y: F.struct(x.alias("old"), y.alias("new")))
    rows = both.select("run", "idx", op.alias("op"), "kind", "scope", F.explode(zipped).alias("param", "v"))
    return rows.where("op <> '~' or not (v.old <=> v.new)").select("run", "idx", "op", "kind", "scope", "param", "v.old", "v.new")


def run_table(records: DataFrame, *, failed: bool = False) -> DataFrame:
    """A row a run: part, outcome, n_iterations, triangles of the best mesh (of the last attempt without one), score, seconds
    and whether there is a valid mesh; open runs first, then the slowest. failed: only runs that were not accepted."""
    best = F.get(F.filter("iterations", lambda i: i["index"] == F.col("best_index")), F.lit(0))
    last = F.try_element_at("iterations", F.lit(-1))
    out = records.select(
        stem_of(F.col("model")).alias("part"), "outcome", F.coalesce(F.size("iterations"), F.lit(0)).alias("n_iterations"),
        F.coalesce(best["n_triangles"], last["n_triangles"], F.lit(0)).alias("triangles"), F.coalesce(best["score"], F.lit(0.0)).alias("score"),
        F.coalesce("elapsed_seconds", F.lit(0.0)).alias("seconds"), best.isNotNull().alias("valid"),
    )
    out = out.where("outcome <> 'accepted'") if failed else out
    return out.orderBy(F.col("outcome") == "accepted", F.desc("seconds"), "part")


def report(records: DataFrame) -> dict[str, DataFrame]:
    """What a corpus report shows: outcomes with their percentage, the ten most frequent failure codes, the eight objectives
    missed most, and the five slowest parts if one took over 30 seconds."""
    found = aggregate(records)
    top = lambda df, k: df.orderBy(F.desc("n"), df.columns[0]).limit(k)
    rows = run_table(records).select("part", "outcome", "seconds")
    slow = rows.orderBy(F.desc("seconds"), "part").limit(5)
    return {
        "outcomes": found["outcomes"].withColumn("percent", F.col("share") * 100).drop("share").orderBy(F.desc("n"), "outcome"),
        "failures": top(found["failures"], 10),
        "missed": top(found["missed"], 8),
        "slowest": slow.withColumn("most", F.max("seconds").over(Window.partitionBy())).where("most > 30").drop("most"),  # five rows
    }


def estimate_ratio(runs: DataFrame, by: list[str]) -> DataFrame:
    """runs(by, estimate, n_triangles) to (by, n, ratio_mean, ratio_max): triangles made over triangles estimated."""
    ratio = F.when(F.col("estimate") > 0, F.col("n_triangles") / F.when(F.col("estimate") > 0, F.col("estimate")))
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(ratio).alias("ratio_mean"), F.max(ratio).alias("ratio_max"))


def suggestions(names: DataFrame, asked: str, most: int = 6) -> DataFrame:
    """Names that contain what was asked for, in any case."""
    return names.where(F.contains(F.lower("name"), F.lower(F.lit(asked)))).orderBy("name").limit(most)
