"""Persistent identity of CAD entities over snapshots: fingerprints, matching, provenance.

An entity row has dim, tag, mass, cx .. cz, xlo .. zhi, n_boundary, curvature_sig and normal_sig (arrays of doubles).
Frames have ox, oy, oz and scale: the first snapshot's bounding box, kept for all later ones.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.operators import boxes
from facetwise.operators.matching import match_snapshots  # noqa: F401  part of this module's interface
from facetwise.scratch import Scratch

DIGITS, TOLERANCE = 4, 0.02


def model_frame(entities: DataFrame) -> DataFrame:
    """(model, ox, oy, oz, scale): the corner and the diagonal of each model's bounding box (1e-12 at least)."""
    low = {x: F.min(f"{x}lo") for x in "xyz"}
    high = {x: F.max(f"{x}hi") for x in "xyz"}
    span = F.sqrt(sum((high[x] - low[x]) * (high[x] - low[x]) for x in "xyz"))
    return entities.groupBy("model").agg(*(low[x].alias("o" + x) for x in "xyz"), F.greatest(span, F.lit(1e-12)).alias("scale"))


def fingerprint(frame: tuple[Column, Column, Column, Column], digits: int = DIGITS) -> Column:
    """16 hex digits over the rounded invariants of a row, relative to a frame; the tag and the perimeter don't count."""
    ox, oy, oz, scale = frame
    at = lambda c, o: F.format_string(f"%.{digits}f", F.bround((F.col(c) - o) / scale, digits) + 0.0)
    parts = [F.col("dim").cast("string")]
    parts += [at(c + suffix, o) for suffix in ("lo", "hi") for c, o in zip("xyz", (ox, oy, oz), strict=True)]
    parts += [at("c" + c, o) for c, o in zip("xyz", (ox, oy, oz), strict=True)]
    mass = F.col("mass") / F.pow(scale, F.greatest(F.col("dim"), F.lit(1)).cast("double"))
    parts.append(F.format_string(f"%.{digits}f", F.bround(mass, digits) + 0.0))
    parts.append(F.col("n_boundary").cast("string"))
    for sig, k in (("curvature_sig", scale), ("normal_sig", F.lit(1.0))):
        parts.append(F.array_join(F.transform(F.coalesce(F.col(sig), F.array().cast("array<double>")), lambda x, k=k: F.format_string(f"%.{digits}f", F.bround(x * k, digits) + 0.0)), ","))
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def canonical_order(entities: DataFrame, by: list[str]) -> DataFrame:
    """entities with `place`, which doesn't depend on tags unless all else is equal."""
    w = Window.partitionBy(*by).orderBy("dim", *(F.round("c" + x, 9) for x in "xyz"), F.round("mass", 9), "tag")
    return entities.withColumn("place", F.row_number().over(w))


def new_pids(entities: DataFrame, by: list[str], fp: str = "fp") -> DataFrame:
    """entities (with place) with pid: the fingerprint, then fingerprint~1, ~2, ... for equal ones in canonical order."""
    k = F.row_number().over(Window.partitionBy(*by, fp).orderBy("place")) - 1
    return entities.withColumn("pid", F.when(k == 0, F.col(fp)).otherwise(F.concat_ws("~", F.col(fp), k.cast("string"))))


def coincident_pairs(old: DataFrame, new: DataFrame, by: list[str], tol: Column, rel: float = TOLERANCE) -> DataFrame:
    """(by, o_.., n_..): boxes that contain each other to tol, and masses within rel. by are equality keys.

    Boxes meet by the cells of all six ends (boxes.equal); tol is a constant, or depends on by alone. Null ends or keys
    meet nothing.
    """
    big = F.greatest("l_mass", "r_mass")
    same = (big <= 0) | (G.guarded(F.abs(F.col("l_mass") - F.col("r_mass")), big, 0.0) <= rel)
    met = boxes.equal(old.withColumn("tol", tol), new.withColumn("tol", tol), by).where(same).drop("l_tol", "r_tol")
    return met.select(*by, *(F.col("l_" + c).alias("o_" + c) for c in old.columns if c not in by), *(F.col("r_" + c).alias("n_" + c) for c in new.columns if c not in by))


def tightest_parent(old: DataFrame, new: DataFrame, by: list[str], tol: Column) -> DataFrame:
    """(by, n_tag, o_pid): for each new box the old box of least mass that contains it (of equal ones the least pid).

    Different boxes meet by cells of grids in all three axes (boxes.tightest); tol is a constant, or depends on by alone.
    """
    met = boxes.tightest(old.withColumn("tol", tol), new.withColumn("tol", tol), by, ["mass", "pid"])
    return met.groupBy(*by, F.col("tag").alias("n_tag")).agg(F.min("o")["pid"].alias("o_pid"))


def fingerprint_matches(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """(by, fp, pid, tag): exact matches, only where as many old as new entities share a fingerprint; paired in order."""
    rank = lambda d, key: d.withColumn("k", F.row_number().over(Window.partitionBy(*by, "fp").orderBy(key))).withColumn("c", F.count("*").over(Window.partitionBy(*by, "fp")))
    o, n = rank(old.select(*by, "fp", "pid"), "pid"), rank(new.select(*by, "fp", "tag"), "tag")
    return o.join(n, [*by, "fp", "k", "c"]).select(*by, "fp", "pid", "tag")


def stability(entities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Live entities by relation, and the share that kept their identity (created counts only in the first snapshot)."""
    own = entities.where("alive")
    out = own.groupBy(*(by or [])).agg(
        *(F.count_if(F.col("relation") == r).alias(r) for r in ("same", "split", "merge", "created")), F.count("*").alias("n")
    )
    return out.withColumn("preserved", G.guarded(F.col("same"), F.col("n"), 0.0))


def closure(edges: DataFrame, *, up: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(node, reached): everything below (or, up, above) each node of edges(parent, child), at any depth.

    Paths double in length each round, so the rounds are logarithmic in the depth; every round is distinct and written.
    Cycles end when nothing new is reached. No edges give no rows; null ends are no edges.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    a, b = ("child", "parent") if up else ("parent", "child")
    # far: pairs at exactly 2^k steps; near: pairs at up to 2^k steps
    far = near = scratch.cut(edges.where("parent is not null and child is not null").select(F.col(a).alias("node"), F.col(b).alias("reached")).distinct())
    n = near.count()
    then = lambda x, y: x.join(y.select(F.col("node").alias("reached"), F.col("reached").alias("next")), "reached").select("node", F.col("next").alias("reached"))
    while True:
        more = scratch.cut(near.unionAll(then(near, far)).distinct())
        m = more.count()
        if m == n:
            return more
        before = far, near
        far, near, n = scratch.cut(then(far, far).distinct()), more, m
        for table in before:
            scratch.drop(table)


def descendants(edges: DataFrame, alive: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, reached): live entities below each node, itself included if live."""
    own = alive.select(F.col("pid").alias("node"), F.col("pid").alias("reached"))
    return closure(edges, scratch=scratch).join(alive.select(F.col("pid").alias("reached")), "reached", "left_semi").select("node", "reached").unionByName(own).distinct()


def pid_for_tag(entities: DataFrame, dim: int, tag: int) -> DataFrame:
    """(model, pid) of the live entities of a dimension with a tag."""
    return entities.where(F.col("alive") & (F.col("dim") == dim) & (F.col("tag") == tag)).select("model", "pid")


def tag_for_pid(entities: DataFrame, pid: str) -> DataFrame:
    """(model, dim, tag) of a live entity; dead ones have no tag."""
    return entities.where(F.col("alive") & (F.col("pid") == pid)).select("model", "dim", "tag")


def register(old: DataFrame, new: DataFrame, matches: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """The entities after a snapshot, and the provenance edges it adds.

    same keeps its pid; split, merge and created get new ones and link to their parents, which die; deleted ones die.
    New pids don't collide with pids that were ever used.
    """
    hit = matches.select("model", "relation", F.explode_outer("new_tags").alias("tag"), "old_pids", "mass_ratio")
    kept = hit.where("relation = 'same'").select("model", "tag", F.get("old_pids", F.lit(0)).alias("pid"))
    born = hit.where("relation in ('split', 'merge', 'created')")
    fresh = canonical_order(new.join(born.select("model", "tag", "relation", "old_pids", "mass_ratio"), ["model", "tag"]), ["model"])
    used = old.select("model", F.substring_index("pid", "~", 1).alias("fp")).groupBy("model", "fp").agg(F.count("*").alias("taken"))
    k = F.row_number().over(Window.partitionBy("model", "fp").orderBy("place")) - 1 + F.coalesce("taken", F.lit(0))
    fresh = fresh.join(used, ["model", "fp"], "left").withColumn("pid", F.when(k == 0, F.col("fp")).otherwise(F.concat_ws("~", "fp", k.cast("string"))))
    same = new.join(kept, ["model", "tag"]).select("model", "pid", "dim", "tag", "mass", F.lit("same").alias("relation"), F.lit(True).alias("alive"), F.lit(label).alias("last_seen"))
    made = fresh.select("model", "pid", "dim", "tag", "mass", "relation", F.lit(True).alias("alive"), F.lit(label).alias("last_seen"))
    dead = old.join(kept.select("model", "pid"), ["model", "pid"], "left_anti").select(
        "model", "pid", "dim", F.lit(None).cast("long").alias("tag"), "mass", F.col("relation") if "relation" in old.columns else F.lit("created").alias("relation"), F.lit(False).alias("alive"),
        F.col("last_seen") if "last_seen" in old.columns else F.lit("").alias("last_seen"),
    )
    edges = fresh.select("model", F.explode("old_pids").alias("parent"), F.col("pid").alias("child"), F.lit(label).alias("snapshot"), "relation", "mass_ratio")
    return same.unionByName(made).unionByName(dead), edges


def spec_digest(rules: list[tuple]) -> str:
    """Digest of a rule list for the loop's guard against repeats."""
    return hashlib.sha256(json.dumps(rules, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
