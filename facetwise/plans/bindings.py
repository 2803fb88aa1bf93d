"""Operator inputs derived from the driver's tables, each with the same derivation in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def soup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free triangles: the first nine coordinates of each vector are its corners, its label is the face."""
    xs = [F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(p + x for p in "abc" for x in "xyz")]
    return table(spark, sf_dir, "embeddings").select(F.lit("soup").alias("mesh_id"), F.col("vec_id").alias("tri"), F.col("label").alias("pid"), *xs)


SOUP = (
    "soup as (select vec_id as tri, label as pid, "
    + ", ".join(f"cast(embedding[{k + 1}] as double) as {n}" for k, n in enumerate(p + x for p in "abc" for x in "xyz"))
    + " from embeddings)"
)
#: Metrics of the triangles of a table `soup`, as DuckDB SQL.
METRICS = """
lengths as (
    select *, sqrt((bx-ax)*(bx-ax)+(by-ay)*(by-ay)+(bz-az)*(bz-az)) as l1, sqrt((cx-bx)*(cx-bx)+(cy-by)*(cy-by)+(cz-bz)*(cz-bz)) as l2,
        sqrt((ax-cx)*(ax-cx)+(ay-cy)*(ay-cy)+(az-cz)*(az-cz)) as l3,
        (by-ay)*(cz-az)-(bz-az)*(cy-ay) as nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) as ny, (bx-ax)*(cy-ay)-(by-ay)*(cx-ax) as nz from soup),
areas as (select *, 0.5 * sqrt(nx*nx+ny*ny+nz*nz) as area from lengths),
angles as (
    select *, degrees(acos(greatest(-1, least(1, (l1*l1+l3*l3-l2*l2)/(2*l1*l3))))) as a1,
        degrees(acos(greatest(-1, least(1, (l1*l1+l2*l2-l3*l3)/(2*l1*l2))))) as a2,
        degrees(acos(greatest(-1, least(1, (l2*l2+l3*l3-l1*l1)/(2*l2*l3))))) as a3 from areas),
m as (
    select *, 4*sqrt(3)*area/(l1*l1+l2*l2+l3*l3) as shape, 8*area*area/((l1+l2+l3)/2*l1*l2*l3) as rr,
        least(a1,a2,a3) as min_angle, greatest(a1,a2,a3) as max_angle,
        greatest(l1,l2,l3)/(2*area/greatest(l1,l2,l3)) as aspect, sqrt((l1*l1+l2*l2+l3*l3)/3) as size from angles)"""

#: Vertex ids are l_orderkey and l_partkey modulo K and K + l_suppkey modulo SUPP.
K, SUPP = 97, 11


def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles over a small set of vertices, from lineitem; the mesh is the line number, the face the supplier class."""
    li = table(spark, sf_dir, "lineitem")
    out = li.select(
        F.col("l_linenumber").cast("string").alias("mesh_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tri"),
        (F.col("l_orderkey") % K).alias("v0"),
        (F.col("l_partkey") % K).alias("v1"),
        (F.col("l_suppkey") % SUPP + K).alias("v2"),
        (F.col("l_suppkey") % SUPP).alias("pid"),
    )
    return out.where("v0 <> v1")


CONNECTIVITY = f"""conn as (
    select cast(l_linenumber as varchar) as mesh_id, l_orderkey * 10 + l_linenumber as tri, l_orderkey % {K} as v0, l_partkey % {K} as v1,
        l_suppkey % {SUPP} + {K} as v2, l_suppkey % {SUPP} as pid
    from lineitem where l_orderkey % {K} <> l_partkey % {K})"""


def sparse_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As connectivity, with so many vertices that most edges have one or two uses."""
    li = table(spark, sf_dir, "lineitem")
    out = li.select(
        F.lit("m").alias("mesh_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tri"),
        (F.col("l_orderkey") % 499).alias("v0"),
        (F.col("l_partkey") % 499).alias("v1"),
        ((F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_suppkey")) % 499).alias("v2"),
    )
    return out.where("v0 <> v1 and v1 <> v2 and v0 <> v2")


SPARSE = """conn as (
    select * from (
        select 'm' as mesh_id, l_orderkey * 10 + l_linenumber as tri, l_orderkey % 499 as v0, l_partkey % 499 as v1,
            (l_orderkey * 7 + l_partkey * 3 + l_suppkey) % 499 as v2 from lineitem)
    where v0 <> v1 and v1 <> v2 and v0 <> v2)"""


def vertices(spark: SparkSession, sf_dir: str, mesh_id: str = "m") -> DataFrame:
    """Vertex v of a mesh is at the first three coordinates of vector v."""
    xyz = [F.col("embedding")[k].cast("double").alias(x) for k, x in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.lit(mesh_id).alias("mesh_id"), F.col("vec_id").alias("v"), *xyz)


VERTICES = "vert as (select vec_id as v, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings)"

#: Requested size by label; label 3 has none.
SIZES = "case when label = 3 then null else 0.1 + 0.02 * label end"


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label").distinct().selectExpr("label as pid", f"{SIZES} as requested_size")


REQUESTED = f"faces as (select distinct label as pid, cast({SIZES} as double) as requested_size from embeddings)"


def iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as loop iterations: user = run, order of time = index, value = score."""
    from pyspark.sql import Window

    ev = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(
        F.col("user_id").alias("run"),
        (F.row_number().over(order) - 1).alias("idx"),
        F.col("value").alias("score"),
        F.col("event_type").alias("code"),
        (F.col("event_type") != "error").alias("is_valid"),
        (F.col("value") > 150).alias("ready"),
        F.floor(F.col("value") * 10).cast("long").alias("n_tri"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


ITERATIONS = """it as (
    select user_id as run, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, value as score, event_type as code,
        event_type <> 'error' as is_valid, value > 150 as ready, cast(floor(value * 10) as bigint) as n_tri,
        cast(json_extract_string(props, '$.k') as bigint) as k from events)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterations nested into one record a run: ready ones are accepted; an error is a failure, a low score a missed objective."""
    it = iterations(spark, sf_dir)
    failed = F.filter(F.array(F.when(~F.col("is_valid"), F.lit("mesher.failed")), F.when(F.col("k") > 80, F.lit("validity.nonmanifold"))), lambda c: c.isNotNull())
    goals = F.array(*(F.struct(F.lit(n).alias("name"), (F.col("score") >= t).alias("satisfied")) for n, t in (("min_shape", 60.0), ("min_angle", 20.0), ("chordal", 5.0))))
    own = it.select(
        "run", "idx", F.struct(
            F.col("idx").cast("int").alias("index"), F.col("n_tri").alias("n_triangles"), F.col("score").alias("score"), F.col("is_valid").alias("is_valid"), F.col("ready").alias("ready"),
            F.transform(failed, lambda c: F.struct(c.alias("code"), F.lit(1).cast("long").alias("count"))).alias("failures"), goals.alias("objectives"),
        ).alias("i"),
    )
    rec = own.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("idx", "i")))["i"].alias("iterations"))  # a run has a handful of iterations
    last = F.element_at("iterations", -1)
    best = F.array_max(F.transform(F.filter("iterations", lambda i: i["is_valid"]), lambda i: F.struct(i["ready"].alias("r"), i["score"].alias("s"), (-i["index"]).alias("i"))))
    return rec.select(
        F.concat(F.lit("/parts/p"), F.col("run").cast("string"), F.lit(".v1.step")).alias("model"), F.when(last["ready"], "accepted").when(last["is_valid"], "plateau").otherwise("escalated").alias("outcome"),
        "iterations", (-best["i"]).alias("best_index"), F.aggregate("iterations", F.lit(0.0), lambda s, i: s + i["score"] / 20).alias("elapsed_seconds"),
    )


RECORDS = f"""{ITERATIONS},
last as (select * from it qualify row_number() over (partition by run order by idx desc) = 1),
best as (select * from it where is_valid qualify row_number() over (partition by run order by ready desc, score desc, idx) = 1),
rec as (
    select l.run, 'p' || l.run || '.v1' as part, case when l.ready then 'accepted' when l.is_valid then 'plateau' else 'escalated' end as outcome, n, secs as seconds,
        l.n_tri as last_tri, l.score as last_score, b.n_tri as best_tri, b.score as best_score
    from last l join (select run, count(*) as n, sum(score / 20) as secs from it group by run) using (run) left join best b using (run))"""
