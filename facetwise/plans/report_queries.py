"""Report, tally, signature and ray queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.operators import meshers, reports, topology
from facetwise.plans import bindings as B
from facetwise.plans.registry import query, rounded

_CURVES = """c as (select o_orderkey as curve, count(l_suppkey) as n, count(distinct l_suppkey % 5) as nf from orders left join lineitem on l_orderkey = o_orderkey group by 1),
k as (select curve, n, curve % 50 = 0 as degenerate, case when n = 0 then 'orphan' when n = 1 then 'free' when n = 2 and nf = 1 then 'seam' when n = 2 then 'manifold' else 'nonmanifold' end as class from c)"""


@query(
    f"""with {_CURVES} select severity, code, count(*) as n from (
        select case when n = 0 or class = 'free' then 'BLOCK' when class = 'nonmanifold' then 'WARN' else 'INFO' end as severity,
            case when n = 0 then 'curve.empty' when class = 'free' then 'curve.free_edge' when class = 'seam' then 'curve.seam' else 'curve.nonmanifold' end as code
        from k where not degenerate and class <> 'manifold') group by all"""
)
def curve_report(spark, sf_dir):
    fc = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("curve"), (F.col("l_suppkey") % 5).alias("face"))
    inc = topology.incidence(fc, B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("curve")))
    curves = inc.select("curve", topology.edge_class(F.col("n_incidences"), F.col("n_faces")).alias("class"), F.col("n_incidences").alias("n_segments"), (F.col("curve") % 50 == 0).alias("degenerate"))
    return reports.curve_report(curves).groupBy("severity", "code").agg(F.count("*").alias("n"))


@query("select l_orderkey as curve, count(*) as n, min(l_quantity) as least, max(l_quantity) as most from lineitem group by 1")
def segment_counts(spark, sf_dir):
    return reports.segment_counts(B.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as curve", "l_quantity as length"))


@query("select c_custkey as pid, c_acctbal as area from customer where c_custkey % 2 = 0 and c_custkey not in (select c_custkey // 3 from customer where c_custkey % 4 = 1)")
def removed_faces(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    e = c.selectExpr("c_custkey as pid", "2 as dim", "c_custkey % 2 = 1 as alive", "c_acctbal as area")
    return reports.removed_faces(e, c.where("c_custkey % 4 = 1").selectExpr("cast(floor(c_custkey / 3) as bigint) as parent")).select("pid", "area")


@query(
    """with m as (select s_nationkey as mesh, max(case when s_suppkey % 3 > 0 then s_acctbal / 1e5 end) as c, max(case when s_suppkey % 4 > 0 then s_suppkey % 20 end)::double as n from supplier group by 1)
    select mesh, 'chordal' as name, c as value, 0.05::double as target, c <= 0.05 as satisfied from m where c is not null
    union all select mesh, 'normal_deviation', n, 15, n <= 15 from m where n is not null"""
)
def fidelity_objectives(spark, sf_dir):
    s = B.table(spark, sf_dir, "supplier").selectExpr(
        "s_nationkey as mesh", "if(s_suppkey % 3 > 0, s_acctbal / 1e5, double('NaN')) as chordal_relative", "if(s_suppkey % 4 > 0, cast(s_suppkey % 20 as double), double('NaN')) as normal_p99_deg"
    )
    return reports.fidelity_objectives(s, ["mesh"])


@query(
    """select case when event_type = 'error' then 'timeout' when event_type = 'signup' then 'crash' when event_type = 'click' then 'fail' when value > 60 then 'slow' else 'pass' end as status,
    count(*) as n, round(sum(value), 4) as seconds from events group by 1"""
)
def job_tally(spark, sf_dir):
    jobs = B.table(spark, sf_dir, "events").selectExpr("case event_type when 'error' then 124 when 'signup' then -1 when 'click' then 2 else 0 end as rc", "value as seconds")
    return rounded(reports.tally(jobs), digits=4)


@query(
    """with p as (select o_custkey as model, max(o_orderkey % 5) filter (o_orderkey % 3 = 0) as plain, max(o_orderkey % 5) filter (o_orderkey % 3 = 1) as healed, max(o_orderkey % 5) filter (o_orderkey % 3 = 2) as memory from orders group by 1)
    select *, case when plain = memory then 'none' when healed = memory then 'import without healing' when plain > healed then 'healing' else 'other' end as cause from p"""
)
def import_diagnosis(spark, sf_dir):
    c = B.table(spark, sf_dir, "orders").selectExpr("o_custkey as model", "element_at(array('plain', 'healed', 'memory'), cast(o_orderkey % 3 + 1 as int)) as mode", "o_orderkey % 5 as n_volumes")
    return reports.import_diagnosis(c)


@query("select l_suppkey as face, count(distinct l_returnflag) = 1 as fair from lineitem where l_quantity > 49 group by 1")
def boundary_fairness(spark, sf_dir):
    return reports.fair(B.table(spark, sf_dir, "lineitem").where("l_quantity > 49").selectExpr("l_suppkey as face", "l_returnflag as fingerprint"))


@query("select p_partkey as pid, p_size / 50.0::double as size from part where p_size / 50.0::double < 0.999 * 0.5")
def local_sizes(spark, sf_dir):
    return reports.local_sizes(B.table(spark, sf_dir, "part").selectExpr("p_partkey as pid", "p_size / 50.0D as size"), 0.5)


@query(
    f"""with {B.SOUP}, s as (select pid as face, avg(greatest(abs(ax), abs(ay))) as curvature_mean, max(greatest(abs(ax), abs(ay))) as curvature_max, avg(bx) as x, avg(by) as y, avg(bz) as z from soup group by pid)
    select face, round(curvature_mean, 6) as curvature_mean, round(curvature_max, 6) as curvature_max, round(x / sqrt(x*x+y*y+z*z), 5) as n0 from s"""
)
def face_signatures(spark, sf_dir):
    s = B.soup(spark, sf_dir).selectExpr("pid as face", "ax as k1", "ay as k2", "bx as nx", "by as ny", "bz as nz")
    return reports.signatures(s).select("face", F.round("curvature_mean", 6).alias("curvature_mean"), F.round("curvature_max", 6).alias("curvature_max"), F.round(F.col("normal")[0], 5).alias("n0"))


@query(
    f"""with {B.SOUP}, n as (select *, (by-ay)*(cz-az)-(bz-az)*(cy-ay) as nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) as ny, (bx-ax)*(cy-ay)-(by-ay)*(cx-ax) as nz from soup)
    select tri, round((ax+bx+cx)/3, 5) as ox, round(-nx/sqrt(nx*nx+ny*ny+nz*nz), 5) as dx, 5 as n from n"""
)
def thickness_cones(spark, sf_dir):
    rays = reports.cone_rays(B.soup(spark, sf_dir))
    first = F.first(F.when(F.col("ray") % 5 == 0, F.col("dx")), ignorenulls=True)
    return rays.groupBy("tri").agg(F.round(F.first("ox"), 5).alias("ox"), F.round(first, 5).alias("dx"), F.count("*").cast("int").alias("n"))


@query(
    """with recursive n as (select user_id as face, row_number() over (partition by user_id order by ts, event_id) as ord, value / 40 as u from events),
    fold(face, ord, kept, n) as (
        select face, ord, u, 1 from n where ord = 1
        union all
        select n.face, n.ord, case when abs(n.u - f.kept) > 0.3 then n.u else f.kept end, f.n + case when abs(n.u - f.kept) > 0.3 then 1 else 0 end from fold f join n on n.face = f.face and n.ord = f.ord + 1),
    last as (select * from fold qualify row_number() over (partition by face order by ord desc) = 1)
    select l.face, cast(l.n - case when l.n > 2 and abs(l.kept - n.u) <= 0.3 then 1 else 0 end as bigint) as n from last l join n on n.face = l.face and n.ord = 1"""
)
def distinct_nodes(spark, sf_dir):
    from pyspark.sql import Window

    ev = B.table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    nodes = ev.select(F.col("user_id").alias("face"), F.lit(0).alias("loop"), F.row_number().over(w).alias("ord"), (F.col("value") / 40).alias("u"), F.lit(0.0).alias("v"))
    return meshers.drop_repeats(nodes, ["face"], 0.3).groupBy("face").agg(F.count("*").alias("n"))


@query(f"with {B.ITERATIONS} select run, cast(idx as integer) as idx, printf('[%d] %d tris %s score %.3f', idx, n_tri, case when ready then 'READY' when is_valid then 'valid' else 'INVALID' end, score) as line from it")
def run_lines(spark, sf_dir):
    return reports.run_lines(B.iterations(spark, sf_dir)).withColumn("idx", F.col("idx").cast("int"))


@query()
def uv_drawing(spark, sf_dir):
    return reports.uv_drawing(B.soup(spark, sf_dir))
