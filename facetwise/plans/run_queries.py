"""Verdict, contract, size field, run record and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.operators import audit, mesh, records, sizefield, topology, verdict
from facetwise.plans import bindings as B
from facetwise.plans.registry import query, rounded

# Each label is a mesh; its triangles are free, so its topology comes from the connectivity of the same number.
_MEASURES = f"""with {B.SOUP}, {B.METRICS}, {B.REQUESTED},
r as (select m.*, size / requested_size as ratio from m left join faces using (pid)),
q as (
    select pid, count(*) as n_triangles, count(*) filter (area <= 0) as n_inverted, count(*) filter (shape < 0.05) as n_degenerate, min(shape) as min_shape,
        min(min_angle) as min_angle, max(max_angle) as max_angle, avg(case when ratio < 1/1.5 or ratio > 1.5 then 0 else 1 end) as size_in_band from r group by pid),
{B.CONNECTIVITY},
dir as (select mesh_id, v0 as i, v1 as j from conn union all select mesh_id, v1, v2 from conn union all select mesh_id, v2, v0 from conn),
use as (select mesh_id, least(i, j) as a, greatest(i, j) as b, count(*) as n, count(*) filter (i < j) as f from dir group by all),
topo as (select cast(mesh_id as integer) as pid, count(*) filter (n > 2) as nm, count(*) filter (n = 2 and f in (0, 2)) as inc from use group by mesh_id),
meas as (select q.*, nm, inc from q left join topo using (pid)),
fail as (
    select pid, 'validity.inverted' as code, n_inverted as count from meas where n_inverted > 0
    union all select pid, 'validity.nonmanifold', nm from meas where nm > 0
    union all select pid, 'validity.orientation', inc from meas where inc > 0
    union all select pid, 'validity.degenerate_shape', n_degenerate from meas where n_degenerate > 0),
goal as (
    select pid, 0 as ord, 'min_shape' as name, min_shape as value, 0.3 as target, 2.0 as weight, true as up from meas
    union all select pid, 1, 'min_angle', min_angle, 20, 2.0, true from meas union all select pid, 2, 'max_angle', max_angle, 130, 1.0, false from meas
    union all select pid, 3, 'size_in_band', size_in_band, 0.9, 1.5, true from meas),
obj as (
    select *, case when up then value >= target else value <= target end as satisfied,
        case when up then greatest(0, least(1, value / target)) else case when value <= 0 then 1 else greatest(0, least(1, target / value)) end end as attainment from goal)"""


def _measures(spark, sf_dir):
    tri = mesh.with_requested_size(B.soup(spark, sf_dir), B.requested(spark, sf_dir))
    m = G.with_triangle_metrics(tri)
    q = m.groupBy("pid").agg(
        F.count("*").alias("n_triangles"), F.count_if(F.col("area") <= 0).alias("n_inverted"), F.count_if(F.col("shape") < 0.05).alias("n_degenerate"),
        F.min("shape").alias("min_shape"), F.min("min_angle").alias("min_angle"), F.max("max_angle").alias("max_angle"),
        F.avg(mesh.in_band(mesh.size_ratio()).cast("int")).alias("size_in_band"),
    )
    topo = topology.edge_topology(B.connectivity(spark, sf_dir), ["mesh_id"]).withColumn("pid", F.col("mesh_id").cast("int"))
    return q.join(topo.select("pid", "n_nonmanifold_edges", "n_inconsistent_normals"), "pid", "left")


@query(f"{_MEASURES} select pid, code, count from fail")
def validity_gate(spark, sf_dir):
    return verdict.failures(_measures(spark, sf_dir), ["pid"])


@query(f"{_MEASURES} select pid, cast(ord as integer) as ord, name, round(value, 6) as value, cast(target as double) as target, cast(weight as double) as weight, satisfied, round(attainment, 6) as attainment from obj")
def objectives(spark, sf_dir):
    return rounded(verdict.objectives(_measures(spark, sf_dir), ["pid"]))


@query(
    f"""{_MEASURES}, s as (select pid, bool_and(satisfied) as met, sum(attainment*weight)/sum(weight) as raw,
        min(struct_pack(a := attainment, o := ord, n := name)) filter (not satisfied) as w from obj group by pid),
    n as (select pid, count(*) as n_failures from fail group by pid)
    select pid, n_failures is null as is_valid, n_failures is null and met as ready, round(case when n_failures is null then raw else 0 end, 6) as score,
        coalesce(n_failures, 0) as n_failures, w.n as worst from q left join s using (pid) left join n using (pid)"""
)
def verdict_score(spark, sf_dir):
    return rounded(verdict.scored(_measures(spark, sf_dir), ["pid"]).drop("codes"))


_FACES = "f as (select p_partkey as pid, p_brand as model, p_retailprice as area, p_size / 10.0::double as curvature_max, case when p_size % 3 = 0 then null else p_size / 5.0::double end as thickness from part)"


def _faces(spark, sf_dir):
    return B.table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as pid", "p_brand as model", "p_retailprice as area", "p_size / 10.0D as curvature_max", "case when p_size % 3 = 0 then null else p_size / 5.0D end as thickness"
    )


@query(
    f"""with {_FACES} select cast(pid as varchar) as pid, round(case when curvature_max > 0 then least(sqrt(8*0.01/curvature_max), 2/curvature_max*sin(radians(12)), 2*pi()/curvature_max/12)
    else 'infinity'::double end, 6) as size, round(case when 0.8 > 0.1 then (0.8-0.1)/(1.4-1) end, 6) as ramp from f"""
)
def curvature_size(spark, sf_dir):
    size = G.curvature_size(G.guarded(F.lit(1.0), F.col("curvature_max"), G.inf()), F.lit(0.01), F.lit(12.0), F.lit(12.0))
    return _faces(spark, sf_dir).select("pid", F.round(size, 6).alias("size"), F.round(G.ramp_distance(F.lit(0.1), F.lit(0.8), F.lit(1.4)), 6).alias("ramp"))


_RULES = [sizefield.base(1.5), sizefield.curvature(0.05, 15.0, 12.0), sizefield.thickness(3), sizefield.feature(0.2, ["7", "11"]), sizefield.clamp(0.15, 1.2), sizefield.gradation(1.4)]
_RESOLVED = f"""{_FACES}, s as (
    select pid, model, area, least(greatest(least(1.5, case when curvature_max > 0 then least(sqrt(8*0.05/curvature_max), 2/curvature_max*sin(radians(15)), 2*pi()/curvature_max/12) else 'infinity'::double end,
        coalesce(thickness / 3, 'infinity'::double), case when pid in (7, 11) then 0.2 else 'infinity'::double end), 0.15), 1.2) as size from f)"""


@query(f"with {_RESOLVED} select cast(pid as varchar) as pid, round(size, 6) as size from s")
def size_resolve(spark, sf_dir):
    return rounded(sizefield.resolve(_faces(spark, sf_dir), _RULES).select("pid", "size"))


@query(f"with {_RESOLVED} select model, cast(round_even(sum(area/(sqrt(3)/4*size*size)), 0) as bigint) as estimate from s group by model")
def element_estimate(spark, sf_dir):
    return sizefield.element_estimate(sizefield.resolve(_faces(spark, sf_dir), _RULES), ["model"])


@query(f"with {_RESOLVED}, e as (select model, cast(round_even(sum(area/(sqrt(3)/4*size*size)), 0) as bigint) as estimate from s group by model) select * from e where estimate <= 4000000")
def budget_refusal(spark, sf_dir):
    return sizefield.within_budget(sizefield.resolve(_faces(spark, sf_dir), _RULES), 4_000_000, ["model"])


@query(
    """with o as (select p_brand as kind, p_type as scope, max_by(p_size, p_partkey) as h, max_by(p_retailprice, p_partkey) as w from part where p_partkey % 5 > 0 group by all),
    n as (select p_brand as kind, p_type as scope, max_by(p_size + p_partkey % 2, p_partkey) as h, max_by(p_retailprice, p_partkey) as w from part where p_partkey % 7 > 0 group by all),
    a as (select kind, scope, unnest(['h', 'w']) as param, unnest([h::double, w::double]) as old from o), b as (select kind, scope, unnest(['h', 'w']) as param, unnest([h::double, w::double]) as new from n)
    select case when old is null then '+' when new is null then '-' else '~' end as op, kind, scope, param, old, new from a full join b using (kind, scope, param) where old is distinct from new"""
)
def spec_diff(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    old = p.where("p_partkey % 5 > 0").selectExpr("p_partkey as ord", "p_brand as kind", "array(p_type) as scope", "map('h', cast(p_size as double), 'w', p_retailprice) as params")
    new = p.where("p_partkey % 7 > 0").selectExpr("p_partkey as ord", "p_brand as kind", "array(p_type) as scope", "map('h', cast(p_size + p_partkey % 2 as double), 'w', p_retailprice) as params")
    return sizefield.diff(old, new)


def _neighbours(faces, reach: int):
    """(model, pid, nbr): faces of a model whose numbers differ by 1 to reach; each asks for the numbers, so rows grow with faces."""
    near = faces.selectExpr("model", "pid as nbr", "cast(pid as int) as key")
    asked = faces.selectExpr("model", "pid", f"explode(filter(transform(sequence(-{reach}, {reach}), k -> cast(pid as int) + k), key -> key <> cast(pid as int))) as key")
    return asked.join(near, ["model", "key"]).drop("key")


@query(
    """with recursive face as (select 'm' || s_nationkey % 5 as model, cast(s_suppkey as varchar) as pid, 0.05::double + (s_suppkey * 37 % 100) / 20.0::double as size, sqrt(abs(s_acctbal) / 100) as extent from supplier),
    link as (select a.model, a.pid, b.pid as nbr from face a join face b using (model) where abs(cast(a.pid as integer) - cast(b.pid as integer)) between 1 and 25),
    pass as (
        select 0 as k, * from face
        union all
        select a.k + 1, a.model, a.pid, least(a.size, coalesce(min(b.size * power(1.4, greatest(least(b.extent / b.size, 40), 1))), a.size)), a.extent
        from pass a left join link l on l.model = a.model and l.nbr = a.pid left join pass b on b.model = l.model and b.pid = l.pid and b.size > 0
        where a.k < 50 group by a.k, a.model, a.pid, a.size, a.extent)
    select model, pid, round(size, 6) as size from pass where k = 50"""
)
def size_smooth(spark, sf_dir):
    s = B.table(spark, sf_dir, "supplier")
    faces = s.selectExpr("'m' || s_nationkey % 5 as model", "cast(s_suppkey as string) as pid", "0.05D + (s_suppkey * 37 % 100) / 20.0D as size", "abs(s_acctbal) / 100 as area")
    return rounded(sizefield.smooth(faces, _neighbours(faces, 25), 1.4))


@query(
    """with p as (select c_custkey as point, c_nationkey % 5 as mesh, c_acctbal / 1000 as x, c_custkey % 17 as y from customer),
    s as (select s_nationkey % 5 as mesh, s_acctbal / 1000 as sx, s_suppkey % 17 as sy, 0.1 + (s_suppkey % 7) / 10.0 as h from supplier)
    select point, round(least(min(h + (2 - h) * greatest(0, least(1, sqrt(power(x-sx,2)+power(y-sy,2)) / 3))), 2), 6) as size from p join s using (mesh) group by point"""
)
def size_at_points(spark, sf_dir):
    p = B.table(spark, sf_dir, "customer").selectExpr("c_nationkey % 5 as mesh_id", "c_custkey as point", "c_acctbal / 1000 as x", "cast(c_custkey % 17 as double) as y", "0D as z")
    s = B.table(spark, sf_dir, "supplier").selectExpr("s_nationkey % 5 as mesh_id", "s_acctbal / 1000 as x", "cast(s_suppkey % 17 as double) as y", "0D as z", "0.1D + (s_suppkey % 7) / 10.0D as h", "3D as ramp")
    return rounded(sizefield.size_at(p, s, 2.0).select("point", "size"))


_PART = "g as (select p_partkey, p_brand as part, p_type as code, p_retailprice as area, p_size * 12.0::double as perimeter from part)"


@query(
    f"""with {_PART}, c as (select *, 4*pi()*area/(perimeter*perimeter) as c from g)
    select p_partkey, round(c, 6) as circularity, round(case when c <= 0 then 'infinity'::double when c >= pi()/4 then 1 else ((pi()/c-2)+sqrt(power(pi()/c-2,2)-4))/2 end, 5) as aspect from c"""
)
def circularity_aspect(spark, sf_dir):
    c = G.circularity(F.col("p_retailprice"), F.col("p_size") * 12.0)
    return B.table(spark, sf_dir, "part").select("p_partkey", F.round(c, 6).alias("circularity"), F.round(G.aspect_from_circularity(c), 5).alias("aspect"))


@query(
    f"""with {_PART}, c as (select p_partkey as face, 4*pi()*area/(perimeter*perimeter*20) as c, area/20 / (1e5*1e5) as s from g)
    select face, 'face.sliver' as code, 'WARN' as severity, 'sliver_circularity' as threshold_name, 0.05::double as threshold, round(c, 8) as measured from c where c < 0.05
    union all select face, 'face.tiny', 'WARN', 'tiny_face_area_frac', 1e-7, round(s, 12) from c where s < 1e-7"""
)
def face_findings(spark, sf_dir):
    f = B.table(spark, sf_dir, "part").selectExpr("p_partkey as face", "p_retailprice / 20 as area", "p_size * 12.0D as perimeter")
    found = audit.face_findings(f, 1e5)
    return found.withColumn("measured", F.when(F.col("code") == "face.sliver", F.round("measured", 8)).otherwise(F.round("measured", 12)))


@query(
    """with c as (select l_orderkey * 10 + l_linenumber as curve, l_extendedprice * l_discount / 1e8 as share from lineitem)
    select code, count(*) as n, round(max(measured), 9) as worst from (
        select case when share <= 1e-9 then 'curve.degenerate' else 'curve.tiny' end as code, share as measured from c where share < 1e-4) group by code"""
)
def curve_findings(spark, sf_dir):
    c = B.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as curve", "l_extendedprice * l_discount as length")
    return audit.curve_findings(c, 1e8).groupBy("code").agg(F.count("*").alias("n"), F.round(F.max("measured"), 9).alias("worst"))


_FOUND = "h as (select p_partkey, p_brand as part, p_type as code, case when p_size % 10 = 0 then null else 'size' end as threshold_name, p_size % 10 * 100.0::double as threshold, p_retailprice as measured from part)"


def _found(spark, sf_dir):
    return B.table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_brand as part", "p_type as code", "case when p_size % 10 = 0 then null else 'size' end as threshold_name", "p_size % 10 * 100.0D as threshold", "p_retailprice as measured"
    )


@query(f"with {_FOUND} select p_partkey, round(measured / nullif(threshold, 0), 6) as ratio, coalesce(measured / nullif(threshold, 0) between 0.5 and 2, false) as borderline from h")
def borderline_findings(spark, sf_dir):
    return rounded(audit.with_margin(_found(spark, sf_dir)).select("p_partkey", "ratio", "borderline"))


@query(f"with {_FOUND} select part, code, count(*) as n, count(*) filter (measured / threshold between 0.5 and 2) as n_borderline from h where threshold_name is not null group by all")
def calibration_collect(spark, sf_dir):
    return audit.calibration_rows(_found(spark, sf_dir)).groupBy("part", "code").agg(F.count("*").alias("n"), F.count_if("borderline").alias("n_borderline"))


@query(
    """with l as (select source as threshold_name, n_chars::double as m, quality from documents join labels using (doc_id)),
    g as (
        select threshold_name, count(*) filter (quality = 1) as n_real, min(m) filter (quality = 1) as real_min, max(m) filter (quality = 1) as real_max,
            count(*) filter (quality = 0) as n_false, min(m) filter (quality = 0) as false_min, max(m) filter (quality = 0) as false_max from l group by 1),
    s as (select *, case when n_real > 0 and n_false > 0 then real_max < false_min end as separable from g),
    o as (select *, case when separable then case when real_max > 0 then sqrt(real_max*false_min) else false_min/2 end end as cut,
        case when not separable then greatest(real_min, false_min) end as overlap_low, case when not separable then least(real_max, false_max) end as overlap_high from s)
    select threshold_name, n_real, real_min, real_max, n_false, false_min, false_max, separable, round(cut, 6) as cut, overlap_low, overlap_high,
        (select count(*) from l where l.threshold_name = o.threshold_name and m between overlap_low and overlap_high) as n_overlap from o"""
)
def calibration_fit(spark, sf_dir):
    rows = B.table(spark, sf_dir, "documents").join(B.table(spark, sf_dir, "labels"), "doc_id")
    return rounded(audit.fit(rows.selectExpr("source as threshold_name", "cast(n_chars as string) as measured", "if(quality = 1, ' Real', 'false ') as verdict")))


@query(
    f"""with {_FOUND}, old as (select l_partkey as p_partkey, l_orderkey * 10 + l_linenumber as ord, case when l_returnflag = 'N' then ' ' else l_returnflag end as verdict, l_linestatus as note from lineitem)
    select h.p_partkey, part, arg_max(verdict, ord) filter (trim(verdict) <> '') as verdict from h left join old using (p_partkey) group by all"""
)
def calibration_merge(spark, sf_dir):
    old = B.table(spark, sf_dir, "lineitem").selectExpr("l_partkey as p_partkey", "l_orderkey * 10 + l_linenumber as ord", "if(l_returnflag = 'N', ' ', l_returnflag) as verdict", "l_linestatus as note")
    rows = _found(spark, sf_dir).selectExpr("p_partkey", "part", "'' as verdict", "'' as note")
    return audit.carry_verdicts(rows, old, ["p_partkey"]).select("p_partkey", "part", "verdict")


_FORM = """form as (
    select vec_id, label as face, list_dot_product(embedding[1:3]::double[], embedding[1:3]::double[]) as E, list_dot_product(embedding[1:3]::double[], embedding[4:6]::double[]) as F,
        list_dot_product(embedding[4:6]::double[], embedding[4:6]::double[]) as G from embeddings),
ff as (select *, sqrt(greatest(E*G-F*F, 0)) as scale, (E+G)/2 as mid, sqrt(power((E-G)/2, 2)+F*F) as reach from form)"""


def _derivatives(spark, sf_dir):
    xs = [F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("dux", "duy", "duz", "dvx", "dvy", "dvz"))]
    return B.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("face"), *xs)


@query(
    f"""with {_FORM} select vec_id, round(E, 7) as e, round(F, 7) as f, round(G, 7) as g, round(scale, 7) as scale, round(sqrt((mid+reach)/(mid-reach)), 3) as anisotropy,
    round(0.5/sqrt(E), 5) as hu, round(0.5/sqrt(G), 5) as hv, round(sqrt(greatest(E*0.01+2*F*0.02+G*0.04, 0)), 6) as length from ff"""
)
def first_fundamental_form(spark, sf_dir):
    d = _derivatives(spark, sf_dir)
    e, f, g = G.first_form(G.point("du"), G.point("dv"))
    d = d.select("vec_id", e.alias("e"), f.alias("f"), g.alias("g"))
    e, f, g = (F.col(x) for x in "efg")
    hu, hv = G.parametric_size(e, g, F.lit(0.5))
    length = G.metric_distance(e, f, g, F.lit(0.1), F.lit(0.2))
    cols = [(e, 7, "e"), (f, 7, "f"), (g, 7, "g"), (G.area_scale(e, f, g), 7, "scale"), (G.anisotropy(e, f, g), 3, "anisotropy"), (hu, 5, "hu"), (hv, 5, "hv"), (length, 6, "length")]
    return d.select("vec_id", *(F.round(c, k).alias(n) for c, k, n in cols))


@query(
    f"""with {_FORM}, p as (
        select face, count(*) as n, median(scale) filter (scale > 0) as med, min(scale) filter (scale > 0) as low, max(scale) as high, max(sqrt((mid+reach)/(mid-reach))) as aniso from ff group by face),
    d as (select face, count(*) filter (scale <= med * 1e-12) as dead from ff join p using (face) group by face)
    select face, n, round(high / low, 3) as ratio, round(aniso, 3) as aniso_max, case when n < 4 then 'unparametrizable' when dead > 0 then 'degenerate'
        when high / low > 100 or aniso > 20 then 'distorted' else 'clean' end as class from p join d using (face)"""
)
def param_class(spark, sf_dir):
    out = audit.parametrisation(_derivatives(spark, sf_dir), ["face"])
    return out.select("face", "n", F.round("ratio", 3).alias("ratio"), F.round("aniso_max", 3).alias("aniso_max"), "class")


_IT = f"with {B.ITERATIONS}"
_LAST = "last as (select * from it qualify row_number() over (partition by run order by idx desc) = 1)"


@query(f"{_IT}, {_LAST} select code as outcome, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from last group by code")
def outcome_counts(spark, sf_dir):
    return rounded(records.outcome_counts(records.last_iterations(B.iterations(spark, sf_dir)).withColumnRenamed("code", "outcome")))


@query(f"{_IT} select code, count(*) as n from it where not is_valid or k > 80 group by code")
def failure_codes(spark, sf_dir):
    return B.iterations(spark, sf_dir).where("not is_valid or k > 80").groupBy("code").agg(F.count("*").alias("n"))


@query(f"{_IT}, {_LAST} select name, count(*) as n from (select unnest(case when score < 20 then ['score', 'low'] else ['score'] end) as name from last where code not in ('purchase', 'signup') and score < 60) group by name")
def missed_objectives(spark, sf_dir):
    last = records.last_iterations(B.iterations(spark, sf_dir)).where("code not in ('purchase', 'signup') and score < 60")
    return last.selectExpr("explode(if(score < 20, array('score', 'low'), array('score'))) as name").groupBy("name").agg(F.count("*").alias("n"))


@query(
    f"""{_IT}, b as (select run, idx, n_tri from it where is_valid qualify row_number() over (partition by run order by ready desc, score desc, idx) = 1)
    select run, count(*) as n_iterations, count(*) > 1 as adapted, any_value(b.n_tri) as best_triangles, any_value(b.idx) as best_index from it left join b using (run) group by run"""
)
def per_part(spark, sf_dir):
    it = B.iterations(spark, sf_dir)
    best = records.best_iteration(it).select("run", F.col("n_tri").alias("best_triangles"), F.col("idx").cast("long").alias("best_index"))
    n = it.groupBy("run").agg(F.count("*").alias("n_iterations"), (F.count("*") > 1).alias("adapted"))
    return n.join(best, "run", "left")


@query(f"{_IT} select code, list_sort(list(score))[cast(floor(count(*) / 2) as integer) + 1] as median from it group by code")
def upper_median(spark, sf_dir):
    return records.upper_median(B.iterations(spark, sf_dir), "score", ["code"])


@query(f"{_IT} select run, cast(idx as bigint) as idx, score from it where is_valid qualify row_number() over (partition by run order by ready desc, score desc, idx) = 1")
def best_iteration(spark, sf_dir):
    return records.best_iteration(B.iterations(spark, sf_dir)).select("run", F.col("idx").cast("long").alias("idx"), "score")


@query(
    f"""{_IT} select run, cast(idx as bigint) as idx, coalesce(max(score) over (partition by run order by idx rows between 1 preceding and current row)
    - lag(score, 2) over (partition by run order by idx) < 0.001, false) as plateau from it"""
)
def plateau(spark, sf_dir):
    return records.plateau(B.iterations(spark, sf_dir)).select("run", F.col("idx").cast("long").alias("idx"), "plateau")


@query(
    f"""{_IT}, c as (select run, idx, cast(n_tri // 400 as bigint) as n_tri, code, floor(score / 40) as score from it)
    select run, cast(idx as bigint) as idx, coalesce(n_tri = lag(n_tri) over w and n_tri > 0 and code = lag(code) over w and abs(score - lag(score) over w) < 1e-9, false) as ineffective
    from c window w as (partition by run order by idx)"""
)
def ineffective(spark, sf_dir):
    it = B.iterations(spark, sf_dir).withColumns({"n_tri": F.floor(F.col("n_tri") / 400), "score": F.floor(F.col("score") / 40).cast("double")})
    return records.ineffective(it).select("run", F.col("idx").cast("long").alias("idx"), "ineffective")


@query(f"{_IT}, r as (select run, idx, row_number() over (partition by run, k order by idx) as n from it) select run, cast(min(idx) as bigint) as idx from r where n > 1 group by run")
def oscillation(spark, sf_dir):
    return records.oscillation(B.iterations(spark, sf_dir), "k").select("run", F.col("idx").cast("long").alias("idx"))


@query(f"{_IT} select run, cast(idx as bigint) as idx, count(*) filter (code = 'error') over (partition by run order by idx rows between unbounded preceding and 1 preceding) as prior from it")
def prior_attempts(spark, sf_dir):
    return records.prior_attempts(B.iterations(spark, sf_dir), "error").select("run", F.col("idx").cast("long").alias("idx"), "prior")


@query(f"{_IT} select run, cast(idx as bigint) as idx, max(score) filter (is_valid) over (partition by run order by idx rows unbounded preceding) as best_so_far from it")
def running_best(spark, sf_dir):
    return records.running_best(B.iterations(spark, sf_dir)).select("run", F.col("idx").cast("long").alias("idx"), "best_so_far")


@query("select o_custkey as model, o_orderstatus as outcome, o_orderpriority as n_iterations, min(o_orderkey) as place from orders group by 1, 2, 3")
def records_dedup(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").selectExpr("o_custkey as model", "o_orderstatus as outcome", "o_orderpriority as n_iterations", "'f' as file", "o_orderkey as place")
    return records.dedup(o).drop("file")


@query(f"{_IT}, {_LAST} select c_custkey as file, code as outcome from customer left join last on run = c_custkey where code is null or code <> 'purchase'")
def resume_todo(spark, sf_dir):
    last = records.last_iterations(B.iterations(spark, sf_dir)).selectExpr("run as file", "if(code = 'purchase', 'accepted', code) as outcome")
    return records.to_do(B.table(spark, sf_dir, "customer").selectExpr("c_custkey as file"), last)


@query("select c_name as name from customer where lower(c_name) like '%00001%' order by 1 limit 6")
def suggestions(spark, sf_dir):
    return records.suggestions(B.table(spark, sf_dir, "customer").selectExpr("c_name as name"), "00001")


@query(
    """select s_suppkey as pid, round(4*pi()*abs(s_acctbal)/1e4/power(s_suppkey % 90, 2), 8) as circularity, case when s_nationkey = 3 then 'operator'
        when s_suppkey % 90 > 0 and 4*pi()*abs(s_acctbal)/1e4/power(s_suppkey % 90, 2) <= 0.01 then 'auto: sliver' when abs(s_acctbal)/1e9 <= 1e-6 then 'auto: area' else '' end as approved_by
    from supplier where s_suppkey % 90 > 0"""
)
def removal_approval(spark, sf_dir):
    r = B.table(spark, sf_dir, "supplier").where("s_suppkey % 90 > 0").selectExpr(
        "s_suppkey as pid", "abs(s_acctbal) / 1e4 as area", "cast(s_suppkey % 90 as double) as perimeter", "abs(s_acctbal) / 1e9 as area_frac", "s_nationkey = 3 as approved"
    )
    return verdict.approve_removals(r).select("pid", F.round("circularity", 8).alias("circularity"), "approved_by")


@query("select n_nationkey as pid from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)")
def missing_faces(spark, sf_dir):
    need = B.table(spark, sf_dir, "nation").selectExpr("n_nationkey as pid")
    return verdict.missing(need, B.table(spark, sf_dir, "supplier").where("s_acctbal > 5000").selectExpr("s_nationkey as pid"), ["pid"])


_CONTRACT = """model as (
    select n_nationkey as model, n_nationkey % 4 as nv, n_nationkey % 7 as nf, (n_nationkey % 5)::double as free, coalesce(avg(s_acctbal), 0) / 1000 as len from nation left join supplier on s_nationkey = n_nationkey group by 1),
con as (select *, case when nv >= 2 then 'assembly' when nv = 1 then 'solid' when nf > 0 then 'sheet' else 'unknown' end as kind from model)"""


@query(
    f"""with {_CONTRACT}, gone as (select distinct s_nationkey as model, s_suppkey as pid from supplier where s_acctbal < 0)
    select model, 'contract.unexpected_boundary' as code, 1::bigint as count from con where nv >= 1 and len > 0
    union all select model, 'contract.boundary_mismatch', 1 from con where nv < 1 and ((free > 0 and abs(len - free) / free > 0.05) or (free <= 0 and len <= 0))
    union all select model, 'contract.nonmanifold_skin', 1 from con where model % 6 > 3
    union all select model, 'contract.inconsistent_orientation', 1 from con where model % 8 > 5
    union all select model, 'contract.missing_face', count(*) from gone group by model
    union all select model, 'contract.unapproved_removal', count(*) from gone where pid % 2 = 0 group by model
    union all select model, 'contract.interface_not_conformal', count(*) from gone join con using (model) where kind = 'assembly' and pid % 3 = 0 group by model"""
)
def contract_verify(spark, sf_dir):
    s = B.table(spark, sf_dir, "supplier")
    models = B.table(spark, sf_dir, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("model")).agg(
        (F.coalesce(F.avg("s_acctbal"), F.lit(0.0)) / 1000).alias("boundary_length")
    )
    models = models.selectExpr("*", "model % 4 as n_volumes", "model % 7 as n_faces", "cast(model % 5 as double) as free_edge_length", "if(model % 6 > 3, 1, 0) as n_nonmanifold", "if(model % 8 > 5, 1, 0) as n_inconsistent")
    gone = s.where("s_acctbal < 0").selectExpr("s_nationkey as model", "s_suppkey as pid").distinct()
    return verdict.contract_violations(verdict.topology_contract(models), gone, gone.where("pid % 2 = 0"), gone.where("pid % 3 = 0"))
