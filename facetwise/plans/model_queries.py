"""Gates, contracts, per-face fidelity and thickness, records, specifications, lookups and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.operators import audit, entities, fidelity, mesh, meshers, records, reports, sizefield, verdict
from facetwise.plans import bindings as B
from facetwise.plans.registry import query, rounded
from facetwise.plans.run_queries import _CONTRACT
from facetwise.sources.records import format_verdict

# ---- gates and objectives, all of them ----

_GATES = """g as (
    select s_suppkey as mesh, s_suppkey % 5 as n, s_suppkey % 3 - 1 as inv, s_suppkey % 4 - 2 as nm, s_nationkey % 2 as inc, s_suppkey % 7 - 5 as deg,
        s_suppkey % 2 = 0 as tight, s_suppkey % 11 + 1 as open, s_suppkey % 6 - 3 as dup from supplier),
fail as (
    select mesh, 'mesh.empty' as code, 1::bigint as count from g where n = 0
    union all select mesh, 'validity.inverted', inv from g where n > 0 and inv > 0 union all select mesh, 'validity.nonmanifold', nm from g where n > 0 and nm > 0
    union all select mesh, 'validity.orientation', inc from g where n > 0 and inc > 0 union all select mesh, 'validity.degenerate_shape', deg from g where n > 0 and deg > 0
    union all select mesh, 'validity.not_watertight', open from g where n > 0 and not tight union all select mesh, 'validity.duplicate_nodes', dup from g where n > 0 and dup > 0)"""


def _gates(spark, sf_dir):
    return B.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as mesh", "s_suppkey % 5 as n_triangles", "s_suppkey % 3 - 1 as n_inverted", "s_suppkey % 4 - 2 as n_nonmanifold_edges", "s_nationkey % 2 as n_inconsistent_normals",
        "s_suppkey % 7 - 5 as n_degenerate", "s_suppkey % 2 = 0 as is_watertight", "s_suppkey % 11 + 1 as n_boundary_edges", "s_suppkey % 6 - 3 as n_duplicates",
    )


_STRICT = verdict.Criteria(require_watertight=True, duplicate_tolerance=1e-9)


@query(f"with {_GATES} select * from fail")
def all_gates(spark, sf_dir):
    return verdict.failures(_gates(spark, sf_dir), ["mesh"], _STRICT)


_GOALS = """p as (
    select p_partkey as mesh, p_size / 50.0::double as min_shape, p_size::double as min_angle, 100.0::double + p_size as max_angle, p_size / 40.0::double as size_in_band,
        case when p_partkey % 3 > 0 then 1 + p_size / 25.0::double end as gradation, p_size / 500.0::double as chordal, case when p_partkey % 4 > 0 then p_size / 2.0::double end as normal_deviation from part),
o as (
    select mesh, 0 as ord, 'min_shape' as name, min_shape as value, 0.3::double as target, 2.0::double as weight, true as up from p union all select mesh, 1, 'min_angle', min_angle, 20, 2.0, true from p
    union all select mesh, 2, 'max_angle', max_angle, 130, 1.0, false from p union all select mesh, 3, 'size_in_band', size_in_band, 0.9, 1.5, true from p
    union all select mesh, 4, 'gradation', gradation, 1.5, 1.0, false from p where gradation is not null union all select mesh, 5, 'chordal', chordal, 0.05, 1.5, false from p
    union all select mesh, 6, 'normal_deviation', normal_deviation, 15, 1.5, false from p where normal_deviation is not null),
obj as (
    select mesh, ord, name, value, target, weight, case when up then value >= target else value <= target end as satisfied,
        case when up then greatest(0, least(1, value / target)) else case when value <= 0 then 1 else greatest(0, least(1, target / value)) end end as attainment from o)"""


def _goals(spark, sf_dir):
    return B.table(spark, sf_dir, "part").selectExpr(
        "p_partkey as mesh", "1 as n_triangles", "0 as n_inverted", "0 as n_degenerate", "p_size / 50.0D as min_shape", "cast(p_size as double) as min_angle", "100.0D + p_size as max_angle", "p_size / 40.0D as size_in_band",
        "if(p_partkey % 3 > 0, 1 + p_size / 25.0D, null) as gradation", "p_size / 500.0D as chordal", "if(p_partkey % 4 > 0, p_size / 2.0D, double('NaN')) as normal_deviation",
    )


@query(f"with {_GOALS} select mesh, name, round(value, 6) as value, satisfied, round(attainment, 6) as attainment from obj")
def all_objectives(spark, sf_dir):
    return rounded(verdict.objectives(_goals(spark, sf_dir), ["mesh"]).select("mesh", "name", "value", "satisfied", "attainment"))


@query(
    f"""with {_GOALS}, bad as (select distinct l_partkey as mesh, 'contract.missing_face' as code from lineitem where l_quantity > 49),
    s as (select mesh, bool_and(satisfied) as met, sum(attainment * weight) / sum(weight) as raw, min(struct_pack(a := attainment, o := ord, n := name)) filter (not satisfied) as w from obj group by mesh)
    select mesh, b.code is null as is_valid, b.code is null and met as ready, round(case when b.code is null then raw else 0 end, 6) as score, coalesce(b.code, '') as codes, w.n as worst
    from s left join bad b using (mesh)"""
)
def contract_gate(spark, sf_dir):
    gone = B.table(spark, sf_dir, "lineitem").where("l_quantity > 49").selectExpr("l_partkey as model", "'contract.missing_face' as code", "1L as count").distinct()
    more = verdict.as_failures(gone).withColumnRenamed("model", "mesh")
    out = verdict.scored(_goals(spark, sf_dir), ["mesh"], more=more)
    return rounded(out.select("mesh", "is_valid", "ready", "score", F.array_join("codes", ",").alias("codes"), "worst"))


@query(
    f"""with {_GOALS}, s as (select mesh, bool_and(satisfied) as met, sum(attainment * weight) / sum(weight) as raw, min(struct_pack(a := attainment, o := ord, n := name)) filter (not satisfied) as w from obj group by mesh)
    select mesh, printf('%-7s score %.3f', case when met then 'READY' else 'valid' end, raw) || case when w is not null then ': worst is ' || w.n else '' end as line from s where mesh not in (select mesh from (select mesh, abs(raw * 1000 - floor(raw * 1000) - 0.5) < 1e-6 as tie from s) where tie)"""
)
def verdict_lines(spark, sf_dir):
    scored = verdict.scored(_goals(spark, sf_dir), ["mesh"]).where("abs(score * 1000 - floor(score * 1000) - 0.5) >= 1e-6")  # a half rounds either way
    return reports.verdict_lines(scored, ["mesh"])


@query("select case when p_size % 10 > 7 then 'WARN' else 'INFO' end as severity, p_brand as code, printf('%-5s %s: %d (%.2f to %.2f)', case when p_size % 10 > 7 then 'WARN' else 'INFO' end, p_brand, count(*), min(p_size), max(p_size)) as line from (select * replace (p_size::double as p_size) from part) group by p_size % 10 > 7, p_brand")
def finding_lines(spark, sf_dir):
    return reports.finding_lines(B.table(spark, sf_dir, "part").selectExpr("if(p_size % 10 > 7, 'WARN', 'INFO') as severity", "p_brand as code", "cast(p_size as double) as measured"))


@query(
    f"""with {_CONTRACT}, gone as (select distinct s_nationkey as model, s_suppkey as pid from supplier where s_acctbal < 0)
    select model, 'contract.missing_face' as code, count(*) as count from gone group by model union all select model, 'contract.unexpected_boundary', 1 from con where nv >= 1 and len > 0"""
)
def contract_failures(spark, sf_dir):
    s = B.table(spark, sf_dir, "supplier")
    models = B.table(spark, sf_dir, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("model")).agg(
        (F.coalesce(F.avg("s_acctbal"), F.lit(0.0)) / 1000).alias("boundary_length")
    )
    models = verdict.topology_contract(models.selectExpr("*", "model % 4 as n_volumes", "model % 7 as n_faces", "cast(model % 5 as double) as free_edge_length", "0 as n_nonmanifold", "0 as n_inconsistent"))
    gone = s.where("s_acctbal < 0").selectExpr("s_nationkey as model", "s_suppkey as pid").distinct()
    found = verdict.contract_violations(models.where("n_volumes >= 1"), gone, gone.where("false"), gone.where("false"))
    return verdict.as_failures(found)


# ---- faces ----

_SURFACED = f"""with {B.SOUP}, {B.METRICS}, {B.REQUESTED}, bary as (select * from (values (1/3, 1/3, 1/3), (0.5, 0.5, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (2/3, 1/6, 1/6), (1/6, 2/3, 1/6), (1/6, 1/6, 2/3)) t(wa, wb, wc)),
pts as (select tri, pid, wa*ax+wb*bx+wc*cx as x, wa*ay+wb*by+wc*cy as y, wa*az+wb*bz+wc*cz as z from soup, bary),
dev as (select tri, max(case pid % 3 when 0 then abs(z) when 1 then abs(sqrt(x*x+y*y+z*z) - 0.2) else abs(sqrt(x*x+y*y) - 0.15) end) as d from pts group by tri),
ang as (
    select tri, degrees(acos(least(1, abs(case pid % 3 when 0 then nz / (2*area) when 1 then (nx*gx+ny*gy+nz*gz) / (2*area*sqrt(gx*gx+gy*gy+gz*gz)) else (nx*gx+ny*gy) / (2*area*sqrt(gx*gx+gy*gy)) end)))) as angle
    from (select *, (ax+bx+cx)/3 as gx, (ay+by+cy)/3 as gy, (az+bz+cz)/3 as gz from m))"""


@query(
    f"""{_SURFACED} select pid, count(*) as n_triangles, round(min(shape), 6) as shape_min, round(max(size / requested_size), 6) as size_ratio_max,
    round(max(d / requested_size), 6) as chordal_relative, round(quantile_cont(angle, 0.99), 4) as normal_p99_deg
    from m join dev using (tri) join ang using (tri) left join faces using (pid) group by pid"""
)
def face_fidelity(spark, sf_dir):
    tri = mesh.with_requested_size(B.soup(spark, sf_dir), B.requested(spark, sf_dir))
    faces = B.requested(spark, sf_dir).selectExpr("pid", "array('plane', 'sphere', 'cylinder')[cast(pid % 3 as int)] as kind", "if(pid % 3 = 1, 0.2D, 0.15D) as radius")
    out = mesh.attribute_by_face(fidelity.with_deviations(tri, faces))
    names = ("shape_min", "size_ratio_max", "chordal_relative")
    return out.select("pid", "n_triangles", *(F.round(n, 6).alias(n) for n in names), F.round("normal_p99_deg", 4).alias("normal_p99_deg"))


@query(
    """with h as (select user_id as face, event_id as tri, value as d, row_number() over (partition by user_id order by md5(cast(event_id as varchar)), event_id) as r from events)
    select face, round(quantile_cont(d, 0.05), 6) as thickness, count(*) as n from h where r <= 60 group by face"""
)
def face_thickness(spark, sf_dir):
    hits = B.table(spark, sf_dir, "events").selectExpr("user_id as face", "event_id as tri", "value as distance")
    return rounded(audit.face_thickness(hits, ["face"]))


@query(
    """with t as (select l_suppkey % 20 as model, l_orderkey as tri, median(l_extendedprice / 100) as t from lineitem group by all)
    select model, round(median(t), 6) as median, round(quantile_cont(t, 0.01), 6) as p01, round(min(t), 6) as least, count(*) as n, quantile_cont(t, 0.01) < 3 * 5.0 as blocked from t group by model"""
)
def thickness_rollup(spark, sf_dir):
    hits = B.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 20 as model", "l_orderkey as tri", "l_extendedprice / 100 as distance")
    return rounded(audit.thickness_guard(hits, ["model"], 5.0))


@query(
    f"""with {B.SOUP}, {B.METRICS}, t as (select pid, size / (0.1 + 0.5 * abs((ax+bx+cx)/3)) as ratio from m)
    select pid, count(*) as n_triangles, round(min(ratio), 6) as ratio_min, round(max(ratio), 6) as ratio_max, round(avg(case when ratio between 1/1.5 and 1.5 then 1 else 0 end), 6) as frac_in_band from t group by pid"""
)
def size_by_function(spark, sf_dir):
    tri = mesh.with_target(B.soup(spark, sf_dir), lambda x, y, z: F.abs(x) * 0.5 + 0.1)
    return rounded(mesh.size_adequation(tri, ["pid"]).select("pid", "n_triangles", "ratio_min", "ratio_max", "frac_in_band"))


@query("select label as pid, count(*) as n_triangles, 7 * count(*) as projections, count(*) as normals from embeddings group by label")
def surface_cost(spark, sf_dir):
    return fidelity.cost(B.soup(spark, sf_dir), ["pid"])


@query("select list_sort(list(value))[count(*) // 2 + 1] as median from events")
def whole_upper_median(spark, sf_dir):
    return records.upper_median(B.table(spark, sf_dir, "events"), "value")


@query("select distinct label as pid from embeddings where label is not null")
def mesh_pids(spark, sf_dir):
    return mesh.pids(B.soup(spark, sf_dir))


@query("select vec_id as tri from embeddings where label = 4")
def face_triangles(spark, sf_dir):
    return mesh.indices_for(B.soup(spark, sf_dir), 4).select("tri")


@query(
    """with f as (select s_suppkey as face, s_acctbal / 1000 as u0, s_acctbal / 1000 + 2 as u1, -1.0::double as v0, 1.0::double as v1 from supplier),
    g as (select face, i, j, u0 + (u1-u0)*i/4 as u, v0 + (v1-v0)*j/4 as v from f, range(5) a(i), range(5) b(j))
    select face, count(*) as n, round(sum(u), 6) as su, round(sum(v), 6) as sv from g where u*u + v*v < 20 group by face"""
)
def sample_domain(spark, sf_dir):
    f = B.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as face", "s_acctbal / 1000 as u0", "s_acctbal / 1000 + 2 as u1", "-1D as v0", "1D as v1")
    g = audit.sample_domain(f, 5, lambda u, v: u * u + v * v < 20)
    return rounded(g.groupBy("face").agg(F.count("*").alias("n"), F.sum("u").alias("su"), F.sum("v").alias("sv")))


# ---- audit ----

_MODELS = """e as (
    select c_nationkey as model, c_custkey % 4 as dim, c_custkey as tag, case when c_nationkey % 6 = 5 then -1 else abs(c_acctbal) end as mass, c_acctbal as lo, c_acctbal + c_custkey % 9 as hi
    from customer where not (c_nationkey % 7 = 3 and c_custkey % 4 = 3)),
t as (
    select model, count(*) filter (dim = 0) as n_points, count(*) filter (dim = 1) as n_curves, count(*) filter (dim = 2) as n_faces, count(*) filter (dim = 3) as n_volumes,
        coalesce(sum(mass) filter (dim = 3), 0) as total_volume, sqrt(3) * (max(hi) - min(lo)) as scale from e group by model),
found as (
    select model, 'topology.no_volume' as code, null::double as measured from t where n_volumes = 0 union all select model, 'topology.nonpositive_volume', total_volume from t where n_volumes > 0 and total_volume <= 0)"""


def _entities(spark, sf_dir):
    sides = [f"c_acctbal as {x}lo" for x in "xyz"] + [f"c_acctbal + c_custkey % 9 as {x}hi" for x in "xyz"]
    c = B.table(spark, sf_dir, "customer").where("not (c_nationkey % 7 = 3 and c_custkey % 4 = 3)")
    return c.selectExpr("c_nationkey as model", "cast(c_custkey % 4 as int) as dim", "c_custkey as tag", "if(c_nationkey % 6 = 5, -1D, abs(c_acctbal)) as mass", *sides)


@query(f"with {_MODELS} select model, n_points, n_curves, n_faces, n_volumes, round(total_volume, 4) as total_volume, round(scale, 4) as scale from t")
def model_counts(spark, sf_dir):
    return rounded(audit.counts(_entities(spark, sf_dir), ["model"]), digits=4)


@query(f"with {_MODELS} select model, code, 'BLOCK' as severity, round(measured, 4) as measured from found")
def volume_findings(spark, sf_dir):
    found = audit.volume_findings(audit.counts(_entities(spark, sf_dir), ["model"]), ["model"])
    return rounded(found.select("model", "code", "severity", "measured"), digits=4)


@query(f"with {_MODELS} select model, n_faces from t where model not in (select model from found)")
def audit_gate(spark, sf_dir):
    models = audit.counts(_entities(spark, sf_dir), ["model"])
    warn = models.selectExpr("model", "'face.sliver' as code", "'WARN' as severity")
    return audit.proceed(models, audit.add(audit.volume_findings(models, ["model"]), warn), ["model"]).select("model", "n_faces")


_SHARED = "fv as (select o_orderkey % 40 as model, o_custkey % 90 as face, o_orderkey % 3 as volume from orders where o_orderkey % 40 < o_custkey % 50)"


@query(
    f"""with {_SHARED}, m as (select n_nationkey as model, n_nationkey % 4 as nv from nation),
    s as (select model, count(*) as n from (select model, face from fv group by all having count(distinct volume) > 1) group by model)
    select model, case when coalesce(n, 0) > 0 then 'INFO' else 'WARN' end as severity, coalesce(n, 0)::double as measured from m left join s using (model) where nv > 1"""
)
def imprint_findings(spark, sf_dir):
    fv = B.table(spark, sf_dir, "orders").where("o_orderkey % 40 < o_custkey % 50").selectExpr("o_orderkey % 40 as model", "o_custkey % 90 as face", "o_orderkey % 3 as volume")
    models = B.table(spark, sf_dir, "nation").selectExpr("n_nationkey as model", "n_nationkey % 4 as n_volumes")
    return audit.imprint_findings(models, fv, ["model"]).select("model", "severity", "measured")


@query(
    f"""with {_MODELS}, {_SHARED}, fc as (select o_orderkey % 25 as model, o_custkey as curve from orders),
    free as (select x.model, sum(mass) as len from (select model, curve from fc group by all having count(*) = 1) x join e on x.model = e.model and x.curve = e.tag and e.dim = 1 group by x.model),
    own as (select model, list_sort(list(face)) as faces from (select model, face from fv group by all having count(distinct volume) > 1) group by model)
    select t.model, n_volumes, n_faces, round(coalesce(len, 0), 4) as free_edge_length, coalesce(array_to_string(faces, ','), '') as interface_faces from t left join free using (model) left join own using (model)"""
)
def body_kind_inputs(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders")
    fv = orders.where("o_orderkey % 40 < o_custkey % 50").selectExpr("o_orderkey % 40 as model", "o_custkey % 90 as face", "o_orderkey % 3 as volume")
    out = audit.body_kind_inputs(_entities(spark, sf_dir), orders.selectExpr("o_orderkey % 25 as model", "0 as face", "o_custkey as curve"), fv, ["model"])
    return rounded(out.withColumn("interface_faces", F.array_join(F.transform("interface_faces", lambda x: x.cast("string")), ",")), digits=4)


# ---- entities ----

_LIVE = "x as (select c_nationkey as model, c_custkey % 3 as dim, c_custkey // 3 as tag, 'f' || c_custkey % 50 as fp, c_custkey % 5 > 0 as alive, c_custkey % 10 as cx from customer)"


def _live(spark, sf_dir):
    return B.table(spark, sf_dir, "customer").selectExpr(
        "c_nationkey as model", "c_custkey % 3 as dim", "cast(floor(c_custkey / 3) as bigint) as tag", "concat('f', c_custkey % 50) as fp", "c_custkey % 5 > 0 as alive", "cast(c_custkey % 10 as double) as cx", "0D as cy", "0D as cz", "1D as mass"
    )


@query(f"with {_LIVE} select model, dim, tag, row_number() over (partition by model order by dim, cx, tag) as place from x")
def canonical_order(spark, sf_dir):
    return entities.canonical_order(_live(spark, sf_dir), ["model"]).select("model", "dim", "tag", F.col("place").cast("long").alias("place"))


_NAMED = f"{_LIVE}, p as (select *, row_number() over (partition by model order by dim, cx, tag) as place from x), n as (select *, row_number() over (partition by model, fp order by place) - 1 as k from p), z as (select *, case when k = 0 then fp else fp || '~' || k end as pid from n)"


def _named(spark, sf_dir):
    return entities.new_pids(entities.canonical_order(_live(spark, sf_dir), ["model"]), ["model"])


@query(f"with {_NAMED} select model, dim, tag, pid from z")
def new_pids(spark, sf_dir):
    return _named(spark, sf_dir).select("model", "dim", "tag", "pid")


@query(f"with {_NAMED} select model, pid from z where alive and dim = 1 and tag = 2")
def pid_for_tag(spark, sf_dir):
    return entities.pid_for_tag(_named(spark, sf_dir), 1, 2)


@query(f"with {_NAMED} select model, dim, tag from z where alive and pid = 'f7'")
def tag_for_pid(spark, sf_dir):
    return entities.tag_for_pid(_named(spark, sf_dir), "f7")


# ---- run records ----

_REC = f"with {B.RECORDS}"


@query(f"{_REC} select outcome, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 6) as percent from rec group by outcome")
def report_outcomes(spark, sf_dir):
    return rounded(records.report(B.records(spark, sf_dir))["outcomes"])


@query(f"{_REC} select code, count(*) as n from (select unnest(list_filter([case when not is_valid then 'mesher.failed' end, case when k > 80 then 'validity.nonmanifold' end], lambda c: c is not null)) as code from it) group by code")
def report_failures(spark, sf_dir):
    return records.report(B.records(spark, sf_dir))["failures"]


@query(
    f"""{_REC} select name, count(*) as n from (
        select unnest(list_filter([case when last_score < 60 then 'min_shape' end, case when last_score < 20 then 'min_angle' end, case when last_score < 5 then 'chordal' end], lambda c: c is not null)) as name
        from rec where outcome not in ('accepted', 'escalated')) group by name"""
)
def report_missed(spark, sf_dir):
    return records.report(B.records(spark, sf_dir))["missed"]


@query(f"{_REC} select part, outcome, round(seconds, 6) as seconds from rec where (select max(seconds) from rec) > 30 order by rec.seconds desc, part limit 5")
def report_slowest(spark, sf_dir):
    return rounded(records.report(B.records(spark, sf_dir))["slowest"])


_TABLE = "select part, outcome, n as n_iterations, coalesce(best_tri, last_tri, 0) as triangles, coalesce(best_score, 0) as score, round(seconds, 6) as seconds, best_tri is not null as valid from rec"


@query(f"{_REC} {_TABLE}")
def run_table(spark, sf_dir):
    return rounded(records.run_table(B.records(spark, sf_dir)), "score").withColumn("n_iterations", F.col("n_iterations").cast("long"))


@query(f"{_REC} {_TABLE} where outcome <> 'accepted'")
def run_table_failed(spark, sf_dir):
    return rounded(records.run_table(B.records(spark, sf_dir), failed=True), "score").withColumn("n_iterations", F.col("n_iterations").cast("long"))


@query("select event_id, date_diff('microsecond', min(ts) over (partition by user_id), ts) / 1e6 as elapsed from events")
def elapsed(spark, sf_dir):
    ev = B.table(spark, sf_dir, "events").withColumns({"run": F.col("user_id"), "idx": F.struct("ts", "event_id")})
    return records.elapsed(ev).select("event_id", F.round("elapsed", 6).alias("elapsed"))


_STEPS = """r as (
    select run, idx, 'base' as kind, '' as scope, map {'h': floor(score / 40)::double} as params from it
    union all select run, idx, 'feature', 'f' || k % 3, map {'h': 0.5::double, 'w': (k % 2)::double} from it where k % 4 > 0),
q as (select run, idx, kind, scope, unnest(map_entries(params), recursive := true) from r)"""


@query(
    f"""with {B.ITERATIONS}, {_STEPS},
    b as (select coalesce(n.run, o.run) as run, coalesce(n.idx, o.idx + 1) as idx, coalesce(n.kind, o.kind) as kind, coalesce(n.scope, o.scope) as scope, coalesce(n.key, o.key) as param, o.value as old, n.value as new
        from q n full join q o on n.run = o.run and n.idx = o.idx + 1 and n.kind = o.kind and n.scope = o.scope and n.key = o.key)
    select run, cast(idx as bigint) as idx, case when old is null then '+' when new is null then '-' else '~' end as op, kind, scope, param, old, new
    from b where idx > 0 and old is distinct from new and exists (select 1 from it where it.run = b.run and it.idx = b.idx)"""
)
def spec_changes(spark, sf_dir):
    it = B.iterations(spark, sf_dir)
    base = it.selectExpr("run", "idx", "'base' as kind", "'' as scope", "map('h', cast(floor(score / 40) as double)) as params")
    feature = it.where("k % 4 > 0").selectExpr("run", "idx", "'feature' as kind", "concat('f', k % 3) as scope", "map('h', 0.5D, 'w', cast(k % 2 as double)) as params")
    return records.spec_changes(base.unionByName(feature)).withColumn("idx", F.col("idx").cast("long"))


@query("select p_brand as spec_id, cast(p_partkey as integer) as ord, p_type as kind, p_size::double as h, p_retailprice as w, p_name as scope from part")
def spec_json(spark, sf_dir):
    rules = B.table(spark, sf_dir, "part").selectExpr("p_brand as spec_id", "cast(p_partkey as int) as ord", "p_type as kind", "map('h', cast(p_size as double), 'w', p_retailprice) as params", "array(p_name) as scope")
    back = sizefield.from_json(sizefield.to_json(rules, ["spec_id"]), ["spec_id"])
    return back.selectExpr("spec_id", "ord", "kind", "params['h'] as h", "params['w'] as w", "scope[0] as scope")


@query("select l_returnflag as scenario, count(*) as n, round(avg(l_extendedprice / l_quantity), 6) as ratio_mean, round(max(l_extendedprice / l_quantity), 6) as ratio_max from lineitem group by 1")
def estimate_ratio(spark, sf_dir):
    runs = B.table(spark, sf_dir, "lineitem").selectExpr("l_returnflag as scenario", "l_quantity as estimate", "l_extendedprice as n_triangles")
    return rounded(records.estimate_ratio(runs, ["scenario"]))


# ---- loops and predicates ----

_LOOPS = """node as (
    select user_id // 2 as face, user_id % 2 as loop, row_number() over (partition by user_id order by ts, event_id) - 1 as ord, value * cos(event_id) as u, value * sin(event_id) as v from events),
nxt as (
    select *, coalesce(lead(u) over w, first_value(u) over w) as u1, coalesce(lead(v) over w, first_value(v) over w) as v1 from node
    window w as (partition by face, loop order by ord rows between unbounded preceding and unbounded following)),
area as (select face, loop, count(*) as n, sum(u * v1 - u1 * v) / 2 as area from nxt group by all),
rank as (select *, row_number() over (partition by face order by abs(area) desc, loop) = 1 as is_outer from area)"""


def _loops(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = B.table(spark, sf_dir, "events").withColumn("ord", F.row_number().over(order) - 1)
    return n.selectExpr("cast(floor(user_id / 2) as bigint) as face", "user_id % 2 as loop", "ord", "value * cos(cast(event_id as double)) as u", "value * sin(cast(event_id as double)) as v")


@query(f"with {_LOOPS} select face, loop, cast(case when (area > 0) <> is_outer then n - 1 - ord else ord end as bigint) as ord, is_outer, round(u, 6) as u from node join rank using (face, loop)")
def orient_loops(spark, sf_dir):
    out = meshers.orient_loops(_loops(spark, sf_dir), ["face"])
    return rounded(out.select("face", "loop", F.col("ord").cast("long").alias("ord"), "is_outer", "u"))


@query(f"with {_LOOPS} select face, loop, n, cast(coalesce(sum(n) over (partition by face order by loop rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from area")
def loop_offsets(spark, sf_dir):
    return meshers.loop_offsets(_loops(spark, sf_dir), ["face"])


@query(
    f"""with {_LOOPS}, c as (select *, greatest(1, round(sqrt(power(u1-u, 2) + power(v1-v, 2)) / 50)) as parts from nxt)
    select face, loop, cast(sum(parts) as bigint) as n, round(sum(parts * u + (u1-u) * (parts - 1) / 2), 3) as su from c group by all"""
)
def resample(spark, sf_dir):
    cut = meshers.resample(_loops(spark, sf_dir), ["face"], 50.0)
    return cut.groupBy("face", "loop").agg(F.count("*").alias("n"), F.round(F.sum("u"), 3).alias("su"))


_PLANE = "pt as (select vec_id, " + ", ".join(f"embedding[{k + 1}]::double as {n}" for k, n in enumerate("abcdefgh")) + " from embeddings)"


@query(
    f"""with {_PLANE}, s as (select *, a-g as x1, b-h as y1, c-g as x2, d-h as y2, e-g as x3, f-h as y3 from pt)
    select vec_id, cast(sign((a-e)*(d-f) - (b-f)*(c-e)) as integer) as side,
        cast(sign(x1*(y2*(x3*x3+y3*y3) - y3*(x2*x2+y2*y2)) - y1*(x2*(x3*x3+y3*y3) - x3*(x2*x2+y2*y2)) + (x1*x1+y1*y1)*(x2*y3 - x3*y2)) as integer) as circle from s"""
)
def plane_predicates(spark, sf_dir):
    a, b, c, d, e, f, g, h = (F.col("embedding")[k].cast("double") for k in range(8))
    return B.table(spark, sf_dir, "embeddings").select("vec_id", G.orient2d(a, b, c, d, e, f).alias("side"), G.in_circle(a, b, c, d, e, f, g, h).alias("circle"))


@query(
    """with p as (select c_custkey, 'x/' || c_name || ['.STEP', '.stl', '.sldprt', '.txt', '.iges'][c_custkey % 5 + 1] as path from customer)
    select c_custkey, case when lower(path) like '%.step' or lower(path) like '%.iges' then 'ok' when path like '%.stl' then 'mesh: has no exact surfaces' when path like '%.sldprt' then 'native: export as STEP' else 'unknown format' end as verdict from p"""
)
def format_check(spark, sf_dir):
    path = F.expr("concat('x/', c_name, array('.STEP', '.stl', '.sldprt', '.txt', '.iges')[cast(c_custkey % 5 as int)])")
    return B.table(spark, sf_dir, "customer").select("c_custkey", format_verdict(path).alias("verdict"))


@query()
def front_statistics(spark, sf_dir):
    return meshers.front_statistics(meshers.cases(spark), "front")
