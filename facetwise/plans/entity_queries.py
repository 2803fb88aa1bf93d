"""Entity identity, provenance, policy and mesher queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.operators import decisions, entities, meshers, policy
from facetwise.plans import bindings as B
from facetwise.plans.registry import query, rounded

# Customers are boxes around their balance; even keys are the old snapshot, odd keys the new one, halved keys their place.
_BOX = """box as (
    select c_custkey, c_mktsegment as model, c_custkey // 2 as tag, c_custkey % 2 as side, 2 as dim, abs(c_acctbal) / (1 + c_custkey % 3) as mass,
        round(c_acctbal / 100, 0) - (3 - c_custkey % 3) as xlo, round(c_acctbal / 100, 0) + (3 - c_custkey % 3) as xhi,
        c_nationkey % 5 - (3 - c_custkey % 3)::double as ylo, c_nationkey % 5 + (3 - c_custkey % 3)::double as yhi, -1.0::double as zlo, 1.0::double as zhi from customer),
old as (select * from box where side = 0), new as (select * from box where side = 1)"""
_IN = "{0}.xlo >= {1}.xlo - 0.5 and {0}.xhi <= {1}.xhi + 0.5 and {0}.ylo >= {1}.ylo - 0.5 and {0}.yhi <= {1}.yhi + 0.5 and {0}.zlo >= {1}.zlo - 0.5 and {0}.zhi <= {1}.zhi + 0.5"


def _boxes(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").selectExpr(
        "c_mktsegment as model", "cast(floor(c_custkey / 2) as bigint) as tag", "cast(floor(c_custkey / 2) as bigint) as pid", "c_custkey % 2 as side", "2 as dim",
        "abs(c_acctbal) / (1 + c_custkey % 3) as mass", "round(c_acctbal / 100, 0) - (3 - c_custkey % 3) as xlo", "round(c_acctbal / 100, 0) + (3 - c_custkey % 3) as xhi",
        "cast(c_nationkey % 5 - (3 - c_custkey % 3) as double) as ylo", "cast(c_nationkey % 5 + (3 - c_custkey % 3) as double) as yhi", "-1D as zlo", "1D as zhi",
    )
    return c.where("side = 0").drop("side"), c.where("side = 1").drop("side")


@query(
    f"""with {_BOX} select o.model, o.tag as o_pid, n.tag as n_tag from old o join new n on o.model = n.model
    where {_IN.format('o', 'n')} and {_IN.format('n', 'o')} and (greatest(o.mass, n.mass) <= 0 or abs(o.mass - n.mass) / greatest(o.mass, n.mass) <= 0.2)"""
)
def bbox_coincident(spark, sf_dir):
    old, new = _boxes(spark, sf_dir)
    return entities.coincident_pairs(old, new, ["model"], F.lit(0.5), 0.2).select("model", "o_pid", "n_tag")


@query(
    f"""with {_BOX} select n.model, n.tag as n_tag, arg_min(o.tag, (o.mass, o.tag)) as o_pid from new n join old o on o.model = n.model and {_IN.format('n', 'o')} group by n.model, n.tag"""
)
def bbox_parent(spark, sf_dir):
    old, new = _boxes(spark, sf_dir)
    return entities.tightest_parent(old, new, ["model"], F.lit(0.5))


@query(
    f"""with {_BOX}, key as (select *, concat_ws('|', xlo, xhi, ylo, yhi) as fp from box),
    o as (select model, fp, tag, row_number() over (partition by model, fp order by tag) as k, count(*) over (partition by model, fp) as c from key where side = 0),
    n as (select model, fp, tag, row_number() over (partition by model, fp order by tag) as k, count(*) over (partition by model, fp) as c from key where side = 1)
    select o.model, o.tag as pid, n.tag from o join n using (model, fp, k, c)"""
)
def fingerprint_match(spark, sf_dir):
    old, new = (d.withColumns({"n_boundary": F.lit(4), "curvature_sig": F.array().cast("array<double>"), "normal_sig": F.array().cast("array<double>"), "cx": F.lit(0.0), "cy": F.lit(0.0), "cz": F.lit(0.0), "own": F.col("mass"), "mass": F.lit(1.0)}) for d in _boxes(spark, sf_dir))
    frame = (F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    fp = entities.fingerprint(frame)
    return entities.fingerprint_matches(old.withColumn("fp", fp), new.withColumn("fp", fp), ["model"]).select("model", "pid", "tag")


@query(
    """with e as (select c_mktsegment as model, ['same', 'same', 'split', 'merge', 'created'][c_custkey % 5 + 1] as relation from customer where c_custkey % 7 <> 3)
    select model, count(*) filter (relation = 'same') as same, count(*) filter (relation = 'split') as split, count(*) filter (relation = 'merge') as merge,
        count(*) filter (relation = 'created') as created, count(*) as n, round(count(*) filter (relation = 'same') / count(*), 6) as preserved from e group by model"""
)
def stability(spark, sf_dir):
    e = B.table(spark, sf_dir, "customer").selectExpr("c_mktsegment as model", "array('same', 'same', 'split', 'merge', 'created')[cast(c_custkey % 5 as int)] as relation", "c_custkey % 7 <> 3 as alive")
    return rounded(entities.stability(e, ["model"]))


_TREE = "edge as (select c_custkey // 2 as parent, c_custkey as child from customer where c_custkey > 0)"


def _tree(spark, sf_dir):
    return B.table(spark, sf_dir, "customer").where("c_custkey > 0").selectExpr("cast(floor(c_custkey / 2) as bigint) as parent", "c_custkey as child")


@query(
    f"""with recursive {_TREE}, live as (select c_custkey as pid from customer where c_custkey % 3 <> 0),
    reach(node, reached) as (select parent, child from edge union select r.node, e.child from reach r join edge e on e.parent = r.reached)
    select node, reached from reach where reached in (select pid from live) union select pid, pid from live"""
)
def descendants(spark, sf_dir):
    alive = B.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey as pid")
    return entities.descendants(_tree(spark, sf_dir), alive)


@query(
    f"""with recursive {_TREE}, reach(node, reached) as (select child, parent from edge union select r.node, e.parent from reach r join edge e on e.child = r.reached)
    select node, reached from reach"""
)
def ancestors(spark, sf_dir):
    return entities.closure(_tree(spark, sf_dir), up=True)


@query()
def entity_match(spark, sf_dir):
    old, new = _boxes(spark, sf_dir)
    fp = F.concat_ws("|", "xlo", "xhi", "ylo", "yhi", F.round("mass", 2))
    old = old.withColumns({"fp": fp, "pid": F.col("pid").cast("string")})
    frames = old.select("model").distinct().withColumn("scale", F.lit(25.0))
    return entities.match_snapshots(old, new.withColumn("fp", fp).drop("pid"), frames)


_CODES = (
    "validity.nonmanifold", "validity.degenerate_shape", "validity.inverted", "mesher.failed", "validity.orientation", "contract.unapproved_removal", "contract.interface_not_conformal", "contract.boundary_mismatch", "other.code",
)
#: A case has one, two or three of the codes.
_CASE = f"""e as (
    select c_custkey as case_id, {list(_CODES)} as all_codes, list_distinct([all_codes[c_custkey % 9 + 1], all_codes[c_custkey % 8 + 1], all_codes[(c_custkey // 5) % 9 + 1]]) as codes,
        ['Periodic surface', '1D mesh not forming a closed loop', 'boom'][c_custkey % 7 % 3 + 1] as said, c_custkey % 4 > 0 as imprint, c_custkey % 3 = 1 as heal,
        [0.0001, 0.0005, 0.001, 0.01][c_custkey % 4 + 1]::double as frac, c_custkey % 5 as passes, ['default', 'frontal', 'delaunay', 'meshadapt'][c_custkey % 11 % 4 + 1] as algorithm, c_custkey % 13 % 3 as tightened from customer),
c as (select *, unnest(codes) as code from e),
a as (
    select case_id, code, codes, case
        when code = 'validity.nonmanifold' then case when not imprint then 'reimprint:0' when tightened < 2 then 'tighten_tolerance:1' end
        when code = 'validity.degenerate_shape' then case when not heal then 'enable_healing:0' when frac * 10 <= 0.01 then 'increase_heal_tolerance:1' else 'escalate:90' end
        when code = 'validity.inverted' then case when passes < 3 then 'increase_optimization:2' else 'switch_algorithm:3' end
        when code = 'mesher.failed' and said = 'Periodic surface' then case when algorithm <> 'meshadapt' then 'switch_algorithm:0' when not heal then 'enable_healing:1' else 'escalate:94' end
        when code = 'mesher.failed' and said <> 'boom' then case when not heal then 'enable_healing:0' when tightened < 2 then 'tighten_tolerance:1' else 'escalate:94' end
        when code = 'mesher.failed' then 'switch_algorithm:2' when code = 'validity.orientation' then 'escalate:95' when code = 'contract.unapproved_removal' then 'escalate:91'
        when code = 'contract.interface_not_conformal' then 'reimprint:1' when code = 'contract.boundary_mismatch' then 'escalate:93' end as act,
        case code when 'mesher.failed' then case when said = 'Periodic surface' then 'meshadapt' when said = 'boom' then case algorithm when 'frontal' then 'delaunay' else 'frontal' end end
            when 'validity.inverted' then case algorithm when 'frontal' then 'delaunay' else 'frontal' end end as target,
        case when code = 'validity.nonmanifold' then 0.001 when code = 'mesher.failed' then 0.1 else frac * 10 end as number from c),
act as (
    select case_id, code as evidence, split_part(act, ':', 1) as kind, cast(split_part(act, ':', 2) as integer) as priority, list_position({list(_CODES)}, code) as ord,
        case when kind = 'switch_algorithm' then target end as algorithm, case when kind in ('tighten_tolerance', 'increase_heal_tolerance') then number end as number from a where act is not null
    union all
    select case_id, array_to_string(list_sort(codes), ',') as evidence, 'escalate', 99, 0, null, null from e where not exists (select 1 from a where a.case_id = e.case_id and act is not null))"""


@query(f"with {_CASE} select case_id, evidence, cast(row_number() over (partition by case_id order by priority, ord) - 1 as integer) as place, kind, priority, algorithm, round(number, 9) as number from act")
def policy_actions(spark, sf_dir):
    pick = lambda rows, at: F.array(*map(F.lit, rows))[at.cast("int")]
    k = F.col("c_custkey")
    e = B.table(spark, sf_dir, "customer").select(
        k.alias("case_id"), F.array_distinct(F.array(pick(_CODES, k % 9), pick(_CODES, k % 8), pick(_CODES, F.floor(k / 5) % 9))).alias("codes"),
        pick(("Periodic surface", "1D mesh not forming a closed loop", "boom"), k % 7 % 3).alias("exception"), (k % 4 > 0).alias("imprint"), (k % 3 == 1).alias("heal"),
        pick((0.0001, 0.0005, 0.001, 0.01), k % 4).alias("heal_tolerance_frac"), (k % 5).cast("int").alias("optimize_passes"), pick(("default", "frontal", "delaunay", "meshadapt"), k % 11 % 4).alias("algorithm"),
        F.array_repeat(F.lit("tighten_tolerance"), (k % 13 % 3).cast("int")).alias("history"), F.lit(100.0).alias("scale"),
    )
    out = decisions.strategy_actions(e)
    number = F.round(F.coalesce(F.col("params")["tolerance"], F.col("params")["heal_tolerance_frac"]), 9)
    return out.select("case_id", "evidence", "place", "kind", "priority", "algorithm", number.alias("number"))


#: Runs are suppliers, their faces the lines that they supply.
_FACES = """face as (
    select l_suppkey as case_id, l_orderkey * 10 + l_linenumber as pid, l_extendedprice / 100 as area, case when l_quantity % 10 = 0 then null else l_quantity / 10 end::double as size,
        l_discount * 10 + l_quantity / 1000 as chordal_relative, case when l_tax = 0 then null else l_tax * 100 + l_discount end::double as normal_p99_deg, (l_partkey % 100) / 100.0::double as shape_min from lineitem),
run as (
    select s_suppkey as case_id, 100.0::double as scale, (s_suppkey % 5)::integer as passes, s_suppkey % 2 = 0 as refined, [1000, 100000, 100000000][s_suppkey % 3 + 1] as budget, case when s_suppkey % 4 > 0 then s_suppkey % 7 + 1.0 end::double as h,
        case when s_suppkey % 3 > 0 then 0.5 end::double as chord, list_filter([
            case when s_suppkey % 2 = 0 then 'min_shape' end, case when s_suppkey % 3 < 2 then 'chordal' end, case when s_suppkey % 5 < 3 then 'size_in_band' end, case when s_suppkey % 7 < 4 then 'normal_deviation' end,
            case when s_suppkey % 3 = 0 then 'gradation' end, case when s_suppkey % 11 = 0 then 'unknown' end, case when s_suppkey % 4 = 1 then 'max_angle' end], lambda x: x is not null) as missed from supplier)"""


def _runs(spark, sf_dir):
    f = B.table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as case_id", "l_orderkey * 10 + l_linenumber as pid", "l_extendedprice / 100 as area", "cast(if(l_quantity % 10 = 0, null, l_quantity / 10) as double) as size", "l_discount * 10 + l_quantity / 1000 as chordal_relative",
        "cast(if(l_tax = 0, null, l_tax * 100 + l_discount) as double) as normal_p99_deg", "(l_partkey % 100) / 100D as shape_min",
    )
    c = B.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as case_id", "100D as scale", "cast(s_suppkey % 5 as int) as optimize_passes", "s_suppkey % 2 = 0 as refined", "array(1000L, 100000L, 100000000L)[cast(s_suppkey % 3 as int)] as budget", "cast(if(s_suppkey % 4 > 0, s_suppkey % 7 + 1, null) as double) as h",
        "cast(if(s_suppkey % 3 > 0, 0.5, null) as double) as chordal_tol", "cast(null as double) as normal_tol_deg", "cast(null as double) as max_growth", "cast(null as double) as h_min",
        """transform(filter(array(if(s_suppkey % 2 = 0, 'min_shape', null), if(s_suppkey % 3 < 2, 'chordal', null), if(s_suppkey % 5 < 3, 'size_in_band', null), if(s_suppkey % 7 < 4, 'normal_deviation', null),
            if(s_suppkey % 3 = 0, 'gradation', null), if(s_suppkey % 11 = 0, 'unknown', null), if(s_suppkey % 4 = 1, 'max_angle', null)), x -> x is not null),
            x -> named_struct('name', x, 'frac_oversized', (s_suppkey % 10) / 10D, 'frac_undersized', 0.35D)) as missed""",
    )
    return c, f


_COUNT = "case when area > 0 and {h} > 0 then area / ({h} * {h} * sqrt(3) / 4) else 0 end"
_SCOPED = f"""{_FACES},
low as (select case_id, list(pid order by shape_min, pid)[:5] as pids from face group by case_id),
fine as (select l.case_id, min(coalesce(size, 100)) * 0.6 as h from low l join face f on f.case_id = l.case_id and list_contains(l.pids, f.pid) group by l.case_id),
part as (
    select f.case_id, fine.h, cast(round_even(sum(case when list_contains(pids, pid) then {_COUNT.format(h="fine.h")} else {_COUNT.format(h="coalesce(size, 0)")} end), 0) as bigint) as estimate
    from face f join low using (case_id) join fine on fine.case_id = f.case_id group by f.case_id, fine.h)"""


@query(f"with {_SCOPED} select p.case_id, round(p.h, 9) as h, estimate, estimate <= budget as affordable from part p join run using (case_id)")
def budgeted_refine(spark, sf_dir):
    c, f = _runs(spark, sf_dir)
    scopes = decisions.worst_scopes(f).select("case_id", F.col("shape_min").alias("scope"))
    least = f.join(scopes.select("case_id", F.explode("scope").alias("pid")), ["case_id", "pid"]).groupBy("case_id").agg((F.min(F.coalesce("size", F.lit(100.0))) * 0.6).alias("h"))
    return rounded(decisions.budgeted(f, c.select("case_id", "budget").join(scopes, "case_id").join(least, "case_id")), digits=9)


@query(
    f"""with {_SCOPED},
    chord as (select case_id, list(pid order by chordal_relative desc, pid desc)[:5] as pids from face group by case_id),
    norm as (select case_id, list(pid order by normal_p99_deg desc, pid desc)[:5] as pids from face where normal_p99_deg is not null group by case_id),
    whole as (select case_id, cast(round_even(sum({_COUNT.format(h="(coalesce(run.h, 5) * 0.7)")}), 0) as bigint) as estimate from face join run using (case_id) group by case_id),
    o as (select r.*, coalesce(r.h, 5) as base, coalesce(chord, 2) as tol, unnest(missed) as name, unnest(range(0, len(missed))) as turn from run r),
    a as (
        select case_id, turn, name, 0 as step, 10 + turn as priority, 'tighten_curvature' as kind, tol * 0.5 as value, 12.0 as normal, pids from o left join chord using (case_id) where name = 'chordal'
        union all select case_id, turn, name, 1, 10 + turn, 'tighten_curvature', tol, 7.2, pids from o left join norm using (case_id) where name = 'normal_deviation'
        union all select case_id, turn, name, 2, 10 + turn, 'tighten_gradation', 1.24, null, [] from o where name = 'gradation'
        union all select case_id, turn, name, 3, 10 + turn, 'increase_optimization', null, null, [] from o where name in ('min_shape', 'max_angle') and passes < 3
        union all select case_id, turn, name, 4, 10 + turn, 'refine_global', base * 0.7, null, [] from o left join whole using (case_id) where name in ('min_shape', 'max_angle') and refined and coalesce(estimate, 0) <= budget
        union all select case_id, turn, name, 5, 11 + turn, 'refine_faces', part.h, null, pids from o join part using (case_id) join low using (case_id) where name in ('min_shape', 'max_angle') and estimate <= budget
        union all select case_id, turn, name, 6, 10 + turn, case when case_id % 10 > 3 then 'coarsen_global' else 'raise_floor' end, case when case_id % 10 > 3 then base * 0.8 else 0.2 end, null, [] from o where name = 'size_in_band')
    select case_id, cast(row_number() over (partition by case_id order by priority, turn, step) - 1 as integer) as place, kind, cast(priority as integer) as priority, name as evidence, round(value, 9) as value, cast(normal as double) as normal, coalesce(array_to_string(pids, ','), '') as scope from a"""
)
def objective_actions(spark, sf_dir):
    out = decisions.objective_actions(*_runs(spark, sf_dir))
    p = F.col("params")
    value = F.coalesce(p["chordal_tol"], p["max_growth"], p["h"], p["h_min"])
    return out.select("case_id", "place", "kind", "priority", "evidence", F.round(value, 9).alias("value"), F.round(p["normal_tol_deg"], 9).alias("normal"), F.array_join("scope", ",").alias("scope"))


@query(
    """with c as (select l_orderkey as run, l_linenumber as place, l_shipmode as kind, cast(l_quantity % 5 as integer) as priority from (select *, case when l_suppkey % 2 = 0 then 'refine_faces' else 'escalate' end as l_shipmode from lineitem)),
    h as (select distinct o_orderkey as run, case when o_custkey % 3 = 0 then 'refine_faces' else 'none' end as kind from orders),
    n as (select c.*, row_number() over (partition by run order by priority, place, kind) as r from c where not exists (select 1 from h where h.run = c.run and h.kind = c.kind))
    select run, cast(place as integer) as place, kind, priority from n where r = 1"""
)
def select_action(spark, sf_dir):
    c = B.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as run", "cast(l_linenumber as int) as place", "if(l_suppkey % 2 = 0, 'refine_faces', 'escalate') as kind", "cast(l_quantity % 5 as int) as priority", "'' as scope", "'' as params")
    h = B.table(spark, sf_dir, "orders").selectExpr("o_orderkey as run", "if(o_custkey % 3 = 0, 'refine_faces', 'none') as kind", "'' as scope", "'' as params")
    return policy.choose(c, h, ["run"]).select("run", "place", "kind", "priority")


_POLY = """node as (
    select user_id as face, row_number() over (partition by user_id order by ts, event_id) - 1 as ord, value * cos(event_id) as u, value * sin(event_id) as v from events),
nxt as (
    select *, coalesce(lead(u) over w, first_value(u) over w) as u1, coalesce(lead(v) over w, first_value(v) over w) as v1 from node
    window w as (partition by face order by ord rows between unbounded preceding and unbounded following))"""


def _polygon(spark, sf_dir):
    from pyspark.sql import Window

    ev = B.table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(
        F.col("user_id").alias("face"), F.lit(0).alias("loop"), (F.row_number().over(order) - 1).alias("ord"),
        (F.col("value") * F.cos(F.col("event_id").cast("double"))).alias("u"), (F.col("value") * F.sin(F.col("event_id").cast("double"))).alias("v"),
    )


@query(f"with {_POLY} select face, round(sum(u * v1 - u1 * v) / 2, 4) as area, round(sum(sqrt(power(u1 - u, 2) + power(v1 - v, 2))), 4) as length from nxt group by face")
def loop_measures(spark, sf_dir):
    return rounded(meshers.loop_measures(_polygon(spark, sf_dir), ["face"]), digits=4)


@query(
    f"""with {_POLY}, p as (select c_custkey % 150 as face, c_custkey as point, c_acctbal / 100 as pu, (c_custkey % 37 - 18) * 3.0::double as pv from customer)
    select point, cast(sum(case when v <= pv and v1 > pv and (u1-u)*(pv-v)-(pu-u)*(v1-v) > 0 then 1 when v > pv and v1 <= pv and (u1-u)*(pv-v)-(pu-u)*(v1-v) < 0 then -1 else 0 end) as bigint) as winding
    from p join nxt using (face) group by point"""
)
def winding_number(spark, sf_dir):
    p = B.table(spark, sf_dir, "customer").selectExpr("c_custkey % 150 as face", "c_custkey as point", "c_acctbal / 100 as pu", "(c_custkey % 37 - 18) * 3.0D as pv")
    return meshers.winding(p, _polygon(spark, sf_dir), ["face"]).drop("face")


@query(
    f"""with {_POLY}, side as (
        select a.face, a.u as au, a.v as av, a.u1 as bu, a.v1 as bv, b.u as cu, b.v as cv, b.u1 as du, b.v1 as dv from nxt a join nxt b on a.face = b.face and a.ord < b.ord),
    o as (
        select *, sign((au-cu)*(bv-cv)-(av-cv)*(bu-cu)) as o1, sign((au-du)*(bv-dv)-(av-dv)*(bu-du)) as o2, sign((cu-au)*(dv-av)-(cv-av)*(du-au)) as o3, sign((cu-bu)*(dv-bv)-(cv-bv)*(du-bu)) as o4 from side
        where not ((au = cu and av = cv) or (au = du and av = dv) or (bu = cu and bv = cv) or (bu = du and bv = dv)))
    select face, count(*) >= 3 and not exists (select 1 from o where o.face = n.face and o1 * o2 <= 0 and o3 * o4 <= 0) as is_simple from node n group by face"""
)
def loop_is_simple(spark, sf_dir):
    return meshers.loop_is_simple(_polygon(spark, sf_dir), ["face"]).drop("loop")


#: Two loops a face: events with an even and an odd number.
_LOOPS = """node as (
    select user_id as face, cast(event_id % 2 as integer) as loop, row_number() over (partition by user_id, event_id % 2 order by ts, event_id) - 1 as ord, floor(value / 30) as u, floor(value / 7) % 3 as v from events),
size as (select face, loop, count(*) as n from node group by all)"""


def _loops(spark, sf_dir):
    from pyspark.sql import Window

    loop = (F.col("event_id") % 2).cast("int")
    order = Window.partitionBy("user_id", loop).orderBy("ts", "event_id")
    value = lambda k: F.floor(F.col("value") / k).cast("double")
    return B.table(spark, sf_dir, "events").select(F.col("user_id").alias("face"), loop.alias("loop"), (F.row_number().over(order) - 1).alias("ord"), value(30).alias("u"), (value(7) % 3).alias("v"))


@query(
    f"""with {_LOOPS}, off as (select *, coalesce(sum(n) over (partition by face order by loop rows between unbounded preceding and 1 preceding), 0) as o from size)
    select face, cast(o + ord as bigint) as a, cast(o + (ord + 1) % n as bigint) as b from node join off using (face, loop)"""
)
def constrained_edges(spark, sf_dir):
    out = meshers.constrained_edges(_loops(spark, sf_dir), ["face"])
    return out.select("face", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query(
    f"""with {_LOOPS}, seq as (select face, loop, list(printf('%.12f,%.12f', u, v) order by ord) as t from node group by all),
    turn as (select face, loop, min(array_to_string(list_concat(t[k:], t[: k - 1]), ';')) as line from (select *, unnest(range(1, len(t) + 1)) as k from seq) group by all)
    select face, substring(sha256('#' || string_agg(line, '|' order by loop)), 1, 16) as fingerprint from turn group by face"""
)
def boundary_fingerprint(spark, sf_dir):
    return meshers.boundary_fingerprint(_loops(spark, sf_dir), ["face"])


@query()
def mesh_grid(spark, sf_dir):
    return meshers.grid(spark.createDataFrame([("g4", 4, 1.0, 0.0), ("g9", 9, 0.5, 0.3)], "face string, n int, size double, skew double"))


@query()
def mesh_cdt(spark, sf_dir):
    return rounded(meshers.scores(meshers.mesh(meshers.cases(spark), "cdt"), meshers.cases(spark)))


@query()
def mesh_af(spark, sf_dir):
    return rounded(meshers.scores(meshers.mesh(meshers.cases(spark), "front"), meshers.cases(spark)))


@query()
def mesh_af3d(spark, sf_dir):
    return rounded(meshers.scores(meshers.mesh(meshers.cases(spark), "front3d"), meshers.cases(spark)))
