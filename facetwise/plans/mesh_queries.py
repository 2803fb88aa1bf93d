"""Triangle, topology and fidelity queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from facetwise.functions import geometry as G
from facetwise.functions.surfaces import Cylinder, Plane, Sphere
from facetwise.operators import fidelity, mesh, topology
from facetwise.plans import bindings as B
from facetwise.scratch import Scratch
from facetwise.sources import meshes
from facetwise.plans.registry import query, rounded

WITH = f"with {B.SOUP}, {B.METRICS}"
_STATS = """count(*) as n_triangles, round(sum(area), 6) as total_area, round(min(shape), 6) as shape_min, round(avg(shape), 6) as shape_mean,
    round(quantile_cont(shape, 0.01), 6) as shape_p01, round(min(rr), 6) as radius_ratio_min, round(min(min_angle), 6) as min_angle,
    round(max(max_angle), 6) as max_angle, round(quantile_cont(min_angle, 0.01), 6) as min_angle_p01, round(max(aspect), 6) as aspect_max,
    count(*) filter (area <= 0) as n_inverted, count(*) filter (shape < 0.2) as n_poor"""


@query(f"{WITH} select pid, {_STATS} from m group by pid")
def tri_shape_by_face(spark, sf_dir):
    return rounded(mesh.shape_statistics(B.soup(spark, sf_dir), ["pid"]))


@query(f"{WITH} select {_STATS}, '' as note from m")
def quality_report(spark, sf_dir):
    return rounded(mesh.quality_report(B.soup(spark, sf_dir)))


@query(
    f"""{WITH} select tri, round(area, 6) as area, round(l1, 6) as l1, round(l2, 6) as l2, round(l3, 6) as l3, round(shape, 6) as shape, round(rr, 6) as rr,
    round(a1, 5) as a1, round(a2, 5) as a2, round(a3, 5) as a3, round(aspect, 5) as aspect, round(size, 6) as size, round(sqrt(4*area/sqrt(3)), 6) as size_area,
    round((ax+bx+cx)/3, 6) as gx, round(nx/(2*area), 5) as nx, round(ny/(2*area), 5) as ny, round(nz/(2*area), 5) as nz from m"""
)
def tri_metrics(spark, sf_dir):
    a, b, c = G.point("a"), G.point("b"), G.point("c")
    m = G.with_triangle_metrics(B.soup(spark, sf_dir))
    n = G.normal(a, b, c)
    r = lambda x, k=6: F.round(x, k).alias(x) if isinstance(x, str) else F.round(x, k)
    return m.select(
        "tri", *(r(x) for x in ("area", "l1", "l2", "l3", "shape", "rr")), *(r(x, 5) for x in ("a1", "a2", "a3", "aspect")), r("size"),
        r(G.size_from_area(F.col("area"))).alias("size_area"), r(G.centroid(a, b, c)[0]).alias("gx"), *(r(x, 5).alias(k) for k, x in zip(("nx", "ny", "nz"), n, strict=True)),
    )


@query(
    f"""{WITH} select pid, tri, round(shape, 6) as shape, round(min_angle, 6) as min_angle from (
    select *, row_number() over (partition by pid order by shape, tri) as r from m) where r <= 20"""
)
def worst_triangles_topk(spark, sf_dir):
    m = G.with_triangle_metrics(B.soup(spark, sf_dir))
    return rounded(mesh.worst(m, "shape", 20, by=["pid"]).select("pid", "tri", "shape", "min_angle"))


_RATIO = f"{WITH}, {B.REQUESTED}, r as (select m.*, size / requested_size as ratio from m left join faces using (pid))"
_SIZE = """count(*) as n_triangles, round(min(ratio), 6) as ratio_min, round(max(ratio), 6) as ratio_max, round(avg(ratio), 6) as ratio_mean,
    round(quantile_cont(ratio, 0.01), 6) as ratio_p01, round(quantile_cont(ratio, 0.99), 6) as ratio_p99,
    round(avg(case when ratio < 1/1.5 then 1 else 0 end), 6) as frac_undersized, round(avg(case when ratio > 1.5 then 1 else 0 end), 6) as frac_oversized,
    round(avg(case when ratio < 1/1.5 or ratio > 1.5 then 0 else 1 end), 6) as frac_in_band"""


@query(f"{_RATIO} select {_SIZE} from r")
def size_adequation(spark, sf_dir):
    tri = mesh.with_requested_size(B.soup(spark, sf_dir), B.requested(spark, sf_dir))
    return rounded(mesh.size_adequation(tri, []))


@query(f"{_RATIO} select pid, {_SIZE} from r group by pid")
def size_in_band_by_face(spark, sf_dir):
    tri = mesh.with_requested_size(B.soup(spark, sf_dir), B.requested(spark, sf_dir))
    return rounded(mesh.size_adequation(tri, ["pid"]))


@query(
    f"""{_RATIO} select pid, count(*) as n_triangles, round(min(shape), 6) as shape_min, round(avg(shape), 6) as shape_mean,
    round(min(min_angle), 6) as min_angle, round(max(ratio), 6) as size_ratio_max from r group by pid"""
)
def face_scores(spark, sf_dir):
    tri = mesh.with_requested_size(B.soup(spark, sf_dir), B.requested(spark, sf_dir))
    return rounded(mesh.attribute_by_face(tri))


@query(
    f"""{_RATIO}, f as (select pid, max(ratio) as size_ratio_max from r group by pid)
    select pid, round(size_ratio_max, 6) as size_ratio_max from f where size_ratio_max is not null order by 2 desc, 1 desc limit 5"""
)
def worst_faces(spark, sf_dir):
    tri = mesh.with_requested_size(B.soup(spark, sf_dir), B.requested(spark, sf_dir))
    return rounded(mesh.worst_faces(mesh.attribute_by_face(tri), "size_ratio_max").select("pid", "size_ratio_max"))


@query(f"with {B.SOUP} select pid, round(sum(ax*(by*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-by*cx))/6, 6) as volume from soup group by pid")
def signed_volume(spark, sf_dir):
    return rounded(mesh.signed_volume(B.soup(spark, sf_dir), ["pid"]))


_EDGES = """dir as (
    select mesh_id, tri, v0 as i, v1 as j from conn union all select mesh_id, tri, v1, v2 from conn union all select mesh_id, tri, v2, v0 from conn),
use as (select mesh_id, least(i, j) as a, greatest(i, j) as b, count(*) as n, count(*) filter (i < j) as f, min(tri) as t1, max(tri) as t2 from dir group by all)"""
_TOPOLOGY = """select mesh_id, count(*) filter (n = 1) as n_boundary_edges, count(*) filter (n > 2) as n_nonmanifold_edges,
    count(*) filter (n = 2 and f in (0, 2)) as n_inconsistent_normals, count(*) filter (n <> 2) = 0 as is_watertight from use group by mesh_id"""


@query(f"with {B.CONNECTIVITY}, {_EDGES} {_TOPOLOGY}")
def edge_topology(spark, sf_dir):
    return topology.edge_topology(B.connectivity(spark, sf_dir), ["mesh_id"])


@query(f"with {B.CONNECTIVITY.replace('conn as', 'whole as')}, conn as (select * from whole where pid not in (3, 7)), {_EDGES} {_TOPOLOGY}")
def edge_topology_skin(spark, sf_dir):
    interface = spark.createDataFrame([(3,), (7,)], "pid long")
    return topology.edge_topology(topology.skin(B.connectivity(spark, sf_dir), interface, ["pid"]), ["mesh_id"])


@query(
    f"""with {B.SPARSE}, {_EDGES}, {B.VERTICES}
    select mesh_id, round(sum(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))), 6) as boundary_length, count(*) as n_boundary_edges
    from use join vert p on p.v = a join vert q on q.v = b where n = 1 group by mesh_id"""
)
def boundary_length(spark, sf_dir):
    return rounded(topology.boundary_length(B.sparse_connectivity(spark, sf_dir), B.vertices(spark, sf_dir), ["mesh_id"]))


@query(
    f"""with {B.SPARSE}, {_EDGES}, {B.VERTICES},
    sized as (
        select c.mesh_id, tri, max(sqrt((power(p.x-q.x,2)+power(p.y-q.y,2)+power(p.z-q.z,2)+power(q.x-r.x,2)+power(q.y-r.y,2)+power(q.z-r.z,2)
            +power(r.x-p.x,2)+power(r.y-p.y,2)+power(r.z-p.z,2))/3)) as size
        from conn c join vert p on p.v = v0 join vert q on q.v = v1 join vert r on r.v = v2 group by all),
    pair as (
        select u.mesh_id, greatest(x.size, y.size) / least(x.size, y.size) as ratio from use u
        join sized x on x.tri = t1 join sized y on y.tri = t2 where n = 2)
    select mesh_id, count(*) as n_pairs, round(max(ratio), 6) as max_ratio, round(avg(ratio), 6) as mean_ratio, round(quantile_cont(ratio, 0.99), 6) as p99_ratio,
        round(avg(case when ratio > 1.5 then 1 else 0 end), 6) as frac_over from pair group by mesh_id"""
)
def edge_gradation(spark, sf_dir):
    tri = B.sparse_connectivity(spark, sf_dir)
    sized = G.with_triangle_metrics(mesh.corners(tri, B.vertices(spark, sf_dir))).groupBy("mesh_id", "tri").agg(F.max("size").alias("size"))
    return rounded(topology.gradation(sized, topology.neighbours(tri, ["mesh_id"]), ["mesh_id"]))


@query(
    f"""with {B.VERTICES} select p.v as i, q.v as j from vert p join vert q on p.v < q.v
    where sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) <= 0.05"""
)
def duplicate_nodes(spark, sf_dir):
    return mesh.duplicate_nodes(B.vertices(spark, sf_dir), 0.05).select("i", "j")


@query(
    f"""with {B.SPARSE}, used as (select distinct unnest([v0, v1, v2]) as v from conn)
    select 'm' as mesh_id, v, row_number() over (order by v) - 1 as new_v from used"""
)
def dense_vertices(spark, sf_dir):
    return mesh.dense_vertices(B.sparse_connectivity(spark, sf_dir)).withColumn("new_v", F.col("new_v").cast("long"))


_CURVES = "fc as (select l_orderkey as curve, l_suppkey % 5 as face from lineitem)"


@query(
    f"""with {_CURVES}, c as (
        select o_orderkey as curve, count(face) as n_incidences, count(distinct face) as n_faces, count(*) filter (face = 4) > 0 as iface
        from orders left join fc on curve = o_orderkey group by 1)
    select case when n_incidences = 0 then 'orphan' when n_incidences = 1 then 'free' when n_incidences = 2 and n_faces = 1 then 'seam'
        when n_incidences = 2 then 'manifold' when iface then 'interface' else 'nonmanifold' end as class, count(*) as n, sum(n_incidences)::bigint as uses
    from c group by 1"""
)
def edge_incidence_class(spark, sf_dir):
    fc = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("curve"), (F.col("l_suppkey") % 5).alias("face"))
    curves = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("curve"))
    inc = topology.incidence(fc, curves)
    touches = F.arrays_overlap("faces", F.array(F.lit(4).cast("long")))
    return inc.groupBy(topology.edge_class(F.col("n_incidences"), F.col("n_faces"), touches).alias("class")).agg(F.count("*").alias("n"), F.sum("n_incidences").alias("uses"))


@query("with fc as (select l_suppkey as face, l_partkey as curve from lineitem) select face, curve from fc group by all having count(*) > 1")
def seam_curves(spark, sf_dir):
    fc = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("face"), F.col("l_partkey").alias("curve"))
    return topology.seam_curves(fc)


@query(
    """with fv as (select l_suppkey as face, o_custkey % 3 as volume from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 48)
    select face, count(distinct volume) as n_volumes, case when count(distinct volume) > 1 then 'interface' else 'exterior' end as role from fv group by face"""
)
def face_volume_skin(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem").where("l_quantity > 48")
    fv = li.join(B.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("face"), (F.col("o_custkey") % 3).alias("volume"))
    return topology.face_owners(fv)


@query(
    """with fc as (select l_orderkey as curve from lineitem group by 1 having count(*) = 1)
    select count(*) as n_free, round(coalesce(sum(o_totalprice), 0), 2) as free_length from fc join orders on curve = o_orderkey"""
)
def free_edge_length(spark, sf_dir):
    fc = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("curve"), F.col("l_suppkey").alias("face"))
    lengths = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("curve"), F.col("o_totalprice").alias("length"))
    return rounded(topology.free_edge_length(fc, lengths), digits=2)


@query("select c_custkey as face from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderpriority = '1-URGENT')")
def orphan_faces(spark, sf_dir):
    faces = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("face"))
    fv = B.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("face"), F.col("o_orderkey").alias("volume"))
    return topology.orphan_faces(faces, fv)


@query(
    """with fc as (select distinct l_suppkey as face, l_orderkey as curve from lineitem where l_quantity > 45)
    select a.face, coalesce(list_sort(list(distinct b.face) filter (b.face <> a.face)), []) as neighbours
    from fc a left join fc b on a.curve = b.curve group by a.face"""
)
def face_adjacency(spark, sf_dir):
    fc = B.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("face"), F.col("l_orderkey").alias("curve"))
    return topology.face_adjacency(fc)


@query(
    """select face, round(sum(o_totalprice), 2) as perimeter from (select distinct l_suppkey as face, l_orderkey as curve from lineitem)
    join orders on curve = o_orderkey group by face"""
)
def face_perimeter(spark, sf_dir):
    fc = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("face"), F.col("l_orderkey").alias("curve"))
    lengths = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("curve"), F.col("o_totalprice").alias("length"))
    return rounded(topology.perimeters(fc, lengths), digits=2)


_SAMPLES = "bary as (select * from (values (1/3, 1/3, 1/3), (0.5, 0.5, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (2/3, 1/6, 1/6), (1/6, 2/3, 1/6), (1/6, 1/6, 2/3)) t(wa, wb, wc))"
_POINTS = "pts as (select tri, pid, wa*ax+wb*bx+wc*cx as x, wa*ay+wb*by+wc*cy as y, wa*az+wb*bz+wc*cz as z from soup, bary)"
_DEVIATION = """select pid, count(*) as n_triangles, round(max(d), 6) as max_deviation, round(avg(d), 6) as mean_deviation, round(quantile_cont(d, 0.99), 6) as p99_deviation,
    round(max(d) / 0.5, 6) as max_relative from (select pid, tri, max(far) as d from dev group by all) group by pid"""


@query(f"with {B.SOUP}, {_SAMPLES}, {_POINTS}, dev as (select pid, tri, abs(sqrt(x*x+y*y+z*z) - 0.2) as far from pts) {_DEVIATION}")
def fidelity_sphere(spark, sf_dir):
    return rounded(fidelity.chordal_deviation(B.soup(spark, sf_dir), Sphere(0.2), target=0.5, by=["pid"]))


@query(f"with {B.SOUP}, {_SAMPLES}, {_POINTS}, dev as (select pid, tri, abs(sqrt(x*x+y*y) - 0.15) as far from pts) {_DEVIATION}")
def fidelity_cylinder(spark, sf_dir):
    return rounded(fidelity.chordal_deviation(B.soup(spark, sf_dir), Cylinder(0.15), target=0.5, by=["pid"]))


@query(f"with {B.SOUP}, {_SAMPLES}, {_POINTS}, dev as (select pid, tri, abs(z - 0.1) as far from pts) {_DEVIATION}")
def fidelity_plane(spark, sf_dir):
    return rounded(fidelity.chordal_deviation(B.soup(spark, sf_dir), Plane((0.0, 0.0, 0.1)), target=0.5, by=["pid"]))


@query(
    f"""{WITH}, g as (
        select pid, area, degrees(acos(least(1, abs((nx*(ax+bx+cx)+ny*(ay+by+cy)+nz*(az+bz+cz))
            / (2*area*sqrt(power(ax+bx+cx,2)+power(ay+by+cy,2)+power(az+bz+cz,2))))))) as angle from m)
    select pid, count(*) as n_triangles, round(max(angle), 4) as max_deg, round(avg(angle), 4) as mean_deg, round(quantile_cont(angle, 0.99), 4) as p99_deg,
        round(sum(angle*area)/sum(area), 4) as area_weighted_mean_deg, round(avg(case when angle > 15 then 1 else 0 end), 4) as frac_over from g group by pid"""
)
def normal_deviation(spark, sf_dir):
    return rounded(fidelity.normal_deviation(B.soup(spark, sf_dir), Sphere(0.2), by=["pid"]), digits=4)


@query(
    f"""{WITH} select pid, dense_rank() over (order by pid) as tag, n from (select pid, count(*) as n from m group by pid)"""
)
def msh_groups(spark, sf_dir):
    tri = B.soup(spark, sf_dir)
    return mesh.msh_tags(tri).join(tri.groupBy("pid").agg(F.count("*").alias("n")), "pid").withColumn("tag", F.col("tag").cast("long"))


@query(f"with {B.SOUP} select tri, 'facet normal ' as head, 7 as n_lines, printf('    vertex %.6e %.6e %.6e', ax, ay, az) as first_vertex from soup")
def stl_facets(spark, sf_dir):
    lines = mesh.facet_lines(B.soup(spark, sf_dir)).withColumn("l", F.split("facet", "\n"))
    return lines.select("tri", F.substring("facet", 1, 13).alias("head"), F.size("l").alias("n_lines"), F.col("l")[2].alias("first_vertex"))


@query(
    f"""with {B.SOUP}, rays as (select tri as ray, pid, (ax+bx+cx)/3 as ox, (ay+by+cy)/3 as oy, (az+bz+cz)/3 as oz from soup),
    x as (
        select ray, r.pid, cx-ax as e2x, cy-ay as e2y, cz-az as e2z, bx-ax as e1x, by-ay as e1y, bz-az as e1z, ox-ax as sx, oy-ay as sy, oz-az as sz
        from rays r join soup s on r.pid = s.pid and r.ray <> s.tri),
    y as (select *, -e2y as hx, e2x as hy, sy*e1z-sz*e1y as qx, sz*e1x-sx*e1z as qy, sx*e1y-sy*e1x as qz from x),
    z as (select ray, pid, e1x*hx+e1y*hy as det, sx*hx+sy*hy as u, qz as v, e2x*qx+e2y*qy+e2z*qz as t from y)
    select pid, ray, round(min(t/det), 5) as distance from z where abs(det) > 1e-14 and u/det >= 0 and v/det >= 0 and u/det+v/det <= 1 and t/det > 1e-9 group by all"""
)
def thickness_rays(spark, sf_dir):
    tri = B.soup(spark, sf_dir).withColumn("mesh_id", F.col("pid"))
    a, b, c = G.point("a"), G.point("b"), G.point("c")
    g = G.centroid(a, b, c)
    zero = F.lit(0.0)
    rays = tri.select("mesh_id", F.col("tri").alias("ray"), g[0].alias("ox"), g[1].alias("oy"), g[2].alias("oz"), zero.alias("dx"), zero.alias("dy"), F.lit(1.0).alias("dz"))
    hits = fidelity.ray_hits(tri, rays, own="ray")
    return hits.select(F.col("mesh_id").alias("pid"), "ray", F.round("distance", 5).alias("distance"))


#: Triangles of a mesh in five faces, over vertices whose coordinates have few digits.
_MESH = f"""{B.SPARSE}, tri as (select tri, max(v0) as v0, max(v1) as v1, max(v2) as v2, 'f' || tri % 5 as pid from conn group by tri),
vert as (select v, (v % 4 + 4) / 8.0::double as x, (v % 3 + 4) / 8.0::double as y, 0.5::double as z from range(499) t(v)),
tag as (select pid, row_number() over (order by pid) as tag from (select distinct pid from tri)),
node as (select *, v + 1 as n from vert),
el as (select row_number() over (order by tri) as n, tag, v0 + 1 as a, v1 + 1 as b, v2 + 1 as c from tri join tag using (pid))"""


def _mesh(spark, sf_dir):
    tri = B.sparse_connectivity(spark, sf_dir).groupBy("tri").agg(*(F.max(v).alias(v) for v in ("v0", "v1", "v2")))
    tri = tri.select("tri", "v0", "v1", "v2", F.concat(F.lit("f"), (F.col("tri") % 5).cast("string")).alias("pid"))
    vert = spark.range(499).select(F.col("id").alias("v"), ((F.col("id") % 4 + 4) / 8).alias("x"), ((F.col("id") % 3 + 4) / 8).alias("y"), F.lit(0.5).alias("z"))
    return tri, vert


@query(
    f"""with {_MESH}
    select 2 as section, tag as key, printf('2 %d "%s"', tag, pid) as line from tag union all select 5, n, n || ' ' || printf('%.16f %.16f %.16f', x, y, z) from node
    union all select 8, n, printf('%d 2 2 %d %d %d %d %d', n, tag, tag, a, b, c) from el
    union all select 1, 0, cast(count(*) as varchar) from tag union all select 4, 0, cast(count(*) as varchar) from node union all select 7, 0, cast(count(*) as varchar) from el
    union all select unnest([0, 3, 6, 9]), 0, unnest(['$MeshFormat' || chr(10) || '2.2 0 8' || chr(10) || '$EndMeshFormat' || chr(10) || '$PhysicalNames', '$EndPhysicalNames' || chr(10) || '$Nodes', '$EndNodes' || chr(10) || '$Elements', '$EndElements'])"""
)
def msh_lines(spark, sf_dir):
    return meshes.msh_lines(*_mesh(spark, sf_dir))


@query(
    f"""with {_MESH} select 'tri' as what, n as id, pid, cast(a * 1000000 + b * 1000 + c as double) as value from el join tag using (tag) union all select 'node', n, '', x + 10 * y + 100 * z from node"""
)
def msh_round_trip(spark, sf_dir):
    """The mesh written to part files and read back by ranges of bytes."""
    path = Scratch(spark).path()
    meshes.write_msh(*_mesh(spark, sf_dir), path)
    got = meshes.read_msh(spark, path)
    tri = got["triangles"].join(got["groups"], "tag").select(F.lit("tri").alias("what"), F.col("tri").alias("id"), "pid", (F.col("v0") * 1000000 + F.col("v1") * 1000 + F.col("v2")).cast("double").alias("value"))
    return tri.unionByName(got["nodes"].select(F.lit("node").alias("what"), F.col("v").alias("id"), F.lit("").alias("pid"), (F.col("x") + F.col("y") * 10 + F.col("z") * 100).alias("value")))
