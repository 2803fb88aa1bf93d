"""Mesh files: MSH 2.2 and STL. A file, or a folder of part files in the order of their names, is one mesh.

Writers sort lines by ranges and write the parts in parallel: the parts one after the other are the file (`cat part-*`).
Readers take ranges of bytes of any number of files in parallel, with the places of the section marks found first.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetwise.operators.mesh import facet_lines
from facetwise.operators.ranks import numbered


#: Marks of sections of a mesh at most: a file has two for each of a handful of sections.
MARKS = 1000


def msh_lines(triangles: DataFrame, vertices: DataFrame, name: str = "surface") -> DataFrame:
    """(section, key, line) of a MSH 2.2 file for one mesh: triangles(tri, v0, v1, v2, pid), vertices(v, x, y, z).

    Nodes and elements are numbered from 1 in the order of their ids, physical groups from 1 in the order of the pids; a
    null pid puts its triangle into a group named `name`.
    """
    tri = triangles.withColumn("pid", F.coalesce(F.col("pid").cast("string"), F.lit(name)))
    tags = tri.select("pid").distinct().withColumn("tag", F.row_number().over(Window.orderBy("pid")))
    nodes = numbered(vertices.select("v", "x", "y", "z"), ["v"])
    own = tri.join(tags, "pid")
    for k in range(3):
        own = own.join(nodes.select(F.col("v").alias(f"v{k}"), F.col("number").alias(f"n{k}")), f"v{k}")
    elements = numbered(own.select("tri", "tag", "n0", "n1", "n2"), ["tri"])
    line = lambda s, key, text: (F.lit(s).alias("section"), key.cast("long").alias("key"), text.alias("line"))
    one = triangles.sparkSession.range(1)
    fixed = lambda s, text: one.select(*line(s, F.lit(0), text if not isinstance(text, str) else F.lit(text)))
    count = lambda s, df: df.agg(F.count("*").alias("n")).select(*line(s, F.lit(0), F.col("n").cast("string")))
    parts = [
        fixed(0, "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$PhysicalNames"),
        count(1, tags),
        tags.select(*line(2, F.col("tag"), F.format_string('2 %d "%s"', "tag", "pid"))),
        fixed(3, "$EndPhysicalNames\n$Nodes"),
        count(4, nodes),
        nodes.select(*line(5, F.col("number"), F.concat_ws(" ", F.col("number").cast("string"), *(F.format_string("%.16g", c) for c in "xyz")))),
        fixed(6, "$EndNodes\n$Elements"),
        count(7, elements),
        elements.select(*line(8, F.col("number"), F.format_string("%d 2 2 %d %d %d %d %d", "number", "tag", "tag", "n0", "n1", "n2"))),
        fixed(9, "$EndElements"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_msh(triangles: DataFrame, vertices: DataFrame, path: str, name: str = "surface") -> dict[int, str]:
    """Write the lines under path, as part files in order; returns {tag: pid}, one entry a face."""
    msh_lines(triangles, vertices, name).orderBy("section", "key").select("line").write.mode("overwrite").text(path)
    pids = sorted({str(r["pid"]) if r["pid"] is not None else name for r in triangles.select("pid").distinct().toLocalIterator()})
    return dict(enumerate(pids, 1))


def write_stl(tri: DataFrame, path: str, name: str = "mesh") -> None:
    """ASCII STL of triangles with corners, in the order of tri, as part files in order."""
    body = facet_lines(tri).select(F.lit(1).alias("section"), F.col("tri").cast("long").alias("key"), F.col("facet").alias("line"))
    ends = tri.sparkSession.createDataFrame([(0, 0, f"solid {name}"), (2, 0, f"endsolid {name}")], "section int, key long, line string")
    ends.unionByName(body).orderBy("section", "key").select("line").write.mode("overwrite").text(path)


def section_lines(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The lines between the marks of each section of a mesh, by the section's name, each as `line`.

    A line's place is its file, the begin of its range of bytes, and its row there. The marks ($Nodes, $EndNodes, two a
    section) are found by one scan and come to the driver; the lines of a section are those between two places, so no task
    sees more than its own ranges of bytes. A section without an end, or an end without a begin, is an error.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r")).alias("at"))
    marks = sorted((tuple(r["at"]), r["line"][1:]) for r in lines.where(F.col("line").startswith("$")).limit(MARKS + 1).collect())
    if len(marks) > MARKS:
        raise ValueError(f"{path}: over {MARKS} marks of sections, this is no single mesh")
    out: dict[str, DataFrame] = {}
    place = lambda p: F.struct(F.lit(p[0]).alias("f"), F.lit(p[1]).cast("long").alias("b"), F.lit(p[2]).cast("long").alias("r"))
    for (begin, name), (end, closing) in zip(marks[::2], [*marks[1::2], ((), "")], strict=False):
        if closing != f"End{name}":
            raise ValueError(f"{path}: section {name} has no end")
        own = lines.where((F.col("at") > place(begin)) & (F.col("at") < place(end)) & (F.col("line") != "")).select("line")
        out[name] = out[name].unionByName(own) if name in out else own
    return out


def read_msh(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes(v, x, y, z), triangles(tri, tag, v0, v1, v2; element type 2 only) and groups(tag, pid) of a MSH 2.2 file or of
    its parts. Sections that are not there give empty tables; a section's count is not read."""
    found = section_lines(spark, path)
    none = spark.range(0).select(F.lit("").alias("line"))
    row = lambda s: found.get(s, none).select(F.split("line", r"\s+").alias("f"), "line")
    nodes = row("Nodes").where("size(f) >= 4").select(F.col("f")[0].cast("long").alias("v"), *(F.col("f")[k + 1].cast("double").alias(c) for k, c in enumerate("xyz")))
    el = row("Elements").where("size(f) >= 6 and get(f, 1) = '2'")
    skip = F.get("f", F.lit(2)).cast("int") + 3
    tri = el.select(F.get("f", F.lit(0)).cast("long").alias("tri"), F.get("f", F.lit(3)).cast("int").alias("tag"), *(F.get("f", skip + k).cast("long").alias(f"v{k}") for k in range(3)))
    groups = row("PhysicalNames").where("size(f) >= 3").select(F.get("f", F.lit(1)).cast("int").alias("tag"), F.regexp_extract("line", '"(.*)"', 1).alias("pid"))
    return {"nodes": nodes, "triangles": tri, "groups": groups}


def export(run_row: dict, triangles: DataFrame, vertices: DataFrame, corners: DataFrame, folder: str, stem: str) -> list[str]:
    """Mesh, facets, manifest and record of a run under one folder; returns their paths. The record keeps its nested values."""
    spark = triangles.sparkSession
    paths = [f"{folder}/{stem}{end}" for end in (".msh", ".stl", ".manifest.json", ".run.json")]
    tags = write_msh(triangles, vertices, paths[0], stem)
    write_stl(corners, paths[1], stem)
    spark.createDataFrame([(stem, {str(k): v for k, v in tags.items()})], "name string, groups map<string,string>").coalesce(1).write.mode("overwrite").json(paths[2])
    spark.createDataFrame([(json.dumps(run_row, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(paths[3])
    return paths
