"""Readers of run records, audit reports, calibration sheets and thresholds; format checks of CAD files."""

from __future__ import annotations

import tomllib
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.operators.audit import Thresholds

ITERATION = (
    "index int, request_fingerprint string, spec_diff array<string>, estimated_elements long, n_triangles long, n_vertices long, seconds double, "
    "is_valid boolean, ready boolean, score double, failures array<struct<code:string,count:long,message:string>>, "
    "objectives array<struct<name:string,value:double,target:double,satisfied:boolean,attainment:double>>, "
    "action struct<kind:string,params:map<string,string>,scope:array<string>,rationale:string,priority:int>, over_budget boolean, ineffective boolean, note string"
)
RUN = (
    "model string, backend string, selector string, budget long, outcome string, best_index int, elapsed_seconds double, notes array<string>, "
    f"iterations array<struct<{', '.join(x.replace(' ', ':', 1) for x in ITERATION.split(', '))}>>"
)
REPORT = (
    "source_path string, findings array<struct<code:string,severity:string,dim:int,tag:long,message:string,threshold_name:string,threshold:double,measured:double>>"
)
SHEET = (
    "borderline string, part string, code string, severity string, dim string, tag string, threshold_name string, threshold double, measured double, ratio string, "
    "verdict string, note string"
)

#: Suffixes that can be imported, and suffixes of meshes and of native CAD systems, which cannot.
CAD = (".step", ".stp", ".iges", ".igs", ".brep")
MESH = (".stl", ".obj", ".ply", ".off", ".msh", ".vtk")
NATIVE = (".sldprt", ".sldasm", ".catpart", ".prt", ".ipt", ".f3d", ".3dm")
#: Suffixes that a corpus is searched for.
CORPUS_GLOB = "*.{step,stp,STEP,STP,iges,igs,brep}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


def format_verdict(path: Column) -> Column:
    """`ok`, or why a file of this name can't be imported."""
    s = suffix(path)
    return F.when(s.isin(*CAD), "ok").when(s.isin(*MESH), "mesh: has no exact surfaces").when(s.isin(*NATIVE), "native: export as STEP").otherwise("unknown format")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of CAD files anywhere under root; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", CORPUS_GLOB).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length").distinct()


def run_records(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """Run records of all JSON files (by their names): a record or a list of records a file. Files that don't parse, and records without an
    outcome, are left out; of equal (model, outcome, iterations) the first by file name counts."""
    from facetwise.operators.records import dedup

    raw = spark.read.schema(RUN).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", names).json(path)
    rows = raw.withColumns({"file": F.input_file_name(), "place": F.monotonically_increasing_id()}).where("outcome is not null")
    return dedup(rows.withColumn("n_iterations", F.coalesce(F.size("iterations"), F.lit(0)))).drop("file", "place")


def first_outcomes(records: DataFrame) -> DataFrame:
    """(model, outcome): the first outcome of each model."""
    return records.groupBy("model").agg(F.first("outcome", ignorenulls=True).alias("outcome"))


def findings(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """Findings of all audit reports (JSON files by their names, each a report or a list), one row each, with the part they belong to."""
    raw = spark.read.schema(REPORT).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", names).json(path)
    own = raw.where("findings is not null").select("source_path", F.explode("findings").alias("f"))
    return own.select("source_path", F.regexp_extract("source_path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1).alias("part"), "f.*")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHEET).option("header", "true").csv(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    """CSV part files with a header each, in order, borderline rows first: no task holds the sheet. Spark makes one of a small sheet."""
    names = [x.split()[0] for x in SHEET.split(", ")]
    rows.select(*(F.col(n) if n in rows.columns else F.lit("").alias(n) for n in names)).orderBy(F.desc("borderline"), "threshold_name", "part").write.mode("overwrite").option("header", "true").csv(path)


def thresholds(text: str) -> Thresholds:
    """Thresholds from TOML text with a [thresholds] table; an unknown key is an error."""
    given = tomllib.loads(text).get("thresholds", {})
    if odd := sorted(set(given) - {f.name for f in fields(Thresholds)}):
        raise ValueError(f"unknown thresholds: {', '.join(odd)}")
    return Thresholds(**given)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, with nested columns in full."""
    df.write.mode("overwrite").json(path)


class UnsupportedKernel(RuntimeError):
    """Raised for what needs a CAD kernel: there is none here; its results come in as tables."""


def import_cad(path: str) -> None:
    raise UnsupportedKernel(f"{path}: CAD import needs a geometry kernel; load its entity, face and curve tables instead")
