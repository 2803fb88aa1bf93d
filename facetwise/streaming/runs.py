"""Run records as a stream: an extension, as the batch operators read the same records again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "run long, idx int, ts timestamp, score double, code string, is_valid boolean, ready boolean"


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Iterations as they arrive as JSON lines under path."""
    return spark.readStream.schema(ROW).json(path)


def code_counts(rows: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Codes by time window; rows later than `late` are dropped, and closed windows leave the state."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "code").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "code", "n")


def best_so_far(rows: DataFrame) -> DataFrame:
    """The best valid iteration of every run so far: ready first, then score, then the earliest. The state is a row a run."""
    order = F.struct("ready", "score", (-F.col("idx")).alias("earlier"))
    return rows.where("is_valid").groupBy("run").agg(F.max_by(F.struct("idx", "score", "ready"), order).alias("best")).select("run", "best.*")
