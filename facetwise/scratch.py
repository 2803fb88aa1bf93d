"""Tables written to the shared checkpoint folder, which cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that still hold tables. Tables themselves are held weakly, so that their plans can go.
_roots: set[str] = set()


def _delete(sc: SparkContext, path: str) -> None:
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear() -> None:
    """At the end of the application: whatever is left."""
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None:
        for root in _roots:
            try:
                _delete(sc, root)
            except Exception:  # the gateway may be gone already at exit
                return


@contextmanager
def _files_of_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that begin in here delete their shuffle files at their end, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables of one computation under spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session (tests) gets a private folder; on a cluster that is an error, since executors
    don't see each other's local folders.
    """

    _own: dict[str, str] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        sc = spark.sparkContext
        root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = self._own.get(sc.applicationId)
            if root is None:
                root = self._own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="facetwise-")
        self.root = f"{root.rstrip('/')}/facetwise-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

    def path(self) -> str:
        """A new folder, deleted at the end of the application."""
        self.n += 1
        _roots.add(self.root)
        return f"{self.root}/{self.n}"

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df and return it as read back. Shuffle files of the write go with it: nothing else reads them."""
        path = self.path()
        with _files_of_shuffles_removed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[out] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        if path := self.paths.pop(df, None):
            _delete(self.spark.sparkContext, path)
