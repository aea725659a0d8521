"""Scratch tables in the folder that the cluster names in ``spark.checkpoint.dir``.

Only in local mode may that setting be absent; a temporary folder is made then.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder of this session's scratch tables, removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="rillframe-")
        _roots[app] = f"{base.rstrip('/')}/rillframe-{uuid.uuid4().hex}"
        atexit.register(_remove_quietly, spark, _roots[app])
    return _roots[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may have gone before the interpreter ends
        return


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder on whatever file system holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def _shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of the queries within when they end, instead of some time after
    the driver has let go of them."""
    before = spark.conf.get(LET_GO, None)
    spark.conf.set(LET_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(LET_GO)
        else:
            spark.conf.set(LET_GO, before)


class Scratch:
    """Scratch tables that are written, read back and can be dropped early.

    What has been shuffled for a table goes when the table is written.

    A written table cuts the lineage: a lost executor costs the reading of a file in shared
    storage, not a new run of all that came before.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def save(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Writes ``df`` as Parquet and returns the table read back."""
        path = fresh_path(self.spark, name)
        with _shuffles_let_go(self.spark):
            df.write.parquet(path, compression=compression)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            remove(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        if name in self.paths:
            remove(self.spark, self.paths.pop(name))
