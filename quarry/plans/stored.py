"""Cuts long lineages with reliable checkpoints, and gives tables a place in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or in a local session without it a temporary folder that goes with the process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _own, True)
    return _own


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the application's own folder, which goes when the driver ends."""
    root = f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_delete_at_exit, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _delete_at_exit(spark: SparkSession, root: str) -> None:
    # The JVM may be gone by then; what it leaves is a folder named after the application.
    with contextlib.suppress(Exception):
        delete(spark, root)


def delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
