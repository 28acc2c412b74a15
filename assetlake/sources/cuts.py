"""Lineage cuts that survive the loss of executors: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process (tests) a temporary folder is made, and removed when Python
    ends; on a cluster it must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="assetlake-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def forget_later(path: str) -> None:
    """Has a folder removed when Python ends."""
    _made.add(path)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; removed by ``discard`` or when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    forget_later(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for t in tables:
        _remove(t._cut)


def _remove(path: str) -> None:
    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    conf = context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()
    where.getFileSystem(conf).delete(where, True)
    _made.discard(path)


@atexit.register
def _remove_all() -> None:
    for path in list(_made):
        with contextlib.suppress(Exception):  # the session may be gone by then
            _remove(path)
