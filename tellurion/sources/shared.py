"""The folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; where nothing is named and all runs on one machine, as in tests, a temporary folder of this application.

    A cluster that names none is refused: executors wouldn't see what others wrote.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tellurion-")
    return _own[app]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/tellurion-{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and returns the written table: later reads neither recompute it nor need its executors."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(stashed: DataFrame) -> None:
    """Deletes the table that stash wrote, where nothing reads it any more: the one before, of steps that each write a table."""
    path = _paths.pop(stashed, None)
    if path:
        jvm, jsc = stashed.sparkSession._jvm, stashed.sparkSession._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)
