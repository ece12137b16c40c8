"""Tables that end a lineage: written to the folder that driver and executors share, and read back.

Everything a session writes lies in one folder of its own, which goes when the session's process
ends, or by ``release``; loops give up a round's table by ``forget`` when the next one is there.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session that has none, as in tests, gets a folder of this machine; a cluster's is refused."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    made = context._jsc.sc().getCheckpointDir()
    if not made.isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder; on a cluster it has to be one that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="citeloom-"))
        made = context._jsc.sc().getCheckpointDir()
    return made.get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    with suppress(Py4JError, OSError):  # the JVM is gone, and this is all that's left to do
        _delete(spark, path)


def own_dir(spark: SparkSession) -> str:
    """The session's folder in the shared one."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/citeloom-{context.applicationId}"
    if getattr(context, "_citeloom_folder", None) != path:
        context._citeloom_folder = path
        atexit.register(_at_exit, spark, path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's folder."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """df, computed once: later readers, retries and lost executors start from its files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a small file is one partition, however long its rows take to work on."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` returned and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._stored_at)


#: Called with the session when its tables go, by whoever holds frames that read them.
at_release: list[Callable[[SparkSession], None]] = []


def release(spark: SparkSession) -> None:
    """Delete all that the session has stored; results not yet read go with it."""
    for drop in at_release:
        drop(spark)
    _delete(spark, own_dir(spark))
