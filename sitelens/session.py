"""Session settings and the one way lineage is cut: a written table."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # call-site capture costs several round trips per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "sitelens", **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """The engine's timestamps are UTC; pin an existing session to that."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    On a single machine (``local`` masters, as in tests) a temporary folder
    stands in where none is set; on a cluster a missing setting is an error,
    because files in a machine's own folder are lost to the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master == "local" or master.startswith("local["):
        return _local_folder()
    raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/sitelens-{uuid.uuid4().hex}"


#: Removes the shuffle files of a statement when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several outputs share one expensive scan: the pages are read a
    single time, and the copy survives the loss of executors.
    """
    path = f"{work_folder(df.sparkSession)}/{name}"
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    copy.written_to = path
    return copy


def discard(*copies: DataFrame) -> None:
    """Remove tables that ``written`` returned and nothing will read again."""
    for copy in copies:
        context = copy.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(copy.written_to).getParent()
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
