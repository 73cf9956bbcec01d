"""Tables between jobs: where they live, and how a plan's lineage is cut.

On a cluster the driver and the executors share no local folder, so intermediate
tables go below ``spark.checkpoint.dir``. Only a local master without that setting
(tests, a notebook) gets a folder of its own.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Least seconds between two calls of the garbage collectors.
PAUSE = 2.0
_freed = 0.0
_made: dict[str, SparkSession] = {}
_local: dict[str, str] = {}  # folders of local applications


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, one below it for this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="sieveline-")
            _made[_local[app]] = spark
        return _local[app]
    path = f"{base.rstrip('/')}/sieveline-{spark.sparkContext.applicationId}"
    _made.setdefault(path, spark)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, safe from lost executors.

    The plan behind it is dropped, and with it its shuffle files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    # The shuffles behind the table are of no use once it is written: drop their files right away.
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    free(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() returned, or of what was made of such tables alone, once nothing
    reads them any more."""
    for df in tables:
        spark = df.sparkSession
        own = shared_dir(spark).split(":", 1)[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not folder.split(":", 1)[-1].lstrip("/").startswith(own):
                raise ValueError(f"{folder} isn't a table of this application")
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and broadcasts that nothing refers to any more; not more often
    than every PAUSE seconds, in which little can gather."""
    global _freed
    if time.monotonic() - _freed < PAUSE:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _freed = time.monotonic()


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner clears it
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
