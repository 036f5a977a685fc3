"""Written tables: steps that are read more than once are Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A folder of this application that driver and executors share, removed when it ends.

    ``spark.checkpoint.dir`` names where; only a session on a local master (tests) may do without it, in a temporary folder.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _own_dirs:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tickloom-")
            context.setCheckpointDir(base)
        _own_dirs[app] = f"{base.rstrip('/')}/tickloom-{app}"
        path = context._jvm.org.apache.hadoop.fs.Path(_own_dirs[app])
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return _own_dirs[app]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps no longer depend on executors' state."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stashed_at = path
    return back


def discard(*written: DataFrame) -> None:
    """Remove tables that stash wrote and that nothing reads any more."""
    for df in written:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
