"""Tables in the shared folder of spark.checkpoint.dir, for results that are read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one in local mode;
    on a cluster other machines couldn't read it, so there it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="evalquarry-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{folder}")
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def saved(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/evalquarry/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, bytes_per_core: int = 8 << 20) -> DataFrame:
    """A table that is small for the cluster, dealt over its cores; a large one as it lies. For work
    on texts that one file's few row groups would leave to few tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < bytes_per_core * cores else df
