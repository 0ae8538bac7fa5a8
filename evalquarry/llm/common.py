"""Plumbing shared by the operators: shared-folder tables, Arrow functions, row numbers."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
SPACES = r"[ \t\n\x0B\f\r]+"

BATCH_BYTES = 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their
    Python workers can import it wherever the driver was started; and bound the
    batches that go to these workers in bytes, since texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="evalquarry-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "evalquarry_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in (root / "evalquarry").rglob("*.py"):
            z.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one in local mode;
    on a cluster other machines couldn't read it, so there it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    folder = tempfile.mkdtemp(prefix="evalquarry-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stash(df: DataFrame, even: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends
    there, and any executor can read it again after a loss. The tasks that work df out write
    it, as many as Spark makes of the data. even: deal the rows out anew, so that narrow
    rows of a scan of wide ones become files of the advisory size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evalquarry/{uuid.uuid4().hex}"
    (df.hint("rebalance") if even else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a stash() that no later plan reads."""
    remove(df.sparkSession, df.stash_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Hand memory that this Python worker has freed back to the system; workers live on
    between tasks, and what they keep adds up on an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow, with the worker's memory given back at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, with underscores before it until no column in taken has it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, key: Column, name: str) -> DataFrame:
    """df with numbers from 0 in the order of key, which no two rows share. Rows are dealt
    into ranges, numbered in each, and moved up by the sizes of the ranges before; the driver
    sees one row per range."""
    part = fresh("part", df.columns)
    ranged = stash(df.repartitionByRange(key).withColumn(part, F.spark_partition_id()))
    before, at = {}, 0
    for row in ranged.groupBy(part).count().orderBy(part).collect():
        before[row[0]] = at
        at += row["count"]
    up = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col(part)) if before else F.lit(0)
    return ranged.withColumn(name, (F.row_number().over(Window.partitionBy(part).orderBy(key)) - 1 + up).cast("bigint")).drop(part)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that the optimizer computes once: conditions on it can't be pushed below
    the generator, which would work the expression out again for each of its uses."""
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model is trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, SPACES, -1), lambda w: w != "")), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
