"""Streaming ingestion of traces and events: Structured Streaming takes the place of a
bounded queue and its worker. Backpressure is maxFilesPerTrigger; retries of a batch are
idempotent by batch id."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def sampled(events: DataFrame, key: str, rate: float) -> DataFrame:
    """Head sampling that depends on the key alone, so all events of a trace share its fate."""
    return events.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000)))


def once(events: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """The first of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed(events: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts, errors and latency by tumbling window and keys."""
    w = F.window(time, size)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ERROR").alias("errors"), F.sum("latency_ms").alias("total_ms"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "errors", "total_ms")


def sink(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append", tries: int = 1, pause: float = 0.0, after: Callable[[int], None] | None = None):  # noqa: ANN201
    """Write each batch below its own id, replacing what an earlier try of it left. A try that
    fails, in writing or in `after` (which gets the batch's id), is made again with growing pauses."""

    def write(batch: DataFrame, number: int) -> None:
        for n in range(1, tries + 1):
            try:
                batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
                if after is not None:
                    after(number)
                return
            except Exception:
                if n == tries:
                    raise
                time.sleep(pause * 2 ** (n - 1))

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(key: Column, rate: float) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000))
