"""Queries of telemetry and stored traces (binding T)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.bindings import Evidence
from evalquarry.plans.storage import shared_folder
from evalquarry.registry import on
from evalquarry.sources import store
from evalquarry.streaming import ingest


@on("T", "SELECT event_id, service_id, op_id, latency_ms FROM t_spans WHERE service_id = 'svc8' AND ts >= TIMESTAMP '2024-01-03' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 5")
def S10_trace_scan(ev: Evidence) -> DataFrame:
    t = store.where_equal(ev("t_spans"), service_id="svc8", op_id=None).where(F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz"))
    return t.orderBy(F.desc("ts"), "event_id").offset(5).limit(20).select("event_id", "service_id", "op_id", "latency_ms")


@on("T", "SELECT op_id, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'ERROR') AS errors FROM t_spans GROUP BY 1")
def A07_status_by_operator(ev: Evidence) -> DataFrame:
    p = ev("t_spans").groupBy("op_id").pivot("status", ["OK", "ERROR"]).count()
    return p.select("op_id", F.coalesce("OK", F.lit(0)).alias("ok"), F.coalesce("ERROR", F.lit(0)).alias("errors"))


@on("T", "SELECT status, count(*) AS n FROM t_spans GROUP BY 1")
def A08_status_counts(ev: Evidence) -> DataFrame:
    return ev("t_spans").groupBy("status").agg(F.count("*").alias("n"))


@on("T", "SELECT service_id, count(*) AS n, epoch_us(max(ts)) AS last_us FROM t_spans GROUP BY 1")
def A09_services(ev: Evidence) -> DataFrame:
    return ev("t_spans").groupBy("service_id").agg(F.count("*").alias("n"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"))


@on("T", "SELECT DISTINCT op_id FROM t_spans")
def A11_distinct_operators(ev: Evidence) -> DataFrame:
    return ev("t_spans").select("op_id").distinct().orderBy("op_id")


@on("T", "SELECT DISTINCT service_id, op_id FROM t_spans WHERE op_id <> 'view'")
def A12_labelled_rows(ev: Evidence) -> DataFrame:
    return ev("t_spans").where("op_id <> 'view'").select("service_id", "op_id").distinct()


@on("T", "SELECT op_id, round(avg(CAST(status = 'ERROR' AS INT)), 6) AS failure_rate, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, count(*) AS n FROM t_spans GROUP BY 1")
def A06_status_rates(ev: Evidence) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return ev("t_spans").groupBy("op_id").agg(
        r(F.avg((F.col("status") == "ERROR").cast("int"))).alias("failure_rate"), r(F.percentile("latency_ms", F.lit(0.5))).alias("p50"), r(F.percentile("latency_ms", F.lit(0.95))).alias("p95"), F.count("*").alias("n"))


@on("T", "SELECT service_id, arg_max(event_id, ts) AS event_id FROM t_spans GROUP BY 1")
def W20_latest_by_time(ev: Evidence) -> DataFrame:
    return ev("t_spans").groupBy("service_id").agg(F.max_by("event_id", "ts").alias("event_id"))


@on("T", "SELECT service_id AS id, max(event_id) AS version FROM t_spans GROUP BY 1")
def S19_latest_versions(ev: Evidence) -> DataFrame:
    return store.latest(ev("t_spans").select(F.col("service_id").alias("id"), F.col("event_id").alias("version")), ["id"], "version")


@on("T", "SELECT service_id, op_id, arg_max(latency_ms, event_id) AS latency_ms FROM t_spans GROUP BY 1, 2")
def S09_trace_upsert(ev: Evidence) -> DataFrame:
    t = ev("t_spans").select("service_id", "op_id", "event_id", "latency_ms")
    return store.upsert(t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1"), ["service_id", "op_id"], "event_id").select("service_id", "op_id", "latency_ms")


@on("T", "SELECT count(*) FILTER (status <> 'ERROR') AS stay, count(*) FILTER (status = 'ERROR') AS gone FROM t_spans")
def S39_trace_purge(ev: Evidence) -> DataFrame:
    left, gone = store.purge(ev("t_spans"), F.col("status") == "ERROR")
    return left.agg(F.count("*").alias("stay")).withColumn("gone", F.lit(gone).cast("bigint"))


@on("T", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, op_id FROM t_spans WHERE status = 'ERROR'")
def S29_span_attributes(ev: Evidence) -> DataFrame:
    return ev("t_spans").where("status = 'ERROR'").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"), "op_id")


@on("T", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_us, op_id, count(*) AS n, count(*) FILTER (status = 'ERROR') AS errors, round(sum(latency_ms), 4) AS total_ms FROM t_spans GROUP BY 1, 2")
def T01_streaming_windows(ev: Evidence) -> DataFrame:
    """The events as a stream whose changed windows go to files batch by batch; the newest of
    each window equals that of a batch."""
    path = f"{shared_folder(ev.spark)}/evalquarry/stream-{uuid.uuid4().hex}"
    src = ev("t_spans").select(F.col("ts").cast("timestamp").alias("ts"), "op_id", "status", "latency_ms")
    src.repartition(4).write.parquet(f"{path}/in")
    stream = ingest.windowed(ingest.read(ev.spark, f"{path}/in", src.schema, 2), "ts", "1 hour", "60 days", "op_id")
    ingest.sink(stream, f"{path}/out", f"{path}/state", mode="update").awaitTermination()
    rows = store.latest(ev.spark.read.parquet(f"{path}/out"), ["window_start", "op_id"], "batch")
    return rows.select(F.unix_micros("window_start").alias("window_us"), "op_id", "n", "errors", F.round("total_ms", 4).alias("total_ms"))


@on("T", "SELECT op_id, count(*) AS n FROM t_spans GROUP BY 1")
def T02_retrying_export(ev: Evidence) -> DataFrame:
    """An export whose first try of each batch fails after it wrote; the next try replaces it."""
    path = f"{shared_folder(ev.spark)}/evalquarry/stream-{uuid.uuid4().hex}"
    src = ev("t_spans").select("event_id", "op_id")
    src.repartition(3).write.parquet(f"{path}/in")
    failed: set[int] = set()

    def flaky(number: int) -> None:
        if number not in failed:
            failed.add(number)
            raise ConnectionError("try again")

    ingest.sink(ingest.read(ev.spark, f"{path}/in", src.schema, 1), f"{path}/out", f"{path}/state", tries=3, after=flaky).awaitTermination()
    return ev.spark.read.parquet(f"{path}/out").groupBy("op_id").agg(F.count("*").alias("n"))


@on("T", "SELECT service_id, count(*) AS accepted, count(*) FILTER (status = 'OK') AS exported, count(*) FILTER (status = 'ERROR') AS dropped_error, max(event_id) AS high_water FROM t_spans GROUP BY 1")
def A39_health_counters(ev: Evidence) -> DataFrame:
    return ev("t_spans").groupBy("service_id").agg(F.count("*").alias("accepted"), F.count_if(F.col("status") == "OK").alias("exported"), F.count_if(F.col("status") == "ERROR").alias("dropped_error"), F.max("event_id").alias("high_water"))


@on("T", "SELECT service_id, op_id, min(event_id) AS event_id FROM t_spans GROUP BY 1, 2")
def W24_first_trace_per_key(ev: Evidence) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("service_id", "op_id").orderBy("event_id"))
    return ev("t_spans").withColumn("n", n).where("n = 1").select("service_id", "op_id", "event_id")


@on("T")
def T03_head_sampling(ev: Evidence) -> DataFrame:
    return ingest.sampled(ev("t_spans"), "service_id", 0.3).groupBy("service_id").agg(F.count("*").alias("n"))
