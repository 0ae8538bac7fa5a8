"""The store of runs: Parquet tables below one folder, partitioned by run.

Appends add files; a scope (a run of a table) is replaced by overwriting its partition alone.
What spans several tables is committed by a status row that is written last: readers take
only scopes whose newest status says complete for the digest they ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.sources import store

TABLES = {
    "runs": "run_id string, started_us bigint, status string, config string, version int",
    "manifests": "run_id string, manifest string",
    "qrels": "run_id string, query_id string, doc_id string, grade int",
    "queries": "run_id string, query_id string, text string",
    "metrics": "run_id string, pipeline_id string, query_id string, stage_index int, metric_name string, k int, branch_id string, value double, metadata string",
    "findings": "run_id string, trace_id string, label string, availability string, n_documents bigint, evidence string",
    "pairs": "run_id string, trace_id string, query_id string, doc_id string, judgment string, observed boolean, final_rank int, membership string, loss_boundary string, partial boolean, outcome string, confusion string, priority int, n_events bigint",
    "summaries": "run_id string, kind string, key string, pairs bigint, delivered bigint, excluded bigint",
    "projections": "run_id string, digest string, state string, version int",
    "records": "run_id string, kind string, record_id string, version bigint, payload string",
    "health": "run_id string, service_id string, at_us bigint, accepted bigint, dropped bigint",
    "sets": "run_id string, name string, query_id string",
    "edges": "run_id string, src string, dst string, edge_type string, weight double",
}


class RunStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        """The columns of the table in their types; those that rows lack are null."""
        want = self.spark.createDataFrame([], TABLES[table]).schema
        have = set(rows.columns)
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in want))

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def exists(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self._path(table))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def scan(self, table: str, **equal: object) -> DataFrame:
        """Rows of the table under equality filters; those on the run prune partitions."""
        if not self.exists(table):
            return self.spark.createDataFrame([], TABLES[table])
        return store.where_equal(self.spark.read.schema(TABLES[table]).parquet(self._path(table)), **equal)

    def append(self, table: str, rows: DataFrame, key: list[str] | None = None) -> None:
        """Add rows; with a key, only those whose key isn't stored yet, one of each."""
        new = self._shaped(table, rows)
        if key:
            new = new.dropDuplicates(key)
            old = self.scan(table).select(*(F.col(k).alias(f"o_{k}") for k in key))
            same = F.lit(True)
            for k in key:
                same = same & F.col(k).eqNullSafe(F.col(f"o_{k}"))
            new = new.join(old, same, "left_anti")
        new.write.mode("append").partitionBy("run_id").parquet(self._path(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Put rows in the place of all rows of their runs."""
        self._shaped(table, rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self._path(table))

    def project(self, run_id: str, digest: str, pairs: DataFrame, summaries: DataFrame, version: int = 1) -> None:
        """Replace the projection of a run; the status row commits it."""
        one = lambda state, v: self.spark.createDataFrame([(run_id, digest, state, v)], TABLES["projections"])
        self.append("projections", one("building", 2 * version))
        self.replace("pairs", pairs.withColumn("run_id", F.lit(run_id)))
        self.replace("summaries", summaries.withColumn("run_id", F.lit(run_id)))
        self.append("projections", one("complete", 2 * version + 1))

    def projection_state(self, digest: Column) -> DataFrame:
        """Per run: complete, stale (another digest) or unavailable."""
        newest = store.latest(self.scan("projections"), ["run_id"], "version")
        return newest.select("run_id", F.when(F.col("state") != "complete", "unavailable").when(F.col("digest") != digest, "stale").otherwise("complete").alias("state"))

    def projected(self, run_id: str, digest: str) -> DataFrame:
        """The pairs of a run if its projection is complete for the digest, else none."""
        good = self.projection_state(F.lit(digest)).where("state = 'complete'").select("run_id")
        return self.scan("pairs", run_id=run_id).join(F.broadcast(good), "run_id", "left_semi")


def history(rows: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    """The newest n rows of each key."""
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("place") <= n)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database as backend of the same rows; the driver jar is the caller's."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def to_jdbc(rows: DataFrame, url: str, table: str, **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
