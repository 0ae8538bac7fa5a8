"""Queries of the run store, file formats and exports: each writes and reads back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.bindings import Evidence
from evalquarry.catalog import evidence as E
from evalquarry.functions import scalar as X
from evalquarry.operators import diagnostics as D
from evalquarry.plans import config as P
from evalquarry.plans.storage import shared_folder
from evalquarry.registry import on
from evalquarry.sources import external, files, store
from evalquarry.sources.runstore import RunStore, history


def _folder(ev: Evidence) -> str:
    return f"{shared_folder(ev.spark)}/evalquarry/runs-{uuid.uuid4().hex}"


def _store(ev: Evidence) -> RunStore:
    return RunStore(ev.spark, _folder(ev))


@on("V", "SELECT query_id, count(*) FILTER (grade > 0) AS n_relevant, count(*) AS n_judged, 100 AS k FROM qrels GROUP BY 1")
def S04_beir_loader(ev: Evidence) -> DataFrame:
    path, q = _folder(ev), ev("qrels")
    q.select(F.col("query_id").alias("_id"), F.col("query_id").alias("text")).distinct().write.json(f"{path}/queries.jsonl")
    q.select(F.col("doc_id").alias("_id"), F.col("doc_id").alias("text")).distinct().write.json(f"{path}/corpus.jsonl")
    q.select(F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("grade").alias("score")).write.option("sep", "\t").option("header", True).csv(f"{path}/qrels/test.tsv")
    queries, _, _ = files.beir(ev.spark, path)
    return queries.select("query_id", "n_relevant", "n_judged", "k")


@on("L", "SELECT CAST(item_id AS VARCHAR) AS query_id, 5 AS k, CAST(length(text) AS INT) AS n FROM benchmark")
def S05_in_memory_dataset(ev: Evidence) -> DataFrame:
    rows = ev("benchmark").orderBy("item_id").collect()  # a benchmark, which this loader takes from memory
    queries, _, _ = files.in_memory(ev.spark, [{"query_id": r["item_id"], "text": r["text"]} for r in rows], {str(r["item_id"]): r["text"] for r in rows}, {}, k=5)
    return queries.select("query_id", "k", F.length("text").alias("n"))


@on("Q", "SELECT doc_id, lang, n_chars FROM documents UNION ALL SELECT doc_id, quality::VARCHAR, toxic FROM labels")
def S07_json_records(ev: Evidence) -> DataFrame:
    path = _folder(ev)
    ev("documents").select("doc_id", "lang", "n_chars").write.json(f"{path}/lines")
    array = ev("labels").select(F.to_json(F.struct("doc_id", F.col("quality").cast("string").alias("lang"), F.col("toxic").alias("n_chars"))).alias("v"))
    array.coalesce(1).agg(F.concat(F.lit("["), F.array_join(F.collect_list("v"), ",\n"), F.lit("]")).alias("value")).write.text(f"{path}/array")
    schema = "doc_id bigint, lang string, n_chars bigint"
    return files.json_records(ev.spark, f"{path}/lines", schema).unionByName(files.json_records(ev.spark, f"{path}/array", schema))


@on("V", "SELECT 'queries' AS part, count(DISTINCT query_id) AS n FROM qrels UNION ALL SELECT 'corpus', count(*) FROM embeddings UNION ALL SELECT 'qrels', count(*) FROM qrels")
def S08_evaluate_inputs(ev: Evidence) -> DataFrame:
    path, q = _folder(ev), ev("qrels")
    q.select("query_id", F.col("query_id").alias("text")).distinct().write.json(f"{path}/q")
    ev("embeddings").select(F.concat(F.lit("d"), "vec_id").alias("id"), F.lit("t").alias("text")).write.json(f"{path}/c")
    q.select(F.concat_ws("\t", "query_id", "doc_id", F.col("grade").cast("string")).alias("value")).write.text(f"{path}/r")
    parts = files.inputs(ev.spark, f"{path}/q", f"{path}/c", f"{path}/r")
    counts = [p.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, p in zip(("queries", "corpus", "qrels"), parts, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@on("M", "SELECT pipeline_id, CAST(ok % 3 AS VARCHAR) AS segment, count(*) AS n, round(sum(value), 6) AS total FROM metrics WHERE run_id = 'cand' GROUP BY 1, 2")
def S12_metric_scan(ev: Evidence) -> DataFrame:
    s = _store(ev)
    s.append("metrics", ev("metrics").withColumn("metadata", F.to_json(F.struct((F.col("ok") % 3).cast("string").alias("segment")))))
    rows = s.scan("metrics", run_id="cand").withColumn("segment", F.from_json("metadata", "map<string,string>")["segment"])
    return rows.groupBy("pipeline_id", "segment").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@on("V", "SELECT run_id, 'finished' AS status, count(DISTINCT trace_id) AS traces, row_number() OVER (ORDER BY run_id DESC) AS place FROM spans GROUP BY 1")
def S13_run_registry(ev: Evidence) -> DataFrame:
    s, runs = _store(ev), ev("spans").groupBy("run_id").agg(F.countDistinct("trace_id").alias("traces"))
    begun = runs.select("run_id", F.ascii("run_id").cast("bigint").alias("started_us"), F.lit("running").alias("status"), F.lit(1).alias("version"))
    s.append("runs", begun)
    s.append("runs", begun.withColumns({"status": F.lit("finished"), "version": F.lit(2)}))
    now = store.latest(s.scan("runs"), ["run_id"], "version").select("run_id", "started_us", "status")
    return files.placed(now.join(runs, "run_id"), F.desc("started_us"), "run_id").select("run_id", "status", "traces", "place")


@on("V", "SELECT run_id, count(DISTINCT op_id) AS operators, count(DISTINCT query_id) AS queries FROM spans GROUP BY 1")
def S14_manifest_store(ev: Evidence) -> DataFrame:
    s = _store(ev)
    s.replace("manifests", ev("spans").groupBy("run_id").agg(F.to_json(F.struct(F.countDistinct("op_id").alias("operators"), F.countDistinct("query_id").alias("queries"))).alias("manifest")))
    return s.scan("manifests").select("run_id", F.from_json("manifest", "operators bigint, queries bigint").alias("m")).select("run_id", "m.*")


@on("V", "SELECT query_id, doc_id, grade FROM qrels")
def S15_run_qrels(ev: Evidence) -> DataFrame:
    s, q = _store(ev), ev("qrels")
    s.replace("qrels", q.withColumn("run_id", F.lit("A")).unionByName(q.where("grade > 0").withColumn("run_id", F.lit("B"))))
    s.replace("qrels", q.where("grade > 1").withColumn("run_id", F.lit("B")))
    return s.scan("qrels", run_id="A").select("query_id", "doc_id", "grade")


@on("L", "SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(length(text) AS INT) AS n FROM benchmark")
def S16_run_queries(ev: Evidence) -> DataFrame:
    s = _store(ev)
    rows = ev("benchmark").select(F.lit("r").alias("run_id"), F.col("item_id").cast("string").alias("query_id"), "text")
    s.append("queries", rows, key=["run_id", "query_id"])
    s.append("queries", rows, key=["run_id", "query_id"])
    return s.scan("queries", run_id="r").select("query_id", F.length("text").alias("n"))


def _findings(ev: Evidence) -> RunStore:
    s = _store(ev)
    rows = D.evaluate(E._context(ev)).withColumn("run_id", F.left("trace_id", F.lit(1)))
    s.append("findings", rows.withColumn("evidence", F.to_json(F.struct("n_documents", "availability"))))
    return s


@on("V", f"{E._RULES} SELECT left(trace_id, 1) AS run_id, label, availability, count(*) AS n FROM fin GROUP BY 1, 2, 3")
def S17_diagnostics_store(ev: Evidence) -> DataFrame:
    return _findings(ev).scan("findings").groupBy("run_id", "label", "availability").agg(F.count("*").alias("n"))


@on("V", f"{E._RULES} SELECT trace_id, label, n FROM fin WHERE availability = 'supported' AND left(trace_id, 1) = 'B'")
def S44_query_diagnostics(ev: Evidence) -> DataFrame:
    rows = _findings(ev).scan("findings", run_id="B").select("trace_id", "label", F.from_json("evidence", "n_documents bigint, availability string").alias("e"))
    return rows.where("e.availability = 'supported'").select("trace_id", "label", F.col("e.n_documents").alias("n"))


@on("V", f"{E._ROWS} SELECT run_id, 'complete' AS state, count(*) AS pairs, sum(n_events) AS events FROM jo GROUP BY 1")
def S18_projection_sink(ev: Evidence) -> DataFrame:
    s, rows = _store(ev), E._rows(ev)
    for run in "AB":
        mine = rows.where(F.col("run_id") == run)
        s.project(run, "d0", mine.limit(5), mine.groupBy().agg(F.lit("run").alias("kind"), F.lit(run).alias("key"), F.count("*").alias("pairs")), version=1)
        s.project(run, "d1", mine, mine.groupBy().agg(F.lit("run").alias("kind"), F.lit(run).alias("key"), F.count("*").alias("pairs")), version=2)
    kept = s.projected("A", "d1").unionByName(s.projected("B", "d1")).unionByName(s.projected("B", "d0"))
    return kept.groupBy("run_id").agg(F.count("*").alias("pairs"), F.sum("n_events").alias("events")).join(s.projection_state(F.lit("d1")), "run_id")


_HEALTH = """, h AS (SELECT service_id, time_bucket(INTERVAL '1 day', ts) AS day, count(*) FILTER (status = 'OK') AS accepted, count(*) FILTER (status = 'ERROR') AS dropped FROM t_spans GROUP BY 1, 2)"""


def _health(ev: Evidence) -> RunStore:
    s = _store(ev)
    day = F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp")))
    s.append("health", ev("t_spans").groupBy(F.lit("live").alias("run_id"), "service_id", day.alias("at_us")).agg(F.count_if(F.col("status") == "OK").alias("accepted"), F.count_if(F.col("status") == "ERROR").alias("dropped")))
    return s


@on("T", f"{_HEALTH} SELECT service_id, epoch_us(day) AS at_us, accepted, dropped FROM h QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY day DESC) <= 3")
def S20_reliability_history(ev: Evidence) -> DataFrame:
    return history(_health(ev).scan("health", run_id="live"), ["service_id"], F.desc("at_us"), 3).select("service_id", "at_us", "accepted", "dropped")


@on("T", f"{_HEALTH} SELECT service_id, count(*) AS snapshots, sum(accepted) AS accepted, sum(dropped) AS dropped FROM h GROUP BY 1")
def S45_health_snapshots(ev: Evidence) -> DataFrame:
    return _health(ev).scan("health").groupBy("service_id").agg(F.count("*").alias("snapshots"), F.sum("accepted").alias("accepted"), F.sum("dropped").alias("dropped"))


@on("L", "SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS name, count(*) AS n FROM benchmark GROUP BY 1")
def S21_golden_sets(ev: Evidence) -> DataFrame:
    s = _store(ev)
    s.append("sets", ev("benchmark").select(F.lit("sets").alias("run_id"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("name"), F.col("item_id").cast("string").alias("query_id")))
    return s.scan("sets").groupBy("name").agg(F.count("*").alias("n"))


@on("Q", "SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user' AND text ILIKE '%a%'")
def S22_test_set_scan(ev: Evidence) -> DataFrame:
    c = store.where_equal(ev("conversations"), role="user", conv_id=None)
    return c.where(F.col("text").ilike("%a%")).select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))


@on("Q", "SELECT conv_id, CAST(count(*) AS BIGINT) AS queries FROM conversations GROUP BY 1")
def S48_test_set_upserts(ev: Evidence) -> DataFrame:
    blobs = ev("conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "text"))).alias("blob"))
    rows = blobs.select("conv_id", F.explode(F.from_json("blob", "array<struct<turn:bigint,text:string>>")).alias("q")).select("conv_id", "q.turn", "q.text")
    stored = store.upsert(rows, rows.withColumn("text", F.upper("text")), ["conv_id", "turn"], "turn")
    return stored.groupBy("conv_id").agg(F.count("*").alias("queries"))


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', qid + n) AS doc_id, 1e0 / n AS score, CAST(n AS INT) AS rank FROM v_q, range(1, 4) r(n)")
def S24_service_source(ev: Evidence) -> DataFrame:
    """A service that answers with its own field names; here a function stands for it."""
    def service(query_id: str, text: str, k: int) -> dict:
        return {"hits": [{"id": f"d{int(query_id[1:]) + n}", "score": 1.0 / n} for n in range(1, k + 1)]}

    return external.retrieve(ev("v_q").select(F.concat(F.lit("q"), "qid").alias("query_id"), F.lit("").alias("text")), service, 3, tries=2)


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, 1e0 / rank AS score, CAST(rank AS INT) AS rank FROM v_dense WHERE rank <= 4")
def S27_framework_source(ev: Evidence) -> DataFrame:
    """A retriever object of a framework: documents with metadata that holds their id."""
    found = {r["query_id"]: list(r["docs"]) for r in ev("cands").where("op_id = 'dense' and side = 'out' and run_id = 'A' and rank <= 4").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs")).collect()}  # 4 per stated query

    class Document:
        def __init__(self, name: str) -> None:
            self.metadata = {"id": name}

    return external.retrieve(ev("v_q").select(F.concat(F.lit("q"), "qid").alias("query_id"), F.lit("").alias("text")), lambda q, t, k: [Document(d) for d in found.get(q, [])], 4)


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, round(1 - (1 - s), 6) AS score, CAST(rank AS INT) AS rank FROM v_dense WHERE rank <= 6")
def S25_cosine_source(ev: Evidence) -> DataFrame:
    from evalquarry.catalog.retrieval import _vectors
    from evalquarry.operators import retrieval as R

    d = R.dense(*_vectors(ev), top_k=6)
    return d.select(F.concat(F.lit("q"), "query_id").alias("query_id"), F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.round(1 - (1 - F.col("score")), 6).alias("score"), "rank")


@on("V", """SELECT trace_id, op_id AS name, 'retrieval.' || k AS attribute, v AS value FROM (SELECT trace_id, op_id, unnest(['operator_type', 'status', 'parents']) AS k, unnest([op_type, status, parents]) AS v FROM spans) WHERE v <> ''""")
def S30_span_export(ev: Evidence) -> DataFrame:
    pairs = F.create_map(*(x for a, c in (("operator_type", "op_type"), ("status", "status"), ("parents", "parents")) for x in (F.lit(f"retrieval.{a}"), F.col(c))))
    return ev("spans").select("trace_id", F.col("op_id").alias("name"), F.explode(pairs).alias("attribute", "value")).where("value <> ''")


@on("V", "SELECT run_id, count(*) AS spans FROM spans GROUP BY 1")
def S31_exporters(ev: Evidence) -> DataFrame:
    """Spans through a streaming export to files, a batch at a time."""
    from evalquarry.streaming import ingest

    path = _folder(ev)
    rows = ev("spans").select("run_id", "trace_id", "op_id")
    rows.repartition(3).write.parquet(f"{path}/in")
    ingest.sink(ingest.read(ev.spark, f"{path}/in", rows.schema, 1), f"{path}/out", f"{path}/state").awaitTermination()
    return ev.spark.read.parquet(f"{path}/out").groupBy("run_id").agg(F.count("*").alias("spans"))


_MEANS = """, mv AS (SELECT run_id, op_id, round(avg(latency_ms), 3) AS v FROM spans WHERE status = 'FIRED' GROUP BY 1, 2)"""


def _means(ev: Evidence) -> DataFrame:
    return ev("spans").where("status = 'FIRED'").groupBy("run_id", "op_id").agg(F.round(F.avg("latency_ms"), 3).alias("v"))


@on("V", f"{_MEANS} SELECT '| ' || run_id || ' | ' || op_id || ' | ' || CAST(CAST(v AS DECIMAL(12, 3)) AS VARCHAR) || ' |' AS line FROM mv")
def S33_report_markdown(ev: Evidence) -> DataFrame:
    from evalquarry.operators.reporting import markdown

    return markdown(_means(ev).withColumn("v", F.col("v").cast("decimal(12,3)")), ["run_id", "op_id", "v"])


@on("V", f"{_MEANS} SELECT run_id, op_id, v AS mean_ms FROM mv")
def S34_results_export(ev: Evidence) -> DataFrame:
    path = _folder(ev)
    _means(ev).withColumnRenamed("v", "mean_ms").write.partitionBy("run_id").json(path)
    return ev.spark.read.schema("op_id string, mean_ms double, run_id string").json(path).select("run_id", "op_id", "mean_ms")


@on("G", "SELECT src, dst, edge_type, CASE WHEN CAST(substr(src, 2) AS BIGINT) % 3 = 0 THEN 0.5e0 ELSE 1e0 END AS weight FROM edges")
def S35_doc_edge_load(ev: Evidence) -> DataFrame:
    path = _folder(ev)
    third = F.substring("src", 2, 20).cast("bigint") % 3 == 0
    ev("edges").select("src", "dst", F.col("edge_type").alias("type"), F.when(third, F.lit(0.5)).alias("weight")).write.json(path)
    return files.edges(ev.spark, path)


@on("G", "SELECT edge_type, count(*) AS n, count(DISTINCT src) AS sources FROM (SELECT src, edge_type FROM edges UNION ALL SELECT dst, 'back' FROM edges) GROUP BY 1")
def S40_doc_edge_insert(ev: Evidence) -> DataFrame:
    s, e = _store(ev), ev("edges").withColumn("run_id", F.lit("graph"))
    s.append("edges", e)
    s.append("edges", e.select("run_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("back").alias("edge_type"), "weight"))
    return s.scan("edges").groupBy("edge_type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


def _policy_text(pipelines: list[str]) -> str:
    return json.dumps({"schema_version": 3, "id": "each-pipeline", "metrics": [{"id": f"recall-{p.lower()}", "metric": "recall", "pipeline": p, "max_regression": 0.02} for p in pipelines], "statistics": {"resamples": 4000}})


@on("M", "SELECT DISTINCT 'recall-' || lower(pipeline_id) AS id, pipeline_id AS pipeline, 'recall' AS metric, 10 AS k, 0.02e0 AS max_regression FROM metrics")
def S36_policy_load(ev: Evidence) -> DataFrame:
    names = [r[0] for r in ev("metrics").select("pipeline_id").distinct().orderBy("pipeline_id").collect()]  # a run's pipelines
    loaded = P.policy(_policy_text(names))
    return ev.spark.createDataFrame([(c.id, c.pipeline, c.metric, c.k, c.max_regression) for c in loaded.checks], "id string, pipeline string, metric string, k int, max_regression double")


@on("V", """, o AS (SELECT DISTINCT op_id FROM spans WHERE op_type IN ('FUSE', 'RERANK', 'EXPAND')), s AS (SELECT op_id, row_number() OVER (ORDER BY op_id) - 1 AS i FROM o)
SELECT string_agg(op_id, '__' ORDER BY i) AS pipeline, count(*) AS stages FROM range(1, 8) r(m), s WHERE (m >> i) & 1 = 1 GROUP BY m""")
def S37_experiment_load(ev: Evidence) -> DataFrame:
    names = [r[0] for r in ev("spans").where("op_type in ('FUSE', 'RERANK', 'EXPAND')").select("op_id").distinct().orderBy("op_id").collect()]  # operators
    loaded = P.experiment(json.dumps({"name": "x", "dataset": {"name": "d"}, "combine": [{"type": n} for n in names]}))
    return ev.spark.createDataFrame([(p, len(s)) for p, s in loaded.pipelines.items()], "pipeline string, stages bigint")


@on("T", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'default' ELSE op_id END AS branch_id FROM t_spans")
def S38_schema_migration(ev: Evidence) -> DataFrame:
    path, t = _folder(ev), ev("t_spans")
    t.where("event_id % 2 = 0").select("event_id").write.parquet(f"{path}/version=2")
    t.where("event_id % 2 = 1").select("event_id", F.col("op_id").alias("branch_id")).write.parquet(f"{path}/version=3")
    return ev.spark.read.option("mergeSchema", True).parquet(path).select("event_id", F.coalesce("branch_id", F.lit("default")).alias("branch_id"))


def _pairs(ev: Evidence) -> RunStore:
    s = _store(ev)
    s.replace("pairs", E._rows(ev))
    return s


@on("V", f"{E._ROWS}, first AS (SELECT query_id, min(doc_id) AS doc_id FROM jo WHERE run_id = 'A' GROUP BY 1) SELECT jo.query_id, jo.doc_id, outcome, n_events FROM jo JOIN first USING (query_id, doc_id) WHERE run_id = 'A'")
def S41_projection_point_reads(ev: Evidence) -> DataFrame:
    pairs = _pairs(ev).scan("pairs", run_id="A")
    keys = pairs.groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return pairs.join(keys, ["query_id", "doc_id"]).select("query_id", "doc_id", "outcome", "n_events")


@on("L", "SELECT CAST(item_id AS VARCHAR) AS run_id FROM benchmark WHERE item_id % 4 <> 3")
def S42_runs_for_dataset(ev: Evidence) -> DataFrame:
    s = _store(ev)
    name = F.element_at(F.array(*(F.lit(x) for x in (" NFCorpus ", "nfcorpus", "beir/nfcorpus", "Mine"))), (F.col("item_id") % 4 + 1).cast("int"))
    s.append("runs", ev("benchmark").select(F.col("item_id").cast("string").alias("run_id"), F.to_json(F.struct(F.struct(name.alias("name")).alias("dataset"))).alias("config")))
    named = s.scan("runs").withColumn("dataset", X.dataset_name(F.get_json_object("config", "$.dataset.name")))
    return named.where("dataset = 'beir/nfcorpus'").select("run_id")


@on("T", "SELECT op_id AS kind, service_id AS record_id, max(event_id) AS version, arg_max(props, event_id) AS payload FROM t_spans GROUP BY 1, 2")
def S43_latest_records(ev: Evidence) -> DataFrame:
    s = _store(ev)
    s.append("records", ev("t_spans").select(F.lit("r").alias("run_id"), F.col("op_id").alias("kind"), F.col("service_id").alias("record_id"), F.col("event_id").alias("version"), F.col("props").alias("payload")))
    return store.latest(s.scan("records"), ["kind", "record_id"], "version").select("kind", "record_id", "version", "payload")


@on("V", f"{E._ROWS} SELECT trace_id, doc_id, outcome, membership, coalesce(final_rank, -1) AS final_rank, n_events, observed FROM jo")
def S46_pair_rows(ev: Evidence) -> DataFrame:
    whole = _pairs(ev).scan("pairs").select(F.struct("*").alias("row"))
    return whole.select("row.trace_id", "row.doc_id", "row.outcome", "row.membership", F.coalesce("row.final_rank", F.lit(-1)).alias("final_rank"), "row.n_events", "row.observed")


@on("T", """, r AS (SELECT op_id, CASE WHEN event_id % 17 = 0 THEN left(props, 3) ELSE props END AS raw FROM t_spans)
SELECT op_id, count(*) FILTER (json_valid(raw)) AS readable, count(*) FILTER (NOT json_valid(raw)) AS unreadable FROM r GROUP BY 1""")
def S47_trace_decode(ev: Evidence) -> DataFrame:
    raw = ev("t_spans").select("op_id", "event_id", F.when(F.col("event_id") % 17 == 0, F.left("props", F.lit(3))).otherwise(F.col("props")).alias("raw"))
    good, bad = files.decoded(raw, "raw", "event_id")
    n = lambda df, c: df.groupBy("op_id").agg(F.count("*").alias(c))
    return n(good, "readable").join(n(bad, "unreadable"), "op_id", "full_outer").na.fill(0)
