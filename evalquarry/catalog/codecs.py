"""Queries of scalar functions, codecs and identities (bindings V, L, M and T)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.bindings import Evidence
from evalquarry.catalog import evidence as E
from evalquarry.catalog.scalar import _LISTS, _lists
from evalquarry.functions import identity as I
from evalquarry.functions import scalar as X
from evalquarry.operators import comparison as C
from evalquarry.operators import journeys as J
from evalquarry.operators import reporting as P
from evalquarry.registry import on


@on("V", f"{_LISTS} SELECT query_id, round(len(list_intersect(ids, rel)) * 1e0 / (len(ids) + len(rel) - len(list_intersect(ids, rel))), 6) AS similarity FROM ls JOIN rs USING (query_id)")
def F17_jaccard(ev: Evidence) -> DataFrame:
    return _lists(ev).select("query_id", F.round(X.jaccard(F.col("ids"), F.col("rel")), 6).alias("similarity"))


@on("V", f"""{E._ROWS} SELECT judgment, membership, CASE WHEN judgment = 'unknown' THEN 'unknown' WHEN judgment = 'relevant' THEN CASE WHEN membership = 'included' THEN 'TP' ELSE 'FN' END WHEN membership = 'included' THEN 'FP' ELSE 'TN' END AS cell, count(*) AS n FROM jo GROUP BY 1, 2, 3""")
def F18_confusion_cell(ev: Evidence) -> DataFrame:
    rows = E._rows(ev).select("judgment", "membership")
    return rows.groupBy("judgment", "membership", J.confusion(F.col("judgment"), F.col("membership")).alias("cell")).agg(F.count("*").alias("n"))


_NAMES = """, nm AS (SELECT DISTINCT CASE event_id % 6 WHEN 0 THEN 'latency_' || op_id WHEN 1 THEN 'cost_' || op_id WHEN 2 THEN 'profile_' || op_id WHEN 3 THEN 'failure' WHEN 4 THEN 'ndcg' ELSE op_id || '_latency' END AS metric, event_id % 40 AS base FROM t_spans)"""


def _names(ev: Evidence) -> DataFrame:
    e, op = F.col("event_id") % 6, F.col("op_id")
    name = F.when(e == 0, F.concat(F.lit("latency_"), op)).when(e == 1, F.concat(F.lit("cost_"), op)).when(e == 2, F.concat(F.lit("profile_"), op)).when(e == 3, "failure").when(e == 4, "ndcg").otherwise(F.concat(op, F.lit("_latency")))
    return ev("t_spans").select(name.alias("metric"), (F.col("event_id") % 40).alias("base")).distinct()


@on("T", f"{_NAMES} SELECT DISTINCT metric, regexp_matches(metric, '^(latency|cost|profile|failure|timeout|dropout)') AS lower FROM nm")
def F19_metric_direction(ev: Evidence) -> DataFrame:
    return _names(ev).select("metric", C.lower_is_better(F.col("metric")).alias("lower")).distinct()


@on("T", f"""{_NAMES} SELECT metric, base, round(CASE WHEN regexp_matches(metric, '^(latency|profile)') THEN greatest(1e0, base * 0.05) WHEN metric LIKE 'cost%' THEN greatest(0.001, base * 0.05) ELSE 0.01 END, 6) AS threshold FROM nm""")
def F21_effect_threshold(ev: Evidence) -> DataFrame:
    return _names(ev).select("metric", "base", F.round(C.effect_threshold(F.col("metric"), F.col("base").cast("double")), 6).alias("threshold"))


@on("T", "SELECT event_id, epoch_us(ts) AS us FROM t_spans")
def F22_datetime_parse(ev: Evidence) -> DataFrame:
    """ISO-8601 texts with Z or an offset."""
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.concat(F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")))
    return ev("t_spans").select("event_id", F.unix_micros(X.instant(text)).alias("us"))


@on("T", """SELECT event_id, '{"a":"' || op_id || '","b":[' || event_id || ',{"x":null,"y":true}],"z":0.0}' AS canonical FROM t_spans""")
def F23_canonical_json(ev: Evidence) -> DataFrame:
    raw = F.concat(F.lit('{"z": -0.0, "b": ['), F.col("event_id").cast("string"), F.lit(', {"y": true, "x": null}], "a": "'), F.col("op_id"), F.lit('"}'))
    return ev("t_spans").select("event_id", I.canonical_json(raw).alias("canonical"))


_IDENTITY = """, qi AS (SELECT item_id, sha256('{"filters":{},"metadata":{},"query_id":"' || item_id || '","schema_version":1,"temporal_anchor":null,"text":' || CAST(to_json(text) AS VARCHAR) || '}') AS identity FROM benchmark)"""


def _identities(ev: Evidence) -> DataFrame:
    return I.query_identities(ev("benchmark").select(F.col("item_id").alias("query_id"), "text"))


@on("L", f"{_IDENTITY} SELECT item_id AS query_id, identity FROM qi")
def F24_query_identity(ev: Evidence) -> DataFrame:
    return _identities(ev).select("query_id", "identity")


@on("L", f"""{_IDENTITY} SELECT sha256('[' || string_agg('"' || identity || '"', ',' ORDER BY identity) || ']') AS digest FROM qi""")
def F25_queries_digest(ev: Evidence) -> DataFrame:
    return I.queries_digest(_identities(ev))


@on("V", "SELECT DISTINCT doc_id FROM qrels WHERE starts_with(doc_id, 'd1')")
def F29_prefix_filter(ev: Evidence) -> DataFrame:
    return ev("qrels").where(F.col("doc_id").like(I.like_prefix("d1"))).select("doc_id").distinct()


@on("L", """SELECT item_id, replace(replace(base64(CAST('["' || item_id || '","x?>"]' AS BLOB)), '+', '-'), '/', '_') AS cursor, CAST(item_id AS VARCHAR) AS first FROM benchmark""")
def F30_cursor_codec(ev: Evidence) -> DataFrame:
    c = ev("benchmark").select("item_id", I.cursor(F.col("item_id"), F.lit("x?>")).alias("cursor"))
    return c.select("item_id", "cursor", F.element_at(I.opened(F.col("cursor")), 1).alias("first"))


@on("T", "SELECT event_id, CAST(coalesce(nullif(regexp_extract(props || op_id, '([012])', 1), ''), '0') AS INT) AS grade FROM t_spans")
def F32_grade_parse(ev: Evidence) -> DataFrame:
    return ev("t_spans").select("event_id", X.grade(F.concat("props", "op_id")).alias("grade"))


@on("L", "SELECT item_id, '[REDACTED]' AS token, left(text, 20) AS note FROM benchmark")
def F33_payload_redaction(ev: Evidence) -> DataFrame:
    m = F.create_map(F.lit("Api_Token"), F.col("text"), F.lit("note"), F.col("text"))
    return ev("benchmark").select("item_id", X.redacted(m, ["api_token"], 20).alias("m")).select("item_id", F.col("m")["Api_Token"].alias("token"), F.col("m")["note"].alias("note"))


_COSTS = [("rerank", 20.0), ("SOURCE", 1.0), ("RERANK", 5.0), ("FUSE", 0.5)]
_COST = """, co AS (SELECT * FROM (VALUES ('rerank', 20e0), ('SOURCE', 1e0), ('RERANK', 5e0), ('FUSE', 0.5e0)) c(name, per_1k)), so AS (SELECT DISTINCT run_id, op_id, op_type FROM spans),
sc AS (SELECT so.*, coalesce(a.per_1k, b.per_1k, 0) AS per_1k FROM so LEFT JOIN co a ON a.name = so.op_id LEFT JOIN co b ON b.name = so.op_type)"""


def costs(ev: Evidence) -> DataFrame:
    return ev.spark.createDataFrame(_COSTS, "name string, per_1k double")


@on("V", f"{_COST} SELECT run_id AS pipeline_id, sum(per_1k) AS per_1k FROM sc GROUP BY 1")
def F34_cost_per_1k(ev: Evidence) -> DataFrame:
    return P.cost_per_1k(ev("spans").select(F.col("run_id").alias("pipeline_id"), "op_id", "op_type").distinct(), costs(ev))


@on("V", """, g AS (SELECT trace_id, span_idx, op_id, candidate_id, count(*) FILTER (side = 'in') AS n_in, count(*) FILTER (side = 'out') AS n_out, max(parent_candidate_id) AS parent FROM cands GROUP BY 1, 2, 3, 4)
SELECT op_id, CASE WHEN parent IS NOT NULL OR n_in = 1 OR op_id = 'fuse' THEN 'recorded' ELSE 'partial' END AS evidence, count(*) AS n FROM g WHERE n_out > 0 GROUP BY 1, 2""")
def F35_identity_evidence(ev: Evidence) -> DataFrame:
    """Explicit parents, single matches and fusions are recorded; anything else is partly known."""
    c = ev("cands").groupBy("trace_id", "span_idx", "op_id", "candidate_id").agg(F.count_if(F.col("side") == "in").alias("n_in"), F.count_if(F.col("side") == "out").alias("n_out"), F.max("parent_candidate_id").alias("parent"))
    sure = F.col("parent").isNotNull() | (F.col("n_in") == 1) | (F.col("op_id") == "fuse")
    return c.where("n_out > 0").groupBy("op_id", F.when(sure, "recorded").otherwise("partial").alias("evidence")).agg(F.count("*").alias("n"))


@on("Q", "SELECT DISTINCT 'dataset:' || coalesce(source, 'none') || ':' || CASE WHEN lang IS NULL THEN 'nocorpus' ELSE sha256(lang) END AS identity FROM documents")
def F36_dataset_cache_identity(ev: Evidence) -> DataFrame:
    return ev("documents").select(I.dataset_identity(F.coalesce("source", F.lit("none")), F.sha2("lang", 256)).alias("identity")).distinct()


@on("T", """, v AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"v": 1}' WHEN 1 THEN '{"v": "1"}' ELSE '{"v": true}' END AS m FROM t_spans)
SELECT event_id FROM v WHERE json_type(m, '$.v') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(m, '$.v') AS BIGINT) = 1""")
def F37_typed_metadata(ev: Evidence) -> DataFrame:
    e = F.col("event_id") % 3
    m = F.when(e == 0, '{"v": 1}').when(e == 1, '{"v": "1"}').otherwise('{"v": true}')
    return ev("t_spans").select("event_id", F.parse_json(m).alias("m")).where(X.same_typed(F.col("m"), "$.v", 1)).select("event_id")


@on("T", """SELECT service_id, round(least(count(*) FILTER (op_id <> 'view') * 2e0 / count(*), 1), 6) AS label_coverage, round(count(*) FILTER (op_id = 'error') * 1e0 / nullif(count(*) FILTER (op_id IN ('error', 'purchase')), 0), 6) AS dropped_rate FROM t_spans GROUP BY 1""")
def F38_coverage_rates(ev: Evidence) -> DataFrame:
    s = ev("t_spans").groupBy("service_id").agg((F.count_if(F.col("op_id") != "view") * 2).alias("labelled"), F.count("*").alias("attempted"), F.count_if(F.col("op_id") == "error").alias("dropped"), F.count_if(F.col("op_id") == "purchase").alias("accepted"))
    return s.select("service_id", F.round(X.label_coverage(F.col("labelled"), F.col("attempted")), 6).alias("label_coverage"), F.round(X.dropped_rate(F.col("accepted"), F.col("dropped")), 6).alias("dropped_rate"))


@on("V", """SELECT DISTINCT op_id, upper(left(op_id, 1)) || substr(op_id, 2) || ' Step' AS label, op_id || '|mrr (whole list)' AS metric FROM spans""")
def F39_display_labels(ev: Evidence) -> DataFrame:
    return ev("spans").select("op_id", P.label(F.concat("op_id", F.lit("_step"))).alias("label"), P.metric_label(F.concat("op_id", F.lit("|mrr@0"))).alias("metric")).distinct()
