"""Queries of scalar functions and of text checks (bindings L and V)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.bindings import Evidence
from evalquarry.functions import scalar as X
from evalquarry.operators.similarity import near_duplicate_pairs
from evalquarry.registry import on

_LISTS = """, ls AS (SELECT query_id, list(doc_id ORDER BY rank) AS ids FROM cands WHERE side = 'out' AND op_id = 'fuse' AND run_id = 'A' GROUP BY 1), rs AS (SELECT query_id, list(doc_id) AS rel FROM qrels WHERE grade > 0 GROUP BY 1)"""


def _lists(ev: Evidence) -> DataFrame:
    c = ev("cands").where("side = 'out' and op_id = 'fuse' and run_id = 'A'").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    return c.join(ev("qrels").where("grade > 0").groupBy("query_id").agg(F.collect_list("doc_id").alias("rel")), "query_id")


@on("V", f"""{_LISTS} SELECT query_id, round(len(list_intersect(ids[1:10], rel)) * 1e0 / len(rel), 6) AS recall, round(len(list_intersect(ids[1:10], rel)) / 10e0, 6) AS precision,
  round(coalesce(1e0 / nullif(list_min(list_transform(list_intersect(ids, rel), lambda x: list_position(ids, x))), 0), 0), 6) AS rr FROM ls JOIN rs USING (query_id)""")  # fmt: skip
def F01_list_metrics(ev: Evidence) -> DataFrame:
    d, ids, rel = _lists(ev), F.col("ids"), F.col("rel")
    return d.select("query_id", F.round(X.recall_at_k(ids, rel, 10), 6).alias("recall"), F.round(X.precision_at_k(ids, rel, 10), 6).alias("precision"), F.round(X.reciprocal_rank(ids, rel), 6).alias("rr"))


@on("L", "SELECT doc_id, count(*) AS n_tokens, count(DISTINCT w) AS n_distinct FROM l_tok GROUP BY 1")
def F15_tokeniser(ev: Evidence) -> DataFrame:
    t = ev("documents").select("doc_id", X.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


_SETS = r""", st AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS s FROM benchmark)"""


@on("L", f"{_SETS} SELECT item_id, CAST(len(s) AS BIGINT) AS n FROM st")
def F16_token_sets(ev: Evidence) -> DataFrame:
    return ev("benchmark").select("item_id", F.size(X.token_set(F.col("text"))).cast("bigint").alias("n"))


_DOCSETS = r""", st AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS s FROM documents WHERE text IS NOT NULL),
tk AS (SELECT doc_id, len(s) AS n, unnest(s) AS w FROM st), k AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM tk a JOIN tk b ON a.w = b.w AND a.doc_id < b.doc_id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY ALL)"""


@on("L", f"{_DOCSETS} SELECT a, b, round(k * 1e0 / (na + nb - k), 3) AS similarity FROM k WHERE k * 1e0 / (na + nb - k) >= 0.8")
def J25_near_duplicate_queries(ev: Evidence) -> DataFrame:
    """Of texts as long as documents, of which there are copies."""
    q = ev("documents").where("text is not null").select(F.col("doc_id").alias("id"), X.token_set(F.col("text")).alias("tokens"))
    return near_duplicate_pairs(q, 0.8)


@on("M", """SELECT DISTINCT concat(pipeline_id, '|stage', stage_index, '|recall@10') AS key, pipeline_id AS pipeline, stage_index AS stage, 'recall' AS metric, 10 AS k, CAST(NULL AS VARCHAR) AS branch FROM metrics""")
def F20_metric_keys(ev: Evidence) -> DataFrame:
    k = X.metric_key(F.col("pipeline_id"), F.col("stage_index"), F.col("metric_name"), F.col("k"), F.lit(None).cast("string"))
    return ev("metrics").select(k.alias("key")).distinct().select("key", X.parsed_key(F.col("key")).alias("p")).select("key", "p.*")


@on("L", "SELECT item_id, concat('q_', left(sha256(text), 10)) AS id FROM benchmark")
def S06_content_stable_ids(ev: Evidence) -> DataFrame:
    return ev("benchmark").select("item_id", X.stable_id(F.col("text")).alias("id"))


@on("L", "SELECT count(*) AS documents, count(DISTINCT sha256(text)) AS texts, count(*) FILTER (trim(text) = '') AS empty_texts, count(*) - count(DISTINCT doc_id) AS repeated_ids FROM documents")
def A34_file_validation(ev: Evidence) -> DataFrame:
    d = ev("documents")
    return d.agg(F.count("*").alias("documents"), F.countDistinct(F.sha2("text", 256)).alias("texts"), F.count_if(F.trim("text") == "").alias("empty_texts"), (F.count("*") - F.countDistinct("doc_id")).alias("repeated_ids"))


@on("Q", """, r AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN ' NFCorpus ' WHEN 1 THEN 'fiqa' WHEN 2 THEN ' ' || upper(source) ELSE 'beir/' || source END AS raw FROM documents)
SELECT raw, CASE WHEN lower(trim(raw)) IN ('nfcorpus', 'fiqa') THEN 'beir/' || lower(trim(raw)) ELSE lower(trim(raw)) END AS name FROM r""")
def F28_dataset_names(ev: Evidence) -> DataFrame:
    n = F.col("doc_id") % 4
    raw = F.when(n == 0, " NFCorpus ").when(n == 1, "fiqa").when(n == 2, F.concat(F.lit(" "), F.upper("source"))).otherwise(F.concat(F.lit("beir/"), "source"))
    return ev("documents").select(raw.alias("raw")).distinct().select("raw", X.dataset_name(F.col("raw")).alias("name"))


@on("L", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'kb' ELSE 'default' END AS namespace, CAST(item_id AS VARCHAR) AS entity_id FROM benchmark")
def F31_entity_split(ev: Evidence) -> DataFrame:
    key = F.concat(F.when(F.col("item_id") % 2 == 0, "kb:").otherwise(""), F.col("item_id").cast("string"))
    return ev("benchmark").select("item_id", X.entity(key).alias("e")).select("item_id", "e.*")
