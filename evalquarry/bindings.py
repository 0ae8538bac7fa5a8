"""Evidence derived from the provided tables, so that operators have data to run on.

Each binding is one SQL text that Spark and DuckDB both read, but for the dot product.
V: a retrieval pipeline over vectors, as traces (runs A and B; B has no filter).
L: benchmark items as queries over documents. T: events as traces of services.
M: line items as a metric fact of two runs. G: links between neighbouring documents. Q: labelled
documents and conversations.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalquarry.plans.storage import saved

_SPARK_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"
_DUCK_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"

#: The V pipeline: dense and lexical sources, a filter behind lexical, rank fusion, a gate to
#: rerank or fast, an expansion, a selection. Each common table is one operator's output.
_V = """
v_q AS (SELECT vec_id AS qid, label, embedding FROM embeddings WHERE vec_id % 20 = 0),
v_sim AS (SELECT q.qid, e.vec_id AS did, round({dot}, 6) AS s, round({dot16}, 6) AS s16, e.label
  FROM v_q q JOIN embeddings e ON e.vec_id <> q.qid),
v_dense AS (SELECT * FROM (SELECT qid, did, s AS score, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, did) AS rank FROM v_sim) t WHERE rank <= 50),
v_lex AS (SELECT * FROM (SELECT qid, did, s16 AS score, s, row_number() OVER (PARTITION BY qid ORDER BY s16 DESC, did) AS rank FROM v_sim) t WHERE rank <= 50),
v_runs AS (SELECT 'A' AS run_id UNION ALL SELECT 'B'),
v_filter AS (SELECT r.run_id, qid, did, score, s, row_number() OVER (PARTITION BY r.run_id, qid ORDER BY rank) AS rank
  FROM v_lex CROSS JOIN v_runs r WHERE r.run_id = 'B' OR did % 5 <> 0),
v_arms AS (SELECT r.run_id, 'dense' AS op_id, qid, did, s, rank FROM v_dense CROSS JOIN v_runs r UNION ALL SELECT run_id, 'filter', qid, did, s, rank FROM v_filter),
v_fuse AS (SELECT * FROM (SELECT run_id, qid, did, s, score, row_number() OVER (PARTITION BY run_id, qid ORDER BY score DESC, CAST(did AS STRING)) AS rank
  FROM (SELECT run_id, qid, did, max(s) AS s, round(sum(1e0 / (60 + rank)), 9) AS score FROM v_arms GROUP BY run_id, qid, did) f) t WHERE rank <= 30),
v_rerank AS (SELECT * FROM (SELECT run_id, qid, did, s AS score, s, row_number() OVER (PARTITION BY run_id, qid ORDER BY s DESC, did) AS rank FROM v_fuse WHERE qid % 40 = 0) t WHERE rank <= 10),
v_fast AS (SELECT run_id, qid, did, score, s, rank FROM v_fuse WHERE qid % 40 <> 0 AND rank <= 12),
v_branch AS (SELECT run_id, 'rerank' AS op_id, qid, did, score, s, rank FROM v_rerank UNION ALL SELECT run_id, 'fast', qid, did, score, s, rank FROM v_fast),
v_back AS (SELECT l.qid, r.run_id, l.did, l.s, row_number() OVER (PARTITION BY l.qid, r.run_id ORDER BY l.rank) AS k
  FROM v_lex l CROSS JOIN v_runs r WHERE l.did % 5 = 0 AND r.run_id = 'A' AND NOT EXISTS (SELECT 1 FROM v_branch b WHERE b.run_id = r.run_id AND b.qid = l.qid AND b.did = l.did)),
v_expand AS (SELECT run_id, qid, did, score, s, parent, row_number() OVER (PARTITION BY run_id, qid ORDER BY g, rank) AS rank FROM (
  SELECT run_id, qid, did, score, s, CAST(NULL AS BIGINT) AS parent, 0 AS g, rank FROM v_branch WHERE rank <> 3
  UNION ALL SELECT run_id, qid, did, s, s, CAST(NULL AS BIGINT), 1, k FROM v_back WHERE k <= 2
  UNION ALL SELECT run_id, qid, did + 100000, score, s, did, 2, rank FROM v_branch WHERE rank = 3) t),
v_select AS (SELECT run_id, qid, did, score, s, rank FROM v_expand WHERE rank <= 10),
v_io AS (
  SELECT r.run_id, qid, 0 AS span_idx, 'dense' AS op_id, 'out' AS side, CAST(NULL AS STRING) AS parent_op_id, did, rank, score, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS STRING) AS reason FROM v_dense CROSS JOIN v_runs r
  UNION ALL SELECT r.run_id, qid, 1, 'lexical', 'out', NULL, did, rank, score, NULL, NULL FROM v_lex CROSS JOIN v_runs r
  UNION ALL SELECT r.run_id, qid, 2, 'filter', 'in', 'lexical', did, rank, score, NULL, CASE WHEN did % 5 = 0 AND r.run_id = 'A' THEN 'stale' END FROM v_lex CROSS JOIN v_runs r
  UNION ALL SELECT run_id, qid, 2, 'filter', 'out', NULL, did, rank, score, NULL, NULL FROM v_filter
  UNION ALL SELECT r.run_id, qid, 3, 'fuse', 'in', 'dense', did, rank, score, NULL, NULL FROM v_dense CROSS JOIN v_runs r
  UNION ALL SELECT run_id, qid, 3, 'fuse', 'in', 'filter', did, rank, score, NULL, NULL FROM v_filter
  UNION ALL SELECT run_id, qid, 3, 'fuse', 'out', NULL, did, rank, score, NULL, NULL FROM v_fuse
  UNION ALL SELECT run_id, qid, 4, 'gate', 'in', 'fuse', did, rank, score, NULL, NULL FROM v_fuse
  UNION ALL SELECT run_id, qid, 4, 'gate', 'out', NULL, did, rank, score, NULL, NULL FROM v_fuse
  UNION ALL SELECT run_id, qid, 5, 'rerank', 'in', 'gate', did, rank, score, NULL, NULL FROM v_fuse WHERE qid % 40 = 0
  UNION ALL SELECT run_id, qid, 5, 'rerank', 'out', NULL, did, rank, score, NULL, NULL FROM v_rerank WHERE qid % 200 <> 0 OR rank <= 4
  UNION ALL SELECT run_id, qid, 6, 'fast', 'in', 'gate', did, rank, score, NULL, NULL FROM v_fuse WHERE qid % 40 <> 0
  UNION ALL SELECT run_id, qid, 6, 'fast', 'out', NULL, did, rank, score, NULL, NULL FROM v_fast
  UNION ALL SELECT run_id, qid, 7, 'expand', 'in', op_id, did, rank, score, NULL, NULL FROM v_branch
  UNION ALL SELECT run_id, qid, 7, 'expand', 'out', NULL, did, rank, score, parent, NULL FROM v_expand
  UNION ALL SELECT run_id, qid, 8, 'select', 'in', 'expand', did, rank, score, NULL, NULL FROM v_expand
  UNION ALL SELECT run_id, qid, 8, 'select', 'out', NULL, did, rank, score, NULL, NULL FROM v_select),
cands AS (SELECT run_id, concat(run_id, '-', CAST(qid AS STRING)) AS trace_id, concat('q', CAST(qid AS STRING)) AS query_id, span_idx, op_id, side, parent_op_id,
    concat('d', CAST(did AS STRING)) AS candidate_id, concat('d', CAST(did AS STRING)) AS doc_id, CAST(rank AS INT) AS rank, score,
    CASE WHEN parent IS NOT NULL THEN concat('d', CAST(parent AS STRING)) END AS parent_candidate_id, reason FROM v_io),
v_ops AS (
  SELECT 0 AS span_idx, 'dense' AS op_id, 'SOURCE' AS op_type, '' AS parents, 50 AS top_k UNION ALL SELECT 1, 'lexical', 'SOURCE', '', 50 UNION ALL SELECT 2, 'filter', 'FILTER', 'lexical', NULL
  UNION ALL SELECT 3, 'fuse', 'FUSE', 'dense,filter', 30 UNION ALL SELECT 4, 'gate', 'GATE', 'fuse', NULL UNION ALL SELECT 5, 'rerank', 'RERANK', 'gate', 10
  UNION ALL SELECT 6, 'fast', 'TRANSFORM', 'gate', NULL UNION ALL SELECT 7, 'expand', 'EXPAND', 'rerank,fast', NULL UNION ALL SELECT 8, 'select', 'TRANSFORM', 'expand', NULL),
spans AS (SELECT r.run_id, concat(r.run_id, '-', CAST(q.qid AS STRING)) AS trace_id, concat('q', CAST(q.qid AS STRING)) AS query_id, o.span_idx, o.op_id, o.op_type, o.parents, o.top_k,
    CASE WHEN (o.op_id = 'rerank' AND q.qid % 40 <> 0) OR (o.op_id = 'fast' AND q.qid % 40 = 0) THEN 'SKIPPED_BY_GATE' ELSE 'FIRED' END AS status,
    CASE WHEN o.op_id = 'rerank' AND q.qid % 200 = 0 THEN 'truncated' ELSE 'recorded' END AS output_capture, o.op_id = 'select' AS is_final,
    CAST((q.qid * 7 + q.qid % 39 + o.span_idx * 13) % 50 + 1 AS DOUBLE) AS latency_ms,
    CASE WHEN o.op_id = 'gate' THEN CASE WHEN q.qid % 40 = 0 THEN 'rerank' ELSE 'fast' END END AS route
  FROM v_q q CROSS JOIN v_ops o CROSS JOIN v_runs r),
qrels AS (SELECT concat('q', CAST(q.qid AS STRING)) AS query_id, concat('d', CAST(e.vec_id AS STRING)) AS doc_id,
    CASE WHEN e.label = q.label AND e.vec_id % 7 = q.qid % 7 THEN 2 WHEN e.label = q.label THEN 1 ELSE 0 END AS grade
  FROM v_q q JOIN embeddings e ON e.vec_id <> q.qid WHERE e.label = q.label OR e.vec_id % 11 = 0)
"""
_L = """
l_q AS (SELECT item_id, text FROM benchmark),
l_tok AS (SELECT doc_id, w FROM (SELECT doc_id, {explode_doc} AS w FROM documents) t WHERE w <> ''),
l_qtok AS (SELECT item_id, w FROM ({explode_q}) t WHERE w <> '')
"""
_M = """
m_cell AS (SELECT l_orderkey AS ok, l_linenumber AS stage, min(l_returnflag) AS pipeline, max(l_discount) AS base, max(l_tax) AS cand FROM lineitem GROUP BY l_orderkey, l_linenumber),
metrics AS (SELECT 'base' AS run_id, pipeline AS pipeline_id, CAST(ok AS STRING) AS query_id, stage AS stage_index, 'recall' AS metric_name, 10 AS k, base AS value, ok FROM m_cell
  UNION ALL SELECT 'cand', pipeline, CAST(ok AS STRING), stage, 'recall', 10, cand, ok FROM m_cell WHERE ok % 20 <> 0)
"""
_T = """
t_spans AS (SELECT event_id, ts, concat('svc', CAST(user_id AS STRING)) AS service_id, event_type AS op_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status, value AS latency_ms, props FROM events)
"""
_Q = """
q_lab AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
"""
_G = """
edges AS (SELECT concat('d', CAST(doc_id AS STRING)) AS src, concat('d', CAST(nxt AS STRING)) AS dst, 'next' AS edge_type, 1e0 AS weight
  FROM (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM documents) t WHERE nxt IS NOT NULL)
"""


def _v(dot: str, a16: str, b16: str) -> str:
    return _V.replace("{dot}", dot.format(a="q.embedding", b="e.embedding")).replace("{dot16}", dot.format(a=a16, b=b16))


SPARK = {
    "V": _v(_SPARK_DOT, "slice(q.embedding, 1, 16)", "slice(e.embedding, 1, 16)"),
    "L": _L.replace("{explode_doc}", r"explode(split(lower(text), '[ \\t\\n\\r]+'))").replace("{explode_q}", r"SELECT item_id, pos, w FROM l_q LATERAL VIEW posexplode(split(lower(text), '[ \\t\\n\\r]+')) p AS pos, w"),
    "M": _M, "T": _T, "G": _G, "Q": _Q,
}
DUCK = {
    "V": _v(_DUCK_DOT, "q.embedding[1:16]", "e.embedding[1:16]"),
    "L": _L.replace("{explode_doc}", r"unnest(regexp_split_to_array(lower(text), '[ \t\n\r]+'))").replace(
        "{explode_q}", r"SELECT item_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM (SELECT item_id, regexp_split_to_array(lower(text), '[ \t\n\r]+') AS ws FROM l_q) z"),
    "M": _M, "T": _T, "G": _G, "Q": _Q,
}
_BASE = {"V": ["embeddings"], "L": ["benchmark", "documents"], "M": ["lineitem"], "T": ["events"], "G": ["documents"], "Q": ["labels", "documents", "conversations"]}


_kept: dict[tuple[str, str, str], DataFrame] = {}


def forget() -> None:
    """Work the stored tables out again on their next use."""
    _kept.clear()


def _state(spark: SparkSession, path: str) -> str:
    """The path with the sizes and times of its files."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return "|".join([path, *sorted(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in found)])


#: Steps of V that several others read; each is written once.
STORED = ("v_dense", "v_lex", "v_filter", "v_fuse", "v_expand")


def _searched(ev: Evidence, name: str) -> DataFrame:
    """The two sources of V, by the search operator: what the SQL's v_dense and v_lex say."""
    from pyspark.sql import functions as F

    from evalquarry.operators import retrieval as R

    e = ev.tables["embeddings"]
    q = e.where("vec_id % 20 = 0")
    part = lambda df, name, n: df.select(F.col("vec_id").alias(name), (F.col("embedding") if n is None else F.slice("embedding", 1, n)).alias("embedding"))
    named = lambda d: d.select(F.col("query_id").alias("qid"), F.col("doc_id").alias("did"), "score", "rank")
    if name == "v_dense":
        return named(R.dense(part(q, "query_id", None), part(e, "doc_id", None), top_k=50)).select("qid", "did", "score", F.col("score").alias("s"), "rank")
    return similarity(ev, named(R.dense(part(q, "query_id", 16), part(e, "doc_id", 16), top_k=50))).select("qid", "did", "score", "s", "rank")


def similarity(ev: Evidence, pairs: DataFrame) -> DataFrame:
    """pairs (qid, did) with s, the inner product of their vectors, worked out for these pairs alone."""
    from pyspark.sql import functions as F

    e = ev.tables["embeddings"].select("vec_id", "embedding")
    a, b = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qe")), e.select(F.col("vec_id").alias("did"), F.col("embedding").alias("de"))
    dot = F.expr(_SPARK_DOT.format(a="qe", b="de"))
    return pairs.join(a, "qid").join(b, "did").withColumn("s", F.round(dot, 6)).drop("qe", "de")


class Evidence:
    """The tables of a binding as DataFrames: ev = Evidence(spark, sf_dir, "V"); ev("cands").

    Traces are stored tables that many queries read: those of V are written once per
    application and state of the input files, so no query works the pipeline out again and
    changed files are read anew. `forget` drops them."""

    def __init__(self, spark: SparkSession, sf_dir: str, binding: str) -> None:
        self.spark, self.sf_dir, self.binding = spark, sf_dir, binding
        self.tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _BASE[binding]}
        #: The binding's tables by name, each as the SQL behind it; what they read by its name in braces.
        self.made: dict[str, str] = {}
        given = [*self.tables, *(STORED if binding == "V" else ())]
        for part in re.split(r",\n(?=\w+ AS \()", SPARK[binding].strip()):
            name, _, sql = part.partition(" AS (")
            for t in given:
                sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
            self.made[name] = f"({sql}"

    def _needs(self, name: str) -> list[str]:
        """The tables that one reads, directly or not, in order."""
        seen: list[str] = []

        def visit(n: str) -> None:
            for m in self.made:
                if m not in seen and m != n and re.search(rf"\b(FROM|JOIN) {{?{m}\b", self.made[n]):
                    visit(m)
            if n not in seen:
                seen.append(n)

        visit(name)
        return seen

    def _query(self, name: str) -> DataFrame:
        parts = [n for n in self._needs(name) if n not in STORED or n == name]
        return self.spark.sql(f"WITH {', '.join(f'{n} AS {self.made[n]}' for n in parts)} SELECT * FROM {name}", **self.tables)

    def _stored(self, name: str, made: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, _state(self.spark, f"{self.sf_dir}/embeddings.parquet"), name)
        if key not in _kept:
            _kept[key] = saved(made())
        return _kept[key]

    def __call__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if self.binding != "V":
            return self._query(name)
        for t in self._needs(name):
            if t in STORED and t not in self.tables:
                self.tables[t] = self._stored(t, lambda t=t: _searched(self, t) if t in ("v_dense", "v_lex") else self._query(t))
        return self.tables[name] if name in self.tables else self._stored(name, lambda: self._query(name))


def oracle(binding: str, query: str) -> str:
    return f"WITH {DUCK[binding]} {query}" if not query.lstrip().startswith(",") else f"WITH {DUCK[binding]}{query}"
