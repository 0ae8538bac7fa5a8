"""The dataflow operators of a retrieval pipeline, each for all queries at once.

Ranked lists are rows (query_id, doc_id, score, rank), ranks from 1. Operators that cut
lists rank with row_number, so Spark limits each group before the shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evalquarry.plans.shipping import ship
from evalquarry.plans.storage import saved, spread

BROADCAST_ROWS = 20_000


def ranked(scored: DataFrame, *order: Column, key: str = "query_id", top_k: int | None = None) -> DataFrame:
    """Ranks within each query; keeps the first top_k."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def by_score(key: str = "doc_id") -> tuple[Column, Column]:
    """Descending score; ties by id as text."""
    return F.desc("score"), F.asc(F.col(key).cast("string"))


def _best(scores: np.ndarray, ids: np.ndarray, top_k: int) -> np.ndarray:
    """Indices of the top_k by descending score, then id."""
    some = np.arange(len(scores))
    if len(scores) > 4 * top_k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - top_k)[len(scores) - top_k])
    return some[np.lexsort((ids[some], -scores[some]))[:top_k]]


def _parts(rows: int) -> int:
    return max(1, -(-rows // BROADCAST_ROWS))


def dense(queries: DataFrame, corpus: DataFrame, top_k: int, allow: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """Exact inner products of query and corpus vectors (query_id, embedding; doc_id,
    embedding; ids are whole numbers; a query doesn't meet the document of its own id). The stated
    queries are taken in blocks of some BROADCAST_ROWS, each broadcast to one scan of the
    corpus; a task multiplies batch by batch and lets go of all but its top_k of each query, so
    what is shuffled is queries x tasks x top_k rows, however large the corpus."""
    spark = queries.sparkSession
    ship(spark)
    if allow is not None:
        corpus = corpus.join(allow.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = saved(queries.where("embedding is not null").select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>")))
    blocks = _parts(asked.count())
    vectors = corpus.where("embedding is not null").select(F.col("doc_id").cast("bigint"), F.col("embedding").cast("array<double>"))

    def scan(shared) -> DataFrame:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            held = [(np.zeros(0), np.zeros(0, np.int64)) for _ in names]
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for lo in range(0, len(ids), 4096):
                    some = ids[lo : lo + 4096]
                    x = batch.column(1).slice(lo, len(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)
                    scores = np.round(matrix @ x.T, digits)
                    for i, (s, d) in enumerate(held):
                        s, d = np.concatenate((s, scores[i])), np.concatenate((d, some))
                        s, d = s[d != names[i]], d[d != names[i]]
                        top = _best(s, d, top_k)
                        held[i] = s[top], d[top]
            for i, (s, d) in enumerate(held):
                if len(d):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), names[i])), pa.array(d), pa.array(s + 0.0)], names=["query_id", "doc_id", "score"])

        return vectors.mapInArrow(run, "query_id bigint, doc_id bigint, score double")

    out = []
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect()  # BROADCAST_ROWS rows or so
        if block:
            shared = spark.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block])))
            one = ranked(scan(shared), F.desc("score"), F.asc("doc_id"), top_k=top_k)
            out.append(one if blocks == 1 else saved(one))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "query_id bigint, doc_id bigint, score double, rank int")


def bm25_texts(queries: DataFrame, documents: DataFrame, top_k: int, split: str = r"[ \t\n\r]+", k1: float = 1.5, b: float = 0.75, digits: int = 6) -> DataFrame:
    """BM25 over texts. queries: query_id, w, one row per occurrence of a query term (repeats
    add again); documents: doc_id (whole number), text (as it is to be split). Scores above 0
    only; ties keep corpus order, that of doc_id.

    One scan counts documents, words and in how many documents each query term is; a second scores
    every document against the queries where it is read and keeps each task's top_k. Query terms,
    in blocks of some BROADCAST_ROWS queries, are broadcast; postings are never shuffled, so
    no frequent term gathers in a task."""
    spark = queries.sparkSession
    ship(spark)
    bag = saved(queries.groupBy("query_id", "w").agg(F.count("*").alias("qtf")))
    blocks = _parts(bag.select("query_id").distinct().count())
    texts = spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
    kind, arrow = queries.schema["query_id"].dataType.simpleString(), to_arrow_type(queries.schema["query_id"].dataType)

    def words_of(apart: re.Pattern, text: pa.Scalar) -> list[str]:
        return [w for w in apart.split(text.as_py() or "") if w]

    def frequencies(terms: dict[str, int]) -> tuple[np.ndarray, int, int]:
        """(documents of each term, documents that have a word, words)."""
        vocabulary = spark.sparkContext.broadcast(terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, apart = vocabulary.value, re.compile(split)
            df, n, length = np.zeros(len(known), np.int64), 0, 0
            for batch in batches:
                for text in batch.column(1):
                    words = words_of(apart, text)
                    if words:
                        n, length = n + 1, length + len(words)
                        df[[known[w] for w in set(words) if w in known]] += 1
            there = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(there, [-1, -2])), pa.array(np.append(df[there], [n, length]))], names=["term", "n"])

        sums = {r["term"]: r["n"] for r in texts.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        vocabulary.destroy()
        return np.array([sums.get(i, 0) for i in range(len(terms))], float), sums.get(-1, 0), sums.get(-2, 0)

    def search(rows: list) -> DataFrame | None:
        terms = {w: i for i, w in enumerate(sorted({r["w"] for r in rows}))}
        df, n, length = frequencies(terms)
        if not n:
            return None
        names = sorted({r["query_id"] for r in rows})
        place = {q: i for i, q in enumerate(names)}
        at = np.array([terms[r["w"]] for r in rows])
        order = np.argsort(at, kind="stable")
        asked = np.array([place[r["query_id"]] for r in rows])[order], np.array([r["qtf"] for r in rows], float)[order]
        first = np.searchsorted(at[order], np.arange(len(terms) + 1))  # the queries of term t are at first[t]:first[t+1]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        shared = spark.sparkContext.broadcast((terms, *asked, first, idf, length / n, names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, query, times, first, idf, mean, names = shared.value
            apart = re.compile(split)
            held: list = [([], []) for _ in names]
            least = np.zeros(len(names))  # below this a document is not among a query's best

            def settle(i: int) -> None:
                s, d = np.array(held[i][0]), np.array(held[i][1], np.int64)
                top = _best(s, d, top_k)
                held[i] = s[top].tolist(), d[top].tolist()
                if len(top) == top_k:
                    least[i] = s[top[-1]]

            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = words_of(apart, text)
                    met = [(t, tf) for w, tf in Counter(words).items() if (t := known.get(w)) is not None]
                    if not met:
                        continue
                    t, tf = (np.array(x) for x in zip(*met, strict=True))
                    weight = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
                    n = first[t + 1] - first[t]
                    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[t], n)
                    score = np.round(np.bincount(query[inner], times[inner] * np.repeat(weight, n), len(names)), digits)
                    for i in np.flatnonzero((score > 0) & (score >= least)).tolist():
                        held[i][0].append(score[i])
                        held[i][1].append(doc)
                        if len(held[i][0]) > 8 * top_k + 64:
                            settle(i)
            for i, name in enumerate(names):
                if held[i][0]:
                    settle(i)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(held[i][0]), arrow), pa.array(held[i][1], pa.int64()), pa.array(held[i][0], pa.float64())], names=["query_id", "doc_id", "score"])

        return ranked(texts.mapInArrow(run, f"query_id {kind}, doc_id bigint, score double"), F.desc("score"), F.asc("doc_id"), top_k=top_k)

    out = []
    for number in range(blocks):
        rows = bag.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect()  # the terms of BROADCAST_ROWS queries or so
        one = search(rows) if rows else None
        if one is not None:
            out.append(one if blocks == 1 else saved(one))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"query_id {kind}, doc_id bigint, score double, rank int")


def bm25(queries: DataFrame, corpus: DataFrame, top_k: int, k1: float = 1.5, b: float = 0.75, digits: int = 6) -> DataFrame:
    """queries: query_id, w, one row per occurrence of a query term (repeats add again);
    corpus: doc_id, w, one row per occurrence. Scores above 0 only; ties keep corpus order,
    that of doc_id. Postings are cut down to query terms before they are counted."""
    sizes = corpus.groupBy("doc_id").agg(F.count("*").alias("dl"))
    total = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    bag = queries.groupBy("query_id", "w").agg(F.count("*").alias("qtf"))
    terms = bag.select("w").distinct()
    tf = corpus.join(terms, "w").groupBy("w", "doc_id").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    weight = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    post = tf.join(df, "w").join(sizes, "doc_id").join(F.broadcast(total), F.lit(True)).select("w", "doc_id", weight.alias("weight"))
    scored = bag.join(post, "w").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * F.col("weight")), digits).alias("score")).where("score > 0")
    return ranked(scored, F.desc("score"), F.asc("doc_id"), top_k=top_k)


def fuse(arms: list[DataFrame], top_k: int | None = None, rrf_k: int = 60, ties: str = "id", digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion. ties: 'id' orders by id as text, 'first_seen' by the first
    arm that has the document and its rank there."""
    tagged = reduce(DataFrame.unionByName, (a.select("query_id", "doc_id", "rank", F.lit(i).alias("arm")) for i, a in enumerate(arms)))
    scored = tagged.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), digits).alias("score"), F.min(F.struct("arm", "rank")).alias("seen"))
    order = by_score() if ties == "id" else (F.desc("score"), F.asc("seen"))
    return ranked(scored, *order, top_k=top_k).drop("seen")


def rerank(candidates: DataFrame, score: Column, top_k: int | None = None) -> DataFrame:
    """A new score and order; ties keep the input order."""
    out = candidates.withColumn("before", F.col("rank")).withColumn("score", score)
    return ranked(out.drop("rank"), F.desc("score"), F.asc("before"), top_k=top_k).drop("before")


def keep(candidates: DataFrame, condition: Column) -> DataFrame:
    """FILTER: what meets the condition, ranked anew in the same order."""
    out = candidates.where(condition).withColumn("before", F.col("rank")).drop("rank")
    return ranked(out, F.asc("before")).drop("before")


def drops(before: DataFrame, after: DataFrame, reason: str) -> DataFrame:
    """Candidates of `before` that `after` lacks, with a reason."""
    return before.join(after.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("drop_reason", F.lit(reason))


def truncate(candidates: DataFrame, top_k: int) -> DataFrame:
    """All candidates; those beyond top_k carry the reason 'truncated'."""
    return candidates.withColumn("drop_reason", F.when(F.col("rank") > top_k, "truncated"))


def gate(candidates: DataFrame, route: Column, routes: list[str]) -> DataFrame:
    """GATE: adds the route of each query; a route that isn't declared fails the query."""
    undeclared = F.raise_error(F.concat(F.lit("undeclared route "), route))
    return candidates.withColumn("route", F.when(route.isin(routes), route).otherwise(undeclared))


def branch(candidates: DataFrame, route: str) -> DataFrame:
    return candidates.where(F.col("route") == route)


def boost(candidates: DataFrame, score: Column) -> DataFrame:
    return rerank(candidates, score)


def expand(candidates: DataFrame, edges: DataFrame, factor: float = 0.9) -> DataFrame:
    """EXPAND: appends neighbours (edges src, dst) of the candidates that aren't candidates,
    with a share of the best source's score."""
    near = candidates.join(edges, candidates["doc_id"] == edges["src"]).groupBy("query_id", F.col("dst").alias("doc_id")).agg(F.max(F.struct("score", "src")).alias("s"))
    new = near.join(candidates.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    new = new.select("query_id", "doc_id", (F.col("s.score") * factor).alias("score"), F.col("s.src").alias("parent_candidate_id"), F.lit(1).alias("g"), F.lit(0).alias("at"))
    old = candidates.select("query_id", "doc_id", "score", F.lit(None).cast("string").alias("parent_candidate_id"), F.lit(0).alias("g"), F.col("rank").alias("at"))
    return ranked(old.unionByName(new), F.asc("g"), F.asc("at"), F.desc("score"), F.asc("doc_id")).drop("g", "at")


def transform(candidates: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return f(candidates)


def dedupe(candidates: DataFrame, *keys: str) -> DataFrame:
    """The first of each candidate within keys, and how many were dropped after it."""
    w = Window.partitionBy(*keys, "candidate_id")
    out = candidates.withColumn("nth", F.row_number().over(w.orderBy("rank"))).withColumn("copies", F.count("*").over(w))
    return out.where("nth = 1").withColumn("dropped_duplicates", F.col("copies") - 1).drop("nth", "copies")


def hydrate(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Fill missing text from the corpus (doc_id, text)."""
    c = corpus.select("doc_id", F.col("text").alias("corpus_text"))
    text = F.coalesce(F.nullif("text", F.lit("")), "corpus_text", F.lit(""))
    return candidates.join(c, "doc_id", "left").withColumn("text", text).drop("corpus_text")


def transition(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per candidate of a span: ranks before and after, how often it came in, from
    where, and why it was added or dropped. inputs: keys, candidate_id, rank, parent_op_id,
    reason; outputs: keys, candidate_id, rank."""
    came = inputs.groupBy(*keys, "candidate_id").agg(
        F.min("rank").alias("input_rank"), F.count("*").alias("input_occurrences"), F.array_join(F.array_sort(F.collect_set("parent_op_id")), ",").alias("origins"), F.max("reason").alias("reason")
    )
    went = outputs.groupBy(*keys, "candidate_id").agg(F.min("rank").alias("output_rank"))
    state = F.when(F.col("input_rank").isNull(), "added").when(F.col("output_rank").isNull(), "dropped").otherwise("kept")
    return came.join(went, [*keys, "candidate_id"], "full_outer").withColumn("change", state)


def coerced(item: Column) -> Column:
    """The id of an item given as JSON: its own fields, a node's, or its metadata's; without one an error."""
    paths = [f"$.{f}" for f in ("doc_id", "id", "node_id", "id_", "node.id", "node.node_id", "metadata.id")]
    found = F.coalesce(*(F.get_json_object(item, p) for p in paths))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("a candidate has no id: "), item)))
