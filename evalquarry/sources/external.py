"""Sources and rerankers that are calls: functions, framework objects, services.

A call gets one query (id, text or candidates) and k, and returns ids, (id, score) pairs,
mappings or objects. Calls run in Arrow batches on the executors, with bounded retries.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalquarry.plans.shipping import ship

LISTS = "query_id string, doc_id string, score double, rank int"
ID_FIELDS = ("doc_id", "id", "node_id", "id_")


def identity(item: Any) -> str:
    """The id of what a call returned; an item without one is an error."""
    if isinstance(item, (str, int)):
        return str(item)
    read = item.get if isinstance(item, Mapping) else lambda f, default=None: getattr(item, f, default)
    for name in ID_FIELDS:
        if (found := read(name)) is not None:
            return str(found)
    for inner in (read("node"), read("metadata")):
        if inner is not None and inner is not item:
            try:
                return identity(inner)
            except ValueError:
                continue
    raise ValueError("a returned item has no id")


def normalised(result: Any) -> list[tuple[str, float]]:
    """Ids, (id, score) pairs, mappings or objects as (id, score), in order; without scores
    1/place. A result that holds its documents in a field of its own is opened."""
    for name in ("documents", "results", "hits"):
        inner = result.get(name) if isinstance(result, Mapping) else getattr(result, name, None)
        if isinstance(inner, (list, tuple)):
            result = inner
            break
    out = []
    for place, item in enumerate(result, 1):
        if isinstance(item, tuple) and len(item) == 2 and isinstance(item[1], (int, float)):
            out.append((identity(item[0]), float(item[1])))
        else:
            score = item.get("score") if isinstance(item, Mapping) else getattr(item, "score", None)
            out.append((identity(item), 1.0 / place if score is None else float(score)))
    return out


def attempted(call: Callable[[], Any], tries: int, pause: float = 0.0) -> tuple[Any, int, str | None]:
    """(result, attempts, error): errors are tried again with growing pauses, a timeout is not."""
    for n in range(1, tries + 1):
        try:
            return call(), n, None
        except TimeoutError as e:
            return None, n, f"TIMEOUT: {e}"
        except Exception as e:  # noqa: BLE001  whatever a user's function raises is its status
            if n == tries:
                return None, n, f"ERROR: {e}"
            time.sleep(pause * 2 ** (n - 1))
    return None, 0, "ERROR: no attempt"


def retrieve(queries: DataFrame, call: Callable[[str, str, int], Any], k: int, tries: int = 1) -> DataFrame:
    """queries: query_id, text. Ranked lists of call(query_id, text, k), cut to k."""
    ship(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, _, error = attempted(lambda q=q, text=text: call(q, text, k), tries)
                if error is not None:
                    raise RuntimeError(f"retriever failed for {q}: {error}")
                rows += [(q, d, s, i) for i, (d, s) in enumerate(normalised(found)[:k], 1)]
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["query_id", "doc_id", "score", "rank"])

    return queries.select(F.col("query_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, LISTS)


def reranked(candidates: DataFrame, call: Callable[[str, list[str]], Any], k: int) -> DataFrame:
    """candidates: query_id, doc_id, rank. Each query's list, as long as retrieval made it, is one
    call; what comes back is cut to k."""
    ship(candidates.sparkSession)
    lists = candidates.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
    return _over_lists(lists, call, k)


def _over_lists(lists: DataFrame, call: Callable[[str, list[str]], Any], k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(q, d, s, i) for i, (d, s) in enumerate(normalised(call(q, docs))[:k], 1)]
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["query_id", "doc_id", "score", "rank"])

    return lists.select(F.col("query_id").cast("string"), "docs").mapInArrow(run, LISTS)


def scored(candidates: DataFrame, model: Callable[[list[str], list[str]], list[float]], k: int) -> DataFrame:
    """A cross-encoder: model(queries, documents) scores whole batches of pairs; ties keep the
    order they came in. candidates: query_id, doc_id, query_text, text, rank."""
    ship(candidates.sparkSession)
    names = ["query_id", "doc_id", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(values, pa.float64())], names=[*names, "score"])

    got = candidates.select(F.col("query_id").cast("string"), F.col("doc_id").cast("string"), F.col("rank").cast("int"), "query_text", "text").mapInArrow(run, "query_id string, doc_id string, rank int, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "before")
    return got.withColumnRenamed("rank", "before").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("before")


def judged(pairs: DataFrame, judge: Callable[[str, str], str], grade: Callable[[str], int]) -> DataFrame:
    """pairs: query_id, doc_id. Grades of a judge's answers."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grades = [grade(judge(q, d)) for q, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grades, pa.int32())], names=["query_id", "doc_id", "grade"])

    return pairs.select(F.col("query_id").cast("string"), F.col("doc_id").cast("string")).mapInArrow(run, "query_id string, doc_id string, grade int")


def first_grade(answer: str) -> int:
    """The first of the digits 0, 1, 2; 0 without one."""
    return next((int(c) for c in answer if c in "012"), 0)


def imported(path: str) -> Callable:
    """The callable behind 'module:name'."""
    module, _, name = path.partition(":")
    found = getattr(importlib.import_module(module), name)
    if not callable(found):
        raise TypeError(f"{path} is not callable")
    return found


REGISTRY: dict[str, Callable] = {}


def retriever(name: str) -> Callable[[Callable], Callable]:
    """Register a function (query_id, text, k) as a source."""

    def register(f: Callable) -> Callable:
        REGISTRY[name] = f
        return f

    return register


def reranker(name: str) -> Callable[[Callable], Callable]:
    """Register a function (query_id, documents) as a reranker."""
    return retriever(name)
