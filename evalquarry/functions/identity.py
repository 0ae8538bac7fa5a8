"""Canonical JSON and the identities of queries, judgments and caches."""

from __future__ import annotations

import datetime
import hashlib
import json
import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.plans.shipping import ship


def plain(value: Any) -> Any:
    """A value as JSON holds it: no minus zero, keys as text, sets in order; NaN and infinity are errors."""
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError(f"{value!r} has no canonical form")
        return value + 0.0 if value else 0.0
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((plain(v) for v in value), key=json.dumps)
    return value.isoformat() if isinstance(value, datetime.datetime) else str(value)


def canonical(value: Any) -> str:
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def query_identity(query_id: str, text: str, filters: Mapping | None = None, metadata: Mapping | None = None, anchor: str | None = None) -> str:
    """What a query is, whatever cut-off it is scored at."""
    return digest({"schema_version": 1, "query_id": str(query_id), "text": str(text), "filters": filters or {}, "metadata": metadata or {}, "temporal_anchor": anchor})


def canonical_json(payload: Column) -> Column:
    """Canonical JSON of a JSON text."""
    ship(SparkSession.active())
    return F.udf(lambda s: None if s is None else canonical(json.loads(s)), "string", useArrow=True)(payload)


def query_identities(queries: DataFrame) -> DataFrame:
    """queries: query_id, text. Adds identity."""
    ship(queries.sparkSession)
    f = F.udf(lambda q, t: query_identity(q, t or ""), "string", useArrow=True)
    return queries.withColumn("identity", f(F.col("query_id").cast("string"), "text"))


def queries_digest(identities: DataFrame) -> DataFrame:
    """One digest of all identities in order; a benchmark's queries, not its corpus, so one task."""
    listed = F.array_sort(F.collect_list("identity"))
    text = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]"))
    return identities.agg(F.sha2(text, 256).alias("digest"))


def cache_key(config: Column, dataset: Column, query_id: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("::", config, dataset, query_id, text), 256)


def upstream_key(doc_ids: Column) -> Column:
    """The part of a stage's key that stands for the candidates before it."""
    return F.when(F.size(doc_ids) > 0, F.left(F.sha2(F.array_join(F.array_sort(doc_ids), ","), 256), F.lit(16))).otherwise("nostage")


def dataset_identity(name: Column, corpus: Column) -> Column:
    return F.concat(F.lit("dataset:"), name, F.lit(":"), F.coalesce(corpus, F.lit("nocorpus")))


def like_prefix(prefix: str) -> str:
    """A LIKE pattern for what starts with the prefix."""
    for c in ("\\", "%", "_"):
        prefix = prefix.replace(c, "\\" + c)
    return prefix + "%"


def cursor(*keys: Column) -> Column:
    """URL-safe base64 of the keys as a JSON list."""
    return F.translate(F.base64(F.to_json(F.array(*(k.cast("string") for k in keys))).cast("binary")), "+/", "-_")


def opened(cursor_: Column) -> Column:
    return F.from_json(F.unbase64(F.translate(cursor_, "-_", "+/")).cast("string"), "array<string>")
