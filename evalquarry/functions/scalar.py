"""Scalar functions of the engine as column expressions, and list forms of the metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recall_at_k(ids: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first k distinct ones; 0 without relevant ids."""
    if k <= 0:
        raise ValueError("k must be positive")
    hits = F.size(F.array_intersect(F.slice(F.array_distinct(ids), 1, k), relevant))
    return F.when(F.size(relevant) > 0, hits / F.size(F.array_distinct(relevant))).otherwise(0.0)


def precision_at_k(ids: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(F.array_distinct(ids), 1, k), relevant)) / F.lit(float(k))


def reciprocal_rank(ids: Column, relevant: Column) -> Column:
    at = F.array_position(F.transform(F.array_distinct(ids), lambda x: F.array_contains(relevant, x)), True)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def average_precision(ids: Column, relevant: Column) -> Column:
    seen = F.array_distinct(ids)
    hit = F.filter(F.transform(seen, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda p: p.isNotNull())
    total = F.aggregate(F.transform(hit, lambda p, i: (i + 1) / p), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(relevant) > 0, total / F.size(F.array_distinct(relevant))).otherwise(0.0)


def tokens(text: Column) -> Column:
    """Lower case, split at ASCII space."""
    return F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def token_set(text: Column) -> Column:
    """Distinct tokens after everything but letters, digits and space became space."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def metric_key(pipeline: Column, stage: Column, metric: Column, k: Column, branch: Column) -> Column:
    return F.concat(pipeline, F.lit("|stage"), stage.cast("string"), F.lit("|"), metric, F.when(k > 0, F.concat(F.lit("@"), k.cast("string"))).otherwise(""), F.when(branch.isNotNull(), F.concat(F.lit("|branch="), branch)).otherwise(""))


def parsed_key(key: Column) -> Column:
    """(pipeline, stage, metric, k, branch) of a metric key."""
    part = F.split(key, r"\|")
    metric = F.element_at(part, 3)
    return F.struct(
        F.element_at(part, 1).alias("pipeline"), F.regexp_extract(F.element_at(part, 2), r"stage(-?\d+)", 1).cast("int").alias("stage"), F.element_at(F.split(metric, "@"), 1).alias("metric"),
        F.coalesce(F.regexp_extract(metric, r"@(\d+)", 1).try_cast("int"), F.lit(0)).alias("k"), F.nullif(F.regexp_extract(key, r"\|branch=(.*)$", 1), F.lit("")).alias("branch"),
    )


#: Names of the public benchmark collections that get a prefix.
COLLECTIONS = ("nfcorpus", "scifact", "fiqa", "trec-covid", "hotpotqa", "nq", "msmarco", "arguana", "quora", "dbpedia-entity", "fever", "scidocs")


def dataset_name(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return F.when(n.isin(*COLLECTIONS), F.concat(F.lit("beir/"), n)).otherwise(n)


def stable_id(text: Column) -> Column:
    return F.concat(F.lit("q_"), F.left(F.sha2(text, 256), F.lit(10)))


def entity(key: Column) -> Column:
    """namespace and id of 'ns:id'; without a namespace 'default'."""
    there = F.contains(key, F.lit(":"))
    return F.struct(F.when(there, F.substring_index(key, ":", 1)).otherwise("default").alias("namespace"), F.when(there, F.regexp_replace(key, "^[^:]*:", "")).otherwise(key).alias("entity_id"))


def grade(answer: Column) -> Column:
    """The first of the digits 0, 1, 2 in a judge's answer; 0 without one."""
    return F.coalesce(F.regexp_extract(answer, "([012])", 1).try_cast("int"), F.lit(0))


def redacted(payload: Column, keys: list[str], limit: int) -> Column:
    """A string map without the values of some keys and with the others cut to a length."""
    return F.transform_values(payload, lambda k, v: F.when(F.lower(k).isin([x.lower() for x in keys]), "[REDACTED]").otherwise(F.left(v, F.lit(limit))))


def instant(text: Column) -> Column:
    """ISO-8601 with Z or an offset as a timestamp; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def same_typed(value: Column, path: str, want: bool | int | str) -> Column:
    """Whether a variant holds the value in its own type: 1, "1" and true are three values."""
    kind = "BOOLEAN" if isinstance(want, bool) else "BIGINT" if isinstance(want, int) else "STRING"
    inner = F.try_variant_get(value, path, "variant")
    return F.coalesce((F.schema_of_variant(inner) == kind) & (F.try_variant_get(value, path, kind.lower()) == F.lit(want)), F.lit(False))


def label_coverage(labelled: Column, attempted: Column) -> Column:
    """Share of attempted queries with a label, at most 1; unknown without attempts."""
    return F.when(attempted > 0, F.least(labelled / attempted, F.lit(1.0)))


def dropped_rate(accepted: Column, dropped: Column) -> Column:
    return F.try_divide(dropped, accepted + dropped)
