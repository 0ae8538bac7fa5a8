"""Mixing sources to target weights by entropy balancing.

Every document has `most` slots (2) in the mix. Of all ways to fill slots at random,
entropy balancing takes the one nearest to filling each with chance 1/most that meets
every source's token target: slots of a document of size n are filled with chance
1 / (1 + exp(-lambda n / scale)), an exponential tilt of the even rate, with one lambda
per source. The lambdas maximise the concave dual; Newton's method with a bracket
solves for all sources at once over a table of (source, size, documents), which is all
that an iteration reads. Sums are exact decimals, so reruns agree to the last bit.

Rates become whole copies within (source, cell) groups of about CELL documents, dealt by
a hash: largest documents first, each gets the copies nearest to its share plus what the
ones before are short, between the whole numbers around its rate unless the shortfall
exceeds its size, and never more than `most`. A group ends within about its smallest
document of its share, however many groups a source has. Rows of one doc_id and size are one
entry of their group with a number, and share its copies evenly; so rows that repeat without
end don't fill a group.

Targets: sources by code point, null last, weigh `weights` in turn and share `total`
times all tokens; a target stops at `most` times its source and the rest is shared again.

Defined results: a null text has size 0, takes 0 and is in no constraint. Rows with a
null doc_id take part; rows that repeat a doc_id are documents of their own. Ties in size are
settled by a hash of doc_id and size. A very long text is one document of its size. An empty
table gives an empty table. Only doc_id, text and source are read, so the names of other
columns can't clash.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.llm import common

WEIGHTS = (5, 2, 1)
CELL = 4096
TOLERANCE = 1e-10
STEPS = 60


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), common.word_count(F.col("text").cast("string")).alias("size"))


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: int = 2) -> DataFrame:
    """by_source: source, source_size. Adds number (from 0, by code point, null last) and
    target. Each round caps the sources whose share is above `most` times their size."""
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    out = common.numbered(by_source, F.col("source").asc_nulls_last(), "number")
    out = common.stash(out.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size")))
    goal = total * (out.agg(F.sum("source_size")).first()[0] or 0)
    level, known = None, -1
    while True:  # capped sources only grow in number, so this ends
        capped = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.col("cap")
        n, used, free = out.agg(F.count(F.when(capped, 1)), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == known:
            break
        known = n
        if not free:
            level = float("inf")
            break
        level = max(0.0, goal - (used or 0.0)) / free
    return out.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("cap")) if level is not None else F.lit(0.0)).drop("weight", "cap")


def tilts(histogram: DataFrame, sources: DataFrame, most: int = 2) -> DataFrame:
    """histogram: number, size, docs; sources: number, source_size, target. Returns number,
    lam and scale: a document of size n fills a slot with chance 1 / (1 + exp(-lam n / scale)).
    Sources without a target or with a full one need no tilt and have no row."""
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    known = histogram.where("size > 0").groupBy("number").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("scale"))
    open_ = sources.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * most))
    state = open_.join(known, "number").select("number", "target", "source_size", "scale", F.lit(0.0).alias("lam"), F.lit(-800.0).alias("lo"), F.lit(800.0).alias("hi"), F.lit(1.0).alias("miss"))
    state = common.stash(state)
    rows = common.stash(histogram.where("size > 0"))
    for _ in range(STEPS):
        x = F.col("size") / F.col("scale")
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("lam") * x))))
        value = rows.join(state.select("number", "lam", "scale"), "number").groupBy("number").agg(
            exact(most * p * F.col("size") * F.col("docs")).alias("f"), exact(most * p * (1 - p) * x * F.col("size") * F.col("docs")).alias("d")
        )
        gap = F.col("f") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.greatest(F.col("d"), F.lit(1e-300))
        inside = (newton > F.col("lo2")) & (newton < F.col("hi2"))
        after = (
            state.join(value, "number").withColumn("lo2", lo).withColumn("hi2", hi)
            .select("number", "target", "source_size", "scale", F.when(gap == 0, F.col("lam")).when(inside, newton).otherwise((F.col("lo2") + F.col("hi2")) / 2).alias("lam"),
                    F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), (F.abs(gap) / F.greatest(F.col("source_size"), F.lit(1))).cast("double").alias("miss"))
        )
        before, state = state, common.stash(after)
        common.discard(before)
        worst = state.where("hi - lo > 1e-12").agg(F.max("miss")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    common.discard(rows)
    return state.select("number", "lam", "scale")


def whole(group: pd.DataFrame, most: int) -> pd.DataFrame:
    """Copies that all rows of each entry of one group take together; an entry is `rows` rows of one
    size and rate. Entry by entry this is what row by row would come to."""
    group = group.sort_values(["size", "order"], ascending=[False, True], kind="stable")
    short, copies = 0.0, []
    for size, rate, rows in zip(group["size"].tolist(), group["rate"].tolist(), group["rows"].tolist(), strict=True):
        if size <= 0:
            copies.append(0)
            continue
        n = math.floor((rows * rate * size + short) / size + 0.5)
        n = min(max(n, 0), rows * most)
        short += (rows * rate - n) * size
        copies.append(n)
    return group.assign(copies=copies)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies of every row of docs."""
    each = common.stash(sizes(docs), even=True)
    by_source = each.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    sources = common.stash(targets(by_source, weights, total, most))
    numbered = each.join(sources.select(F.col("source").alias("_s"), "number", "source_size", "source_docs", "target"), each["source"].eqNullSafe(F.col("_s"))).drop("_s")
    histogram = numbered.groupBy("number", "size").agg(F.count("*").alias("docs"))
    tilt = tilts(histogram, sources, most)
    full = F.col("target") >= F.col("source_size") * most
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("lam") * F.col("size") / F.col("scale")))))
    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), F.lit(0.0)).when(full, F.lit(float(most))).otherwise(most * p)
    spread = F.xxhash64("doc_id", "size")
    cells = F.ceil(F.col("source_docs") / CELL)
    once = numbered.groupBy("number", "doc_id", "size").agg(F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("source", "source_size", "source_docs", "target")))
    rated = (
        once.join(tilt, "number", "left")
        .withColumns({"rate": F.coalesce(rate, F.lit(0.0)), "cell": F.pmod(spread, cells), "order": spread})
        .select("doc_id", "source", "size", "source_size", "target", "rate", "rows", "number", "cell", "order")
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return whole(group, most)[names]

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, size bigint, source_size bigint, target double, rate double, rows bigint, copies bigint"
    names = ["doc_id", "source", "size", "source_size", "target", "rate", "rows", "copies"]
    out = rated.groupBy("number", "cell").applyInPandas(run, schema)
    # a row for each row, in steps so that no array grows with their number
    out = out.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / CELL))))
    out = out.withColumn("i", F.explode(F.sequence(F.col("step") * CELL + 1, F.least(F.col("rows"), (F.col("step") + 1) * CELL))))
    more = (F.col("i") <= F.col("copies") % F.col("rows")).cast("bigint")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", (F.floor(F.col("copies") / F.col("rows")) + more).alias("copies"))
