"""Release audits: checks of resolved policies, slices, evidence thresholds, decisions.

Check results have one row per check: status (PASS, HOLD, FAIL, BLOCK) and why. What a
comparison must account for is a universe of queries: one without a value in either run
shows as missing coverage and is never dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalquarry.operators import comparison as C
from evalquarry.operators.release import SEVERITY


def gravest(status: Column) -> Column:
    """The gravest status of a group; BLOCK without any."""
    names = F.array(*(F.lit(s) for s in SEVERITY))
    level = F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), status)
    return F.element_at(names, F.coalesce(F.max(level), F.lit(SEVERITY["BLOCK"])) + 1)


def checked(base: DataFrame, cand: DataFrame, keys: list[str], margin: float, intervals: DataFrame, least: int = 20, min_coverage: float = 0.95) -> DataFrame:
    """One check per key over the union of both runs' queries: HOLD with too few pairs or too little
    coverage, else by the interval (keys, low, high) against the margin; BLOCK without values on a side."""
    n = C.coverage(base, cand, keys)
    j = n.join(intervals, keys, "left")
    by_interval = F.when(F.col("low").isNull(), "BLOCK").otherwise(C.interval_status(F.col("low"), F.col("high"), F.lit(margin), C.lower_is_better(F.lit("quality"))))
    empty = (F.col("attempted") == F.col("missing_base")) | (F.col("attempted") == F.col("missing_cand"))
    status = F.when(empty, "BLOCK").when(F.col("paired") < least, "HOLD").when(F.col("coverage") < min_coverage, "HOLD").otherwise(by_interval)
    reason = F.when(empty, "unavailable").when(F.col("paired") < least, "too_few_pairs").when(F.col("coverage") < min_coverage, "pair_coverage").otherwise("interval")
    return j.withColumn("status", status).withColumn("reason", reason)


def normal_intervals(pairs: DataFrame, keys: list[str], z: float = 1.96) -> DataFrame:
    """Large-sample intervals of the mean difference, in one aggregation."""
    se = F.stddev_samp("delta") / F.sqrt(F.count("*"))
    s = pairs.groupBy(*keys).agg(F.avg("delta").alias("effect"), se.alias("se"))
    return s.select(*keys, "effect", (F.col("effect") - z * F.col("se")).alias("low"), (F.col("effect") + z * F.col("se")).alias("high"))


def confidence(family: Column, level: float = 0.95, alpha: float = 0.05) -> Column:
    """Bonferroni over a family of checks."""
    return F.greatest(F.lit(level), 1 - alpha / F.greatest(family, F.lit(1)))


def resamples_needed(adjusted: Column) -> Column:
    """So many that each tail has 20."""
    return F.ceil(40 / (1 - adjusted) - 1e-9)


def execution(base: DataFrame, cand: DataFrame, keys: list[str], budget: float) -> DataFrame:
    """Queries that the base run answers and the candidate doesn't, against a budget."""
    n = C.coverage(base, cand, keys)
    rate = F.try_divide("missing_cand", "attempted")
    return n.select(*keys, "attempted", F.col("missing_cand").alias("failed"), rate.alias("failure_rate"), F.when(rate.isNull(), "BLOCK").when(rate > budget, "FAIL").otherwise("PASS").alias("status"))


def membership(base: DataFrame, cand: DataFrame) -> DataFrame:
    """query_id, segment of two runs. Per segment: members by either run, and queries that both
    label but not alike."""
    b, a = base.select("query_id", F.col("segment").alias("b")).distinct(), cand.select("query_id", F.col("segment").alias("a")).distinct()
    j = b.join(a, "query_id", "full_outer")
    members = j.select("query_id", F.explode(F.array_distinct(F.array_compact(F.array("b", "a")))).alias("segment"), (F.col("b") != F.col("a")).alias("differs"))
    return members.groupBy("segment").agg(F.countDistinct("query_id").alias("members"), F.count_if(F.coalesce("differs", F.lit(False))).alias("disagreement"))


def decided(statuses: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """statuses: key, check, status; expected: key, check. The gravest status per key; a check
    without a result blocks."""
    j = expected.join(statuses, [key, "check"], "left")
    return j.groupBy(key).agg(gravest(F.coalesce("status", F.lit("BLOCK"))).alias("decision"), F.count_if(F.col("status").isNull()).alias("missing"))


def thresholds(rows: DataFrame, keys: list[str], floors: dict[str, float], caps: dict[str, float] | None = None) -> DataFrame:
    """Each measured column against its floor or cap: PASS, HOLD, or BLOCK where unknown."""
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"), F.lit(float(x)).alias("limit"), F.lit(True).alias("floor")) for c, x in floors.items()]
    cells += [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"), F.lit(float(x)).alias("limit"), F.lit(False).alias("floor")) for c, x in (caps or {}).items()]
    out = rows.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")
    bad = F.when(F.col("floor"), F.col("value") < F.col("limit")).otherwise(F.col("value") > F.col("limit"))
    return out.select(*keys, "field", F.when(F.col("value").isNull(), "BLOCK").when(bad, "HOLD").otherwise("PASS").alias("status"))


def artifact(policy_id: str, checks: list[dict], decision: str) -> str:
    """The audit as canonical JSON."""
    from evalquarry.functions.identity import canonical

    return canonical({"schema_version": 1, "policy": policy_id, "decision": decision, "checks": sorted(checks, key=lambda c: json.dumps(c, sort_keys=True))})


def page(text: str) -> str:
    """The same as a small HTML page."""
    import html

    audit = json.loads(text)
    rows = "".join("<tr>" + "".join(f"<td>{html.escape(str(c[k]))}</td>" for k in sorted(c)) + "</tr>" for c in audit["checks"])
    return f"<!doctype html><title>{html.escape(audit['policy'])}</title><h1>{html.escape(audit['decision'])}</h1><table>{rows}</table>"
