"""Release checks: decision ladders over check results, multiplicity and resolution rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITY = {"PASS": 0, "HOLD": 1, "FAIL": 2, "BLOCK": 3}


def decide(checks: DataFrame, readiness: str = "PASS") -> DataFrame:
    """One row: the gravest status of all checks and the evidence's readiness, BLOCK > FAIL >
    HOLD > PASS; without a check the release is blocked."""
    level = F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("status"))
    worst = F.greatest(F.coalesce(F.max(level), F.lit(SEVERITY["BLOCK"])), F.lit(SEVERITY[readiness]))
    names = F.array(*(F.lit(s) for s in SEVERITY))
    return checks.agg(worst.alias("w"), F.count("*").alias("checks")).select(F.element_at(names, F.col("w") + 1).alias("decision"), "checks")


def adjusted_confidence(confidence: float, alpha: float, family: int) -> float:
    """Bonferroni over the family of checks."""
    return max(confidence, 1 - alpha / max(family, 1))


def enough_resamples(resamples: int, adjusted: float) -> bool:
    """Whether each tail of the interval has 20 resamples."""
    return resamples * (1 - adjusted) / 2 >= 20


def execution(attempted: int | None, failed: int | None, budget: float) -> tuple[str, float | None]:
    """(status, failure rate) of a candidate run."""
    if not attempted or failed is None:
        return "BLOCK", None
    rate = failed / attempted
    return ("PASS" if rate <= budget else "FAIL"), rate


def coverage_findings(profile: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Which coverage columns of a profile (one row per run) are below their floor or unknown."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"), F.lit(f).alias("floor")) for c, f in floors.items())))
    out = profile.select("run_id", cells.alias("c")).select("run_id", "c.*")
    return out.withColumn("status", F.when(F.col("value").isNull(), "BLOCK").when(F.col("value") < F.col("floor"), "HOLD").otherwise("PASS"))


def interventions(before: dict, after: dict, expected: set[str]) -> dict[str, str]:
    """Each provenance field: invariant, expected, unexpected or unknown."""
    out = {}
    for field in sorted(before.keys() | after.keys()):
        a, b = before.get(field), after.get(field)
        out[field] = "unknown" if a is None or b is None else "invariant" if a == b else "expected" if field in expected else "unexpected"
    return out
