"""Recording what DataFrame steps do: every observed step becomes an operator of the evidence.

    trace = Recorder(run_id="A")
    with trace.scope():
        hits = trace.observe("SOURCE", "dense")(retrieve)(queries)
        kept = trace.observe("FILTER", "fresh")(lambda df: df.where(...))(hits)
    trace.cands(), trace.spans()

A step takes and returns ranked lists (query_id, doc_id, rank). Which step's output an
argument is, is known by the DataFrame itself; what no step returned has no parent.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDS = ("run_id", "trace_id", "query_id", "span_idx", "op_id", "side", "parent_op_id", "candidate_id", "doc_id", "rank")


class Recorder:
    def __init__(self, run_id: str, rate: float = 1.0) -> None:
        self.run_id, self.rate, self.open = run_id, rate, False
        self.steps: list[dict] = []
        self.made: dict[int, str] = {}

    @contextmanager
    def scope(self) -> Iterator[Recorder]:
        """Steps are recorded inside a scope alone; scopes don't nest."""
        if self.open:
            raise RuntimeError("a scope is open already")
        self.open = True
        try:
            yield self
        finally:
            self.open = False

    def name(self, op_id: str) -> str:
        uses = sum(s["operator_id"] == op_id for s in self.steps)
        return op_id if not uses else f"{op_id}#{uses + 1}"

    def observe(self, op_type: str, op_id: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            @functools.wraps(f)
            def step(*inputs: DataFrame, **options: object) -> DataFrame:
                began, status = time.perf_counter(), "FIRED"
                try:
                    out = f(*inputs, **options)
                except Exception:
                    status = "ERROR"
                    raise
                finally:
                    if self.open:
                        name = self.name(op_id)
                        groups = [(self.made.get(id(i)), i) for i in inputs if {"query_id", "doc_id", "rank"} <= set(i.columns)]
                        self.steps.append({"op_id": name, "operator_id": op_id, "op_type": op_type, "status": status, "inputs": groups, "output": out if status == "FIRED" else None, "plan_ms": 1000 * (time.perf_counter() - began)})
                if self.open:
                    self.made[id(out)] = name
                return out

            return step

        return wrap

    @contextmanager
    def gate(self, op_id: str, routes: list[str]) -> Iterator[dict]:
        """A gate's span: the block sets `route`, a column of the declared routes."""
        chosen: dict = {"routes": routes}
        yield chosen
        if self.open:
            self.steps.append({"op_id": self.name(op_id), "operator_id": op_id, "op_type": "GATE", "status": "FIRED", "inputs": [], "output": None, "plan_ms": 0.0, "route": chosen.get("route")})

    def _kept(self, df: DataFrame) -> DataFrame:
        """Head sampling by query, so that a query is recorded at every step or at none."""
        return df if self.rate >= 1 else df.where(F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(1_000_000)) < F.lit(int(self.rate * 1_000_000)))

    def cands(self) -> DataFrame:
        """Every input and output row of every step."""
        parts = []
        for i, s in enumerate(self.steps):
            for side, group in [("in", g) for g in s["inputs"]] + ([("out", (None, s["output"]))] if s["output"] is not None else []):
                parent, df = group
                q = F.col("query_id").cast("string")
                parts.append(self._kept(df).select(
                    F.lit(self.run_id).alias("run_id"), F.concat(F.lit(f"{self.run_id}-"), q).alias("trace_id"), q.alias("query_id"), F.lit(i).alias("span_idx"), F.lit(s["op_id"]).alias("op_id"), F.lit(side).alias("side"),
                    F.lit(parent).cast("string").alias("parent_op_id"), F.col("doc_id").cast("string").alias("candidate_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("rank").cast("int").alias("rank")))
        return reduce(DataFrame.unionByName, parts)

    def spans(self) -> list[dict]:
        """The steps with their parents, in order."""
        return [{"span_idx": i, "op_id": s["op_id"], "operator_id": s["operator_id"], "op_type": s["op_type"], "status": s["status"], "parents": ",".join(sorted({p for p, _ in s["inputs"] if p}))} for i, s in enumerate(self.steps)]


def no_regression(before: DataFrame, after: DataFrame, quality_drop: float = 0.0, latency_pct: float = 10.0) -> None:
    """Raise if a metric of `after` (metric_name, mean) is worse: quality by more than
    quality_drop, latency by more than latency_pct percent. For use in tests."""
    j = before.select("metric_name", F.col("mean").alias("b")).join(after.select("metric_name", F.col("mean").alias("a")), "metric_name")
    slow = F.col("metric_name").startswith("latency")
    worse = F.when(slow, F.col("a") > F.col("b") * (1 + latency_pct / 100)).otherwise(F.col("b") - F.col("a") > quality_drop)
    bad = [f"{r['metric_name']}: {r['b']} -> {r['a']}" for r in j.where(worse).orderBy("metric_name").collect()]
    if bad:
        raise AssertionError("worse than before: " + "; ".join(bad))
