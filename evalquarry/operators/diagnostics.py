"""Diagnostic rules: one finding per rule and trace, as set joins of evidence and judgments.

A finding has a label and an availability: supported, limited, unavailable or
not_observed. The rules read the relevant documents (grade above 0) of each trace's query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.plans.storage import saved

Rule = Callable[["Context"], DataFrame]


class Context:
    """Evidence of all traces that the rules share. What is relevant is worked out once and stored, and so
    is its part among the candidates (met): rules about candidates read that, as the
    judgments of a corpus are many times what a trace meets."""

    def __init__(self, cands: DataFrame, spans: DataFrame, qrels: DataFrame, corpus: DataFrame, cutoff: int = 10) -> None:
        self.cands, self.spans, self.corpus, self.cutoff = cands, spans, corpus, cutoff
        self.traces = spans.groupBy("trace_id", "query_id").agg(F.bool_and(F.col("output_capture") == "recorded").alias("complete"))
        judged = qrels.where("grade > 0").select("query_id", "doc_id").distinct()
        self.relevant = saved(self.traces.select("trace_id", "query_id").join(judged, "query_id").select("trace_id", "doc_id"))
        self.judged = saved(self.traces.join(judged.select("query_id"), "query_id", "left_semi").select("trace_id").distinct().withColumn("judged", F.lit(True)))
        self.met = saved(self.relevant.join(cands.select("trace_id", "doc_id").distinct(), ["trace_id", "doc_id"], "left_semi").distinct())

    def side(self, side: str, where: str) -> DataFrame:
        """Distinct trace_id, op_id, doc_id of candidates of spans that meet a condition."""
        some = self.spans.where(where).select("trace_id", "span_idx")
        return self.cands.where(F.col("side") == side).join(some, ["trace_id", "span_idx"]).select("trace_id", "op_id", "doc_id").distinct()

    def findings(self, label: str, documents: DataFrame, spans: str | None, unavailable: DataFrame | None = None, limited: DataFrame | None = None, need_judgments: bool = True) -> DataFrame:
        """documents: trace_id, doc_id of what the rule found. spans: condition on the spans that it
        needs, else not observed. unavailable, limited: trace_id, before and after it looks."""
        out = self.traces.select("trace_id").join(self.judged, "trace_id", "left")
        found = documents.groupBy("trace_id").agg(F.countDistinct("doc_id").alias("n_documents"))
        out = out.join(found, "trace_id", "left")
        case = F.when(F.lit(need_judgments) & F.col("judged").isNull(), "unavailable") if need_judgments else F.when(F.lit(False), "")
        for name, marks in (("unavailable", unavailable), ("limited", limited)):
            if marks is not None:
                out = out.join(marks.select("trace_id").distinct().withColumn(name, F.lit(True)), "trace_id", "left")
                case = case.when(F.col(name), name)
        case = case.when(F.col("n_documents") > 0, "supported").otherwise("not_observed")
        shown = F.when(case == "supported", F.col("n_documents")).otherwise(F.lit(0))
        return out.select("trace_id", F.lit(label).alias("label"), case.alias("availability"), shown.alias("n_documents"))


def qrel_absent_from_corpus(c: Context) -> DataFrame:
    return c.findings("qrel_absent_from_corpus", c.relevant.join(c.corpus.select("doc_id"), "doc_id", "left_anti"), None)


def source_miss(c: Context) -> DataFrame:
    missed = c.relevant.join(c.side("out", "op_type = 'SOURCE' and status = 'FIRED'"), ["trace_id", "doc_id"], "left_anti")
    return c.findings("source_miss", missed, None, unavailable=c.traces.where("not complete"))


def branch_specific_miss(c: Context) -> DataFrame:
    sources = c.spans.where("op_type = 'SOURCE' and status = 'FIRED'").select("trace_id", "op_id")
    hits = c.side("out", "op_type = 'SOURCE' and status = 'FIRED'").join(c.met, ["trace_id", "doc_id"])
    per = sources.join(hits.select("trace_id", "op_id").distinct().withColumn("hit", F.lit(True)), ["trace_id", "op_id"], "left")
    mixed = per.groupBy("trace_id").agg(F.count("hit").alias("hit"), F.count("*").alias("all")).where("hit > 0 and hit < all")
    return c.findings("branch_specific_miss", hits.join(mixed, "trace_id", "left_semi"), None)


def gate_exclusion(c: Context) -> DataFrame:
    measured = c.side("out", "status = 'SKIPPED_BY_GATE'")
    skipped = c.spans.where("status = 'SKIPPED_BY_GATE'").select("trace_id").distinct()
    return c.findings("gate_exclusion", measured.join(c.met, ["trace_id", "doc_id"]), None, limited=skipped.join(measured, "trace_id", "left_anti"))


def transition_loss(label: str, where: str, need_judgments: bool = True) -> Rule:
    """Relevant documents that go into a span and don't come out."""

    def rule(c: Context) -> DataFrame:
        lost = c.side("in", where).join(c.side("out", where), ["trace_id", "op_id", "doc_id"], "left_anti").join(c.met, ["trace_id", "doc_id"], "left_semi")
        blind = c.spans.where(where).where("parents <> ''").join(c.cands.where("side = 'in'"), ["trace_id", "span_idx"], "left_anti") if need_judgments else None
        return c.findings(label, lost, where, unavailable=blind, need_judgments=need_judgments)

    return rule


fusion_loss = transition_loss("fusion_loss", "op_type = 'FUSE' and status = 'FIRED'")
filter_loss = transition_loss("filter_loss", "op_type = 'FILTER' and status = 'FIRED'")
reranker_loss = transition_loss("reranker_loss", "op_type = 'RERANK' and status = 'FIRED'")
truncation_loss = transition_loss("truncation_loss", "top_k is not null", need_judgments=False)


def ranking_failure(c: Context) -> DataFrame:
    last = c.spans.where("is_final")
    low = c.cands.where((F.col("side") == "out") & (F.col("rank") > c.cutoff)).join(last.select("trace_id", "span_idx"), ["trace_id", "span_idx"]).select("trace_id", "doc_id")
    cut = last.where(F.col("top_k") == c.cutoff)
    none = c.traces.join(last, "trace_id", "left_anti")
    return c.findings("ranking_failure", low.join(c.met, ["trace_id", "doc_id"], "left_semi"), None, unavailable=cut.select("trace_id").union(none.select("trace_id")))


RULES: tuple[Rule, ...] = (qrel_absent_from_corpus, source_miss, branch_specific_miss, gate_exclusion, fusion_loss, filter_loss, reranker_loss, truncation_loss, ranking_failure)


def evaluate(context: Context, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rules over all traces; further rules are functions of the context too."""
    return reduce(DataFrame.unionByName, (rule(context) for rule in rules))


def rollup(findings: DataFrame) -> DataFrame:
    """Findings by label, by availability and by both, in one pass."""
    return findings.cube("label", "availability").agg(F.count("*").alias("n"), F.sum("n_documents").alias("documents"))
