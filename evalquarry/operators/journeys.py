"""Document journeys: what every operator did to every candidate, and how each judged
document ended.

Evidence: cands (run_id, trace_id, query_id, span_idx, op_id, side, candidate_id, doc_id,
rank, parent_candidate_id, reason) and spans (trace_id, span_idx, op_id, parents, status,
output_capture, is_final). All queries and runs go through together, keyed by trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRACE = ["run_id", "trace_id", "query_id"]
SPAN = [*TRACE, "span_idx", "op_id"]
#: The order in which pages list outcomes.
PRIORITY = {"relevant_excluded": 0, "not_observed": 0, "insufficient_evidence": 1, "relevant_delivered": 2, "retained_below_cutoff": 3, "judged_nonrelevant": 4, "unjudged": 5}


def events(cands: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per fired span and candidate: introduced, recovered, retained, promoted,
    demoted, transformed, removed or unknown, with ranks, occurrences and reason."""
    fired = spans.where("status = 'FIRED'").select(*SPAN, (F.col("output_capture") == "recorded").alias("complete"))
    came = cands.where("side = 'in'").groupBy(*SPAN, "candidate_id").agg(
        F.min("rank").alias("input_rank"), F.count("*").alias("input_occurrences"), F.max("reason").alias("decision"), F.min("doc_id").alias("doc_in"))
    went = cands.where("side = 'out'").groupBy(*SPAN, "candidate_id").agg(F.min("rank").alias("output_rank"), F.min("doc_id").alias("doc_out"))
    child = cands.where("side = 'out' and parent_candidate_id is not null").groupBy(*SPAN, F.col("parent_candidate_id").alias("candidate_id")).agg(F.min("rank").alias("child_rank"))
    both = came.join(went, [*SPAN, "candidate_id"], "full_outer").join(child, [*SPAN, "candidate_id"], "left").join(fired, SPAN)
    there, here = F.col("input_rank").isNotNull(), F.col("output_rank").isNotNull()
    gone = ~here & F.col("child_rank").isNull() & F.col("complete")
    before = F.max(gone.cast("int")).over(Window.partitionBy(*TRACE, "candidate_id").orderBy("span_idx").rowsBetween(Window.unboundedPreceding, -1))
    kind = (
        F.when(here & ~there, F.when(F.col("before") == 1, "recovered").otherwise("introduced"))
        .when(here, F.when(F.col("output_rank") == F.col("input_rank"), "retained").when(F.col("output_rank") < F.col("input_rank"), "promoted").otherwise("demoted"))
        .when(F.col("child_rank").isNotNull(), "transformed").when(~F.col("complete"), "unknown").otherwise("removed")
    )
    reason = F.when(F.col("kind") == "removed", F.col("decision")).when(there & here & (F.col("input_occurrences") > 1), "deduplicated")
    return both.withColumn("before", before).withColumn("kind", kind).select(
        *SPAN, "candidate_id", F.coalesce("doc_out", "doc_in").alias("doc_id"), "kind", "input_rank", F.coalesce("output_rank", "child_rank").alias("output_rank"),
        F.coalesce("input_occurrences", F.lit(0)).alias("input_occurrences"), reason.alias("reason"), "complete", there.alias("input_present"), (here | F.col("child_rank").isNotNull()).alias("output_present"),
    )


def links(spans: DataFrame) -> DataFrame:
    """Distinct (run_id, op_id, parent) of the operator graph."""
    parts = F.explode(F.filter(F.split("parents", ","), lambda p: p != "")).alias("parent")
    return spans.select("run_id", "op_id", "parents").distinct().select("run_id", "op_id", parts).distinct()


def finals(spans: DataFrame) -> DataFrame:
    """Declared final operators of each run; where none is declared, those that are no one's parent."""
    ops = spans.groupBy("run_id", "op_id").agg(F.bool_or("is_final").alias("declared"))
    any_ = ops.groupBy("run_id").agg(F.bool_or("declared").alias("some"))
    parents = links(spans).select("run_id", F.col("parent").alias("op_id"), F.lit(True).alias("is_parent")).distinct()
    tagged = ops.join(any_, "run_id").join(parents, ["run_id", "op_id"], "left")
    return tagged.where(F.when(F.col("some"), F.col("declared")).otherwise(F.col("is_parent").isNull())).select("run_id", "op_id")


def ancestors(spans: DataFrame) -> DataFrame:
    """Operators on a path to a final one. The operator graphs, tens of nodes per run, come
    to the driver; the evidence doesn't."""
    up: dict[tuple[str, str], list[str]] = {}
    for r in links(spans).collect():
        up.setdefault((r["run_id"], r["op_id"]), []).append(r["parent"])
    todo = [(r["run_id"], r["op_id"]) for r in finals(spans).collect()]
    seen = set()
    while todo:
        node = todo.pop()
        if node not in seen:
            seen.add(node)
            todo += [(node[0], p) for p in up.get(node, ())]
    return spans.sparkSession.createDataFrame(sorted(seen), spans.select("run_id", "op_id").schema)


def journeys(cands: DataFrame, spans: DataFrame, qrels: DataFrame, k: int, threshold: int = 1) -> DataFrame:
    """One row per query and document that was seen or is judged relevant."""
    e = events(cands, spans)
    last = finals(spans).withColumn("final", F.lit(True))
    path = ancestors(spans).withColumn("on_path", F.lit(True))
    e = e.join(F.broadcast(last), ["run_id", "op_id"], "left").join(F.broadcast(path), ["run_id", "op_id"], "left")
    loss = F.col("on_path") & F.col("kind").isin("removed", "unknown")
    end = F.col("final") & F.col("output_present") & (F.col("kind") != "transformed")
    seq = F.struct("span_idx", "candidate_id")
    seen = e.groupBy(*TRACE, "doc_id").agg(
        F.min(F.when(end, F.struct("output_rank", "op_id"))).alias("fin"), F.max(F.when(loss, F.struct(seq.alias("seq"), F.when(F.col("kind") == "removed", F.col("op_id")).otherwise("unknown").alias("at")))).alias("loss"),
        F.bool_or(~F.col("complete")).alias("partial"), F.count("*").alias("n_events"),
    )
    traces = spans.groupBy(*TRACE).agg(
        F.bool_and(F.when(F.col("is_final"), F.col("output_capture") == "recorded").otherwise(True)).alias("final_complete"),
        F.bool_and(F.when(F.col("op_type") == "SOURCE", F.col("output_capture") == "recorded").otherwise(True)).alias("sources_complete"),
    )
    relevant = traces.join(qrels.where(F.col("grade") >= threshold), "query_id").select(*TRACE, "doc_id", F.lit(True).alias("is_relevant"))
    out = seen.join(relevant, [*TRACE, "doc_id"], "full_outer").join(traces, TRACE).join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")
    observed, rank = F.col("n_events").isNotNull(), F.col("fin.output_rank")
    judgment = F.when(F.col("grade").isNull(), "unknown").when(F.col("grade") >= threshold, "relevant").otherwise("nonrelevant")
    membership = F.when(~F.col("final_complete"), "unknown").when(rank <= k, "included").otherwise("excluded")
    out = out.select(
        *TRACE, "doc_id", "grade", judgment.alias("judgment"), observed.alias("observed"), rank.alias("final_rank"), membership.alias("membership"),
        F.when(membership == "included", F.lit(None)).when(rank.isNotNull(), F.col("fin.op_id")).when(~observed, "not_observed").otherwise(F.col("loss.at")).alias("loss_boundary"),
        F.when(observed, F.col("partial")).otherwise(~F.col("sources_complete")).alias("partial"), F.coalesce("n_events", F.lit(0)).alias("n_events"),
    )
    inside = F.col("membership") == "included"
    outcome = (
        F.when(F.col("membership") == "unknown", "insufficient_evidence")
        .when(F.col("judgment") == "nonrelevant", "judged_nonrelevant").when(F.col("judgment") != "relevant", "unjudged")
        .when(inside, "relevant_delivered").when(F.col("final_rank").isNotNull(), "retained_below_cutoff")
        .when((F.col("loss_boundary") == "unknown") | (~F.col("observed") & F.col("partial")), "insufficient_evidence")
        .when(~F.col("observed"), "not_observed").otherwise("relevant_excluded")
    )
    out = out.withColumn("outcome", outcome).withColumn("confusion", confusion(F.col("judgment"), F.col("membership")))
    level = F.when((F.col("outcome") == "relevant_excluded") & F.col("partial"), 1).otherwise(F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("outcome")))
    return out.withColumn("priority", level)


def confusion(judgment, membership):  # noqa: ANN001, ANN201
    """TP, FP, FN, TN; unknown without a judgment or without a known end."""
    inside = membership == "included"
    known = (membership != "unknown") & judgment.isin("relevant", "nonrelevant")
    return F.when(~known, "unknown").when(judgment == "relevant", F.when(inside, "TP").otherwise("FN")).otherwise(F.when(inside, "FP").otherwise("TN"))


def pair_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of pairs and events by outcome, confusion cell and end, in one pass."""
    case = lambda c, v: F.count_if(F.col(c) == v)
    relevant = F.col("judgment") == "relevant"
    aggs = [
        F.count("*").alias("pairs"), F.sum("n_events").alias("events"), *(case("outcome", o).alias(o) for o in PRIORITY), *(case("confusion", c).alias(f"cell_{c.lower()}") for c in ("TP", "FP", "FN", "TN", "unknown")),
        F.count_if(relevant & (F.col("membership") == "excluded") & F.col("observed")).alias("misses_observed"), F.count_if(relevant & ~F.col("observed")).alias("misses_never_observed"),
    ]
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def journey_summary(rows: DataFrame) -> DataFrame:
    """Per run, per query and per document at once, as grouping sets."""
    return rows.groupingSets([["run_id"], ["run_id", "query_id"], ["run_id", "doc_id"]], "run_id", "query_id", "doc_id").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("outcome") == "relevant_delivered").alias("delivered"), F.count_if(F.col("membership") == "excluded").alias("excluded"),
        F.count_if(F.col("outcome") == "not_observed").alias("not_observed"), F.count_if(F.col("outcome") == "insufficient_evidence").alias("unknown"),
    )


def stage_summary(cands: DataFrame, spans: DataFrame) -> DataFrame:
    """Per operator: queries served and skipped, candidates received, introductions,
    removals and boundaries that weren't fully captured."""
    e = events(cands, spans).groupBy("run_id", "op_id").agg(F.count_if(F.col("kind").isin("introduced", "recovered")).alias("introduced"), F.count_if(F.col("kind") == "removed").alias("removal_events"))
    got = cands.where("side = 'in'").groupBy("run_id", "op_id").agg(F.count("*").alias("candidates_received"))
    fired = F.col("status") == "FIRED"
    s = spans.groupBy("run_id", "op_id").agg(
        F.count_if(fired).alias("queries_served"), F.count_if(F.col("status") == "SKIPPED_BY_GATE").alias("queries_skipped"), F.count_if(fired & (F.col("output_capture") != "recorded")).alias("partial_boundaries"))
    return s.join(got, ["run_id", "op_id"], "left").join(e, ["run_id", "op_id"], "left").na.fill(0)


def flow(cands: DataFrame, spans: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Per operator over the relevant pairs: seen, received, put out, in the first k, removed
    and lost there, by kind of loss."""
    relevant = rows.where("judgment = 'relevant'").select(*TRACE, "doc_id", "outcome", "loss_boundary")
    e = events(cands, spans).join(relevant, [*TRACE, "doc_id"])
    top = F.col("output_present") & (F.col("output_rank") <= k)
    at = e.groupBy(*TRACE, "doc_id", "op_id", "outcome", "loss_boundary").agg(
        F.max(F.col("input_present")).alias("i"), F.max("output_present").alias("o"), F.coalesce(F.max(top), F.lit(False)).alias("t"), F.max(F.col("kind") == "removed").alias("r"))
    elsewhere = F.max(F.col("t") & (F.col("op_id") != F.coalesce("loss_boundary", F.lit("")))).over(Window.partitionBy(*TRACE, "doc_id"))
    at = at.withColumn("pushed", (F.col("outcome") == "retained_below_cutoff") & elsewhere)
    here = F.col("loss_boundary") == F.col("op_id")
    lost = lambda o, p: F.count_if(here & (F.col("outcome") == o) & ~F.col("pushed")) if p is None else F.count_if(here & F.col("pushed"))
    return at.groupBy("run_id", "op_id").agg(
        F.count("*").alias("seen"), F.count_if("i").alias("input"), F.count_if("o").alias("output"), F.count_if("t").alias("in_top_k"), F.count_if("r").alias("removed"),
        F.count_if(F.col("r") & (F.col("outcome") == "relevant_delivered")).alias("removed_but_delivered"), lost("relevant_excluded", None).alias("dropped"),
        lost("retained_below_cutoff", None).alias("ranked_low"), lost("", 1).alias("pushed_out"), lost("insufficient_evidence", None).alias("lost_unknown"),
    )


def copresence(cands: DataFrame, spans: DataFrame, rows: DataFrame) -> DataFrame:
    """How many relevant pairs one operator put out and another received."""
    relevant = rows.where("judgment = 'relevant'").select(*TRACE, "doc_id")
    e = events(cands, spans).join(relevant, [*TRACE, "doc_id"], "left_semi")
    out = e.where("output_present").select(*TRACE, "doc_id", F.col("op_id").alias("from_op")).distinct()
    got = e.where("input_present").select(*TRACE, "doc_id", F.col("op_id").alias("to_op")).distinct()
    return out.join(got, [*TRACE, "doc_id"]).where("from_op <> to_op").groupBy("run_id", "from_op", "to_op").agg(F.count("*").alias("pairs"))


CHANGES = ("lost", "gained", "membership_changed", "rank_changed", "path_changed", "unaligned", "unchanged")


def journey_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer join of two runs' journey rows by query and document, with the class of
    change; a missing row counts as a document that was not observed."""
    side = lambda df, p: df.select("query_id", "doc_id", *(F.col(c).alias(f"{p}_{c}") for c in ("membership", "final_rank", "loss_boundary", "partial")), F.lit(True).alias(f"{p}_row"))
    j = side(before, "b").join(side(after, "a"), ["query_id", "doc_id"], "full_outer")
    b_queries, a_queries = (df.select("query_id").distinct().withColumn(c, F.lit(True)) for df, c in ((before, "b_query"), (after, "a_query")))
    j = j.join(b_queries, "query_id", "left").join(a_queries, "query_id", "left")
    m = {p: F.coalesce(f"{p}_membership", F.lit("excluded")) for p in "ab"}
    at = {p: F.when(F.col(f"{p}_row"), F.coalesce(f"{p}_loss_boundary", F.lit(""))).otherwise("not_observed") for p in "ab"}
    part = {p: F.coalesce(f"{p}_partial", F.lit(False)) for p in "ab"}
    align = (
        F.when(F.col("b_query").isNull(), "missing_in_baseline").when(F.col("a_query").isNull(), "missing_in_candidate")
        .when(F.col("b_row").isNull(), "missing_in_baseline").when(F.col("a_row").isNull(), "missing_in_candidate").otherwise("aligned")
    )
    change = (
        F.when(F.col("b_query").isNull() | F.col("a_query").isNull(), "unaligned")
        .when((m["b"] == "unknown") | (m["a"] == "unknown"), F.when(m["b"] == m["a"], "unchanged").otherwise("membership_changed"))
        .when(m["b"] != m["a"], F.when(m["b"] == "included", "lost").otherwise("gained"))
        .when(m["b"] == "included", F.when(F.col("b_final_rank") != F.col("a_final_rank"), "rank_changed").otherwise("unchanged"))
        .when((at["b"] != at["a"]) | (part["b"] != part["a"]), "path_changed").otherwise("unchanged")
    )
    limited = F.lit(False)
    for p in "ab":
        limited = limited | F.coalesce((F.col(f"{p}_membership") == "unknown") | F.col(f"{p}_partial"), F.lit(False))
    return j.select("query_id", "doc_id", align.alias("alignment"), change.alias("change"), F.col("b_final_rank").alias("before_rank"), F.col("a_final_rank").alias("after_rank"), limited.alias("capture_limited"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Pairs per class of change, zero where there is none."""
    spark = diff.sparkSession
    classes = spark.createDataFrame([(c,) for c in CHANGES], "change string")
    got = diff.groupBy("change").agg(F.count("*").alias("n"), F.count_if("capture_limited").alias("limited"))
    return classes.join(got, "change", "left").na.fill(0)


def align_stages(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs the n-th invocation of an operator in one run with that in the other.
    Rows: operator_id, op_id, idx."""
    nth = F.row_number().over(Window.partitionBy("operator_id").orderBy("idx"))
    side = lambda df, p: df.withColumn("nth", nth).select("operator_id", "nth", F.col("op_id").alias(f"{p}_op"))
    j = side(before, "before").join(side(after, "after"), ["operator_id", "nth"], "full_outer")
    return j.withColumn("state", F.when(F.col("before_op").isNull(), "added").when(F.col("after_op").isNull(), "removed").otherwise("paired"))


def history_index(cands: DataFrame, spans: DataFrame, docs: DataFrame) -> DataFrame:
    """State of each document (query_id, doc_id) at every span of its query's traces."""
    def side(v: str) -> DataFrame:
        return cands.where(F.col("side") == v).groupBy("trace_id", "span_idx", "doc_id").agg(F.min("rank").alias(f"{v}_rank"))

    grid = spans.join(docs.select("query_id", "doc_id").distinct(), "query_id")
    j = grid.join(side("in"), ["trace_id", "span_idx", "doc_id"], "left").join(side("out"), ["trace_id", "span_idx", "doc_id"], "left")
    state = F.when(F.col("status") != "FIRED", "skipped").when(F.col("out_rank").isNotNull(), "emitted").when(F.col("in_rank").isNotNull(), "removed").otherwise("absent")
    return j.select("run_id", "trace_id", "query_id", "doc_id", "span_idx", "op_id", state.alias("state"), "in_rank", "out_rank")


def loss_classes(cands: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Each relevant pair: delivered; destroyed (in some operator's first k); never in the
    first k though surfaced; never surfaced."""
    up = cands.where("side = 'out'").groupBy(*TRACE, "doc_id").agg(F.bool_or(F.col("rank") <= k).alias("in_window"))
    j = rows.where("judgment = 'relevant'").join(up, [*TRACE, "doc_id"], "left")
    cls = F.when(F.col("outcome") == "relevant_delivered", "delivered").when(F.col("in_window"), "destroyed").when(F.col("in_window").isNotNull(), "never_in_window").otherwise("never_surfaced")
    return j.select(*TRACE, "doc_id", cls.alias("loss_class"))


def miss_table(rows: DataFrame) -> DataFrame:
    """Journey rows with text in the words of a table of misses, and a preview of 160 characters."""
    state = F.when(F.col("outcome") == "relevant_delivered", "survived").when(F.col("outcome") == "not_observed", "never_retrieved").when(F.col("outcome") == "insufficient_evidence", "unknown").otherwise("dropped")
    at = F.when(F.col("outcome").isin("relevant_excluded", "retained_below_cutoff"), F.col("loss_boundary"))
    preview = F.when(F.length("text") > 160, F.concat(F.left("text", F.lit(157)), F.lit("..."))).otherwise(F.col("text"))
    return rows.withColumns({"state": state, "dropped_at": at, "preview": preview})
