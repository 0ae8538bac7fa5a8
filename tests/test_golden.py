"""A hybrid run worked out by hand: stage counts, document outcomes and chunk journeys."""

import pytest

from evalquarry.operators import diagnostics as D
from evalquarry.operators import journeys as J

#: The operators, lists, judgments and expected tables of the scenario that FIXTURES.md describes.
OPS = [("dense", "SOURCE", ""), ("lexical", "SOURCE", ""), ("recency_filter", "FILTER", "lexical"), ("rerank@dense", "RERANK", "dense"), ("rerank@lexical", "RERANK", "recency_filter"),
       ("fuse", "FUSE", "rerank@dense,rerank@lexical"), ("expand_gate", "GATE", "fuse"), ("expand", "EXPAND", "expand_gate"), ("select", "TRANSFORM", "expand_gate,expand")]
P1, P2, FAQ, LEGAL, NEWS, G1, G2, K1, T1 = "kb:doc-policy/1", "kb:doc-policy/2", "kb:doc-faq/1", "kb:doc-legal/1", "kb:doc-news/1", "kb:doc-guide/1", "kb:doc-guide/2", "kb:doc-1/1", "tickets:doc-1/1"
#: Per query: (operator, inputs by parent, outputs, reasons of what goes).
RUN = {
    "q-refund": [
        ("dense", {}, [P1, G1, FAQ], {}), ("lexical", {}, [P1, NEWS, FAQ, LEGAL, P2], {}),
        ("recency_filter", {"lexical": [P1, NEWS, FAQ, LEGAL, P2]}, [FAQ, LEGAL, P2], {NEWS: "stale_year", P1: "min_score"}),
        ("rerank@dense", {"dense": [P1, G1, FAQ]}, [P1, FAQ, G1], {}), ("rerank@lexical", {"recency_filter": [FAQ, LEGAL, P2]}, [FAQ, P2, LEGAL], {}),
        ("fuse", {"rerank@dense": [P1, FAQ, G1], "rerank@lexical": [FAQ, P2, LEGAL]}, [FAQ, P1, P2, G1, LEGAL], {}), ("expand_gate", {"fuse": [FAQ, P1, P2, G1, LEGAL]}, [FAQ, P1, P2, G1, LEGAL], {}),
        ("select", {"expand_gate": [FAQ, P1, P2, G1, LEGAL]}, [FAQ, P1, G1, LEGAL], {P2: "duplicate_document"}),
    ],
    "q-outage": [
        ("dense", {}, [FAQ, NEWS], {}), ("lexical", {}, [G1, FAQ, NEWS], {}), ("recency_filter", {"lexical": [G1, FAQ, NEWS]}, [G1, FAQ], {NEWS: "stale_year"}), ("rerank@dense", {"dense": [FAQ, NEWS]}, [FAQ, NEWS], {}),
        ("rerank@lexical", {"recency_filter": [G1, FAQ]}, [G1], {}), ("fuse", {"rerank@dense": [FAQ, NEWS], "rerank@lexical": [G1, FAQ]}, [FAQ, G1, NEWS], {}),
        ("expand_gate", {"fuse": [FAQ, G1, NEWS]}, [FAQ, G1, NEWS], {}), ("select", {"expand_gate": [FAQ, G1, NEWS]}, [FAQ, G1, NEWS], {}),
    ],
    "q-invoice": [
        ("dense", {}, [G1, K1, T1], {}), ("lexical", {}, [G2, T1], {}), ("recency_filter", {"lexical": [G2, T1]}, [T1], {G2: "min_score"}), ("rerank@dense", {"dense": [G1, K1, T1]}, [T1, G1, K1], {}),
        ("rerank@lexical", {"recency_filter": [T1]}, [T1], {}), ("fuse", {"rerank@dense": [T1, G1, K1], "rerank@lexical": [T1]}, [T1, G1, K1], {}), ("expand_gate", {"fuse": [T1, G1, K1]}, [T1, G1, K1], {}),
        ("expand", {"expand_gate": [T1, G1, K1]}, [T1, G1, K1, G2], {}), ("select", {"expand": [T1, G1, K1, G2]}, [T1, G1, K1], {G2: "duplicate_document"}),
    ],
}
JUDGED = {"q-refund": {"kb:doc-policy": 2, "kb:doc-faq": 1, "kb:doc-legal": 0}, "q-outage": {"kb:doc-guide": 1, "kb:doc-faq": 0}, "q-invoice": {"kb:doc-guide": 1, "kb:doc-archive": 1, "tickets:doc-1": 2, "kb:doc-1": 0}}


@pytest.fixture(scope="module")
def run(spark):
    number = {op: i for i, (op, _, _) in enumerate(OPS)}
    cands, spans = [], []
    for q, steps in RUN.items():
        fired = {s[0] for s in steps}
        for op, kind, parents in OPS:
            cut = (q, op) == ("q-outage", "rerank@lexical")
            spans.append(("r", q, q, number[op], op, kind, parents, None, "FIRED" if op in fired else "SKIPPED_BY_GATE", "truncated" if cut else "recorded", op == "select", 1.0, None))
        for op, inputs, outputs, reasons in steps:
            for parent, items in inputs.items():
                cands += [("r", q, q, number[op], op, "in", parent, c, c.rsplit("/", 1)[0], i + 1, 1.0, None, reasons.get(c)) for i, c in enumerate(items)]
            cands += [("r", q, q, number[op], op, "out", None, c, c.rsplit("/", 1)[0], i + 1, 1.0, None, None) for i, c in enumerate(outputs)]
    head = "run_id string, trace_id string, query_id string, span_idx int, op_id string, "
    c = spark.createDataFrame(cands, head + "side string, parent_op_id string, candidate_id string, doc_id string, rank int, score double, parent_candidate_id string, reason string").cache()
    s = spark.createDataFrame(spans, head + "op_type string, parents string, top_k int, status string, output_capture string, is_final boolean, latency_ms double, route string").cache()
    q = spark.createDataFrame([(a, d, g) for a, ds in JUDGED.items() for d, g in ds.items()], "query_id string, doc_id string, grade int")
    return c, s, q


def test_stage_counts(run):
    c, s, _ = run
    names = ("queries_served", "queries_skipped", "candidates_received", "removal_events", "introduced", "partial_boundaries")
    got = {r["op_id"]: tuple(r[n] for n in names) for r in J.stage_summary(c, s).collect()}
    assert got == {
        "dense": (3, 0, 0, 0, 8, 0), "lexical": (3, 0, 0, 0, 10, 0), "recency_filter": (3, 0, 10, 4, 0, 0), "rerank@dense": (3, 0, 8, 0, 0, 0), "rerank@lexical": (3, 0, 6, 0, 0, 1),
        "fuse": (3, 0, 14, 0, 0, 0), "expand_gate": (3, 0, 11, 0, 0, 0), "expand": (1, 2, 3, 0, 1, 0), "select": (3, 0, 12, 2, 0, 0),
    }


def test_document_outcomes(run):
    rows = {(r["query_id"], r["doc_id"]): (r["judgment"], r["final_rank"], r["confusion"], r["partial"], r["loss_boundary"]) for r in J.journeys(*run, k=3).collect()}
    want = {
        ("q-refund", "kb:doc-faq"): ("relevant", 1, "TP", False, None), ("q-refund", "kb:doc-policy"): ("relevant", 2, "TP", False, None), ("q-refund", "kb:doc-guide"): ("unknown", 3, "unknown", False, None),
        ("q-refund", "kb:doc-legal"): ("nonrelevant", 4, "TN", False, "select"), ("q-outage", "kb:doc-faq"): ("nonrelevant", 1, "FP", True, None), ("q-outage", "kb:doc-guide"): ("relevant", 2, "TP", True, None),
        ("q-outage", "kb:doc-news"): ("unknown", 3, "unknown", False, None), ("q-invoice", "tickets:doc-1"): ("relevant", 1, "TP", False, None), ("q-invoice", "kb:doc-guide"): ("relevant", 2, "TP", False, None),
        ("q-invoice", "kb:doc-1"): ("nonrelevant", 3, "FP", False, None), ("q-invoice", "kb:doc-archive"): ("relevant", None, "FN", False, "not_observed"),
    }
    assert {k: rows[k] for k in want} == want


def test_chunk_journeys(run):
    c, s, _ = run
    path = {}
    for r in J.events(c, s).orderBy("span_idx").collect():
        path.setdefault((r["query_id"], r["candidate_id"]), []).append((r["op_id"], r["kind"], r["output_rank"], r["reason"]))
    assert path["q-refund", P2] == [("lexical", "introduced", 5, None), ("recency_filter", "promoted", 3, None), ("rerank@lexical", "promoted", 2, None), ("fuse", "demoted", 3, None), ("expand_gate", "retained", 3, None), ("select", "removed", None, "duplicate_document")]
    assert path["q-invoice", G2] == [("lexical", "introduced", 1, None), ("recency_filter", "removed", None, "min_score"), ("expand", "recovered", 4, None), ("select", "removed", None, "duplicate_document")]
    assert ("rerank@lexical", "unknown", None, None) in path["q-outage", FAQ]
    assert any(e[0] == "fuse" and e[3] == "deduplicated" for e in path["q-refund", FAQ])


def test_diagnostics(run, spark):
    corpus = spark.createDataFrame([(d,) for ds in JUDGED.values() for d in ds if d != "kb:doc-archive"], "doc_id string").distinct()
    got = {(r["trace_id"], r["label"]): r["availability"] for r in D.evaluate(D.Context(*run, corpus, cutoff=3)).collect()}
    assert got["q-invoice", "qrel_absent_from_corpus"] == "supported" and got["q-refund", "qrel_absent_from_corpus"] == "not_observed"
    assert got["q-invoice", "source_miss"] == "supported" and got["q-outage", "source_miss"] == "unavailable"
    assert got["q-refund", "filter_loss"] == "not_observed" and got["q-refund", "gate_exclusion"] == "limited" and got["q-outage", "branch_specific_miss"] == "supported"
