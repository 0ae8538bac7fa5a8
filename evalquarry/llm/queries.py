"""The registered queries of this subpackage: thin views of the operators' results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.llm import common, decontaminate, licenses, line_dedup, mixing, ngram_join, pii, quality_classifier, repetition, toxicity, warc


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    scored = quality_classifier.classify(docs, labels, threshold=0.3)
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.repetition(common.table(spark, sf_dir, "documents"), with_spans=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "class_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.table(spark, sf_dir, "documents"))


def op5_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_folder(spark)}/evalquarry/warc-{uuid.uuid4().hex}"
    warc.write(common.table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op9_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), threshold=0.5, with_spans=False)
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "hits")


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_before", "lines_removed", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_suffix_array_repetition, op3_ngram_jaccard_join, op4_license_scan, op5_entropy_balanced_mix,
        op6_warc_dictionary, op7_greedy_string_tiling, op8_weak_supervision_pii, op9_levenshtein_toxicity, op10_line_windows,
    )
}

_OP6 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
bits AS (SELECT page_id, html, h, string_agg(CASE substr(h, CAST(i AS INT), 1)
    WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111'
    WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'A' THEN '1010' WHEN 'B' THEN '1011' WHEN 'C' THEN '1100' WHEN 'D' THEN '1101' WHEN 'E' THEN '1110' ELSE '1111' END, '' ORDER BY i) AS b
  FROM p, range(1, 41) r(i) GROUP BY ALL),
d AS (SELECT page_id, html, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(b, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * k + 2, 1) AS INT)
    + 4 * CAST(substr(b, 5 * k + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * k + 4, 1) AS INT) + CAST(substr(b, 5 * k + 5, 1) AS INT) AS INT), 1), '' ORDER BY k) AS payload_digest
  FROM (SELECT *, CAST(i AS INT) AS k FROM bits, range(32) r(i)) GROUP BY page_id, html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS m FROM d)"""

_OP10 = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
nb AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos
  FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
w AS (SELECT doc_id, pos, t, lead(t, 1) OVER d AS t2, lead(t, 2) OVER d AS t3 FROM nb WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
again AS (SELECT doc_id, pos FROM w WHERE t3 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t, t2, t3 ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM again, range(3) r(k)),
hit AS (SELECT nb.doc_id, nb.i FROM nb JOIN gone USING (doc_id, pos)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN hit ON l.doc_id = hit.doc_id AND l.i = hit.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS lines_before, coalesce(h.n, 0) AS lines_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM nb GROUP BY 1) n ON d.doc_id = n.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM hit GROUP BY 1) h ON d.doc_id = h.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": licenses.duckdb_sql(),
    "op6_warc_dictionary": _OP6,
    "op10_line_windows": _OP10,
}
