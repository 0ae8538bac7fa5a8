"""From candidates to judged documents: chunk maps, namespaces, fingerprints."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from evalquarry.plans.shipping import ship


def document_of(cands: DataFrame, chunk_map: DataFrame) -> DataFrame:
    """Adds document: the candidate's own document_id, else its chunk's by the map
    (namespace, chunk_id, document_id), else its doc_id."""
    m = chunk_map.select("namespace", F.col("chunk_id").alias("doc_id"), F.col("document_id").alias("mapped"))
    return cands.join(m, ["namespace", "doc_id"], "left").withColumn("document", F.coalesce("document_id", "mapped", "doc_id"))


def only_namespace(chunk_map: DataFrame) -> DataFrame:
    """chunk_id and namespace of chunks that lie in one namespace alone."""
    return chunk_map.groupBy("chunk_id").agg(F.countDistinct("namespace").alias("n"), F.min("namespace").alias("namespace")).where("n = 1").drop("n")


def judged_as(docs: DataFrame, judgments: DataFrame) -> DataFrame:
    """docs: query_id, namespace, document, doc_id. Adds entity and grade: the first of the
    document, the own id and, if all judgments are in 'default', the same ids there, that the query's
    judgments (query_id, namespace, entity_id, grade) name; with none of them the document, unjudged."""
    plain = judgments.agg(F.bool_and(F.col("namespace") == "default").alias("plain"))
    out = docs.join(F.broadcast(plain), F.lit(True))
    for name, key, space in (("a", "document", "namespace"), ("b", "doc_id", "namespace"), ("c", "document", None), ("d", "doc_id", None)):
        j = judgments.select(F.col("query_id").alias("jq"), F.col("namespace").alias("jn"), F.col("entity_id").alias("je"), F.col("grade").alias(f"g_{name}"))
        same = (F.col("jn") == F.col(space)) if space else (F.col("plain") & (F.col("jn") == "default") & (F.col("namespace") != "default"))
        out = out.join(j, (F.col("jq") == F.col("query_id")) & (F.col("je") == F.col(key)) & same, "left").drop("jq", "jn", "je")
    own = F.when(F.col("g_a").isNotNull(), F.col("document")).when(F.col("g_b").isNotNull(), F.col("doc_id")).when(F.col("g_c").isNotNull(), F.col("document")).when(F.col("g_d").isNotNull(), F.col("doc_id"))
    return out.withColumn("entity", F.coalesce(own, "document")).withColumn("grade", F.coalesce("g_a", "g_b", "g_c", "g_d")).drop("g_a", "g_b", "g_c", "g_d", "plain")


def relevance(grade: Column, threshold: int = 1) -> Column:
    return F.when(grade.isNull(), "unknown").when(grade >= threshold, "relevant").otherwise("nonrelevant")


def document_view(lists: DataFrame, document: str) -> DataFrame:
    """Ranked chunks as ranked documents: the first chunk of each, ranked anew."""
    from evalquarry.operators.scoring import deduped

    return deduped(lists.select("query_id", F.col(document).alias("doc_id"), "rank"))


def fingerprint(queries: DataFrame, corpus: DataFrame, judged: DataFrame) -> DataFrame:
    """Counts, the first ten judged documents that the corpus lacks, and how sparse judgments are."""
    lost = judged.select("doc_id").distinct().join(corpus.select("doc_id"), "doc_id", "left_anti")
    parts = [
        queries.agg(F.countDistinct("query_id").alias("queries")), corpus.agg(F.countDistinct("doc_id").alias("documents")), judged.agg(F.count("*").alias("judgments")),
        lost.agg(F.count("*").alias("missing"), F.array_join(F.slice(F.array_sort(F.collect_list("doc_id")), 1, 10), ",").alias("first_missing")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))
    return out.withColumn("sparsity_pct", F.round(100.0 * (1 - F.col("judgments") / (F.col("queries") * F.col("documents"))), 4))


def content_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """One digest of all rows that doesn't depend on their order; sums of row digests, so
    no task holds all rows."""
    d = F.sha2(F.to_json(F.struct(*columns)), 256)
    part = lambda i: F.sum(F.conv(F.substring(d, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.sha2(F.concat_ws("|", part(0), part(1), part(2), F.count("*").cast("string")), 256).alias("digest"))


def in_namespace(qrels: DataFrame, chunk_map: DataFrame) -> DataFrame:
    """Judgments (query_id, doc_id, grade) placed in the namespace where the map has their entity;
    one in two namespaces is an error, one the map lacks stays in 'default'."""
    spaces = chunk_map.groupBy(F.col("chunk_id").alias("doc_id")).agg(F.countDistinct("namespace").alias("n"), F.min("namespace").alias("space"))
    wrong = F.raise_error(F.concat(F.col("doc_id"), F.lit(" is in several namespaces")))
    j = qrels.join(spaces, "doc_id", "left")
    return j.select("query_id", F.when(F.col("n") > 1, wrong).otherwise(F.coalesce("space", F.lit("default"))).alias("namespace"), F.col("doc_id").alias("entity_id"), "grade")


def listed_digest(lines: DataFrame, *order: str) -> str | None:
    """SHA-256 of the texts in line, joined by commas in this order; null lines are left out, and
    without a line there is none.

    No task holds all lines. Ranges of them are sorted and joined to blocks, an Arrow batch each,
    which are packed; one task, as the hash wants them in turn, takes the blocks in order
    and lets go of each. A sort of packed blocks can spill."""
    ship(lines.sparkSession)
    said = lines.where(F.col("line").isNotNull()).select(*order, "line")
    kinds = StructType([*said.drop("line").schema]).add("block", LongType()).add("packed", BinaryType())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            if len(batch):
                text = pc.binary_join(pa.ListArray.from_arrays([0, len(batch)], batch.column("line")), ",")[0].as_py()
                first = [batch.column(c).slice(0, 1) for c in order]  # equal keys are in one range, where the number tells them apart
                yield pa.RecordBatch.from_arrays([*first, pa.array([number], pa.int64()), pa.array([zlib.compress(text.encode(), 1)])], names=kinds.names)

    def digest(blocks: Iterable[Row]) -> Iterator[str]:
        whole, between = hashlib.sha256(), b""
        for (packed,) in blocks:
            whole.update(between)
            whole.update(zlib.decompress(packed))
            between = b","
        if between:
            yield whole.hexdigest()

    blocks = said.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, kinds)
    return next(iter(blocks.repartition(1).sortWithinPartitions(*order, "block").select("packed").rdd.mapPartitions(digest).collect()), None)
