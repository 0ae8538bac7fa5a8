"""Line deduplication over overlapping windows of three lines.

The lines of a text are what lies between its \\n; blank lines are passed over. Each
three consecutive lines, trimmed of ASCII space, are hashed to 128 bits. A window that
occurs more than once in the whole table keeps its first occurrence, by (doc_id, line);
the lines of all later occurrences, overlapping or not, are merged and removed. Every
removed line has an equal line that comes earlier and stays, since the earliest
one is in no later occurrence.

Windows are hashed once, into a table of 28 bytes each. They meet in a grouped minimum,
summed up before the shuffle; the repeated ones are a table of their own, so that Spark can
split its join with the windows where one is very frequent. Only texts that lose lines are
shuffled, as far as a bitmap of fixed size can tell, and no stage has more than one Python
function.

Defined results: a null text stays null, a text of fewer than three lines stays as it
is. A row with a null doc_id stays as it is and makes no window. Rows that share a
doc_id count as one occurrence of what they have at the same line, and each loses what
any of them loses there. A text all of whose lines go is left as its blank lines, or empty;
the row stays. A very long text is one string in its worker, its windows leave in batches.
Ties are settled by (doc_id, line). doc_id is a whole number (it is read as bigint). An empty
table gives an empty table. lines_before and lines_removed replace columns of these names;
all other columns pass through under any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.llm import bitmaps, common

SPACE = " \t\v\f\r"
SPAN = 3
MOST = 1 << 16  # windows in a batch of results


def lines_of(text: str | None) -> tuple[list[str], list[int]]:
    """(all lines, indices of those that aren't blank)."""
    lines = (text or "").split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(SPACE)]


def windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, at (number of the window's first line among those that aren't blank), k1, k2."""
    common.ship(docs.sparkSession)

    def batch_of(ids: list, at: list, keys: list[bytes]) -> pa.RecordBatch:
        k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(at)), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], names=["doc_id", "at", "k1", "k2"])
        for x in (ids, at, keys):
            x.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda x: hashlib.blake2b(x, digest_size=16).digest()
        ids: list = []
        at: list = []
        keys: list[bytes] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines, there = lines_of(text.as_py())
                n = len(there) - span + 1
                if doc is None or n < 1:
                    continue
                each = [digest(lines[i].strip(SPACE).encode()) for i in there]
                for lo in range(0, n, MOST):
                    hi = min(lo + MOST, n)
                    keys += [digest(b"".join(each[i : i + span])) for i in range(lo, hi)]
                    ids.append(np.full(hi - lo, doc, np.int64))
                    at.append(np.arange(lo, hi, dtype=np.int32))
                    if len(keys) >= MOST:
                        yield batch_of(ids, at, keys)
        if keys:
            yield batch_of(ids, at, keys)

    return common.in_arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, "doc_id bigint, at int, k1 bigint, k2 bigint")


def later(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """A table of doc_id and the starts of its windows that occurred before, as an array."""
    found = common.stash(windows(docs, span))
    first = found.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", "f")
    first = common.stash(first)
    again = found.join(first, ["k1", "k2"]).where((F.col("doc_id") != F.col("f.doc_id")) | (F.col("at") != F.col("f.at")))
    out = common.stash(again.groupBy("doc_id").agg(F.collect_set("at").alias("starts")))
    common.discard(found)
    common.discard(first)
    return out


def cut(text: str | None, starts: list[int] | None, span: int = SPAN) -> tuple[str | None, int, int]:
    """(text without the covered lines, lines that aren't blank, lines removed)."""
    lines, there = lines_of(text)
    gone = {there[i] for s in starts or () for i in range(s, min(s + span, len(there)))}
    return ("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text), len(there), len(gone)


def dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with text cut down, and lines_before and lines_removed (which replace columns
    of these names)."""
    docs = docs.drop("lines_before", "lines_removed")
    starts = later(docs, span)
    packed = docs.sparkSession.sparkContext.broadcast(bitmaps.bitmap(starts.select("doc_id")))
    cols, names = docs.columns, [*docs.columns, "lines_before", "lines_removed"]
    at, marks = cols.index("text"), common.fresh("starts", cols)
    id_at = cols.index("doc_id")

    def marked(batch: pa.RecordBatch) -> np.ndarray:
        ids = batch.column(id_at).cast(pa.int64())
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return known & bitmaps.present(packed.value, ids.fill_null(0).to_numpy(zero_copy_only=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts_of = batch.column(len(cols)) if batch.num_columns > len(cols) else pa.nulls(batch.num_rows)
            rows = [cut(x.as_py(), s.as_py(), span) for x, s in zip(batch.column(at), starts_of, strict=True)]
            new = [batch.column(i) for i in range(len(cols))]
            new[at] = pa.array([r[0] for r in rows], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*new, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=names)

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.filter(pa.array(~marked(b))) for b in batches)

    def perhaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.filter(pa.array(marked(b))) for b in batches)

    schema = docs.withColumns({"lines_before": F.lit(0).cast("bigint"), "lines_removed": F.lit(0).cast("bigint")}).schema
    key = common.fresh("cut_id", [*cols, marks])
    starts = starts.select(F.col("doc_id").alias(key), F.col("starts").alias(marks))
    # dealt out by id, so that the two Python functions are in stages of their own however the join is done
    inside = common.in_arrow(docs, perhaps, docs.schema).withColumn(common.fresh("id", [*cols, marks, key]), F.col("doc_id").cast("bigint"))
    own = inside.columns[-1]
    inside = inside.repartition(own).join(starts, F.col(own) == F.col(key), "left").select(*(F.col(f"`{c}`") for c in cols), marks)
    return common.in_arrow(inside, run, schema).union(common.in_arrow(docs, sure, schema))
