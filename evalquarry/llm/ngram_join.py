"""N-gram Jaccard self-join: rare-first prefix filtering on word shingles.

Texts are sets of distinct k-word shingles, as 64-bit hashes. Two texts link when
their Jaccard similarity is at least num/den. The way there:

1. `scan` hashes every text once: size and 128-bit fingerprint of its set, and a
   counting sketch of all shingles (of fixed size, summed by slices). Texts with equal
   sets are one class from here on; its number is its least doc_id.
2. Shingles are put in one global order, rare before frequent by the sketch. The order
   need not be exact to lose nothing: any one order will do. `entries` keeps of each
   text only its prefix, which any partner must meet.
3. `meet` joins prefixes on the shingle, in buckets of bounded size, and pairs classes
   under the length and positional filters. The prefixes are a twentieth longer than one
   common shingle asks for; so partners share a twentieth more, and classes that share less
   than that with all others together are out. Shingles that the sketch calls very
   frequent don't go there, nor do those left with more than ALL_PAIRS classes: in
   `frequent` each class meets one leader of each such shingle, verified links merge classes
   into components, and only where a shingle still spans several components do classes
   outside its largest one meet the others, until all are done. So a group of near copies
   costs in proportion to its size, and no link between components is lost.
4. `verify` decides each pair once: the suffix filter bounds the overlap by the sizes of
   the parts that fixed pivots cut the sets into, then the sorted sets are intersected.
5. `components` follows the links.

Defined results: a null or empty text has no shingles and links with nothing. A text
with fewer than k words is one shingle; a very long text is hashed in pieces and is one set.
Rows that share a doc_id are one node with the links of all of them. A row with a null
doc_id links with nothing and has component_id null. Ties: of equal sets the least doc_id stands for the class. doc_id is a
whole number (it is read as bigint). Columns beyond doc_id and text are never read, so their
names can't clash. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalquarry.llm import bitmaps, common, tokens
from evalquarry.llm.components import components

CELLS, SLICES = 1 << 20, 64
BUCKET = 300_000  # prefix entries in a bucket, on average
REDUCERS = 20_000  # partitions at most; with more buckets, a partition has several
EMIT = 1 << 18  # entries that a task gathers before it deals them out to buckets
ALL_PAIRS = 6  # classes of one shingle that are paired directly
OUTSIDERS = 32
GUESSES, GUESS_FROM = 2, 4
ASKED_SHINGLES, ASKED_BLOCKS = 1_000_000, 16
PIVOTS = 64


@dataclass(frozen=True)
class Rule:
    """Words in a shingle; link at a Jaccard similarity of num/den or more."""

    k: int = 5
    num: int = 3
    den: int = 4

    def least_overlap(self, both: np.ndarray) -> np.ndarray:
        return -(-self.num * both // (self.num + self.den))

    def prefix(self, n):  # noqa: ANN001, ANN201
        """Shingles of which partners share one at least."""
        return n - -(-self.num * n // self.den) + 1

    def support(self, n):  # noqa: ANN001, ANN201
        """Among the first prefix(n) + support(n) shingles of either of two partners they
        share 1 + support of the smaller one's size, as both only leave out so many."""
        return n // 20

    def needed(self, n):  # noqa: ANN001, ANN201
        """Shingles of that longer prefix that a text with a partner shares with others:
        the partner has num/den of its shingles at least."""
        return 1 + self.support(-(-self.num * n // self.den))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, hashes, bounds) of runs of documents; the hashes are sorted and distinct."""
    data, offsets = tokens.utf8(texts)
    for lo, hi in tokens.runs(offsets, tokens.PIECE):
        yield lo, *tokens.distinct(*tokens.grams(tokens.words(data, offsets[lo : hi + 1], fold=True), k))


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        one = tokens.sums(tokens.mix(h ^ np.uint64(0xA0761D6478BD642F)), bounds)
        two = tokens.sums(tokens.mix(h ^ np.uint64(0xE7037ED1A0B428DB)), bounds)
    return one.view(np.int64), two.view(np.int64)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def scan(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows (doc_id, n, f1, f2) of all documents and rows (slice, counts) of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, names = np.zeros(CELLS, np.int32), ["doc_id", "n", "f1", "f2", "slice", "counts"]
        for batch in batches:
            n, f1, f2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, h, bounds in shingle_sets(batch.column(1), rule.k):
                hi = lo + len(bounds) - 1
                n[lo:hi] = np.diff(bounds)
                f1[lo:hi], f2[lo:hi] = fingerprints(h, bounds)
                np.add.at(sketch, _cells(h), 1)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(f1), pa.array(f2), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        if sketch.any():
            none = pa.nulls(SLICES, pa.int64())
            parts = [x.tobytes() for x in sketch.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return common.in_arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, "doc_id bigint, n bigint, f1 bigint, f2 bigint, slice int, counts binary")


def summed(slices: DataFrame) -> np.ndarray:
    """The sketch of all documents: its slices are summed apart and only the sums, of
    CELLS numbers whatever the input, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(blob.as_buffer(), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros((SLICES, CELLS // SLICES), np.int32)
    for row in common.in_arrow(slices.select("slice", "counts").repartition(SLICES, "slice"), run, "slice int, counts binary").collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.int32)
    return out.reshape(-1)


def rare_first(h: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices that put each document's shingles in the global order (count, hash)."""
    docs = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
    order = np.argsort(counts, kind="stable")  # h is sorted within documents already
    return order[np.argsort(docs[order].astype(np.int32), kind="stable")]


_ENTRY = ["bucket", "tok", "pos", "f1", "n", "run", "hot"]
_ENTRY_SCHEMA = "bucket int, tok binary, pos binary, f1 binary, n binary, run binary, hot boolean"


def _blobs(bucket: int, hot: bool, tok: np.ndarray, pos: np.ndarray, doc: np.ndarray, f1: np.ndarray, n: np.ndarray) -> tuple:
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    run = np.diff(np.append(first, len(doc))).astype(np.uint32)
    at = doc[first]
    return bucket, tok.tobytes(), np.minimum(pos, 65535).astype(np.uint16).tobytes(), f1[at].tobytes(), n[at].astype(np.int32).tobytes(), run.tobytes(), hot


def _dealt(parts: list[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Gathered entries (tok, pos, doc, hot, f1 and n of the docs), a row for each bucket that
    has any. Of exact copies among them one is enough."""
    shift, at = [], 0
    for p in parts:
        shift.append(p[2] + at)
        at += len(p[4])
    tok, pos, hot = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
    f1, n, doc = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts]), np.concatenate(shift)
    parts.clear()
    _, first = np.unique(f1, return_index=True)
    once = np.zeros(len(f1), bool)
    once[first] = True
    mine = once[doc]
    tok, pos, doc, hot = tok[mine], pos[mine], doc[mine], hot[mine]
    b = (tokens.mix(tok) % np.uint64(buckets)).astype(np.int64)
    rows = []
    by = np.flatnonzero(~hot)
    by = by[np.argsort(b[by], kind="stable")]
    cuts = np.flatnonzero(np.concatenate(([True], b[by][1:] != b[by][:-1]))) if len(by) else by
    for x in np.split(by, cuts[1:]) if len(by) else ():
        rows.append(_blobs(int(b[x[0]]), False, tok[x], pos[x], doc[x], f1, n))
    x = np.flatnonzero(hot)
    if len(x):  # any bucket will do for these: they only pass through
        rows.append(_blobs(int(b[x[0]]), True, tok[x], pos[x], doc[x], f1, n))
    kinds = [pa.int32(), *[pa.binary()] * 5, pa.bool_()]
    for lo in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 64], strict=True), kinds, strict=True)], names=_ENTRY)


def entries(docs: DataFrame, rule: Rule, sketch, buckets: int, hot_from: int) -> DataFrame:
    """Prefix shingles of every text, packed by bucket: sketch is a broadcast variable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, parts, held = sketch.value, [], 0
        for batch in batches:
            for _, h, bounds in shingle_sets(batch.column(0), rule.k):
                n = np.diff(bounds)
                c = count[_cells(h)]
                order = rare_first(h, bounds, c)
                pos = np.arange(len(h)) - np.repeat(bounds[:-1], n)
                keep = pos < np.repeat(rule.prefix(n) + rule.support(n), n)
                pick = order[keep]
                parts.append((h[pick], pos[keep], np.repeat(np.arange(len(n)), n)[keep], c[pick] >= hot_from, fingerprints(h, bounds)[0], n))
                held += len(pick)
                if held >= EMIT:
                    yield from _dealt(parts, buckets)
                    held = 0
        if held:
            yield from _dealt(parts, buckets)

    return common.in_arrow(docs.select(F.col("text").cast("string")), run, _ENTRY_SCHEMA)


def _unpack(blobs: list[tuple]) -> tuple[np.ndarray, ...]:
    tok = np.concatenate([np.frombuffer(x[0], np.uint64) for x in blobs])
    pos = np.concatenate([np.frombuffer(x[1], np.uint16) for x in blobs]).astype(np.int64)
    run = [np.frombuffer(x[4], np.uint32) for x in blobs]
    f1 = np.concatenate([np.repeat(np.frombuffer(x[2], np.int64), r) for x, r in zip(blobs, run, strict=True)])
    n = np.concatenate([np.repeat(np.frombuffer(x[3], np.int32), r) for x, r in zip(blobs, run, strict=True)]).astype(np.int64)
    return tok, pos, f1, n


def may_link(rule: Rule, pos_a, n_a, pos_b, n_b):
    """Length filter, and positional filter for a first common shingle."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (rule.den * small >= rule.num * large) & (np.minimum(n_a - pos_a, n_b - pos_b) >= rule.least_overlap(n_a + n_b))


def paired(rule: Rule, tok: np.ndarray, pos: np.ndarray, f1: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: candidate pairs (a, b), each once; which entries are of shingles
    with more classes than ALL_PAIRS and within the prefix; and which are of shingles
    with more classes than one (both as indices)."""
    order = np.lexsort((pos, n, f1, tok))
    t, c, m, p = tok[order], f1[order], n[order], pos[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | (m[1:] != m[:-1]) | (p[1:] != p[:-1])
    order, t, c, m, p = order[new], t[new], c[new], m[new], p[new]
    starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(t)))
    shared = order[np.repeat(size > 1, size)]
    inner = p < rule.prefix(m)
    big = order[np.repeat(size > ALL_PAIRS, size) & inner]
    few = inner & np.repeat((size > 1) & (size <= ALL_PAIRS), size)
    t, c, m, p = t[few], c[few], m[few], p[few]
    starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(t)))
    found = []
    for s in np.unique(size[size > 1]):
        g = starts[size == s]
        i, j = np.triu_indices(s, 1)
        a, b = (g[:, None] + i).ravel(), (g[:, None] + j).ravel()
        ok = may_link(rule, p[a], m[a], p[b], m[b]) & (c[a] != c[b])
        found.append(np.stack([np.minimum(c[a], c[b])[ok], np.maximum(c[a], c[b])[ok]], 1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1], big, shared


def meet(packed: DataFrame, rule: Rule, buckets: int) -> DataFrame:
    """Rows (a, b): pairs of classes, by f1; rows (tok, a, n, pos) without b: entries of
    shingles with many classes, for `frequent`; and rows (g, counts): packed triples of a
    class, its size and how many of its first shingles here are shared with other classes,
    for `supported`, dealt out by class."""
    names = ["tok", "a", "b", "n", "pos", "g", "counts"]

    def out(tok, a, b, n, pos):
        none = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(x)
        for lo in range(0, len(a), 1 << 16):
            cut = lambda x: none(x).slice(lo, 1 << 16)
            m = len(cut(a))
            yield pa.RecordBatch.from_arrays([*(cut(x) for x in (tok, a, b, n, pos)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)

    def counted(f1, n):
        if not len(f1):
            return
        each, times = np.unique(np.stack([f1, n], 1), axis=0, return_counts=True)
        g = (tokens.mix(each[:, 0].copy().view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        rows = np.column_stack([each, times])[np.argsort(g, kind="stable")]
        groups, first = np.unique(np.sort(g), return_index=True)
        blobs = [x.tobytes() for x in np.split(rows, first[1:])]
        none = pa.nulls(len(groups), pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 5 + [pa.array(groups, pa.int32()), pa.array(blobs, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def settle(rows: list) -> Iterator[pa.RecordBatch]:
            tok, pos, f1, n = _unpack(rows)
            rows.clear()
            a, b, big, shared = paired(rule, tok, pos, f1, n)
            yield from counted(f1[shared], n[shared])
            yield from out(None, a, b, None, None)
            yield from out(tok[big].view(np.int64), f1[big], None, n[big], pos[big])

        for batch in batches:
            for bucket, *row, hot in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if hot:
                    tok, pos, f1, n = _unpack([row])
                    yield from counted(f1, n)
                    inner = pos < rule.prefix(n)
                    yield from out(tok[inner].view(np.int64), f1[inner], None, n[inner], pos[inner])
                    continue
                if ordered and held and bucket not in held:
                    yield from settle(held.popitem()[1])
                held.setdefault(bucket, []).append(row)
        while held:
            yield from settle(held.popitem()[1])

    ordered = buckets > REDUCERS
    dealt = packed.repartition(min(buckets, REDUCERS), "bucket")
    dealt = dealt.sortWithinPartitions("bucket") if ordered else dealt  # then a task holds one bucket at a time
    return common.in_arrow(dealt, run, "tok bigint, a bigint, b bigint, n bigint, pos bigint, g int, counts binary")


def supported(counts: DataFrame, rule: Rule, buckets: int) -> DataFrame:
    """f1 and n of the classes that share enough of their first shingles with others to have
    a partner. counts: g, counts of `meet`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3) for batch in batches for x in batch.column(1)]
        if not rows:
            return
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1))))
        total, f1, n = np.add.reduceat(rows[:, 2], first), rows[first, 0], rows[first, 1]
        ok = total >= rule.needed(n)
        yield pa.RecordBatch.from_arrays([pa.array(f1[ok]), pa.array(n[ok])], names=["f1", "n"])

    return common.in_arrow(counts.select("g", "counts").repartition(min(buckets, REDUCERS), "g"), run, "f1 bigint, n bigint")


def sets_of(docs: DataFrame, packed, rule: Rule) -> DataFrame:  # noqa: ANN001
    """rep and the sorted shingles of every document whose doc_id is in the bitmap, a
    broadcast variable. These are all classes wanted and the few that the bitmap can't tell
    from them; joins on rep leave the latter out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            batch = batch.filter(pa.array(bitmaps.present(packed.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for lo, h, bounds in shingle_sets(batch.column(1), rule.k) if batch.num_rows else ():
                blobs = [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(blobs)), pa.array(blobs, pa.binary())], names=["rep", "shingles"])

    return common.in_arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, "rep bigint, shingles binary")


def linked(rule: Rule, a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test of two sorted sets, behind the suffix filter."""
    least = int(rule.least_overlap(np.int64(len(a) + len(b))))
    if min(len(a), len(b)) < least:
        return False
    pivots = (np.arange(1, PIVOTS, dtype=np.uint64) << np.uint64(58)) if len(a) + len(b) > 64 else None
    if pivots is not None:
        parts = lambda x: np.diff(np.concatenate(([0], np.searchsorted(x, pivots), [len(x)])))
        if int(np.minimum(parts(a), parts(b)).sum()) < least:
            return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return rule.den * both >= rule.num * (len(a) + len(b) - both)


def verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of classes that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(rule, np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    side = lambda k: sets.select(F.col("rep").alias(k), F.col("shingles").alias(f"s{k}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    return common.in_arrow(full, run, "a bigint, b bigint")


def _filters(rule: Rule, x: str, y: str) -> Column:
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    least = F.ceil(rule.num * (n + m) / (rule.num + rule.den) - 1e-9)
    return (rule.den * F.least(n, m) >= rule.num * F.greatest(n, m)) & (F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos")) >= least)


class Asked:
    """A block of classes with their sets, by shingle, to be met by any other set."""

    def __init__(self, reps: list[int], sets: list[np.ndarray]) -> None:
        self.reps, self.n = np.array(reps, np.int64), np.array([len(x) for x in sets], np.int64)
        tok = np.concatenate(sets)
        order = np.argsort(tok, kind="stable")
        self.owners = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)[order]
        self.toks, self.first = np.unique(tok[order], return_index=True)
        self.first = np.append(self.first, len(tok))

    def partners(self, s: np.ndarray, rule: Rule) -> np.ndarray:
        """Which of the block's classes link with the set s, by exact overlaps."""
        at = np.minimum(np.searchsorted(self.toks, s), len(self.toks) - 1)
        at = at[self.toks[at] == s]
        both, size = np.zeros(len(self.n), np.int64), self.first[at + 1] - self.first[at]
        ends = np.cumsum(size)
        for lo in range(0, len(at), 4096):
            a, k = at[lo : lo + 4096], size[lo : lo + 4096]
            inner = np.arange(int(k.sum())) - np.repeat(ends[lo : lo + 4096] - k - (ends[lo] - size[lo]), k)
            both += np.bincount(self.owners[np.repeat(self.first[a], k) + inner], minlength=len(both))
        return self.reps[rule.den * both >= rule.num * (len(s) + self.n - both)]


def asked(sets: DataFrame, few: DataFrame, rule: Rule) -> list[DataFrame]:
    """Tables of the links (a, b) of the classes of few (rep) with all others, one for each
    block of them. A block is let go, here and on the executors, before the next is gathered."""
    spark, links = sets.sparkSession, []
    reps: list[int] = []
    held: list[np.ndarray] = []
    size = 0

    def meet_block() -> None:
        shared = spark.sparkContext.broadcast(Asked(reps, held))
        reps.clear()
        held.clear()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                pairs = [(y, x) for y, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in block.partners(np.frombuffer(blob.as_buffer(), np.uint64), rule).tolist() if x != y]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        links.append(common.stash(common.in_arrow(sets, run, "a bigint, b bigint")))
        shared.destroy()
        common.give_back()

    for row in sets.join(few, "rep").toLocalIterator():
        reps.append(row["rep"])
        held.append(np.frombuffer(row["shingles"], np.uint64))
        size += len(held[-1])
        if size >= ASKED_SHINGLES:
            meet_block()
            size = 0
    if reps:
        meet_block()
    return links


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of (x, y), one row per common shingle, the y that shares most with each x."""
    each = pairs.groupBy("x", "y").agg(F.count("*").alias("k"))
    top = each.groupBy("x").agg(F.max(F.struct("k", "y")).alias("t"))
    return top.select(F.least("x", "t.y").alias("a"), F.greatest("x", "t.y").alias("b"))


def _few(named: DataFrame, open_: DataFrame, sets: DataFrame) -> DataFrame | None:
    """The classes outside the largest component of a shingle, if their sets are small enough."""
    few = common.stash(named.join(open_.select("tok", "main"), "tok").where("c <> main").select("rep").distinct())
    size = sets.join(few, "rep").agg(F.sum(F.length("shingles"))).first()[0] or 0
    if size <= 8 * ASKED_SHINGLES * ASKED_BLOCKS:
        return few
    common.discard(few)
    return None


def frequent(hot: DataFrame, first: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Components of all links: those among `first`, pairs found elsewhere, and those
    between classes of one shingle of hot (tok, rep, n, pos).

    A shingle's largest component needs no further pair within it, so it is done once every
    class outside that component has met all classes of other components. Before that, in
    GUESSES rounds each class outside meets, for each of its shingles, a member of the
    largest component there that a hash picks; this merges most of them. If the sets of those
    still outside fit into ASKED_BLOCKS blocks, these blocks are asked against all sets: overlaps are
    counted where the sets lie and no pair is emitted for each common shingle. Where they
    are more, they meet by shingles: up to OUTSIDERS classes of one shingle at once, and of
    more a growing part leads in each round. The tables of a round are deleted at its end."""
    u = (F.xxhash64("rep").cast("double") / 2.0**64 + 0.5).alias("u")
    hot = common.stash(hot.select("tok", "rep", "n", "pos", u).distinct())
    meet_ = lambda x, y: (F.col(f"{x}.rep").alias("x"), F.col(f"{y}.rep").alias("y"))
    lead = hot.groupBy("tok").agg(F.min(F.struct("u", "rep", "n", "pos")).alias("l"))
    one = hot.alias("x").join(lead.select("tok", "l.*").alias("y"), "tok").where(F.col("x.rep") != F.col("y.rep")).where(_filters(rule, "x", "y"))
    label = components(verify(first.union(_likeliest(one.select(*meet_("x", "y")))).distinct(), sets, rule))
    done: DataFrame | None = None
    limit, guesses = OUTSIDERS, 0
    while True:
        named = hot.join(label, hot["rep"] == label["node"], "left").select("tok", "rep", "n", "pos", "u", F.coalesce("component", "rep").alias("c"))
        named = common.stash(named)
        sizes = named.groupBy("tok", "c").agg(F.count("*").alias("k"), F.min(F.struct(F.xxhash64("rep", "tok", F.lit(guesses)).alias("h"), "rep", "n", "pos")).alias("l"))
        sizes = sizes.groupBy("tok").agg(F.max(F.struct("k", "c", "l")).alias("top"), F.sum("k").alias("m"))
        open_ = sizes.select("tok", F.col("top.c").alias("main"), F.col("top.l").alias("l"), (F.col("m") - F.col("top.k")).alias("outside")).where("outside > 0")
        open_ = common.stash(open_ if done is None else open_.join(done, "tok", "left_anti"))
        biggest, tables = open_.agg(F.max("outside")).first()[0], [named, open_]
        known = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
        last = biggest is None
        if last:
            found = None
        elif guesses < GUESSES and biggest > GUESS_FROM:
            guesses += 1
            out = named.join(open_.select("tok", "main"), "tok").where("c <> main")
            found = out.alias("x").join(open_.select("tok", "l.*").alias("y"), "tok").where(_filters(rule, "x", "y"))
            found = verify(found.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct(), sets, rule)
        elif (few := _few(named, open_, sets)) is not None:
            links = asked(sets, few, rule)
            tables += [few, *links]
            found, last = reduce(DataFrame.union, links, known), True
        else:
            leads = named.join(open_, "tok").where((F.col("c") != F.col("main")) & ((F.col("outside") <= limit) | (F.col("u") * F.col("outside") < limit)))
            leads = leads.select("tok", "rep", "n", "pos", "c")
            found = named.alias("x").join(leads.alias("y"), "tok").where((F.col("x.c") != F.col("y.c")) & _filters(rule, "x", "y"))
            found = verify(found.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct(), sets, rule)
            closed = open_.where(F.col("outside") <= limit).select("tok")
            before, done = done, common.stash(closed if done is None else done.union(closed))
            tables += [before] if before is not None else []
            last = biggest <= limit
            limit *= 4
        if found is not None:
            tables.append(label)
            label = components(found.union(known))
        for t in tables:
            common.discard(t)
        if last:
            for t in (hot, done):
                if t is not None:
                    common.discard(t)
            return label


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, class_id (least doc_id with the same set) and component_id of every row."""
    spark = docs.sparkSession
    common.ship(spark)
    scanned = common.stash(scan(docs, rule), even=True)
    rows = scanned.where("slice is null").select("doc_id", "n", "f1", "f2")
    prefix = F.col("n") - F.ceil(rule.num * F.col("n") / rule.den - 1e-9) + 1 + F.floor(F.col("n") / 20)
    total = rows.where("n > 0").agg(F.sum(prefix), F.count("*"), F.sum("n")).first()
    if not total[1]:
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    sketch = spark.sparkContext.broadcast(summed(scanned.where("slice is not null")))
    buckets = max(common.partitions(spark), -(-int(total[0]) // BUCKET))
    hot_from = 500 + 8 * int(total[2]) // CELLS
    met = common.stash(meet(entries(docs, rule, sketch, buckets, hot_from), rule, buckets))
    sketch.destroy()
    classes = rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("rep is not null")
    # only classes that share enough with others can have a partner
    alive = supported(met.where("g is not null"), rule, buckets)
    wanted = common.stash(classes.join(alive, ["f1", "n"]).select("f1", "rep").distinct())
    reps = spark.sparkContext.broadcast(bitmaps.bitmap(wanted.select("rep")))
    sets = common.stash(sets_of(docs, reps, rule))  # the one copy of what verify reads in each round
    reps.destroy()
    name = wanted.select("f1", "rep")
    side = lambda k: name.select(F.col("f1").alias(k), F.col("rep").alias(f"r{k}"))
    pairs = met.where("b is not null").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    hot = met.where("tok is not null").join(side("a"), "a").select("tok", F.col("ra").alias("rep"), "n", "pos")
    label = frequent(hot, pairs, sets, rule)
    for t in (met, wanted, sets):
        common.discard(t)
    copied = classes.where("copies > 1").select("f1", "f2", "n", "rep")
    out = rows.join(copied, ["f1", "f2", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"))
    return (
        out.join(label, out["class_id"] == label["node"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """docs without those that have a near duplicate of smaller doc_id in their group.
    Texts without shingles and rows without doc_id stay. Of rows that repeat the least
    doc_id all stay."""
    gone = near_duplicates(docs, rule).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
