"""Benchmark decontamination by greedy string tiling.

Texts are words of letters and digits in lower case. Each k consecutive words of a text
are hashed by Karp-Rabin and looked up among those of the benchmark items: these are
the seeds. Seeds that run on along one diagonal make a match; of one text and item the
longest match free of marked words is marked as a tile, again and again, until none of
k words is left. Tiles may come in any order, so reordered passages are caught. An
item is in a text if tiles cover min_coverage of the item's words.

The index of the benchmark is broadcast in blocks of at most BLOCK words, however large
the benchmark is: BLOCKS of them meet all documents in one scan, and are let go before the
next. Nothing is shuffled and no text leaves its task. Texts and items whose seeds can't
cover enough are told apart before any of their matches is built, from each text's distinct
seeds alone.

Defined results: an item of fewer than k words has no tile and is never found; null
texts are empty; null ids are carried as null. Rows that repeat an id are tested each. A very
long text is tested as a whole. Ties: of matches of one length the first in the item, then
in the text. An empty table on either side gives no row (`clean`: all of docs). Other columns
of docs pass through `clean` under any name; `contaminated` reads doc_id and text alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.llm import common, tokens

K = 5
MIN_COVERAGE = 0.5
BLOCK = 2_000_000
BLOCKS = 4  # blocks that one scan of the documents meets
MEETINGS = 1 << 21


@dataclass
class Index:
    """Words of a block of items, and where each k-gram stands among them."""

    ids: list
    bounds: np.ndarray
    seeds: np.ndarray  # sorted distinct k-gram hashes
    first: np.ndarray  # seeds[i] stands at places[first[i]:first[i+1]]
    places: np.ndarray
    there: np.ndarray  # which leading bits occur at all
    grams: np.ndarray  # the k-grams in order, those of item i at gram_bounds[i]:gram_bounds[i+1]
    gram_bounds: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[str | None], k: int) -> Index:
        w = tokens.words(*tokens.utf8(pa.array(texts, pa.string())), fold=True, letters_only=True)
        g, bounds = tokens.grams(w, k, whole_if_shorter=False)
        n = np.diff(bounds)
        place = np.arange(len(g)) + np.repeat(w.bounds[:-1] - bounds[:-1], n)
        order = np.argsort(g, kind="stable")
        seeds, first = np.unique(g[order], return_index=True)
        there = np.zeros(1 << 20, bool)
        there[(seeds >> np.uint64(44)).astype(np.int64)] = True
        return Index(ids, w.bounds, seeds, np.append(first, len(g)), place[order], there, g, bounds)

    def grams_of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted k-grams of item i, where each starts in it)."""
        own = self.grams[self.gram_bounds[i] : self.gram_bounds[i + 1]]
        order = np.argsort(own, kind="stable")
        return own[order], order


def blocks(benchmark: DataFrame, k: int) -> Iterator[Index]:
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string")).toLocalIterator():
        words = len((row[1] or "").split()) + 1
        if ids and size + words > BLOCK:
            yield Index.of(ids, texts, k)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += words
    if ids:
        yield Index.of(ids, texts, k)


def passes(spark: SparkSession, benchmark: DataFrame, k: int) -> Iterator[tuple[list, bool]]:
    """Up to BLOCKS broadcast blocks at a time, and whether more follow."""
    source = blocks(benchmark, k)
    held = list(islice(source, BLOCKS))
    while held:
        shared = [spark.sparkContext.broadcast(index) for index in held]
        held = list(islice(source, BLOCKS))
        yield shared, bool(held)


def greedy_tiles(p: np.ndarray, t: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (start in text, start in item, words) from the seeds of one text and item.
    Of matches of one length, the one that starts first in the item and then in the text comes first.

    Matches of one length and start in the item wait in one queue, of which only the first
    is up for choice: once a tile has taken their words of the item the rest are dropped
    unseen, so a passage that a text repeats costs little more than one that it has once."""
    order = np.lexsort((t, p - t))
    p, t = p[order], t[order]
    start = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 1) | (np.diff(t) != 1))))
    length = np.diff(np.append(start, len(p))) + k - 1
    p, t = p[start], t[start]
    order = np.lexsort((p, t, -length))
    p, t, length = p[order], t[order], length[order]
    cuts = np.flatnonzero(np.concatenate(([True], (np.diff(t) != 0) | (np.diff(length) != 0), [True])))
    heap = [(-int(length[i]), int(t[i]), int(p[i]), int(i + 1), int(j)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    heapq.heapify(heap)
    in_text, in_item, tiles = set(), set(), []

    def open_part(n: int, b: int) -> bool:
        run = 0
        for i in range(b, b + n):
            run = 0 if i in in_item else run + 1
            if run >= k:
                return True
        return False

    while heap:
        n, b, a, after, end = heapq.heappop(heap)
        n = -n
        free = [i for i in range(n) if a + i not in in_text and b + i not in in_item]
        if len(free) == n:
            tiles.append((a, b, n))
            in_text.update(range(a, a + n))
            in_item.update(range(b, b + n))
        else:
            lo = 0
            for i in range(1, len(free) + 1):
                if i == len(free) or free[i] != free[i - 1] + 1:
                    if i - lo >= k:
                        heapq.heappush(heap, (lo - i, b + free[lo], a + free[lo], 0, 0))
                    lo = i
        if after < end and open_part(n, b):
            heapq.heappush(heap, (-n, b, int(p[after]), after + 1, end))
    return tiles


def likely(index: Index, g: np.ndarray, bounds: np.ndarray, min_coverage: float, k: int) -> Iterator[tuple[int, int]]:
    """(text, item) where the text's seeds cover enough of the item. Seeds that a text
    repeats count once, and texts are taken together only up to MEETINGS meetings."""
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(index.there[(g >> np.uint64(44)).astype(np.int64)])
    if not len(at):
        return
    s = np.minimum(np.searchsorted(index.seeds, g[at]), len(index.seeds) - 1)
    hit = index.seeds[s] == g[at]
    pairs = np.unique(docs[at[hit]] * np.int64(len(index.seeds)) + s[hit])
    docs, s = pairs // len(index.seeds), pairs % len(index.seeds)
    sizes, starts = np.diff(index.bounds), np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, np.int64)
    each = index.first[s + 1] - index.first[s]
    ends = np.append(starts, len(docs))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(np.add.reduceat(each, starts[lo:]) if lo < len(starts) else each), MEETINGS, "right")) + lo)
        hi = min(hi, len(starts))
        a, b = int(starts[lo]), int(ends[hi])
        n = each[a:b]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = index.places[np.repeat(index.first[s[a:b]], n) + inner]
        d = np.repeat(docs[a:b], n)
        item = np.searchsorted(index.bounds, place, "right") - 1
        order = np.lexsort((place, item, d))
        d, item, place = d[order], item[order], place[order]
        new = np.concatenate(([True], (np.diff(d) != 0) | (np.diff(item) != 0)))
        # words that the seeds of one text and item cover: k each, less what neighbours share
        gap = np.minimum(np.diff(place, append=0), k)
        last = np.append(new[1:], True)
        gap[last] = k
        first = np.flatnonzero(new)
        cover = np.add.reduceat(gap, first)
        for i in first[cover >= min_coverage * sizes[item[first]]].tolist():
            yield int(d[i]), int(item[i])
        lo = hi


def found(index: Index, texts: pa.Array, k: int, min_coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, tiles, covered words, item's words) of the items that are in the texts."""
    data, offsets = tokens.utf8(texts)
    for lo, hi in tokens.runs(offsets, tokens.PIECE):
        w = tokens.words(data, offsets[lo : hi + 1], fold=True, letters_only=True)
        g, bounds = tokens.grams(w, k, whole_if_shorter=False)
        for d, i in likely(index, g, bounds, min_coverage, k):
            own, (a, b) = g[bounds[d] : bounds[d + 1]], index.bounds[i : i + 2]
            size = int(b - a)
            seeds, places = index.grams_of(i)
            at = np.minimum(np.searchsorted(seeds, own), len(seeds) - 1)
            mine = np.flatnonzero(seeds[at] == own)
            left, right = np.searchsorted(seeds, own[mine], "left"), np.searchsorted(seeds, own[mine], "right")
            n = right - left
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            tiles = greedy_tiles(np.repeat(mine, n), places[np.repeat(left, n) + inner], k)
            covered = sum(x[2] for x in tiles)
            if covered >= min_coverage * size:
                yield lo + d, i, len(tiles), covered, size


SCHEMA = "n_tiles bigint, covered_words bigint, item_words bigint, coverage double"


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, item_id and the columns of SCHEMA for each document and item that is in it."""
    spark = docs.sparkSession
    common.ship(spark)
    kinds = [docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, {SCHEMA}"
    some = docs.select("doc_id", F.col("text").cast("string"))

    def scan(shared: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for index in (x.value for x in shared):
                    rows = list(found(index, batch.column(1), k, min_coverage))
                    if rows:
                        d, i, tiles, covered, size = (list(x) for x in zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(d, pa.int64())), pa.array([index.ids[x] for x in i], pa.array(index.ids).type), pa.array(tiles, pa.int64()), pa.array(covered, pa.int64()), pa.array(size, pa.int64()),
                             pa.array([c / n for c, n in zip(covered, size, strict=True)], pa.float64())],
                            names=["doc_id", "item_id", "n_tiles", "covered_words", "item_words", "coverage"],
                        )

        return common.in_arrow(some, run, schema)

    out: DataFrame | None = None
    for shared, more in passes(spark, benchmark, k):
        one = scan(shared)
        if more or out is not None:  # the blocks of a pass are let go before the next is read
            one = common.stash(one)
            for x in shared:
                x.destroy()
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, k: int = K, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """docs without those that have an item of the benchmark in them."""
    spark = docs.sparkSession
    common.ship(spark)
    at = docs.columns.index("text")

    def without(frame: DataFrame, shared: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for index in (x.value for x in shared):
                    for row in found(index, batch.column(at), k, min_coverage):
                        keep[row[0]] = False
                yield batch.filter(pa.array(keep))

        return common.in_arrow(frame, run, frame.schema)

    out = docs
    for shared, more in passes(spark, benchmark, k):
        out = without(out, shared)
        if more:
            out = common.stash(out)
            for x in shared:
                x.destroy()
    return out
