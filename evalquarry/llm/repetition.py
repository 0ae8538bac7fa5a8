"""Quality rules: repetition from suffix arrays of words.

A run of documents is one sequence of word ids, apart by document. Prefix doubling
sorts its suffixes; only suffixes that still tie are sorted again, so ordinary text is
settled after two or three rounds. The ranks of every round give the length of the
longest common prefix of neighbours in the array. Neighbours that share min_words or
more form LCP intervals; a suffix's longest interval is the longest maximal repeat
that starts there. The union of these spans is the covered part of a document.

A document fails by the method if repeats of min_words or more cover more than max_covered
of its words, or if its longest repeat has long_words or more and exceeds max_longest
of its words. min_words (4) is half the window of the base rule, so texts that go round in
phrases of four to seven words fail by the method alone; so do texts that say one passage
of 40 words twice, though no more than a tenth of them.

Defined results: a null text is empty: no words, no spans, base_failed, not kept.
Rows that repeat a doc_id are judged one by one, ties (equal texts) alike. A very long text is one
suffix array: some 100 bytes a word. An empty table gives an empty table. Only doc_id and
text are read, so the names of other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.llm import common, tokens

WINDOW = 8
SHORTEST = 4  # words of the shortest repeat that counts
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30


def suffix_ranks(ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... words of every suffix until all differ.
    ends: for each position, where its document ends."""
    n = len(ids)
    if not n:
        return [np.zeros(0, np.int64)]
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    start = np.maximum.accumulate(np.where(np.concatenate(([True], s[1:] != s[:-1])), np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    rank = rank.astype(np.int32) if n < 1 << 31 else rank  # a level is kept for each doubling
    levels, h = [rank], 1
    ties = np.concatenate((s[1:] == s[:-1], [False]))
    ties[1:] |= s[1:] == s[:-1]
    active = order[ties]
    while len(active):
        rank = levels[-1]
        after = active + h
        second = np.where(after < ends[active], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[active].astype(np.int64) * np.int64(n + 1) + second
        by = np.argsort(key)
        pos, key = active[by], key[by]
        base = rank[pos]
        m = np.arange(len(pos))
        group = np.maximum.accumulate(np.where(np.concatenate(([True], base[1:] != base[:-1])), m, 0))
        same = key[1:] == key[:-1]
        pair = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), m, 0))
        new = rank.copy()
        new[pos] = base + pair - group
        levels.append(new)
        ties = np.concatenate((same, [False]))
        ties[1:] |= same
        active = pos[ties]
        h *= 2
    return levels


def longest_repeats(levels: list[np.ndarray], ends: np.ndarray, least: int) -> np.ndarray:
    """For each suffix the longest prefix, of at least `least` words, that another
    suffix of its document shares (0: none)."""
    n = len(ends)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    array = np.empty(n, np.int64)
    array[levels[-1]] = np.arange(n)
    ranks = levels[min(least.bit_length() - 1, len(levels) - 1)]
    at = np.flatnonzero(ranks[array[1:]] == ranks[array[:-1]])
    a, b = array[at], array[at + 1]
    lcp = np.zeros(len(at), np.int64)
    for x in range(len(levels) - 1, -1, -1):
        p, q = a + lcp, b + lcp
        inside = (p < ends[a]) & (q < ends[b])
        lcp += np.where(inside & (levels[x][np.minimum(p, n - 1)] == levels[x][np.minimum(q, n - 1)]), 1 << x, 0)
    lcp[lcp < least] = 0
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best


def covered(spans: np.ndarray) -> np.ndarray:
    """Whether each position lies in one of the spans that start at i and have spans[i] words."""
    delta = np.zeros(len(spans) + 1, np.int64)
    starts = np.flatnonzero(spans)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + spans[starts], -1)
    return np.cumsum(delta[:-1]) > 0


def repeats(w: tokens.Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(longest repeat at each word, end of each word's document)."""
    docs = w.docs.astype(np.uint64)
    ends = np.repeat(w.bounds[1:], w.counts)
    with np.errstate(over="ignore"):
        ids = tokens.mix(w.hashes ^ tokens.mix(docs + np.uint64(1)))
    return longest_repeats(suffix_ranks(ids, ends), ends, least), ends


_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


_LETTER = np.array([(b & 0xC0) != 0x80 and not (b == 32 or 9 <= b <= 13) for b in range(256)])


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points in words, symbols) of each text, piece by piece of the buffer."""
    letters, symbols = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    for lo in range(0, len(data), tokens.PIECE):
        hi = min(lo + tokens.PIECE, len(data))
        a, b = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")
        cuts = np.clip(offsets[a : b + 1] - lo, 0, hi - lo)
        for out, table in ((letters, _LETTER), (symbols, _SYMBOL)):
            out[a:b] += tokens.sums(table[data[lo:hi]].astype(np.int64), cuts)
    return letters, symbols


def _duplicate_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "covered_words bigint, longest_repeat bigint, kept boolean, spans array<struct<start:bigint,length:bigint>>"
)


def repetition(docs: DataFrame, min_words: int = SHORTEST, max_covered: float = 0.3, long_words: int = 40, max_longest: float = 0.1, with_spans: bool = True) -> DataFrame:
    """doc_id and the columns of SCHEMA for each row of docs; spans are the maximal
    repeats in words from 0, none nested in another from the same start (null if not asked for)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1)
            data, offsets = tokens.utf8(texts)
            out = {k: np.zeros(batch.num_rows, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "covered_words", "longest_repeat")}
            spans: list = [None] * batch.num_rows
            out["word_chars"], out["n_symbols"] = counted(data, offsets)
            for lo, hi in tokens.runs(offsets, tokens.PIECE):
                w = tokens.words(data, offsets[lo : hi + 1])
                best, _ = repeats(w, min(min_words, WINDOW))
                out["n_words"][lo:hi] = w.counts
                windows = np.where(best >= WINDOW, WINDOW, 0)
                out["n_repeat_words"][lo:hi] = tokens.sums(covered(windows).astype(np.int64), w.bounds)
                best = np.where(best >= min_words, best, 0)
                out["covered_words"][lo:hi] = tokens.sums(covered(best).astype(np.int64), w.bounds)
                hit = np.flatnonzero(best)
                doc = np.searchsorted(w.bounds, hit, "right") - 1
                np.maximum.at(out["longest_repeat"], lo + doc, best[hit])
                if with_spans:
                    for i in range(lo, hi):
                        spans[i] = []
                    last = -1
                    for p, d, n in zip(hit.tolist(), doc.tolist(), best[hit].tolist(), strict=True):
                        if p + n > last or not spans[lo + d]:  # not inside the span before
                            spans[lo + d].append({"start": p - int(w.bounds[d]), "length": n})
                            last = p + n
            n = out["n_words"]
            failed = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED_PERCENT * n)
            bad = (out["covered_words"] > max_covered * n) | ((out["longest_repeat"] >= long_words) & (out["longest_repeat"] > max_longest * n))
            lines = [_duplicate_lines(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(out["word_chars"]), pa.array(out["n_symbols"]), pa.array(lines, pa.int64()), pa.array(out["n_repeat_words"]), pa.array(failed),
                 pa.array(out["covered_words"]), pa.array(out["longest_repeat"]), pa.array(~failed & ~bad), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "covered_words", "longest_repeat", "kept", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.in_arrow(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, {SCHEMA}")
