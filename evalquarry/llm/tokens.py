"""Words and n-grams of whole Arrow batches as 64-bit hashes, in numpy.

A batch's texts lie in one UTF-8 buffer. Every byte is looked up in a table of
random 64-bit values, multiplied by a power of an odd base and summed up
cumulatively; the hash of a word is a difference of two sums, brought to the same
power and mixed. No Python object is made per word. Pieces of the buffer are
bounded, so a very long text costs 8 bytes a word, not 8 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
U = np.uint64


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    with np.errstate(over="ignore"):
        for step in (base, inverse):
            p = np.empty(PIECE + 1, U)
            p[0] = 1
            have = 1
            while have <= PIECE:
                take = min(have, PIECE + 1 - have)
                p[have : have + take] = p[:take] * U(pow(step, have, 1 << 64))
                have += take
            out.append(p)
    return out[0], out[1]


@lru_cache(4)
def _alphabet(fold: bool, letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(value of each byte, whether it separates words)."""
    value = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
    if fold:
        value[65:91] = value[97:123]
    apart = np.zeros(256, bool)
    if letters_only:
        apart[:128] = True
        for lo, hi in ((48, 58), (65, 91), (97, 123)):
            apart[lo:hi] = False
    else:
        apart[[0x20, *range(0x09, 0x0E)]] = True
    return value, apart


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of a run of documents in order; bounds[i]:bounds[i+1] are those of document i."""

    hashes: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), self.counts)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Document ranges whose texts have about size bytes, one document at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _piece(b: np.ndarray, cut: np.ndarray, value: np.ndarray, apart: np.ndarray):
    """Hashes, byte lengths and starts of the words of b; cut: where a new document begins."""
    sep = apart[b]
    first = ~sep
    first[1:] &= sep[:-1]
    begins = cut[cut < len(b)]
    first[begins] = ~sep[begins]
    last = ~sep
    last[:-1] &= sep[1:]
    ends = begins[begins > 0] - 1
    last[ends] = ~sep[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    powers, inverse = _powers()
    with np.errstate(over="ignore"):
        total = value[b]
        total *= powers[: len(b)]
        np.cumsum(total, out=total)
        h = total[e]
        h[1:] -= total[s[1:] - 1]
        if len(s) and s[0] > 0:
            h[0] -= total[s[0] - 1]
        h = h * inverse[s]
        n = (e - s + 1).astype(np.int64)
        return mix(h + n.astype(U) * U(0xD6E8FEB86659FD93)), n, s


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False, letters_only: bool = False) -> Words:
    """All words of the texts. fold: A-Z count as a-z. letters_only: words are runs of
    ASCII letters and digits and of all other characters beyond ASCII."""
    value, apart = _alphabet(fold, letters_only)
    base, n = int(offsets[0]), int(offsets[-1])
    hashes, lengths, starts = [], [], []
    lo = base
    carry = None
    while lo < n:
        hi = min(lo + PIECE, n)
        if hi < n:  # end at a separator or a document's end, if there is one
            seps = np.flatnonzero(apart[data[lo:hi]])
            stop = offsets[np.searchsorted(offsets, hi, "right") - 1]
            best = max(lo + int(seps[-1]) + 1 if len(seps) else lo, int(stop))
            if best > lo:
                hi = best
            else:
                carry = hi
        if carry is not None and hi == carry:  # a single word beyond a piece: hash its parts together
            end = hi
            limit = int(offsets[np.searchsorted(offsets, lo, "right")])
            while end < limit and not apart[data[end]]:
                end += 1
            h = U(len(range(lo, end)) & (2**64 - 1))
            for at in range(lo, end, PIECE):
                part, _, _ = _piece(np.where(apart[data[at : min(at + PIECE, end)]], 0, data[at : min(at + PIECE, end)]), np.zeros(1, np.int64), value, apart)
                h = mix(np.array([h ^ part[0]], U))[0]
            hashes.append(np.array([h], U))
            lengths.append(np.array([end - lo], np.int64))
            starts.append(np.array([lo], np.int64))
            lo, carry = end, None
            continue
        inside = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "left")]
        h, m, s = _piece(data[lo:hi], np.unique(np.append(inside - lo, 0)), value, apart)
        hashes.append(h)
        lengths.append(m)
        starts.append(s + lo)
        lo = hi
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    at = cat(starts, np.int64)
    return Words(cat(hashes, U), cat(lengths, np.int64), np.searchsorted(at, offsets, "left").astype(np.int64))


_ODD = [U(x) for x in (0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def grams(w: Words, k: int, whole_if_shorter: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-grams, bounds by document). A document of 1 to k-1 words has its
    whole sequence as one gram, if asked for."""
    n = len(w.hashes)
    counts = w.counts
    with np.errstate(over="ignore"):
        def combine(first: np.ndarray, size: int) -> np.ndarray:
            h = np.full(len(first), U(size * 0x9FB21C651E98DF25 & (2**64 - 1)))
            for j in range(size):
                h = h * _ODD[1] + w.hashes[first + j] * _ODD[0]
                h ^= h >> U(29)
            return mix(h)

        full = np.maximum(counts - k + 1, 0)
        out = np.where((counts > 0) & (counts < k), 1, full) if whole_if_shorter else full
        bounds = np.concatenate(([0], np.cumsum(out))).astype(np.int64)
        h = np.empty(int(bounds[-1]), U)
        long = np.flatnonzero(full)
        if len(long):
            keep = np.zeros(n + 1, np.int64)
            np.add.at(keep, w.bounds[long], 1)
            np.add.at(keep, w.bounds[long] + full[long], -1)
            first = np.flatnonzero(np.cumsum(keep[:n]) > 0)
            to = np.repeat(bounds[:-1][long] - w.bounds[:-1][long], full[long]) + first
            h[to] = combine(first, k)
        if whole_if_shorter:
            for size in range(1, k):
                short = np.flatnonzero(counts == size)
                if len(short):
                    h[bounds[short]] = combine(w.bounds[short], size)
    return h, bounds


def distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each document, and their bounds."""
    docs = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(docs[order].astype(np.int32), kind="stable")]
    h, docs = h[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])
    h, docs = h[new], docs[new]
    return h, np.searchsorted(docs, np.arange(len(bounds)), "left").astype(np.int64)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each document's values (0 if it has none)."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
        return total[bounds[1:]] - total[bounds[:-1]]
