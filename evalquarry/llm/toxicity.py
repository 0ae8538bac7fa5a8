"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows.

The lexicon is a short list of insults and the words that training labels single out.
Its trie and the edit automaton are run together as one automaton over the letters of a
word: a state is the set of trie nodes within reach and the edits spent on each; states
and transitions are made when first met and kept, so nearly every word leaves after a
few steps. A word within the edits that a term's length allows is a misspelling of it,
unless it is at home in clean training documents: one that toxic ones don't use clearly more.
States and words that a worker remembers are bounded; what falls out is worked out again,
with the same result.

Each hit is placed by a window of the words before it and by the marks of its line: in
quotation, or reported by a verb of saying, it counts apart from abuse. Logistic
regression on these sums gives the score.

The model is fitted on at most max_train labelled documents outside the held-out
fifth, the first by a hash of doc_id, each text once; everything else covers every
document and whole texts.

Defined results: null and empty texts have no hits and score below 0.5. Without
training rows of both classes the weights are those in PRIOR. A very long text is read as a
whole; marks of quotation count up to REACH characters to either side within the line. Rows
that repeat a doc_id are scored each by its own text, and train once with the highest label.
Of several terms in reach the one with the fewest edits, then the first by name, is hit. An
empty table gives an empty table. Only doc_id and text are read, so the names of
other columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.llm import common

#: Insults that need no training label, and verbs of saying.
SEEDS = "idiot moron stupid loser pathetic scum worthless trash clown disgusting imbecile dumbass".split()
SAYING = frozenset("said says say wrote writes write quoted quotes quote called calls dit disait sagt sagte schrieb dijo dice".split())
QUOTES = {"“": "”", "«": "»", "„": "“", "‘": "’"}

FEATURES = ("exact", "fuzzy", "exact_quoted", "fuzzy_quoted", "share")
PRIOR = np.array([-3.5, 4.0, 3.0, 1.0, 0.7, 1.0])  # intercept, then FEATURES
PRIOR_WEIGHT = 2.0
WORD = re.compile(r"[^\W_]+")
WINDOW = 6
REACH = 400
MEMORY = 300_000  # words that a worker remembers
STATES = 100_000  # states of the automaton that a worker keeps
LEAST_LIFT = 1.0


def allowed(term: str) -> int:
    """Edits that make a misspelling: none for terms of up to 4 letters, 1 up to 9, else 2."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Automaton:
    """Words to (term, edits): the trie of the terms run together with edit counts."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.most: list[int] = [0]  # edits allowed to some term below
        for i, term in enumerate(terms):
            node = 0
            for ch in term:
                self.most[node] = max(self.most[node], allowed(term))
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                node = self.children[node][ch]
            self.most[node] = max(self.most[node], allowed(term))
            self.ends[node] = i
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.numbers: dict[tuple, int] = {}
        self.known = 0  # transitions kept
        self.dead = self._state({})
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, reach: dict[int, int]) -> dict[int, int]:
        todo = list(reach.items())  # letters left out of the word: go on in the trie without reading
        while todo:
            node, spent = todo.pop()
            if reach.get(node, 99) < spent:
                continue
            for child in self.children[node].values():
                if spent + 1 <= self.most[child] and spent + 1 < reach.get(child, 99):
                    reach[child] = spent + 1
                    todo.append((child, spent + 1))
        return reach

    def _accepted(self, reach: Iterable[tuple[int, int]]) -> tuple[int, int] | None:
        return min(((spent, self.ends[n]) for n, spent in reach if self.ends[n] >= 0 and spent <= allowed(self.terms[self.ends[n]])), default=None)

    def _state(self, reach: dict[int, int]) -> int:
        key = tuple(sorted(reach.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.accepts.append(self._accepted(key))
        return self.numbers[key]

    def _after(self, before: Iterable[tuple[int, int]], ch: str) -> dict[int, int]:
        reach: dict[int, int] = {}

        def to(node: int, spent: int) -> None:
            if spent <= self.most[node] and spent < reach.get(node, 99):
                reach[node] = spent

        for node, spent in before:
            to(node, spent + 1)  # a letter too many
            for letter, child in self.children[node].items():
                to(child, spent + (letter != ch))
        return self._closed(reach)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term in reach. Once STATES states or as many
        transitions per letter are kept, what is not among them is worked out anew each time."""
        state, dead, steps = self.start, self.dead, self.steps
        for at, ch in enumerate(word):
            after = steps[state].get(ch)
            if after is None:
                if len(self.states) >= STATES or self.known >= 10 * STATES:
                    return self._plainly(dict(self.states[state]), word[at:])
                after = steps[state][ch] = self._state(self._after(self.states[state], ch))
                self.known += 1
            state = after
            if state == dead:
                return None
        return self.accepts[state]

    def _plainly(self, reach: dict[int, int], rest: str) -> tuple[int, int] | None:
        for ch in rest:
            reach = self._after(reach.items(), ch)
            if not reach:
                return None
        return self._accepted(reach.items())


def distance(a: str, b: str) -> int:
    """Plain edit distance, for tests."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@dataclass
class Lexicon:
    """Terms with weights in (0, 1], and words that clean documents use though a term is near."""

    weights: dict[str, float]
    blocked: frozenset[str] = frozenset()
    automaton: Automaton | None = field(default=None, repr=False)
    memory: dict[str, tuple[float, bool] | None] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "blocked": self.blocked, "automaton": None, "memory": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def look_up(self, word: str) -> tuple[float, bool] | None:
        """(weight, exact) of a word in lower case."""
        if word in self.memory:
            return self.memory[word]
        if self.automaton is None:
            self.automaton = Automaton(sorted(self.weights))
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        hit = self.automaton.match(word)
        out = None
        if hit is not None and (hit[0] == 0 or word not in self.blocked):
            out = (self.weights[self.automaton.terms[hit[1]]], hit[0] == 0)
        self.memory[word] = out
        return out

    def hits(self, text: str | None) -> tuple[list[tuple[int, int, float, bool, bool]], int]:
        """((start, end, weight, exact, quoted) of each hit, number of words)."""
        low = (text or "").lower()
        words, found, memory = WORD.findall(low), {}, self.memory
        for w in set(words):
            hit = memory[w] if w in memory else self.look_up(w)
            if hit:
                found[w] = hit
        if not found:
            return [], len(words)
        out, before = [], []
        for m in WORD.finditer(low):
            w = m.group()
            if w in found:
                out.append((m.start(), m.end(), *found[w], quoted(low, m.start(), m.end(), before)))
            before.append(w)
            if len(before) > WINDOW:
                del before[0]
        return out, len(words)


def quoted(text: str, start: int, end: int, before: list[str]) -> bool:
    """Whether the words at start:end are someone's words that the text reports."""
    left, right = text[max(0, start - REACH) : start], text[end : end + REACH]
    whole = start <= REACH or text[start - REACH - 1] == "\n"  # whether left begins where the line does
    at = left.rfind("\n")
    if at >= 0:
        left, whole = left[at + 1 :], True
    right = right.partition("\n")[0]
    if whole and left.lstrip().startswith(">"):
        return True
    if left.count('"') % 2 and '"' in right:
        return True
    if any(left.rfind(a) > left.rfind(b) and b in right for a, b in QUOTES.items()):
        return True
    return any(w in SAYING for w in before)


def features(lexicon: Lexicon, texts: pa.Array) -> tuple[np.ndarray, list]:
    x, spans = np.zeros((len(texts), len(FEATURES))), []
    for i, text in enumerate(texts):
        hits, n = lexicon.hits(text.as_py())
        spans.append(hits)
        if hits:
            for _, _, weight, exact, cited in hits:
                x[i, (0 if exact else 1) + 2 * cited] += weight
            x[i, 4] = 10 * min(1.0, x[i, :2].sum() / max(n, 1))
    x[:, :4] = np.log1p(x[:, :4])
    return x, spans


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    beta: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + x @ self.beta[1:], -700, 700)))


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
    """Newton's method for the posterior mode under a normal prior around `prior`."""
    x = np.column_stack((np.ones(len(x)), x))
    beta = prior.astype(float).copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        grad = x.T @ (y - p) - weight * (beta - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + weight * np.eye(len(beta)), grad)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return beta


def _word_counts(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = (Counter(), Counter())
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                by[label].update(set(WORD.findall((text.as_py() or "").lower())))
            words = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([by[1][w] for w in words], pa.int64()), pa.array([by[0][w] for w in words], pa.int64())], names=["word", "toxic", "clean"])

    return common.in_arrow(sample, run, "word string, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = 40_000, max_terms: int = 2_000) -> ToxicityModel:
    spark = docs.sparkSession
    common.ship(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~common.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("_class"))
    # at most max_train ids of 8 bytes are broadcast
    some = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).withColumnRenamed("doc_id", "_id"))
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(some, F.col("doc_id") == F.col("_id"))
    sample = common.stash(sample.groupBy(F.xxhash64("text").alias("_text"), F.length("text").alias("_n")).agg(F.min(F.struct("doc_id", "_class", "text")).alias("r")).select("r.text", "r._class"))
    sizes = {r["_class"]: r["count"] for r in sample.groupBy("_class").count().collect()}
    weights = dict.fromkeys(SEEDS, 1.0)
    if not (sizes.get(0) and sizes.get(1)):
        return ToxicityModel(Lexicon(weights), PRIOR)
    counts = common.stash(_word_counts(sample))
    least = max(3, sizes[1] // 1000)
    lift = F.log((F.col("toxic") + 0.1) / (sizes[1] + 1) / ((F.col("clean") + 0.1) / (sizes[0] + 1)))
    mined = counts.where((F.col("toxic") >= least) & (F.length("word") >= 3)).withColumn("lift", lift).where("lift > 3")
    for r in mined.orderBy(F.desc(F.col("lift") * F.log1p("toxic")), "word").limit(max_terms).collect():
        weights[r["word"]] = float(min(1.0, r["lift"] / 6 * min(1.0, r["toxic"] / (2 * least))))
    for r in counts.where(F.col("word").isin(SEEDS) & (F.col("clean") > 0)).withColumn("lift", lift).collect():
        weights[r["word"]] = float(min(1.0, max(0.02, r["lift"] / 6)))
    lexicon = spark.sparkContext.broadcast(Lexicon(weights))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [(h := lexicon.value.look_up(w)) is not None and not h[1] for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(hit, pa.bool_()))

    # words of a bounded sample that are near a term, and no likelier in toxic documents by LEAST_LIFT
    at_home = counts.where("clean > 0").where(lift < LEAST_LIFT).select("word")
    blocked = frozenset(r["word"] for r in common.in_arrow(at_home, near, "word string").collect())
    lexicon.destroy()
    lexicon = spark.sparkContext.broadcast(Lexicon(weights, blocked))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = features(lexicon.value, batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(v) for v in x.T)], names=["y", *FEATURES])

    rows = common.in_arrow(sample, vectors, "y int, " + ", ".join(f"{f} double" for f in FEATURES)).collect()  # max_train rows at most
    lexicon.destroy()
    m = np.array(sorted(tuple(r) for r in rows))
    common.discard(sample)
    common.discard(counts)
    return ToxicityModel(Lexicon(weights, blocked), logistic(m[:, 1:], m[:, 0], PRIOR, PRIOR_WEIGHT))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, with_spans: bool = True) -> DataFrame:
    """doc_id, score, predicted, hits (number) and spans (start, end in code points of the
    text in lower case, weight, exact, quoted) of each row of docs."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64()), ("exact", pa.bool_()), ("quoted", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, spans = features(shared.value.lexicon, batch.column(1))
            p = shared.value.score(x)
            rows = [[dict(zip(("start", "end", "weight", "exact", "quoted"), s, strict=True)) for s in hits] for hits in spans] if with_spans else [None] * len(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array([len(s) for s in spans], pa.int64()), pa.array(rows, span)], names=["doc_id", "score", "predicted", "hits", "spans"])

    schema = f"doc_id {kind}, score double, predicted int, hits bigint, spans array<struct<start:bigint,end:bigint,weight:double,exact:boolean,quoted:boolean>>"
    return common.in_arrow(docs.select("doc_id", F.col("text").cast("string")), run, schema)
