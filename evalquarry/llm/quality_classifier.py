"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (`features`). For either class
`fit` takes mean and covariance, shrinks the covariance towards the pooled one and
its diagonal, and keeps the inverse Cholesky factor. The score is the logistic of
the difference of the two log densities (half the Mahalanobis distances and log
determinants) and log priors. Moments are summed in Spark; the driver sees one row
per class. Scoring is a column expression on the cached factors.

Defined results: a null, empty or blank text scores 0. A row without doc_id or with
a null label doesn't train; a doc_id labelled more than once counts once, with the
lower label. Without rows of both classes every other text scores 1 (nothing is
known against it). Rows that repeat a doc_id are scored each by its own text, and equal texts
score alike; all of them train. A very long text is counted in pieces and scored as a whole. An
empty table gives an empty table. `classify` reads doc_id and text alone and returns columns
of its own; `keep` returns the input's columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalquarry.llm import bitmaps, common, tokens

FEATURES = ("word_bytes", "upper", "symbols", "exclamations", "repeats", "digits", "stops", "lines", "beyond_ascii")

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>", "exclaim": b"!?", "stop": b".,;:", "newline": b"\n", "beyond": range(192, 256)}
_NAMES = [*_CLASSES, "other"]


def _kinds() -> np.ndarray:
    kind = np.full(256, len(_CLASSES), np.int64)
    for i, members in enumerate(_CLASSES.values()):
        kind[list(members)] = i
    return kind


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, matrix of FEATURES) of whole texts."""
    data, offsets = tokens.utf8(texts)
    kind, k = _kinds(), len(_NAMES)
    counts = np.zeros((len(texts), k))
    n_words, word_bytes, repeats = (np.zeros(len(texts)) for _ in range(3))
    for lo, hi in tokens.runs(offsets, tokens.PIECE):
        at = offsets[lo : hi + 1]
        w = tokens.words(data, at, fold=True)
        g, bounds = tokens.grams(w, 5)
        d, once = tokens.distinct(g, bounds)
        n_words[lo:hi], word_bytes[lo:hi] = w.counts, tokens.sums(w.lengths, w.bounds)
        repeats[lo:hi] = 1 - np.diff(once) / np.maximum(np.diff(bounds), 1)
        for piece in range(int(at[0]), int(at[-1]), tokens.PIECE):
            end = min(piece + tokens.PIECE, int(at[-1]))
            doc = np.searchsorted(at, np.arange(piece, end), "right") - 1 if hi - lo > 1 else np.zeros(end - piece, np.int64)
            counts[lo:hi] += np.bincount(doc * k + kind[data[piece:end]], minlength=(hi - lo) * k).reshape(hi - lo, k)
    c = dict(zip(_NAMES, counts.T, strict=True))
    some = np.maximum(n_words, 1)
    letters = np.maximum(c["upper"] + c["lower"] + c["beyond"], 1)
    x = np.stack([
        np.log1p(word_bytes / some), np.sqrt(c["upper"] / letters), np.log1p(50 * c["symbol"] / some),
        np.log1p(50 * c["exclaim"] / some), np.sqrt(np.where(n_words > 0, repeats, 0)), np.log1p(10 * c["digit"] / some),
        np.log1p(10 * c["stop"] / some), np.log1p(20 * c["newline"] / some), np.sqrt(c["beyond"] / letters),
    ], axis=1)
    return n_words.astype(np.int64), x


def _id_hash(doc_id: str) -> Column:
    """Alike for ids of any whole-number type."""
    return F.xxhash64(F.col(doc_id).cast("string"))


def features(docs: DataFrame, packed=None) -> DataFrame:  # noqa: ANN001
    """doc_id, n_words and FEATURES of each row of docs, or of those whose doc_id is in a
    bitmap (a broadcast variable) and few others."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if packed is not None:
                batch = batch.filter(pa.array(bitmaps.present(packed.value, batch.column(2).to_numpy(zero_copy_only=False))))
            if batch.num_rows:
                n, x = text_features(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *(pa.array(v) for v in x.T)], names=["doc_id", "n_words", *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    some = [] if packed is None else [_id_hash("doc_id")]
    return common.in_arrow(docs.select("doc_id", F.col("text").cast("string"), *some), run, schema)


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Per class: mean, inverse lower Cholesky factor, log determinant and log prior."""

    mean: dict[int, np.ndarray]
    factor: dict[int, np.ndarray]
    logdet: dict[int, float]
    logprior: dict[int, float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """log p(1|x) - log p(0|x), for tests and driver-side use."""
        side = lambda c: self.logprior[c] - 0.5 * (self.logdet[c] + (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(1))
        return side(1) - side(0)

    def log_odds_column(self) -> Column:
        def side(c: int) -> Column:
            total = F.lit(float(self.logprior[c] - 0.5 * self.logdet[c]))
            for row in self.factor[c]:
                z = None
                for j, weight in enumerate(row):
                    if weight:
                        term = F.lit(float(weight)) * (F.col(FEATURES[j]) - F.lit(float(self.mean[c][j])))
                        z = term if z is None else z + term
                total = total - F.lit(0.5) * z * z
            return total

        return side(1) - side(0)


def discriminant(n: dict[int, float], total: dict[int, np.ndarray], outer: dict[int, np.ndarray], shrinkage: float, prior_negative: float) -> QuadraticDiscriminant:
    """From each class's count, sum and sum of outer products."""
    mean = {c: total[c] / n[c] for c in n}
    scatter = {c: outer[c] / n[c] - np.outer(mean[c], mean[c]) for c in n}
    pooled = sum(n[c] * scatter[c] for c in n) / sum(n.values())
    gap = mean[1] - mean[0]
    spread = np.diag(np.maximum(np.diag(pooled) + prior_negative * (1 - prior_negative) * gap**2, 1e-6))
    factor, logdet = {}, {}
    for c in n:
        weight = max(shrinkage, 1.0 / (1.0 + n[c] / 20))
        low = np.linalg.cholesky((1 - weight) * scatter[c] + weight * spread)
        factor[c] = np.tril(np.linalg.inv(low))
        logdet[c] = 2 * float(np.log(np.diag(low)).sum())
    return QuadraticDiscriminant(mean, factor, logdet, {0: float(np.log(prior_negative)), 1: float(np.log(1 - prior_negative))})


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", shrinkage: float = 0.1, prior_negative: float | None = None) -> QuadraticDiscriminant | None:
    """stats: from features(). Trains on every labelled document outside the held-out fifth,
    whose share of label 0 is the prior unless one is given."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~common.held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label).alias("_class"))
    )
    joined = stats.where("n_words > 0").join(known, "doc_id")
    k = len(FEATURES)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = joined.groupBy("_class").agg(
        F.count("*").alias("n"), *(F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)),
        *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"m{i}_{j}") for i, j in pairs),
    ).collect()
    by = {int(r["_class"]): r for r in rows}
    if set(by) != {0, 1}:
        return None
    n = {c: float(r["n"]) for c, r in by.items()}
    total = {c: np.array([r[f"s{i}"] for i in range(k)]) for c, r in by.items()}
    outer = {}
    for c, r in by.items():
        m = np.zeros((k, k))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        outer[c] = m
    prior = (n[0] + 1) / (n[0] + n[1] + 2) if prior_negative is None else prior_negative
    return discriminant(n, total, outer, shrinkage, prior)


def score(stats: DataFrame, model: QuadraticDiscriminant | None, threshold: float = 0.3) -> DataFrame:
    """Adds score and predicted to features()."""
    if model is None:
        value = F.lit(1.0)
    else:
        odds = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), model.log_odds_column()))
        value = 1 / (1 + F.exp(-odds))
    out = stats.withColumn("score", F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(value))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, n_words, FEATURES, score and predicted of each row of docs."""
    stats = common.stash(features(docs), even=True)
    return score(stats, fit(stats, labels), threshold)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text the classifier accepts. The model is fitted on the
    statistics of all labelled documents, which a bitmap of fixed size picks out of the scan;
    then each text is judged where it is read, so that no text is shuffled and rows that
    share a doc_id are judged each by its own text."""
    common.ship(docs.sparkSession)
    labelled = labels.where(F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id"))).select(_id_hash("doc_id").alias("h"))
    packed = docs.sparkSession.sparkContext.broadcast(bitmaps.bitmap(labelled))
    model = fit(features(docs, packed), labels)
    packed.destroy()
    cols, cut = docs.columns, threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, x = text_features(batch.column(cols.index("text")))
                odds = np.full(len(n), 700.0) if model is None else np.clip(model.log_odds(x), -700, 700)
                yield batch.filter(pa.array((n > 0) & (1 / (1 + np.exp(-odds)) >= cut)))

    return common.in_arrow(docs, run, docs.schema)
