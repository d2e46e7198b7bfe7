"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (3 to 6 bytes of the A-Z lower-cased UTF-8 text) of a document,
hashed to ``2**BITS`` numbers. In the training rows, a feature's ratio is the logarithm of its
share among the features of toxic documents over its share among those of other documents, both
counts plus one. The ``features`` features with the largest chi-square statistic are kept; each
counts with its ratio where it is present, and logistic regression with a quadratic penalty on top of these
values gives the weights. A score is the probability of label 1.

The classifier is fitted on a bounded sample: up to ``sample`` labelled documents of each class, those
with the smallest hash of their id, so the sample of ids can be broadcast and documents need no
shuffle. Counting is a Spark job over the sampled texts; only the kept features of the sample reach the
driver. Scoring reads every whole text once, without a shuffle.

Defined cases: NULL and empty texts have no features and get the score of the intercept; repeated labels of a
document count once, as the largest; NULL labels and ids teach nothing; without rows of both classes
the score is the share of toxic training rows (0 without any). Every input row comes back. Labels,
language, source and id are not inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import arrays
from tallyloom.llm.shipping import shipped
from tallyloom.session import cut_lineage

BITS = 20
SIZES = (3, 4, 5, 6)
# Bytes of text handled at once: each has a few dozen bytes of places, hashes and keys for each size of n-gram.
CHUNK = arrays.CHUNK // 8
# Counts that go back to Spark at once; it holds a whole batch outside its heap.
ROWS = 1 << 16
_U = np.uint64


def gram_places(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all n-grams of one size, and where each starts; none crosses documents."""
    if len(data) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = arrays.prefix_hashes(data)
    n = len(data) - size + 1
    hashes = (sums[size:] - sums[:n]) * arrays.inverse_powers(len(sums))[:n]
    hashes = (hashes ^ (hashes >> _U(32))) * arrays.MULTIPLIER + _U(size)
    ok = np.ones(len(data) + size, bool)
    for cut in offsets[1:]:
        ok[max(cut - size + 1, 0):cut] = False
    at = np.flatnonzero(ok[:n])
    return (hashes[at] >> _U(64 - BITS)).astype(np.int64), at


def present(texts: pa.Array, wanted: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, rows, row, feature)``: the distinct features of each document, of all or the wanted ones."""
    for row, data, offsets in arrays.chunks(texts, CHUNK):
        data = arrays.LOWER[data]
        keys = []
        for size in SIZES:
            features, at = gram_places(data, offsets, size)
            if wanted is not None:
                chosen = wanted[features]
                features, at = features[chosen], at[chosen]
            keys.append(((np.searchsorted(offsets, at, "right") - 1) << BITS) + features)
        keys = np.unique(np.concatenate(keys))
        yield row, len(offsets) - 1, keys >> BITS, keys & ((1 << BITS) - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, _, rows, features in present(batch.column(0), None):
            for label in (0, 1):
                counts[label] += np.bincount(features[toxic[row + rows] == label], minlength=1 << BITS)
    used = np.flatnonzero(counts.any(axis=0))
    for first in range(0, len(used), ROWS):
        own = used[first:first + ROWS]
        yield pa.record_batch([pa.array(own), pa.array(counts[1][own]), pa.array(counts[0][own])], names=["feature", "yes", "no"])


def _kept_features(wanted: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, rows, features in present(batch.column(0), wanted):
                ends = np.searchsorted(rows, np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(features, pa.int32()))
                yield pa.record_batch([batch.column(1).slice(row, n), lists], names=["toxic", "features"])
    return run


def fit_logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int,
                 penalty: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent on the mean log loss; both classes weigh the same."""
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    square = np.bincount(rows, values * values, len(y))
    step = 1.0 / (0.25 * (weight * (square + 1)).sum() + penalty)
    w = np.zeros(width + 1)
    ahead, momentum = w.copy(), 1.0
    for _ in range(rounds):
        margin = np.bincount(rows, values * ahead[columns], len(y)) + ahead[-1]
        slope = weight * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y)
        gradient = np.append(np.bincount(columns, values * slope[rows], width) + penalty * ahead[:-1], slope.sum())
        nxt = ahead - step * gradient
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = nxt + (momentum - 1) / following * (nxt - w)
        w, momentum = nxt, following
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 4000, penalty: float = 1e-4,
          text_column: str = "text") -> tuple[np.ndarray, float]:
    """Weight of every hashed feature, and the intercept, from labelled rows that are not held out."""
    own = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .where(~held_out(F.col("doc_id"))))
    drawn = [own.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for label in (0, 1)]
    drawn = cut_lineage(drawn[0].unionByName(drawn[1]).select(F.col("doc_id").alias("_drawn"), F.col("toxic").alias("_toxic")))
    texts = cut_lineage(documents.join(F.broadcast(drawn), F.col("doc_id") == F.col("_drawn")).select(
        F.col(text_column).alias("text"), F.col("_toxic").cast("long").alias("toxic")))
    sizes = texts.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    weights = np.zeros(1 << BITS, np.float32)
    if not all(sizes):
        share = sizes[0] / max(sum(sizes), 1)
        return weights, float(np.log(share / (1 - share)) if 0 < share < 1 else 50.0 * (2 * share - 1))
    yes, no, n, m = F.col("yes"), F.col("no"), sizes[0], sizes[1]
    counts = texts.mapInArrow(_counts, "feature long, yes long, no long").groupBy("feature").agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    counts = cut_lineage(counts)
    total_yes, total_no, kinds = counts.agg(F.sum("yes"), F.sum("no"), F.count(F.lit(1))).first()
    ratio = F.log((yes + 1) / F.lit(float((total_yes or 0) + kinds))) - F.log((no + 1) / F.lit(float((total_no or 0) + kinds)))
    off = yes * float(m) - no * float(n)
    chi = off * off / ((yes + no) * (n + m - yes - no + 1.0))
    best = counts.select("feature", ratio.alias("ratio"), chi.alias("chi")).orderBy(F.col("chi").desc(), "feature").limit(features)
    chosen = best.select("feature", "ratio").toPandas()  # at most ``features`` rows
    if not len(chosen):
        return weights, float(np.log(n / m))
    ids, ratios = chosen["feature"].to_numpy(), chosen["ratio"].to_numpy()
    wanted = np.zeros(1 << BITS, bool)
    wanted[ids] = True
    rows = texts.mapInArrow(_kept_features(wanted), "toxic long, features array<int>").toArrow()
    rows = rows.combine_chunks()
    y = rows["toxic"].to_numpy()
    lists = rows["features"].combine_chunks() if isinstance(rows["features"], pa.ChunkedArray) else rows["features"]
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
    place = np.zeros(1 << BITS, np.int64)
    place[ids] = np.arange(len(ids))
    w, intercept = fit_logistic(row, place[flat], ratios[place[flat]], y, len(ids), penalty)
    weights[ids] = w * ratios
    return weights, intercept


def _scores(weights: np.ndarray, intercept: float, text: str) -> Callable:
    """Adds ``_score``, from the column ``text``; the column ``_text`` is not returned."""
    wanted = weights != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [name for name in batch.schema.names if name != "_text"]
            for row, n, rows, features in present(batch.column(text), wanted):
                margin = np.bincount(rows, weights[features], n) + intercept
                score = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
                others = [batch.column(name).slice(row, n) for name in names]
                yield pa.record_batch([*others, pa.array(score)], names=[*names, "_score"])
    return run


def score_toxicity(documents: DataFrame, labels: DataFrame, text_column: str = "text", keep: list[str] | None = None,
                   score_column: str = "score", **training) -> DataFrame:
    """The columns ``keep`` (all by default) of every document with ``score_column``; see ``train`` for the rest."""
    weights, intercept = train(shipped(documents), labels, text_column=text_column, **training)
    keep = documents.columns if keep is None else keep
    # A text that is kept goes to Python once, as it is.
    text = f"_{keep.index(text_column)}" if text_column in keep else "_text"
    own = documents.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), *([] if text_column in keep else [F.col(text_column).alias("_text")]))
    schema = ", ".join([f"_{i} {own.schema[f'_{i}'].dataType.simpleString()}" for i in range(len(keep))] + ["_score double"])
    scored = own.mapInArrow(_scores(weights, intercept, text), schema)
    return scored.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), F.col("_score").alias(score_column))
