"""Quality classifier: Naive Bayes support vectors.

Texts become indicators of n-grams: words, pairs of words, and uni- to trigrams of word shapes
(letters by case, digits and signs, runs shortened), hashed to 2**``BITS`` columns. Each column is
scaled by the log of the ratio of its smoothed class frequencies, and a linear hinge-loss model is
fitted to the scaled indicators by dual coordinate descent. The margin is mapped to 0..1 by a
logistic curve fitted to the training margins.

Only texts enter the features. Training uses at most ``MAX_TRAIN`` labelled rows, the smallest by a
hash of their id (a documented bound); scoring runs over every whole text.

Defined cases: null and empty texts have no features and get the bias's score; with one class only the
score is that class's smoothed frequency, without any label 0.5; repeated rows get equal scores;
labels without a document, or null, are ignored; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.blocks import SPACE, mix, slice_hashes, text_blocks, words

BITS, MAX_TRAIN = 18, 6_000
EPOCHS, COST, SMOOTH = 12, 1.0, 1.0
#: Byte shapes: lower case a, upper case A, digits 0, bytes above ASCII like lower case; other signs stay.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[0x80:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row belongs to the fold whose labels are never used."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed columns of all rows one after the other, offsets of the rows in them)."""
    rows = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    row = np.repeat(np.arange(rows), np.diff(first))
    h = slice_hashes(data, starts, ends)
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | SPACE[data[1:]]
    total = np.append(0, np.cumsum(keep))
    keep[starts] = True
    total = np.append(0, np.cumsum(keep))
    s = slice_hashes(shape[keep], total[starts], total[ends])
    k = np.uint64(0x9E3779B97F4A7C15)
    same = row[1:] == row[:-1]
    both = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
    grams = [(h, row), (mix(h[:-1] * k + h[1:])[same], row[1:][same]), (mix(s + np.uint64(1)), row), (mix((s[:-1] + np.uint64(2)) * k + s[1:])[same], row[1:][same])]
    if len(row) > 2:
        grams.append((mix(((s[:-2] + np.uint64(3)) * k + s[1:-1]) * k + s[2:])[both], row[2:][both]))
    code = np.unique(np.concatenate([(r.astype(np.uint64) << np.uint64(BITS)) | (g >> np.uint64(64 - BITS)) for g, r in grams]))
    owner = (code >> np.uint64(BITS)).astype(np.int64)
    return (code & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(owner, np.arange(rows + 1))


class Model:
    """Scaled weights, bias and the logistic curve of the margins."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def score(self, columns: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.append(0.0, np.cumsum(self.weights[columns], dtype=np.float64))
        # Long texts have more indicators; the margin is taken per square root of their number.
        size = np.maximum(np.diff(at), 1)
        margin = (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(size) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def fit(columns: np.ndarray, at: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> Model:
    """Naive Bayes ratios, then dual coordinate descent on the L2-loss hinge over unit-length rows."""
    size, dims = np.diff(at), 1 << BITS
    y = np.where(label == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(dims), 0.0, 1.0, float(np.log(share / (1 - share))))
    owner = np.repeat(np.arange(len(y)), size)
    seen = [np.bincount(columns[y[owner] == c], minlength=dims) + SMOOTH for c in (1.0, -1.0)]
    ratio = np.log(seen[0] / ((y > 0).sum() + 2 * SMOOTH)) - np.log(seen[1] / ((y < 0).sum() + 2 * SMOOTH))
    x = ratio[columns] / np.sqrt(np.maximum(size, 1))[owner]
    square = np.bincount(owner, x * x, minlength=len(y)) + 1.0
    # Rare classes weigh as much as common ones.
    c = cost * len(y) / (2.0 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    alpha, w, bias = np.zeros(len(y)), np.zeros(dims), 0.0
    random = np.random.default_rng(3)
    for _ in range(epochs):
        for i in random.permutation(len(y)):
            lo, hi = at[i], at[i + 1]
            cols, vals = columns[lo:hi], x[lo:hi]
            slope = y[i] * (w[cols] @ vals + bias) - 1.0 + alpha[i] / (2 * c[i])
            new = max(alpha[i] - slope / (square[i] + 1 / (2 * c[i])), 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                w[cols] += step * vals
                bias += step
                alpha[i] = new
    margin = np.bincount(owner, w[columns] * x, minlength=len(y)) + bias
    slope, shift = 1.0, 0.0
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    weight = c / c.sum()
    for _ in range(200):  # Newton steps on the weighted logistic loss
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -50, 50)))
        g, d = weight * (p - target), weight * p * (1 - p) + 1e-12
        hess = np.array([[(d * margin * margin).sum() + 1e-6, (d * margin).sum()], [(d * margin).sum(), d.sum() + 1e-6]])
        move = np.linalg.solve(hess, [(g * margin).sum(), g.sum()])
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return Model(w * ratio, bias, max(slope, 1e-3), shift)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_TRAIN) -> Model:
    """The model from the labelled rows outside the held-out fold; features are made on the executors."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    joined = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, data, offsets in text_blocks(batch.column(1).to_numpy(zero_copy_only=False), batch.column(0)):
                columns, at = features(data, offsets)
                raw = columns.astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array([raw[4 * i : 4 * j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["y", "x"])

    made = joined.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "y").mapInArrow(run, "y int, x binary")
    found = made.toArrow()
    parts = [np.frombuffer(b, "<i4") for b in found["x"].to_pylist()]
    columns = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return fit(columns, np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64), found["y"].to_numpy())


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the broadcast model has 2**BITS weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, data, offsets in text_blocks(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(shared.value.score(*features(data, offsets)))], ["doc_id", "score"])

    out = docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
