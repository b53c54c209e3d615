"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, vectorised over a batch's bytes, words and lines. Trees
are complete binary trees of one depth, kept as flat arrays (feature, threshold per inner
node; value per leaf), so scoring a batch is ``depth`` array lookups per tree.

Defined cases: null and empty texts have all-zero statistics and get the score of those;
repeated rows get equal scores; without labels every score is 0.5; with labels of one kind
the score is that kind's smoothed share; an empty table gives an empty result; only doc_id
and text of ``docs`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestext as bt
from .cluster import fold, prepare
from .labelled import MAX_TRAINING_ROWS, sigmoid, training_rows

#: Byte classes whose share of the text is a statistic.
CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "beyond_ascii": range(128, 256),
    "stop": b".!?",
    "comma": b",;:",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+=~^_\\",
    "bracket": b"<>{}[]()",
    "slash": b"/@",
    "newline": b"\n",
    "blank": b" \t",
    "control": [*range(9), *range(14, 32), 127],
}
NAMES = ("log_bytes", "log_words", "word_length", "word_length_sd", "longest_word", "short_words", "distinct_words", "distinct_pairs", "top_word", "line_length", "distinct_lines", "words_per_stop", *CLASSES)


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many distinct values, and how often the most frequent one occurs."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    key = bt.mix(values + owner.astype(np.uint64) * bt.BASE)
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    of = owner[first]
    top = np.zeros(n)
    np.maximum.at(top, of, count)
    return np.bincount(of, minlength=n).astype(float), top


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES per text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    code, owner, starts, ends = bt.word_hashes(bt.LOWER[raw], offsets)
    words = np.bincount(owner, minlength=n).astype(float)
    some_words = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(owner, length, n) / some_words
    sd = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / some_words - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    distinct, top = _distinct(code, owner, n)
    pair = owner[1:] == owner[:-1]
    pairs, _ = _distinct((code[1:] * bt.BASE + code[:-1])[pair], owner[1:][pair], n)
    not_newline = np.ones(256, dtype=bool)
    not_newline[10] = False
    line, line_owner, line_start, line_end = bt.word_hashes(raw, offsets, not_newline)
    lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
    line_kinds, _ = _distinct(line, line_owner, n)
    shares = []
    for members in CLASSES.values():
        table = np.zeros(256, dtype=np.int64)
        table[list(members)] = 1
        total = np.concatenate([[0], np.cumsum(table[raw])])
        shares.append((total[offsets[1:]] - total[offsets[:-1]]) / some)
    stops = shares[list(CLASSES).index("stop")] * some
    columns = [np.log1p(size), np.log1p(words), mean, sd, np.log1p(longest), np.bincount(owner, length <= 3, n) / some_words, distinct / some_words, pairs / some_words, top / some_words, np.bincount(line_owner, line_end - line_start, n) / lines, line_kinds / lines, words / (stops + 1), *shares]
    out = np.stack(columns, axis=1)
    out[size == 0] = 0
    return out.astype(np.float32)


def batch_statistics(column: pa.Array) -> np.ndarray:
    raw, offsets = bt.flat(column)
    rows = [statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in bt.slices(offsets)]
    return np.concatenate(rows) if rows else np.zeros((0, len(NAMES)), np.float32)


class Trees:
    """Gradient-boosted complete trees for a 0/1 label."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 3.0):
        n, f = x.shape
        self.depth = depth
        share = (y.sum() + 1) / (len(y) + 2)
        self.prior = float(np.log(share / (1 - share)))
        inner = (1 << depth) - 1
        self.feature = np.zeros((0, inner), np.int32)
        self.threshold = np.zeros((0, inner), np.float32)
        self.value = np.zeros((0, inner + 1), np.float32)
        if len(y) < 2 or y.min() == y.max():
            return
        cuts = [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins).astype(np.float32)) for k in range(f)]
        # Values equal to a cut go left with it, as in scoring: x <= threshold.
        binned = np.stack([np.searchsorted(cuts[k], x[:, k], "left") for k in range(f)], axis=1)
        edges = np.full((f, bins), np.inf, np.float32)
        for k in range(f):
            edges[k, : len(cuts[k])] = cuts[k]
        margin = np.full(n, self.prior)
        features, thresholds, values = [], [], []
        for _ in range(trees):
            p = sigmoid(margin)
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
            for level in range(depth):
                width, base = 1 << level, (1 << level) - 1
                slot = ((node - base)[:, None] * f + np.arange(f)) * bins + binned
                shape = (width, f, bins)
                left_g = np.bincount(slot.ravel(), np.repeat(g, f), width * f * bins).reshape(shape).cumsum(2)
                left_h = np.bincount(slot.ravel(), np.repeat(h, f), width * f * bins).reshape(shape).cumsum(2)
                all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_h < least) | (right_h < least)] = 0
                best = gain.reshape(width, -1).argmax(1)
                use = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
                feature[base : base + width] = best // bins
                threshold[base : base + width] = np.where(use, edges[best // bins, best % bins], np.inf)
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
            leaf = node - inner
            value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
            margin += value[leaf]
            features.append(feature)
            thresholds.append(threshold)
            values.append(value.astype(np.float32))
        self.feature, self.threshold, self.value = np.stack(features), np.stack(thresholds), np.stack(values)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.prior)
        row = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            margin += value[node - len(feature)]
        return sigmoid(margin)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, max_rows: int = MAX_TRAINING_ROWS) -> Trees:
    """Trees learned from at most ``max_rows`` labelled documents outside the held-out fold."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = batch_statistics(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"], bt.list_column(x.ravel(), np.arange(len(x) + 1) * x.shape[1], pa.float32())], names=["doc_id", "label", "x"])

    rows = training_rows(docs, labels, label, folds, held_out, max_rows).mapInArrow(run, "doc_id long, label int, x array<float>").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    x = np.array(rows["x"].combine_chunks().flatten()).reshape(-1, len(NAMES)) if len(rows) else np.zeros((0, len(NAMES)), np.float32)
    return Trees(x[order], rows["label"].to_numpy()[order].astype(float))


def score_quality(docs: DataFrame, trees: Trees, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in batches:
            score = shared.value.score(batch_statistics(b["text"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
