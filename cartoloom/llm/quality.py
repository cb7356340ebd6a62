"""Document quality by ordinal cumulative-link regression on graded ratings.

Hashed text features share one weight vector; grades differ only in ordered thresholds:
``P(grade <= k) = sigmoid(threshold_k - w . x)``. Summing the tail probabilities gives the expected
grade, and the tail at a chosen grade selects documents.

Features are hashed tokens of four kinds: words, word shapes (runs of lower case, upper case, digits
and marks), pairs of neighbouring shapes, and repeats of the previous word. Each kind is weighted by
the square root of its share of the document's tokens, so length alone does not move a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear_fit import held_out, minimise, sigmoid, training_sample
from .textbytes import LOWER, Texts, mix, prefix_hash, slices, span_hash
from .workers import lean

BITS, SELECTED = 18, 2000
PER_GRADE = 4000
TAIL = 0.5
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")


def features(texts: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of all documents end to end, their values, and the bounds of each document."""
    starts, ends, first = texts.words()
    n = len(starts)
    words = mix(span_hash(prefix_hash(LOWER[texts.data]), starts, ends))
    kinds = _CLASS[texts.data]
    fresh = np.ones(len(kinds), bool)
    fresh[1:] = kinds[1:] != kinds[:-1]
    fresh[starts] = True
    place = np.concatenate([[0], np.cumsum(fresh)])
    shapes = mix(span_hash(prefix_hash(kinds[fresh]), place[starts], place[ends]))
    opens = np.zeros(n, bool)
    opens[first[:-1][first[:-1] < n]] = True
    before = np.zeros(n, np.uint64)
    before[1:] = shapes[:-1]
    before[opens] = 1
    again = np.zeros(n, bool)
    again[1:] = words[1:] == words[:-1]
    again[opens] = False
    tokens = np.stack([words, mix(shapes + np.uint64(11)), mix(shapes * np.uint64(31) + before), mix(again.astype(np.uint64) + np.uint64(77))], 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    size = np.diff(first)
    key = (np.repeat(doc, 4).astype(np.uint64) << np.uint64(bits)) | (tokens.ravel() >> np.uint64(64 - bits))
    key, count = np.unique(key, return_counts=True)
    of = (key >> np.uint64(bits)).astype(np.int64)
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), np.sqrt(count / np.maximum(size[of], 1)), np.searchsorted(of, np.arange(len(texts) + 1))


def _sums(bits: int, grades: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, count = np.zeros((len(grades), 1 << bits), np.float32), np.zeros(1 << bits, np.float32), np.zeros(len(grades), np.int64)
        for texts in slices(batches):
            labels = np.searchsorted(grades, texts.rows.column(texts.rows.schema.get_field_index("label")).to_numpy())
            at, value, bounds = features(texts, bits)
            for i, g in enumerate(labels):
                own = slice(bounds[i], bounds[i + 1])
                total[g, at[own]] += value[own]
                squares[at[own]] += value[own] ** 2
                count[g] += 1
        if count.sum():
            at = np.flatnonzero(squares)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.uint32), total[:, at], squares[at], count)], ["at", "total", "squares", "count"])

    return run


def _chosen(bits: int, selected: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(1 << bits, -1, np.int32)
        slot[selected] = np.arange(len(selected))
        for texts in slices(batches):
            at, value, bounds = features(texts, bits)
            mine = slot[at]
            rows = [(mine[a:b][mine[a:b] >= 0].tobytes(), value[a:b][mine[a:b] >= 0].astype(np.float32).tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([texts.rows.column(texts.rows.schema.get_field_index("label")).cast(pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["label", "at", "value"])

    return run


class OrdinalModel:
    """Grades, ordered thresholds between them, and the shared weights of the chosen buckets."""

    def __init__(self, grades: list[int], thresholds: np.ndarray, buckets: np.ndarray, weights: np.ndarray, bits: int):
        self.grades, self.thresholds, self.buckets, self.weights, self.bits = grades, thresholds, buckets, weights, bits

    def tails(self, texts: Texts, table: np.ndarray) -> np.ndarray:
        """``P(grade >= k)`` for every grade but the lowest, one row a document."""
        at, value, bounds = features(texts, self.bits)
        part = np.concatenate([[0.0], np.cumsum(table[at] * value)])
        z = part[bounds[1:]] - part[bounds[:-1]]
        return sigmoid(z[:, None] - self.thresholds[None, :])

    def table(self) -> np.ndarray:
        weights = np.zeros(1 << self.bits)
        weights[self.buckets] = self.weights
        return weights


def ordinal_loss(x: np.ndarray, y: np.ndarray, levels: int, penalty: float):
    """Negative log likelihood of grades ``y`` (0 to levels - 1). Parameters: weights, first threshold, logs of the gaps."""
    low, high = y > 0, y < levels - 1

    def parts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, t = p[: x.shape[1]], p[x.shape[1] :]
        return w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, cuts = parts(p)
        z = x @ w.astype(x.dtype)
        upper = np.where(high, sigmoid(cuts[np.minimum(y, levels - 2)] - z), 1.0)
        lower = np.where(low, sigmoid(cuts[np.maximum(y - 1, 0)] - z), 0.0)
        mass = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        g_cuts = np.zeros(levels - 1)
        np.add.at(g_cuts, y[high], -d_upper[high])
        np.add.at(g_cuts, y[low] - 1, d_lower[low])
        g_w = (d_upper - d_lower).astype(x.dtype) @ x + penalty * w
        back = np.cumsum(g_cuts[::-1])[::-1]
        g_t = np.concatenate([back[:1], back[1:] * np.exp(p[x.shape[1] + 1 :])])
        return float(-np.log(mass).sum() + penalty / 2 * w @ w), np.concatenate([g_w, g_t])

    return loss, parts


def fit(docs: DataFrame, labels: DataFrame, rating: str = "quality", per_grade: int = PER_GRADE, bits: int = BITS, selected: int = SELECTED, penalty: float = 0.2, tasks: int = 8) -> OrdinalModel:
    """Fit on at most ``per_grade`` training rows of each grade, and as many of every grade as of any other.

    Grades are any integers; over 64 different ones are an error, and the rows of all grades together are at most
    ``linear_fit.MOST``.
    """
    sample = training_sample(docs, labels, rating, per_grade, tasks)
    grades = sorted(r[0] for r in sample.select("label").distinct().collect())
    if len(grades) < 2:
        return OrdinalModel(grades or [0], np.zeros(0), np.zeros(0, np.int64), np.zeros(0), bits)
    total, squares, count = np.zeros((len(grades), 1 << bits)), np.zeros(1 << bits), np.zeros(len(grades))
    for r in sample.mapInArrow(lean(_sums(bits, grades)), "at binary, total binary, squares binary, count binary").toLocalIterator():
        at = np.frombuffer(r["at"], np.uint32)
        total[:, at] += np.frombuffer(r["total"], np.float32).reshape(len(grades), -1)
        squares[at] += np.frombuffer(r["squares"], np.float32)
        count += np.frombuffer(r["count"], np.int64)
    # One-way analysis of variance picks the buckets whose mean moves most with the grade.
    mean, means = total.sum(axis=0) / count.sum(), total / count[:, None]
    between = (count[:, None] * (means - mean) ** 2).sum(axis=0)
    within = np.maximum(squares - (count[:, None] * means**2).sum(axis=0), 1e-9)
    best = np.sort(np.argsort(-(between / (within + 1e-3)), kind="stable")[:selected])
    rows = sample.mapInArrow(lean(_chosen(bits, best)), "label int, at binary, value binary").collect()
    x = np.zeros((len(rows), len(best)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.float32)
    y = np.searchsorted(grades, [r["label"] for r in rows])
    loss, parts = ordinal_loss(x, y, len(grades), penalty)
    w, cuts = parts(minimise(loss, np.zeros(len(best) + len(grades) - 1)))
    return OrdinalModel(grades, cuts, best, w, bits)


def _score(model: OrdinalModel, tail: float, at_least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, grades = model.table(), np.array(model.grades, float)
        level = int(np.searchsorted(model.grades, at_least))
        for texts in slices(batches):
            tails = model.tails(texts, table)
            expected = grades[0] + tails @ np.diff(grades)
            chosen = np.ones(len(texts)) if level == 0 else tails[:, min(level, len(grades) - 1) - 1] if level < len(grades) else np.zeros(len(texts))
            columns = [texts.rows.column(i) for i in range(texts.rows.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(expected), pa.array(chosen), pa.array(chosen >= tail)], [*texts.rows.schema.names, "expected_grade", "tail_probability", "kept"])

    return run


def score_quality(docs: DataFrame, model: OrdinalModel, at_least: int | None = None, tail: float = TAIL) -> DataFrame:
    """``doc_id, held_out, expected_grade, tail_probability, kept`` of every document.

    The tail is the probability of grade ``at_least`` (default: the highest) or better, and a document
    is kept if it reaches ``tail``. A null text scores as an empty one: no features, so thresholds alone
    decide. With fewer than two grades in training the grade is constant. Null ids count as not held
    out; repeated rows score alike; other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select("doc_id", "text")
    more = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    scored = source.mapInArrow(lean(_score(model, tail, model.grades[-1] if at_least is None else at_least)), T.StructType([*source.schema.fields, *more]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", "kept")
