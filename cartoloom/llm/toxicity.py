"""Toxicity scores from character n-grams scaled by naive Bayes log-count ratios.

The feature of an n-gram bucket is its presence in the lower-cased text times
``log((p + a) / (q + a))``, where p and q are the bucket's rates of occurrence in toxic and other
training texts. A logistic classifier is fitted on those features. Labels are noisy and most
n-grams say nothing, so only the buckets with the strongest evidence (a signed likelihood
statistic) enter the fit; all others have weight zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear_fit import held_out, minimise, sigmoid, training_sample
from .textbytes import Texts, mix, slices
from .workers import lean

ORDERS = (3, 4, 5, 6)
BITS, SELECTED = 20, 3000
PER_CLASS = 4000
THRESHOLD = 0.7


def grams(texts: Texts, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> Iterator[np.ndarray]:
    """Distinct n-gram buckets of each text, order by order end to end (a bucket may repeat across orders)."""
    for text in texts.rows.column(texts.rows.schema.get_field_index("text")).to_pylist():
        chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        rolled, found = chars + np.uint64(1), []
        for n in range(2, max(orders) + 1):
            if len(chars) < n:
                break
            rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :]
            if n in orders:
                found.append((mix(rolled + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64))
        yield np.concatenate(found) if found else np.zeros(0, np.int64)


def _counts(orders: tuple[int, ...], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << bits), np.uint32)
        total = [0, 0]
        for texts in slices(batches):
            labels = texts.rows.column(texts.rows.schema.get_field_index("label")).to_numpy()
            for y, own in zip(labels, grams(texts, orders, bits), strict=True):
                seen[int(y > 0)][np.unique(own)] += 1
                total[int(y > 0)] += 1
        if sum(total):
            at = np.flatnonzero(seen.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (at.astype(np.uint32).tobytes(), seen[0, at].tobytes(), seen[1, at].tobytes())] + [pa.array([t], pa.int64()) for t in total], ["at", "q", "p", "nq", "np"])

    return run


def _chosen(orders: tuple[int, ...], bits: int, selected: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(1 << bits, -1, np.int32)
        slot[selected] = np.arange(len(selected))
        for texts in slices(batches):
            labels = texts.rows.column(texts.rows.schema.get_field_index("label"))
            own = [np.unique(slot[g]) for g in grams(texts, orders, bits)]
            own = [x[x >= 0].astype(np.int32).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([labels.cast(pa.int32()), pa.array(own, pa.binary())], ["label", "at"])

    return run


class Model:
    """Buckets, their weights (classifier weight times log-count ratio) and the intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float, orders: tuple[int, ...], bits: int):
        self.buckets, self.weights, self.bias, self.orders, self.bits = buckets, weights, bias, orders, bits

    def scores(self, texts: Texts, table: np.ndarray) -> np.ndarray:
        out = np.empty(len(texts))
        for i, own in enumerate(grams(texts, self.orders, self.bits)):
            at = table[own]
            hit = np.unique(at[at >= 0])
            out[i] = self.weights[hit].sum() + self.bias
        return sigmoid(out)

    def table(self) -> np.ndarray:
        slot = np.full(1 << self.bits, -1, np.int16)
        slot[self.buckets] = np.arange(len(self.buckets))
        return slot


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, orders: tuple[int, ...] = ORDERS, bits: int = BITS, selected: int = SELECTED, penalty: float = 3.0, tasks: int = 8) -> Model:
    """Fit on at most ``per_class`` training rows of each class; without both classes, every score is the base rate."""
    sample = training_sample(docs, labels, "toxic", per_class, tasks)
    seen, total = np.zeros((2, 1 << bits)), np.zeros(2)
    for r in sample.mapInArrow(lean(_counts(orders, bits)), "at binary, q binary, p binary, nq long, np long").toLocalIterator():
        at = np.frombuffer(r["at"], np.uint32)
        seen[0, at] += np.frombuffer(r["q"], np.uint32)
        seen[1, at] += np.frombuffer(r["p"], np.uint32)
        total += [r["nq"], r["np"]]
    if not total.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), -20.0 if not total[1] else 20.0, orders, bits)
    q, p = seen[0] / total[0], seen[1] / total[1]
    pooled = seen.sum(axis=0) / total.sum()
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / total[0] + 1 / total[1]))
    evidence = np.abs(p - q) / spread
    evidence[seen.sum(axis=0) < 3] = 0
    best = np.sort(np.argsort(-evidence, kind="stable")[:selected])
    best = best[evidence[best] > 3.0]
    ratio = np.log((seen[1, best] + 1) / (total[1] + 2)) - np.log((seen[0, best] + 1) / (total[0] + 2))
    rows = sample.mapInArrow(lean(_chosen(orders, bits, best)), "label int, at binary").collect()
    x = np.zeros((len(rows), len(best)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int32)] = 1
    x *= ratio.astype(np.float32)
    y = np.array([r["label"] > 0 for r in rows], float)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w[:-1].astype(np.float32) + w[-1]
        miss = sigmoid(z) - y
        value = np.logaddexp(0, np.where(y > 0, -z, z)).sum() + penalty / 2 * w[:-1] @ w[:-1]
        return float(value), np.append(miss.astype(np.float32) @ x + penalty * w[:-1], miss.sum())

    base = labels.where(~held_out(F.col("doc_id"))).agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    w = minimise(loss, np.append(np.zeros(len(best)), 0.0))
    # The sample holds the classes in other shares than the labels do.
    share = y.mean()
    shift = np.log(base / (1 - base)) - np.log(share / (1 - share)) if 0 < base < 1 else 0.0
    return Model(best, w[:-1] * ratio, float(w[-1] + shift), orders, bits)


def _score(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for texts in slices(batches):
            score = model.scores(texts, table)
            columns = [texts.rows.column(i) for i in range(texts.rows.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*texts.rows.schema.names, "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, rows: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; with ``rows``, ``text`` and a struct ``row`` of the other columns.

    A null text scores as an empty one, which has no n-grams and gets the intercept's score. Ids are
    not read by the score; a null id counts as not held out. Repeated rows score alike; an empty table
    gives an empty result.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    source = docs.select("doc_id", "text", *([F.struct(*others).alias("row")] if rows and others else []))
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    scored = source.mapInArrow(lean(_score(model, threshold)), schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", *(source.columns[1:] if rows else []))
