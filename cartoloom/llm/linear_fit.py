"""Small dense optimiser and the bounded training sample shared by the text classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded, staged

#: Labels that may differ, and rows of a training sample (the fit holds them as a dense matrix: 2,000 columns are 256 MB).
CLASSES, MOST = 64, 32_000


def held_out(doc_id) -> F.Column:
    """Rows that no fit may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, tasks: int) -> DataFrame:
    """Texts of at most ``per_class`` labelled rows of each class, chosen by hash of the id; ``doc_id, text, label``.

    Held-out rows, null ids, null labels and ids that carry several labels are left out. All classes together have at most
    ``MOST`` rows, dealt evenly; over ``CLASSES`` different labels raise, because a class would be too thin to learn from.
    """
    bounded(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    classes = sorted(r[0] for r in known.select("label").distinct().limit(CLASSES + 1).collect())
    if len(classes) > CLASSES:
        raise ValueError(f"more than {CLASSES} different labels in {label!r}")
    picked = None
    for c in classes:
        own = known.where(F.col("label") == c).select("doc_id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(min(per_class, MOST // len(classes)))
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if picked is None:
        return texts.limit(0).withColumn("label", F.lit(0))
    # At most MOST rows of 12 bytes: the bound makes the broadcast safe.
    return staged(texts.join(F.broadcast(picked), "doc_id").repartition(tasks, "doc_id"), "sample")


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 120, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with backtracking; ``f`` returns value and gradient."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - y @ q / (s @ y))
        slope, step = -(grad @ q), 1.0
        if slope >= 0:
            q, slope, pairs = grad.copy(), -(grad @ grad), []
        while step > 1e-8:
            new = x - step * q
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        small = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if small:
            break
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))
