"""Hard negatives by a pivot table: stored distances to a few pivots bracket every inner product.

A vector ``x`` gets one more part, ``sqrt(M - |x|^2)`` with ``M`` the largest squared length, and a query the part 0.
Then ``|q - x|^2 = |q|^2 + M - 2 <q, x>``, so inner products are distances and the triangle inequality holds:
with the distances of ``x`` and ``q`` to a pivot, ``|d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p)``. Over all pivots this
gives a lowest and a highest score of each pair. A row is scored exactly only if its bracket leaves open
whether it is among the best: its highest score reaches what enough other rows are sure to reach, and (for negatives)
the bracket meets the wanted range.

Distances to pivots are stored with the vectors in blocks, as packed cells. Anchors are dealt to chunks; each pair of a block and a
chunk is one group of bounded size, and only its best rows leave it. Positives are found first, and
their scores then set the range of the negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import pack, unpack
from .scratch import staged
from .vectors import matrix
from .workers import lean_group

TOP, LOW, HIGH, SCALE = 5, 80, 100, 256
PIVOTS, SAMPLE = 16, 4096
BLOCK, SMALL_BLOCK, ASKED, AT_ONCE = 8192, 512, 16384, 64
EXACT = 2.0**53  # sums of whole numbers below this are exact in double precision
LARGEST = 2.0**55  # a hundred times a score still is a long


class Pivots:
    """A few rows of the augmented space, far from each other."""

    def __init__(self, sample: np.ndarray, most: float, count: int = PIVOTS):
        self.most = most
        x = sample.astype(np.float64)
        chosen: list[int] = []
        far = np.full(len(x), np.inf)
        while len(chosen) < min(count, len(x)) and (not chosen or far.max() > 0):
            chosen.append(int(far.argmax()) if chosen else int((x * x).sum(axis=1).argmax()))
            self.x = x[chosen[-1:]]
            far = np.minimum(far, self.from_rows(x)[:, 0])
        self.x = x[chosen]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))

    def _distances(self, x: np.ndarray, lift: np.ndarray) -> np.ndarray:
        width = max(x.shape[1], self.x.shape[1])
        x, p = (np.pad(y, ((0, 0), (0, width - y.shape[1]))) for y in (x, self.x))
        square = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T + (lift[:, None] - self.lift(p)) ** 2
        return np.sqrt(np.maximum(square, 0))

    def from_rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return self._distances(x, self.lift(x))

    def from_queries(self, x: np.ndarray) -> np.ndarray:
        return self._distances(x.astype(np.float64), np.zeros(len(x)))


def brackets(pivots: Pivots, near: np.ndarray, asked: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest possible scores (queries by rows) from the distances of rows and queries to the pivots.

    ``size`` holds the squared lengths of the queries. Single precision is enough: every bound is widened by more than its rounding.
    """
    most, top = pivots.most, np.sqrt(pivots.most)
    least = np.zeros((len(asked), len(near)), np.float32)
    largest = np.full((len(asked), len(near)), np.float32(np.inf))
    for d, q in zip(near.T.astype(np.float32), asked.T.astype(np.float32), strict=True):
        np.maximum(least, np.abs(q[:, None] - d), out=least)
        np.minimum(largest, q[:, None] + d, out=largest)
    # Distances are square roots of differences that cancel: an error of 2**-40 M in the square may be 2**-20 sqrt(M) in the root.
    slack = np.float32(top * 2.0**-18)
    whole = (size + most)[:, None].astype(np.float32)
    pad = np.float32(most * 2.0**-18 + 1)
    high = (whole - np.maximum(least - slack, 0) ** 2) / 2 + pad
    low = (whole - (largest + slack) ** 2) / 2 - pad
    return low, high


def kth_best(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest number of each row, minus infinity where there are fewer."""
    if x.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the largest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(at) > 4 * top:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top])
    return at[np.lexsort((ids[at], -scores[at]))][:top]


class Cell:
    """Rows or anchors with ids, labels, whole-number vectors, and distances to the pivots."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, near: np.ndarray, marks: np.ndarray | None = None):
        self.ids, self.labels, self.x, self.near = ids, labels, x, near
        self.marks = np.zeros((len(ids), 0), np.int64) if marks is None else marks

    def stored(self) -> bytes:
        kind = np.int32 if not self.x.size or np.abs(self.x).max() < 2**31 else np.int64
        shape = np.array([*self.x.shape, self.near.shape[1], self.marks.shape[1]], np.int64)
        return pack(shape, self.ids, self.labels, self.x.astype(kind).ravel(), self.near.astype(np.float32).ravel(), self.marks.ravel())

    @classmethod
    def read(cls, cell: bytes, width: int = 0) -> "Cell":
        (rows, own, pivots, marks), ids, labels, x, near, flat = unpack(cell)
        x = np.pad(x.reshape(rows, own), ((0, 0), (0, max(width - int(own), 0))))
        return cls(ids, labels, x, near.reshape(rows, pivots), flat.reshape(rows, marks))


def _cells(pivots: Pivots, name: str, queries: bool):
    def run(table: pa.Table) -> pa.Table:
        x = matrix(table.column("v"))
        marks = None
        if "marks" in table.schema.names:
            # Scores of the positives, best first; missing ones repeat nothing: their range is empty.
            marks = np.full((len(x), TOP), np.iinfo(np.int64).min, np.int64)
            for row, own in enumerate(table.column("marks").to_pylist()):
                for place, score in own:
                    if place <= TOP:
                        marks[row, place - 1] = score
        near = pivots.from_queries(x) if queries else pivots.from_rows(x)
        own = Cell(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), x.astype(np.int64), near, marks)
        return pa.table({name: pa.array([table.column(name)[0].as_py()], pa.int32()), "cell": pa.array([own.stored()], pa.binary())})

    return run


def _packed(rows: DataFrame, own, name: str, pivots: Pivots, queries: bool) -> DataFrame:
    dealt = rows.withColumn(name, own.cast("int"))
    return dealt.groupBy(name).applyInArrow(lean_group(_cells(pivots, name, queries)), f"{name} int, cell binary")


def _exact(block: Cell, asked: Cell, part: slice, open_: np.ndarray, most: float) -> np.ndarray:
    """Scores of the open pairs of some anchors; other pairs may hold anything."""
    if most < EXACT:
        kind = np.float64
        if open_.mean() > 1 / 8:
            return asked.x[part].astype(kind) @ block.x.astype(kind).T
    else:
        kind = np.int64
    out = np.zeros(open_.shape, kind)
    q, r = np.nonzero(open_)
    for k in range(0, len(q), 1 << 15):
        at = slice(k, k + (1 << 15))
        out[q[at], r[at]] = (asked.x[part][q[at]].astype(kind) * block.x[r[at]].astype(kind)).sum(axis=1)
    return out


def _positives(block: Cell, asked: Cell, pivots: Pivots, top: int, found: list) -> None:
    """Best rows of the anchor's label."""
    for first in range(0, len(asked.ids), AT_ONCE):
        part = slice(first, first + AT_ONCE)
        ours = (asked.labels[part, None] == block.labels) & (asked.ids[part, None] != block.ids)
        low, high = brackets(pivots, block.near, asked.near[part], (asked.x[part].astype(np.float64) ** 2).sum(axis=1))
        sure = kth_best(np.where(ours, low, -np.inf), top)
        open_ = ours & (high >= sure[:, None])
        score = _exact(block, asked, part, open_, pivots.most)
        for k in np.flatnonzero(open_.any(axis=1)).tolist():
            at = np.flatnonzero(open_[k])
            at = at[best(score[k, at], block.ids[at], top)]
            found.append((np.full(len(at), asked.ids[first + k]), np.zeros(len(at), np.int64), block.ids[at], score[k, at].astype(np.int64)))


def _negatives(block: Cell, asked: Cell, pivots: Pivots, top: int, low_share: int, high_share: int, found: list) -> None:
    """Best rows of other labels in the range that each positive's score sets."""
    for first in range(0, len(asked.ids), AT_ONCE):
        part = slice(first, first + AT_ONCE)
        others = asked.labels[part, None] != block.labels
        low, high = brackets(pivots, block.near, asked.near[part], (asked.x[part].astype(np.float64) ** 2).sum(axis=1))
        none = asked.marks[part] == np.iinfo(np.int64).min
        marks = np.where(none, 0, asked.marks[part])
        # low_share p <= 100 s <= high_share p, in whole numbers: from the ceiling to the floor of the quotients.
        least, most = -(-low_share * marks // 100), high_share * marks // 100
        none |= least > most
        open_ = np.zeros(others.shape, bool)
        for k in range(marks.shape[1]):
            a, b = (y[:, k, None].astype(np.float64) for y in (least, most))
            may = others & (high >= a) & (low <= b) & ~none[:, k, None]
            sure = kth_best(np.where(may & (low >= a) & (high <= b), low, -np.inf), top)
            open_ |= may & (high >= sure[:, None])
        score = _exact(block, asked, part, open_, pivots.most)
        for q in np.flatnonzero(open_.any(axis=1)).tolist():
            at = np.flatnonzero(open_[q])
            own = score[q, at]
            for k in np.flatnonzero(~none[q]).tolist():
                here = np.flatnonzero((own >= least[q, k]) & (own <= most[q, k]))
                here = here[best(own[here], block.ids[at[here]], top)]
                found.append((np.full(len(here), asked.ids[first + q]), np.full(len(here), k + 1), block.ids[at[here]], own[here].astype(np.int64)))


FOUND = "anchor_id long, place long, other_id long, score long"


def _search(pivots: Pivots, work, *options):
    def run(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
        if blocks.num_rows and chunks.num_rows:
            cells = blocks.column("cell")[0].as_py(), chunks.column("cell")[0].as_py()
            width = max(int(unpack(c)[0][1]) for c in cells)
            work(*(Cell.read(c, width) for c in cells), pivots, *options, found)
        return pa.table(dict(zip(["anchor_id", "place", "other_id", "score"], (pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)), strict=True)))

    return run


def _met(blocks: DataFrame, chunks: DataFrame, n_blocks: int, n_chunks: int, work, top: int) -> DataFrame:
    """Every chunk of anchors against every block, and the best of what the groups found, numbered."""
    left = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    right = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(lean_group(work), FOUND)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def scaled_rows(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v`` with ``v`` the whole numbers ``floor(scale x)``, of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    return rows.withColumn("size", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).where(F.col("size") < LARGEST)


def hard_negatives(
    table: DataFrame, anchor_every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    top: int = TOP, low: int = LOW, high: int = HIGH, scale: int = SCALE, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, asked: int = ASKED,
) -> DataFrame:
    """The ``top`` hardest rows of other labels for each anchor and each of its ``TOP`` best rows of its own label.

    Scores are inner products of ``floor(scale x)`` as whole numbers, higher first, ties to the smaller id; a negative's score lies
    between ``low`` and ``high`` percent of the positive's. Returns ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``; anchors without positives, and positives without negatives, have no rows.

    Anchors are the rows whose id is divisible by ``anchor_every``; an id that repeats is asked once, with the smallest label and vector it
    has. Rows of the anchor's own id are not its positives; of other rows that repeat an id each counts. A null id, label or
    vector, a null or non-finite part, and scaled vectors of squared length 2**55 or more (whose shares no long holds) take no part; zero
    and empty vectors do. Vectors of different lengths are compared as if filled up with zeros. Other columns are ignored; without anchors the result is empty.

    Pivots come from at most ``sample`` rows, chosen by hash; every row is indexed, in blocks of about ``block``, and met by chunks of about ``asked`` anchors.
    """
    spark = table.sparkSession
    rows = scaled_rows(table, id_col, vector_col, label_col, scale)
    is_anchor = F.pmod("vec_id", F.lit(anchor_every)) == 0
    count, most, asking = rows.agg(F.count("*"), F.max("size"), F.count_if(is_anchor)).first()
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").toArrow()
    own = Pivots(matrix(picked.column("v")) if picked.num_rows else np.zeros((0, 0)), (most or 0.0) * (1 + 1e-12), pivots)
    # At least four groups a core, as far as blocks do not become small.
    n_chunks = max(1, -(-asking // asked))
    n_blocks = max(1, -(-count // block), min(4 * spark.sparkContext.defaultParallelism, count // SMALL_BLOCK))
    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_blocks))
    blocks = staged(_packed(rows.select("vec_id", "label", "v"), place, "block", own, False), "pivots")
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks))
    met = _met(blocks, _packed(anchors, chunk, "chunk", own, True), n_blocks, n_chunks, _search(own, _positives, TOP), TOP)
    positives = staged(met.select("anchor_id", F.col("rank").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    marks = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.array("place", "positive_score")).alias("marks"))
    chunks = _packed(anchors.join(marks, "vec_id"), chunk, "chunk", own, True)
    met = _met(blocks, chunks, n_blocks, n_chunks, _search(own, _negatives, top, low, high), top)
    met = met.select("anchor_id", "place", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(met, ["anchor_id", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE_NEGATIVES = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as other_id, list_inner_product(a.v, b.v)::bigint as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, positive_id, (row_number() over w)::integer as rank, other_id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, other_id)
qualify row_number() over w <= 5"""
