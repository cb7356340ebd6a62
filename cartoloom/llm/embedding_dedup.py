"""Embedding near-duplicates by quantised tile products with rigorous error bounds.

Unit vectors are rounded to int8 with a scale of their own. With ``x = s a + d`` the product of two
vectors lies within ``|d| + |d'| + |d||d'|`` of ``s s' <a, a'>``. Integer products of a whole tile are
exact in single-precision matrix products (at most 2**24, parts of at most 1,040 dimensions at a time), so the bound decides nearly all pairs:
surely below, surely at or above, and a few in between that are computed in double precision.

Vectors are dealt to tiles and quantised once; a tile is stored as one packed cell of int8 codes, scales, errors and the
original numbers, from which single pairs are computed. Each pair of tiles is one group that returns the
number of links of each vector and a forest that spans its links, never the links themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .packing import narrow, pack, unpack
from .scratch import staged
from .vectors import matrix, valid_vectors
from .workers import lean_group

COSINE = 0.95
TILE, SMALL_TILE = 8192, 512
EXACT_DIMS = 2**24 // 127**2


class Quantised:
    """Unit directions as int8 with scales and error norms, in order of scale."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        unit = self._units(x)
        scale = np.abs(unit).max(axis=1) / 127
        order = np.lexsort((ids, scale))
        self.ids, self.x, self.scale = ids[order], x[order], scale[order]
        self._unit: np.ndarray | None = unit[order]
        codes = np.rint(self.unit / self.scale[:, None])
        self.error = np.linalg.norm(self.unit - codes * self.scale[:, None], axis=1) + 1e-9
        self.codes = codes.astype(np.int8)

    @staticmethod
    def _units(x: np.ndarray) -> np.ndarray:
        safe = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
        return safe / np.linalg.norm(safe, axis=1, keepdims=True)

    @property
    def unit(self) -> np.ndarray:
        """Directions in double precision, made from the original numbers when a pair needs them."""
        if self._unit is None:
            self._unit = self._units(self.x)
        return self._unit

    def stored(self) -> bytes:
        return pack(np.array(self.x.shape, np.int64), self.ids, narrow(self.x.ravel()), self.scale, self.error, self.codes.ravel())

    @classmethod
    def read(cls, cell: bytes, width: int) -> "Quantised":
        """A stored tile, filled up with zeros to ``width`` dimensions."""
        shape, ids, x, scale, error, codes = unpack(cell)
        out = cls.__new__(cls)
        wide = lambda a: np.pad(a.reshape(shape), ((0, 0), (0, width - int(shape[1]))))
        out.ids, out.x, out.scale, out.error, out.codes, out._unit = ids, wide(x).astype(np.float64), scale, error, wide(codes), None
        return out


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: single-precision parts that stay below 2**24, summed in double precision."""
    parts = [a[:, k : k + EXACT_DIMS].astype(np.float32) @ b[:, k : k + EXACT_DIMS].astype(np.float32).T for k in range(0, a.shape[1], EXACT_DIMS)]
    return parts[0] if len(parts) == 1 else np.sum([p.astype(np.float64) for p in parts], axis=0)


def tile_links(a: Quantised, b: Quantised, cosine: float, same: bool, side: int = 1024) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Links between two tiles: counts for the rows of each, and spanning forests as pairs of ids."""
    count_a, count_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    spans = []
    for i in range(0, len(a.ids), side):
        rows = slice(i, i + side)
        for j in range(i if same else 0, len(b.ids), side):
            cols = slice(j, j + side)
            product = int_products(a.codes[rows], b.codes[cols])
            worst = b.error[cols].max()
            slack = a.error[rows] + worst + a.error[rows] * worst
            least = (cosine - slack) / (a.scale[rows] * b.scale[cols].max())
            if cosine <= slack.max():
                least[:] = -np.inf
            r, c = np.nonzero(product >= (least - np.abs(least) * 1e-6).astype(product.dtype)[:, None])
            if same and i == j:
                above = c > r
                r, c = r[above], c[above]
            if not len(r):
                continue
            estimate = a.scale[rows][r] * b.scale[cols][c] * product[r, c].astype(np.float64)
            bound = a.error[rows][r] + b.error[cols][c] + a.error[rows][r] * b.error[cols][c]
            linked = estimate - bound >= cosine + 1e-9
            open_ = np.flatnonzero(~linked & (estimate + bound >= cosine - 1e-9))
            for k in range(0, len(open_), 1 << 15):
                at = open_[k : k + (1 << 15)]
                linked[at] = (a.unit[rows][r[at]] * b.unit[cols][c[at]]).sum(axis=1) >= cosine
            r, c = r[linked], c[linked]
            np.add.at(count_a, i + r, 1)
            np.add.at(count_b, j + c, 1)
            if len(r):
                spans.append(forest(a.ids[rows][r], b.ids[cols][c]))
    return count_a, count_b, spans


def _tile(table: pa.Table) -> pa.Table:
    own = Quantised(table.column("vec_id").to_numpy(), matrix(table.column("v")))
    return pa.table({"tile": pa.array([table.column("tile")[0].as_py()], pa.int32()), "cell": pa.array([own.stored()], pa.binary())})


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        cells = dict(zip(table.column("tile").to_pylist(), table.column("cell").to_pylist(), strict=True))
        low, high = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        if low not in cells or high not in cells:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        width = max(int(unpack(c)[0][1]) for c in cells.values())
        same = low == high
        a = Quantised.read(cells[low], width)
        b = a if same else Quantised.read(cells[high], width)
        count_a, count_b, spans = tile_links(a, b, cosine, same)
        if same:
            count_a, count_b = count_a + count_b, np.zeros(0, np.int64)
        u = np.concatenate([a.ids[count_a > 0], b.ids[: len(count_b)][count_b > 0]])
        n = np.concatenate([count_a[count_a > 0], count_b[count_b > 0]])
        p, q = forest(*(np.concatenate(s) for s in zip(*spans, strict=True))) if spans else (np.zeros(0, np.int64),) * 2
        counts = np.arange(len(u) + len(p)) < len(u)  # rows of counts have no second end
        return pa.table({"u": pa.array(np.concatenate([u, p])), "v": pa.array(np.concatenate([u, q]), mask=counts), "n": pa.array(np.concatenate([n, np.zeros(len(p), np.int64)]))})

    return run


def embedding_groups(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """Link vectors of cosine ``cosine`` or more and group them.

    Returns ``vec_id, n_links, component_id, kept`` for every row. A null or zero vector, or one that
    holds null or non-finite parts, links with nothing and is its own component. Rows without id have
    no links, a null component and are not kept. Vectors of different lengths are compared as if filled
    up with zeros. Rows that repeat an id are separate vectors that share the id's component; their links
    add up, links among themselves included. Other columns are ignored; an empty table gives an empty result.
    """
    rows = valid_vectors(table, id_col, vector_col)
    count = rows.count()
    # At least as many pairs of tiles as the cluster has cores, as far as tiles do not become small.
    wide = int(np.ceil(np.sqrt(4 * table.sparkSession.sparkContext.defaultParallelism)))
    tiles = max(1, -(-count // tile), min(wide, count // SMALL_TILE))
    own = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(tiles)).cast("int")
    cells = staged(rows.select("vec_id", "v", own.alias("tile")).groupBy("tile").applyInArrow(lean_group(_tile), "tile int, cell binary"), "cells")
    pairs = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    pairs = pairs.select("tile", "cell", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    found = staged(pairs.groupBy("a", "b").applyInArrow(lean_group(_compare(cosine)), "u long, v long, n long"), "tiles")
    links = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n_links"))
    groups = components(found.where("v is not null").select("u", "v"))
    out = table.select(F.col(id_col).cast("long").alias("vec_id")).join(links, F.col("vec_id") == F.col("u"), "left").join(groups, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
