"""Maximum inner product search with score-aware (anisotropic) product quantisation.

What a search must get right is the score of near vectors, so the part of the quantisation error
that is parallel to a vector, which moves its large products, costs more than the part orthogonal to it:
``h_par * <r, x/|x|>^2 + h_orth * |r_orth|^2``. Codebooks of 16 words for pairs of dimensions
are fitted on a bounded sample under that loss, codes are chosen by coordinate descent. A query's
products with all words make one 16-entry table a pair; scanning 4-bit codes through byte-quantised tables gives
approximate scores. The best of each block are scored again in double precision, and so is every other
row that could still be among the best: the angle between a vector and its code bounds what the code hides.

Every row is encoded once into a stored index: blocks of ids, codes (two to a byte), norms and the vectors
themselves. Queries go to the index in chunks of bounded size, each with one pass over the blocks where they lie, so
candidates are shuffled once, when the index is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import narrow, pack, unpack
from .scratch import new_path, staged
from .vectors import matrix, valid_vectors
from .workers import lean

TOP, RERANK = 20, 256
SAMPLE, WORDS, DIMS = 8192, 16, 2
PARALLEL = 4.0
BLOCK, QUERY_CHUNK, AT_ONCE = 4096, 8192, 512


class Codebook:
    """Words of every subspace, and the weight of parallel error relative to orthogonal error."""

    def __init__(self, words: np.ndarray, parallel: float):
        self.words, self.parallel = words, parallel

    @property
    def width(self) -> int:
        return self.words.shape[0] * self.words.shape[2]

    def parts(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1]))).reshape(len(x), *self.words.shape[::2])

    def encode(self, x: np.ndarray, sweeps: int = 2, codes: np.ndarray | None = None) -> np.ndarray:
        """Codes that lower the anisotropic loss, subspace by subspace."""
        parts = self.parts(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        count = parts.shape[1]
        if codes is None:
            codes = np.stack([((parts[:, m, None] - self.words[m]) ** 2).sum(-1).argmin(1) for m in range(count)], 1).astype(np.uint8)
        leaning = np.stack([((parts[:, m] - self.words[m][codes[:, m]]) * unit[:, m]).sum(-1) for m in range(count)], 1)
        total = leaning.sum(axis=1)
        for _ in range(sweeps):
            for m in range(count):
                error = parts[:, m, None] - self.words[m]
                lean = (error * unit[:, m, None]).sum(-1)
                rest = (total - leaning[:, m])[:, None]
                cost = (error**2).sum(-1) + (self.parallel - 1) * (rest + lean) ** 2
                codes[:, m] = cost.argmin(1)
                own = lean[np.arange(len(x)), codes[:, m]]
                total += own - leaning[:, m]
                leaning[:, m] = own
        return codes


def fit_codebook(x: np.ndarray, words: int = WORDS, dims: int = DIMS, parallel: float = PARALLEL, rounds: int = 6, seed: int = 11) -> Codebook:
    """Alternate coding and, for each word, the least-squares optimum of the anisotropic loss."""
    rng = np.random.default_rng(seed)
    subspaces = max(1, -(-x.shape[1] // dims))
    book = Codebook(np.zeros((subspaces, words, dims)), parallel)
    parts = book.parts(x)
    if not len(x):
        return book
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    book.words = parts[rng.integers(0, len(x), words)].transpose(1, 0, 2).copy()
    codes = None
    for _ in range(rounds):
        codes = book.encode(x, 1, codes)
        for m in range(subspaces):
            rest = _leaning(parts, unit, book.words, codes) - ((parts[:, m] - book.words[m][codes[:, m]]) * unit[:, m]).sum(-1)
            for w in np.unique(codes[:, m]):
                at = codes[:, m] == w
                u, p = unit[at, m], parts[at, m]
                left = at.sum() * np.eye(dims) + (parallel - 1) * u.T @ u
                right = p.sum(0) + (parallel - 1) * (u * (rest[at] + (p * u).sum(-1))[:, None]).sum(0)
                book.words[m, w] = np.linalg.solve(left, right)
    return book


def _leaning(parts: np.ndarray, unit: np.ndarray, words: np.ndarray, codes: np.ndarray) -> np.ndarray:
    coded = words[np.arange(words.shape[0])[None, :], codes]
    return ((parts - coded) * unit).sum(axis=(1, 2))


def byte_tables(book: Codebook, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of queries and words as bytes (subspaces by words by queries), and the offset and step of each query."""
    tables = np.einsum("qmd,mwd->mwq", book.parts(queries), book.words)
    low = tables.min(axis=1, keepdims=True)
    step = np.maximum((tables - low).max(axis=(0, 1)), 1e-300) / 255
    return np.rint((tables - low) / step).astype(np.uint8), low.sum(axis=(0, 1)), step


def table_sums(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    total = np.zeros((len(codes), tables.shape[2]), np.uint16 if 255 * codes.shape[1] <= 65535 else np.uint32)
    for m in range(codes.shape[1]):
        total += tables[m][codes[:, m]]
    return total


def scan(book: Codebook, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Approximate scores (candidates by queries) up to an offset and scale of each query, from byte tables."""
    return table_sums(byte_tables(book, queries)[0], codes)


def exact_scores(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    # Not by BLAS: its sums depend on the place of a row, and equal rows must tie.
    return (x * query).sum(axis=1)


class Block:
    """Rows of the index: ids, vectors, codes, and the sizes and angles that bound what codes hide."""

    def __init__(self, book: Codebook, ids: np.ndarray, x: np.ndarray, codes: np.ndarray):
        self.ids, self.x, self.codes = ids, x, codes
        coded = book.words[np.arange(codes.shape[1])[None, :], codes].reshape(len(ids), -1)
        self.size, self.coded_size = np.linalg.norm(x, axis=1), np.linalg.norm(coded, axis=1)
        # What is not a number in the bounds (overflow, a code of zeros) rules no row out.
        with np.errstate(all="ignore"):
            self.cos = np.clip((coded * x).sum(1) / self.size / self.coded_size, -1, 1)
            self.sin = np.sqrt(1 - self.cos**2)

    def stored(self) -> bytes:
        codes = np.pad(self.codes, ((0, 0), (0, self.codes.shape[1] % 2)))
        return pack(np.array([*self.x.shape, self.codes.shape[1]], np.int64), self.ids, narrow(self.x.ravel()), codes[:, ::2] | codes[:, 1::2] << 4, self.size, self.coded_size, self.cos, self.sin)

    @classmethod
    def read(cls, cell: bytes) -> "Block":
        (rows, width, subspaces), ids, x, packed, *norms = unpack(cell)
        out = cls.__new__(cls)
        packed = packed.reshape(rows, -1)
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(rows, -1)
        out.ids, out.x, out.codes = ids, x.reshape(rows, width).astype(np.float64), np.ascontiguousarray(codes[:, :subspaces])
        out.size, out.coded_size, out.cos, out.sin = norms
        return out


def search_block(book: Codebook, block: Block, query_ids: np.ndarray, queries: np.ndarray, top: int, rerank: int, floors: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Scores and ids of the best rows of a block for each query, best first, ties to the smaller id.

    The ``rerank`` rows of the best approximate scores give a score that ``top`` rows reach; ``floors`` are such scores from
    blocks before. The angle of query and code is at most that of query and vector plus that of vector and code, so a row
    whose approximate score, with the rounding of the tables added, is too low for this cannot reach that score; all
    others are scored.
    """
    ids, x, count = block.ids, block.x, len(block.ids)
    subspaces = block.codes.shape[1]
    asked_size = np.linalg.norm(queries, axis=1)
    # Slack for floating point: 1e-6 of the largest product of a query and any code.
    longest = np.sqrt((book.words**2).sum(-1).max(1).sum())
    # One more than asked for, because a query's own row is no candidate.
    take = min(max(rerank, top) + 1, count)
    out = []
    for first in range(0, len(queries), AT_ONCE):
        part = slice(first, first + AT_ONCE)
        tables, base, step = byte_tables(book, queries[part])
        total = np.ascontiguousarray(table_sums(tables, block.codes).T)
        with np.errstate(all="ignore"):
            for k, query in enumerate(queries[part]):
                q = first + k
                at = np.arange(count)
                if take < count:
                    near = np.argpartition(total[k], count - take)[count - take :]
                    score = exact_scores(x[near[ids[near] != query_ids[q]]], query)
                    floor = np.partition(score, len(score) - top)[len(score) - top] if len(score) >= top else -np.inf
                    if floors is not None:
                        floor = max(floor, floors[q])
                    least = np.clip(floor / asked_size[q] / block.size, -1, 1)
                    need = asked_size[q] * (block.coded_size * (least * block.cos - np.sqrt(1 - least**2) * block.sin) - 1e-6 * longest)
                    most = base[k] + step[k] * (total[k] + 0.51 * subspaces)
                    at = np.flatnonzero(~((most < need) & (least > -block.cos)))
                    if len(at) > count // 8:
                        slack = 16 * x.shape[1] * np.finfo(float).eps * asked_size[q] * block.size
                        at = at[~(x @ query < floor - slack)[at]]
                at = at[ids[at] != query_ids[q]]
                score = exact_scores(x[at], query)
                best = np.lexsort((ids[at], -score))[:top]
                out.append((score[best], ids[at][best]))
    return out


def _index(book: Codebook, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            x = matrix(rows.column("v"), book.width)
            # In order of id, so that a block does not depend on how rows arrive.
            order = np.lexsort((*x.T[::-1], rows.column("vec_id").to_numpy()))
            ids, x = rows.column("vec_id").to_numpy()[order], x[order]
            return pa.RecordBatch.from_arrays([pa.array([Block(book, ids, x, book.encode(x)).stored()], pa.binary())], ["cell"])

        for rows in batches:
            while rows.num_rows:
                room = block - sum(b.num_rows for b in held)
                held.append(rows.slice(0, room))
                rows = rows.slice(min(room, rows.num_rows))
                if sum(b.num_rows for b in held) == block:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return run


def _search(book: Codebook, query_ids: np.ndarray, queries: np.ndarray, top: int, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = []
        floors = np.full(len(query_ids), -np.inf)
        for batch in batches:
            for cell in batch.column(0):
                block = Block.read(cell.as_py())
                width = max(block.x.shape[1], queries.shape[1])
                block.x = np.pad(block.x, ((0, 0), (0, width - block.x.shape[1])))
                asked = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
                found = search_block(book, block, query_ids, asked, top, rerank, floors)
                if best:
                    both = [(np.concatenate([s, t]), np.concatenate([i, j])) for (s, i), (t, j) in zip(best, found, strict=True)]
                    found = [(s[o], i[o]) for s, i in both for o in [np.lexsort((i, -s))[:top]]]
                best = found
                floors = np.array([s[-1] if len(s) == top else -np.inf for s, _ in best])
        if best:
            sizes = np.array([len(s) for s, _ in best])
            flat = pa.StructArray.from_arrays([pa.array(-np.concatenate([s for s, _ in best])), pa.array(np.concatenate([i for _, i in best]))], ["down", "vec_id"])
            bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(query_ids), pa.ListArray.from_arrays(bounds, flat)], ["query_id", "best"])

    return run


def nearest_by_product(table: DataFrame, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, rerank: int = RERANK, sample: int = SAMPLE, block: int = BLOCK, chunk: int = QUERY_CHUNK) -> DataFrame:
    """For each row whose id is divisible by ``query_every``, its ``top`` rows of largest inner product.

    Returns ``query_id, rank, vec_id, score`` with exact scores, best first, ties to the smaller id; a
    query with fewer candidates gets all. A null or zero vector, one with null or non-finite parts,
    and a row without id take no part. Vectors of different lengths are compared as if filled up with zeros.
    Rows that repeat an id are never each other's neighbours; such a query is answered once, for the smallest of its
    vectors. Other columns are ignored. Without queries or candidates the result is empty.

    Codebooks are fitted on at most ``sample`` rows, chosen by hash; every row is indexed. In every
    block ``rerank`` rows a query, and all others that can reach the best of these, are scored exactly. Queries visit
    the index in chunks of about ``chunk`` rows, which the driver hands to the tasks.
    """
    spark = table.sparkSession
    rows = valid_vectors(table, id_col, vector_col)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    book = fit_codebook(matrix(picked.column("v"))) if picked.num_rows else Codebook(np.zeros((1, WORDS, DIMS)), PARALLEL)
    is_query = F.pmod("vec_id", F.lit(query_every)) == 0
    count, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    parts = max(1, -(-count // block))
    index = staged(rows.repartition(parts, F.xxhash64("vec_id", "v")).mapInArrow(lean(_index(book, block)), "cell binary"), "index")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    chunks, path = max(1, -(-asked // chunk)), new_path(spark, "nearest")
    own = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(chunks))
    for k in range(chunks):
        # About ``chunk`` rows: a bound that does not grow with the table.
        part = queries.where(own == k).toArrow()
        order = np.argsort(part.column("vec_id").to_numpy(), kind="stable")
        ids, x = part.column("vec_id").to_numpy()[order], (matrix(part.column("v"), book.width)[order] if part.num_rows else np.zeros((0, book.width)))
        met = index.mapInArrow(lean(_search(book, ids, x, top, rerank)), "query_id long, best array<struct<down: double, vec_id: long>>")
        merged = met.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, top).alias("best"))
        merged.write.mode("append").parquet(path)
    found = spark.read.schema("query_id long, best array<struct<down: double, vec_id: long>>").parquet(path)
    return found.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.down")).alias("score"))
