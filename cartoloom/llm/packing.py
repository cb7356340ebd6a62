"""Many small rows as one compressed binary cell: shuffles move a few cells a task instead of millions of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

CELL = "bucket int, kind byte, cell binary"
_write = zstandard.ZstdCompressor(level=1)
_read = zstandard.ZstdDecompressor()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of any lengths and types, compressed together."""
    head = np.array([len(columns), *(x for c in columns for x in (c.dtype.num, c.nbytes))], np.int64)
    return _write.compress(b"".join([head.tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)]))


def narrow(x: np.ndarray) -> np.ndarray:
    """Doubles as single precision if no value changes."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small if np.array_equal(small.astype(np.float64), x) else x


_types = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.int8, np.bool_, np.uint16, np.int32, np.uint32, np.int64, np.uint64, np.float32, np.float64)}


def unpack(cell: bytes) -> list[np.ndarray]:
    raw = _read.decompress(cell)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * count, 8).reshape(count, 2)
    at, out = 8 * (1 + 2 * count), []
    for kind, size in head:
        dtype = _types[int(kind)]
        out.append(np.frombuffer(raw, dtype, int(size) // dtype.itemsize, at))
        at += int(size)
    return out


def joined(cells: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    """The columns of several cells, one after another; ``kinds`` gives the types if there is no cell."""
    parts = [unpack(c) for c in cells]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def dealt(bucket: np.ndarray, kind: int, columns: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """One cell for every bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
    columns = [c[order] for c in columns]
    return [(int(own[a]), kind, pack(*(c[a:b] for c in columns))) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]


def cells_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int8()), pa.array([r[2] for r in rows], pa.binary())],
        ["bucket", "kind", "cell"],
    )
