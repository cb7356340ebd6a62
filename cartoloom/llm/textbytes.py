"""Vectorised kernels over the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE[LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for slot, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[slot] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def shrink(n: int = 1 << 20) -> None:
    """Forget the powers that only very long texts need."""
    if len(_powers[0]) > n:
        _powers[:] = [x[:n].copy() for x in _powers]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """``p`` such that the hash of ``data[s:e]`` follows from ``p[s]`` and ``p[e]``."""
    power, _ = powers(len(data) + 1)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if fold_case else _BYTE)[data] * power[: len(data)], out=p[1:])
    return p


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unmixed hashes of many byte ranges; independent of where a range lies."""
    _, inverse = powers(len(p))
    return (p[ends] - p[starts]) * inverse[starts]


class Texts:
    """The bytes of several documents laid end to end; a null text counts as empty."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the index of each document's first word."""
        inside = ~SEPARATORS[self.data]
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cut = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[cut] = False
        after[cut - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and 0-based offsets of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[Texts]:
    """Cut Arrow batches so that a slice holds about ``most`` bytes, or one longer document."""
    for rows in batches:
        at = rows.schema.get_field_index(column)
        _, offsets = column_bytes(rows.column(at))
        start = 0
        while start < rows.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
            end = min(max(end, start + 1), rows.num_rows)
            part = rows.slice(start, end - start)
            data, own = column_bytes(part.column(at))
            yield Texts(part, data, own)
            start = end


def merged(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 23) -> Iterator[Texts]:
    """Like :func:`slices`, but small batches are joined so that most slices are nearly full."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches, column, most):
        if held and size + len(part.data) > most:
            yield _joined(held, column)
            held, size = [], 0
        held.append(part.rows)
        size += len(part.data)
    if held:
        yield _joined(held, column)


def _joined(held: list[pa.RecordBatch], column: str) -> Texts:
    rows = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    data, offsets = column_bytes(rows.column(rows.schema.get_field_index(column)))
    return Texts(rows, data, offsets)


def segments_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments, empty ones included."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
