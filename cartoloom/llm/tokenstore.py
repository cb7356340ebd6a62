"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are range-partitioned and sorted by id, encoded, and written as ORC files whose order
continues from file to file. Reading takes one task per file part (stripes are independent), and
lookups by id skip stripes and row groups by their statistics and Bloom filters.

Encoding asks the tokenizers library once per distinct piece of text. Byte-level BPE never merges
across the pieces of its pre-tokenizer; those pieces are found for a whole slice at once from the
classes of its characters, and ids of known pieces come from a bounded cache in the worker.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bounded, new_path
from .textbytes import mix, powers, slices
from .workers import lean

CACHE = 2_000_000
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_classes: list[np.ndarray] = []
_engines: dict[str, "Pieces"] = {}


def char_classes() -> np.ndarray:
    """Class of every code point, as the pre-tokenizer's pattern sees it."""
    if not _classes:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1])
                table[a : b + 1] = kind
        table[0xD800:0xE000] = OTHER
        _classes.append(table)
    return _classes[0]


def code_points(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one string, its code points, and the bounds of each text."""
    whole = "".join(t or "" for t in texts)
    bounds = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])]).astype(np.int64)
    return whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def piece_starts(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte-level pattern begin.

    A run of letters, of numbers or of other marks is a piece, with one blank before it if there is
    one; white space before that blank is a piece; an apostrophe splits off English contractions.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[cp]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    fence = np.zeros(n + 1, bool)
    fence[bounds] = True
    edge |= fence
    run = np.flatnonzero(edge)
    a, b = run[:-1], run[1:]
    blank = kind[a] == SPACE
    start = np.zeros(n + 1, bool)
    start[a[blank]] = True
    tail = blank & ~fence[b]  # white space with something after it in the same text
    start[b[tail] - 1] = True
    solid = a[~blank]
    absorbed = (solid > 0) & (cp[solid - 1] == 0x20) & ~fence[solid]
    start[solid[~absorbed]] = True
    # Contractions: a lone apostrophe that begins a piece, and letters that continue it.
    quote = a[~blank][~absorbed]
    quote = quote[(cp[quote] == 0x27)]
    quote = quote[edge[quote + 1] & ~fence[quote + 1] & (quote + 1 < n)]
    if len(quote):
        padded = np.concatenate([cp, np.zeros(3, np.uint32)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        pair &= ~short & ~edge[np.minimum(quote + 2, n)]
        for at, more in ((quote[short], 2), (quote[pair], 3)):
            start[at + 1] = False
            start[np.minimum(at + more, n)] = True
    return np.flatnonzero(start[:n])


_points = mix(np.arange(1, 0x3001, dtype=np.uint64))


class Pieces:
    """Ids of distinct pieces of text, kept in flat arrays of bounded size (some 50 bytes a piece)."""

    def __init__(self, encode, most: int = CACHE):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.names, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted by name
        self.recent: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.count = np.zeros(1 << 14, np.int64), 0

    def _slots(self, unique: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.names, unique), max(len(self.names) - 1, 0))
        found = np.full(len(unique), -1, np.int64)
        if len(self.names):
            hit = self.names[place] == unique
            found[hit] = self.slots[place[hit]]
        for i in np.flatnonzero(found < 0).tolist() if self.recent else ():
            found[i] = self.recent.get(int(unique[i]), -1)
        return found

    def _add(self, names: np.ndarray, fresh: list) -> np.ndarray:
        sizes = np.array([len(x) for x in fresh], np.int64)
        ids = np.concatenate([np.asarray(x, np.int32) for x in fresh])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        while self.count + len(sizes) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(len(self.at), np.int64)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[self.count + 1 : self.count + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        slots = np.arange(self.count, self.count + len(sizes))
        self.used, self.count = self.used + len(ids), self.count + len(sizes)
        self.recent.update(zip(names.tolist(), slots.tolist(), strict=True))
        if len(self.recent) > 1 << 15:
            every = np.concatenate([self.names, np.fromiter(self.recent, np.uint64, len(self.recent))])
            own = np.concatenate([self.slots, np.fromiter(self.recent.values(), np.int32, len(self.recent))])
            order = np.argsort(every)
            self.names, self.slots, self.recent = every[order], own[order], {}
        return slots

    def ids(self, whole: str, cp: np.ndarray, starts: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive pieces end to end, and the bounds of each piece's ids."""
        ends = np.append(starts[1:], stop)
        value = _points[np.minimum(cp, 0x2FFF)]
        rare = cp >= 0x2FFF
        if rare.any():
            value[rare] = mix(cp[rare].astype(np.uint64) + np.uint64(1))
        power, inverse = powers(len(cp) + 1)
        p = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(value * power[: len(cp)], out=p[1:])
        name = mix((p[ends] - p[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        code, unique = pd.factorize(name)
        if self.count + len(unique) > self.most:
            self.clear()
        known = self._slots(unique)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            first = np.zeros(len(unique), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            at = first[missing]
            known[missing] = self._add(unique[missing], self.encode([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
        slot = known[code]
        size = self.at[slot + 1] - self.at[slot]
        bounds = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(self.at[slot] - bounds[:-1], size) + np.arange(bounds[-1])
        return self.pool[index], bounds


class ByteLevelEncoder:
    """Same ids as ``Tokenizer.encode(text, add_special_tokens=False)``, slice by slice."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec.get("pre_tokenizer") or {}
        self.split = spec.get("normalizer") is None and step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space") and not spec["model"].get("dropout")
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces = Pieces(lambda words: [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        whole, cp, bounds = code_points(texts)
        plain = self.split
        out: list[np.ndarray | None] = [None] * len(texts)
        if plain:
            starts = piece_starts(cp, bounds)
            ids, at = self.pieces.ids(whole, cp, starts, len(cp)) if len(starts) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
            cut = at[np.searchsorted(starts, bounds)]
            out = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for i, text in enumerate(texts):
            if not plain or (self.added and text and self.added.search(text)):
                out[i] = np.asarray(self.tokenizer.encode(text or "", add_special_tokens=False).ids, np.int32)
        return out


def encoder(path: str) -> ByteLevelEncoder:
    """One encoder a worker process; its cache outlives tasks."""
    if path not in _engines:
        _engines[path] = ByteLevelEncoder(path)
    return _engines[path]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, part, start = encoder(path), TaskContext.get().partitionId(), 0
        for texts in slices(batches):
            rows = engine.encode(texts.rows.column(1).to_pylist())
            end = np.array([end_id], np.int32)
            size = np.array([len(r) + 1 for r in rows], np.int64)
            bounds = np.concatenate([[0], np.cumsum(size)])
            ids = np.concatenate([x for r in rows for x in (r, end)])
            yield pa.RecordBatch.from_arrays(
                [texts.rows.column(0), pa.array(np.full(len(rows), part, np.int32)), pa.array(start + bounds[:-1]), pa.array(size), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))],
                ["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            start += int(bounds[-1])

    return run


TOKENS = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", bloom_fpp: float = 0.01, stripe_bytes: int = 64 << 20) -> None:
    """Encode whole texts, append ``end_id`` to each, and write ORC files in ascending id order.

    Null texts count as empty and consist of the end id alone. Null ids come first; rows that
    share an id are ordered by text. Other columns are ignored; an empty table writes no rows.
    """
    bounded(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(lean(_encode(tokenizer, end_id), "tokenstore"), TOKENS)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark, path: str) -> DataFrame:
    """The stored rows; filters on ``doc_id`` reach the stripes' statistics and Bloom filters."""
    return spark.read.schema(TOKENS).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        lists = rows.column(4)
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))
        at = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(sums, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write :func:`write_tokens`' files and describe each document from what they hold.

    Returns ``doc_id, start, n_tokens, ids_crc32``: ids of all documents before it, its own ids with
    the end id, and the unsigned crc32 of those as little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    stored = read_tokens(spark, path)
    # One row a file: the totals of the files before it.
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy(F.col("part").alias("p")).agg(F.sum("n_tokens").alias("total"))
    parts = parts.select("p", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    own = stored.mapInArrow(lean(_digest, "tokenstore"), "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return own.join(F.broadcast(parts), F.col("part") == F.col("p")).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
