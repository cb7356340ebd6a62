"""Alignment of two tokenizers over the same bytes, with id-striped dense count matrices.

Both tokenizers cut a text's bytes; tokens of the two sides whose bytes overlap are linked, and byte offsets where both
sides end cut the tokens into groups. How often an id pair is linked in the whole corpus is counted in a matrix of
B ids by A ids, cut into stripes of B ids. Links are dealt by the stripe of their B id: a group adds its links
to a dense block of that stripe (``np.add.at``), the maximum of a block's row is the count of the best A
id of a B id, and the same group, given the stripe's counts, scores its links. The two uses share one shuffle.

Links travel as one packed cell a slice of texts and stripe: a posting list of documents for each pair that
occurs. Stripes with many links are salted; their blocks are added up in rounds of bounded fan-in.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import pack, unpack
from .scratch import bounded, staged
from .textbytes import Texts, merged, segments_sum
from .tokenstore import ByteLevelEncoder
from .workers import lean, lean_group

STRIPE = 128  # B ids of a block
GROUP = 8_000_000  # postings that one group takes
FAN = 16  # blocks that are added up at once
SLICE = 2 << 20
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_engines: dict[tuple[str, str], "Aligner"] = {}


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the narrowest of three types."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


class ByteTable:
    """Strings by number, end to end, so that those of many numbers are gathered at once."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray, room: int = 0) -> np.ndarray:
        """The strings of ``ids``, each followed by ``room`` bytes of any value."""
        size = self.size[ids] + room
        ends = np.cumsum(size)
        index = np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[np.minimum(index, len(self.blob) - 1)]


def byte_level_entries(path: str) -> list[bytes]:
    """Bytes of each entry of a byte-level vocabulary: visible characters stand for themselves, the others for bytes in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary = dict(spec["model"]["vocab"])
    out = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in spec.get("added_tokens", []))]))
    for entry, own in vocabulary.items():
        out[own] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    return out


class Aligner:
    """Both tokenizers, and the bytes of their entries."""

    def __init__(self, bytes_path: str, pieces_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a = ByteLevelEncoder(bytes_path)
        self.a.tokenizer.encode_special_tokens, self.a.added = True, None  # special strings are plain text
        self.b = SentencePieceProcessor(model_file=pieces_path)
        own = range(self.b.get_piece_size())
        pieces = [self.b.id_to_piece(i) for i in own]
        self.table_a = ByteTable(byte_level_entries(bytes_path))
        self.table_b = ByteTable([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(own, pieces, strict=True)])
        self.ids_a, self.ids_b = len(self.table_a.size), len(self.table_b.size)
        self.digits = ByteTable([str(i).encode() for i in range(max(self.ids_a, self.ids_b))])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = self.a.encode([" " + t for t in texts])
        return a, [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]

    def aligned(self, texts: Texts) -> "Alignment":
        return Alignment(self, texts)


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """One a worker process; the cache of its encoder outlives tasks."""
    key = (bytes_path, pieces_path)
    if key not in _engines:
        _engines[key] = Aligner(*key)
    return _engines[key]


class Alignment:
    """Tokens, groups and links of the texts of a slice.

    ``docs`` are the places of the texts with tokens. Their bytes are laid end to end, so that the running sums of token sizes are
    comparable offsets, and ends of documents are ends of tokens on both sides.
    """

    def __init__(self, engine: Aligner, texts: Texts):
        self.engine, self.count = engine, len(texts)
        full = np.flatnonzero(np.diff(texts.offsets) > 0)
        column = texts.rows.column(texts.rows.schema.get_field_index("text"))
        a, b = engine.encode([column[int(i)].as_py() for i in full])
        cut = [texts.data[texts.offsets[i] : texts.offsets[i + 1]] for i in full]
        fits = [self._same(t, engine.table_a, x) and self._same(t, engine.table_b, y) for t, x, y in zip(cut, a, b, strict=True)]
        good = np.flatnonzero(np.array(fits, bool))
        self.docs = full[good]
        none = [np.zeros(0, np.int64)]
        self.a, self.b = (np.concatenate([*none, *(side[i] for i in good)]).astype(np.int64) for side in (a, b))
        self.n_a, self.n_b = (np.array([len(side[i]) for i in good], np.int64) for side in (a, b))
        self.stop = np.cumsum(np.array([len(cut[i]) + 1 for i in good], np.int64))
        total = int(self.stop[-1]) if len(good) else 0
        ends_a, ends_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        ends_a[np.cumsum(engine.table_a.size[self.a])] = True
        ends_b[np.cumsum(engine.table_b.size[self.b])] = True
        # Every offset where a token ends closes one link: of the two tokens that cover the byte before it.
        self.ends = np.flatnonzero(ends_a | ends_b)
        self.is_a, self.is_b = ends_a[self.ends], ends_b[self.ends]
        self.link_a, self.link_b = np.cumsum(self.is_a) - self.is_a, np.cumsum(self.is_b) - self.is_b
        both = self.is_a & self.is_b
        self.group = np.cumsum(both) - both
        self.link_doc = np.searchsorted(self.stop, self.ends)
        self.n_links = np.bincount(self.link_doc, minlength=len(good))
        self.n_groups = np.bincount(self.link_doc[both], minlength=len(good))

    @staticmethod
    def _same(text: np.ndarray, table: ByteTable, ids: np.ndarray) -> bool:
        if table.size[ids].sum() != len(text) + 1:
            return False
        own = table.joined(ids)
        return own[0] == 0x20 and np.array_equal(own[1:], text)

    def hashes(self) -> list[str]:
        """SHA-256 of each document's groups: ``a1,a2|b1;a3|b2,b3``."""
        if not len(self.docs):
            return []
        in_a, in_b = self.group[self.is_a], self.group[self.is_b]
        upto_a, upto_b = np.cumsum(np.bincount(in_a)), np.cumsum(np.bincount(in_b))
        at_a = np.arange(len(self.a)) + np.append(0, upto_b)[in_a]
        at_b = np.arange(len(self.b)) + upto_a[in_b]
        items, mark = np.zeros(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        items[at_a], items[at_b] = self.a, self.b
        mark[at_a[upto_a - 1]], mark[at_b[upto_b - 1]] = ord("|"), ord(";")
        flat = self.engine.digits.joined(items, 1)
        last = np.cumsum(self.engine.digits.size[items] + 1)
        flat[last - 1] = mark
        stop = last[np.cumsum(self.n_a + self.n_b) - 1]
        view = memoryview(np.ascontiguousarray(flat))
        return [hashlib.sha256(view[a : b - 1]).hexdigest() for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]

    def facts(self, ids: pa.Array) -> bytes:
        """What is known of each document without corpus counts, null ids included."""
        columns = np.zeros((4, self.count), np.int64)
        columns[:, self.docs] = [self.n_a, self.n_b, self.n_groups, self.n_links]
        sha = np.array(bytearray.fromhex("".join(self.hashes())), np.uint8)
        return pack(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), small(self.docs), columns.ravel(), sha)

    def postings(self, stripe: int) -> Iterator[tuple[int, int, bytes]]:
        """For each stripe that occurs: its number, how many postings, and the cell that holds them."""
        count, wide = max(self.count, 1), self.engine.ids_a
        key = (self.b[self.link_b] * wide + self.a[self.link_a]) * count + self.docs[self.link_doc]
        if not len(key):
            return
        key.sort()
        at = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(np.append(at, len(key)))
        pair, doc = key[at] // count, key[at] % count
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        size = np.diff(np.append(first, len(pair)))
        step = np.diff(doc, prepend=0)
        step[first] = doc[first]
        own = pair[first] // (wide * stripe)
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        for a, b in zip(cut, np.append(cut[1:], len(own)), strict=True):
            low, high = first[a], first[b] if b < len(first) else len(pair)
            number = int(own[a])
            cell = pack((pair[first[a:b]] - number * wide * stripe).astype(np.uint32), small(size[a:b]), small(step[low:high]), small(times[low:high]))
            yield number, int(high - low), cell


def _lists(cell: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a cell, where their postings begin, documents and times of the postings."""
    pairs, size, step, times = unpack(cell)
    bounds = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    run = np.concatenate([[0], np.cumsum(step, dtype=np.int64)])
    doc = run[1:] - np.repeat(run[bounds[:-1]], size)
    return pairs.astype(np.int64), bounds, doc, times.astype(np.int64)


def _links(paths: tuple[str, str], stripe: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, turn = aligner(*paths), TaskContext.get().partitionId() << 32
        for texts in merged(batches, most=most):
            own = engine.aligned(texts)
            rows = [(0, -1, 0, own.facts(texts.rows.column(0))), *((1, *r) for r in own.postings(stripe))]
            kind, number, postings, cell = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array([turn] * len(rows), pa.int64()), pa.array(number, pa.int32()), pa.array(postings, pa.int64()), pa.array(cell, pa.binary())],
                ["kind", "slice", "stripe", "postings", "cell"],
            )
            turn += 1

    return run


def _counted(table: pa.Table, stripe: int, wide: int) -> np.ndarray:
    """Dense block of a group's links; the cells are read one at a time."""
    block = np.zeros(stripe * wide, np.int64)
    for cell in table.column("cell"):
        pairs, bounds, _, times = _lists(cell.as_py())
        np.add.at(block, pairs, segments_sum(times, bounds))
    return block


def _stored(table: pa.Table, block: np.ndarray, salt: int) -> pa.Table:
    used = np.flatnonzero(block)
    cell = pack(used.astype(np.uint32), block[used])
    return pa.table({"stripe": pa.array([table.column("stripe")[0].as_py()], pa.int32()), "salt": pa.array([salt], pa.int32()), "counts": pa.array([cell], pa.binary())})


def _count(stripe: int, wide: int):
    def run(table: pa.Table) -> pa.Table:
        return _stored(table, _counted(table, stripe, wide), table.column("salt")[0].as_py())

    return run


def _add(stripe: int, wide: int):
    def run(table: pa.Table) -> pa.Table:
        block = np.zeros(stripe * wide, np.int64)
        for cell in table.column("counts"):
            used, times = unpack(cell.as_py())
            np.add.at(block, used, times)
        return _stored(table, block, table.column("salt")[0].as_py())

    return run


def _score(stripe: int, wide: int):
    def run(links: pa.Table, matrix: pa.Table) -> pa.Table:
        slices, cells = [], []
        if links.num_rows:
            block = np.zeros(stripe * wide, np.int64)
            used, times = unpack(matrix.column("counts")[0].as_py())
            block[used] = times
            best = block.reshape(stripe, wide).max(axis=1)
            for place, cell in zip(links.column("slice"), links.column("cell"), strict=True):
                pairs, bounds, doc, times = _lists(cell.as_py())
                counts = block[pairs]
                top = counts == best[pairs // wide]
                size = np.diff(bounds)
                docs, own = np.unique(doc, return_inverse=True)
                n_best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                np.add.at(n_best, own, times * np.repeat(top, size))
                np.add.at(total, own, times * np.repeat(counts, size))
                slices.append(place.as_py())
                cells.append(pack(small(docs), small(n_best), total))
        return pa.table({"slice": pa.array(slices, pa.int64()), "kind": pa.array([1] * len(cells), pa.int32()), "cell": pa.array(cells, pa.binary())})

    return run


def _finish(table: pa.Table) -> pa.Table:
    facts = [c.as_py() for k, c in zip(table.column("kind"), table.column("cell"), strict=True) if k.as_py() == 0]
    ids, missing, docs, columns, sha = unpack(facts[0])
    columns = columns.reshape(4, -1)
    n_best, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for kind, cell in zip(table.column("kind"), table.column("cell"), strict=True):
        if kind.as_py() == 1:
            own, best, counts = unpack(cell.as_py())
            n_best[own] += best
            total[own] += counts
    digests = [""] * len(ids)
    text = sha.tobytes().hex()
    for k, doc in enumerate(docs.tolist()):
        digests[doc] = text[64 * k : 64 * k + 64]
    names = RESULT.replace(" long", "").replace(" string", "").split(", ")
    return pa.table(dict(zip(names, [pa.array(ids, mask=missing), *map(pa.array, columns), pa.array(n_best), pa.array(total), pa.array(digests, pa.string())], strict=True)))


def align_tokens(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", stripe: int = STRIPE, group: int = GROUP, fan: int = FAN, slice_bytes: int = SLICE) -> DataFrame:
    """Align the tokens of space+text by a byte-level vocabulary (A) with those of the text by a piece model (B).

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row: its tokens, groups and
    links, the links whose pair is among the most frequent of its B id, the sum of the pairs' corpus-wide counts, and the
    SHA-256 of the groups. Texts that are null or empty, or that either side's bytes do not give back, have no tokens: zeros
    and an empty string. Rows with a null id and rows that repeat one count and are answered each for itself. Whole texts of any length are
    aligned; a text longer than a slice is one of its own. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded(spark)
    engine = aligner(bytes_path, pieces_path)
    wide = engine.ids_a
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    links = staged(source.mapInArrow(lean(_links((bytes_path, pieces_path), stripe, slice_bytes), "token_alignment"), "kind int, slice long, stripe int, postings long, cell binary"), "alignment", "kind")
    cells = links.where("kind = 1")
    # One row a stripe: their number depends on the vocabulary alone.
    parts = [1] * -(-engine.ids_b // stripe)
    for r in cells.groupBy("stripe").agg(F.sum("postings").alias("n")).collect():
        parts[r["stripe"]] = max(1, -(-r["n"] // group))
    salts: Column = F.element_at(F.array(*map(F.lit, parts)), F.col("stripe") + 1)
    dealt = cells.select("stripe", F.pmod(F.xxhash64("slice"), salts).cast("int").alias("salt"), "slice", "cell")
    matrix = dealt.groupBy("stripe", "salt").applyInArrow(lean_group(_count(stripe, wide)), "stripe int, salt int, counts binary")
    most = max(parts)
    while most > 1:
        most = -(-most // fan)
        matrix = matrix.withColumn("salt", F.floor(F.col("salt") / fan).cast("int")).groupBy("stripe", "salt").applyInArrow(lean_group(_add(stripe, wide)), "stripe int, salt int, counts binary")
    matrix = matrix.select("stripe", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "counts")
    scored = dealt.groupBy("stripe", "salt").cogroup(matrix.groupBy("stripe", "salt")).applyInArrow(lean_group(_score(stripe, wide)), "slice long, kind int, cell binary")
    every = scored.unionByName(links.where("kind = 0").select("slice", "kind", "cell"))
    return every.groupBy("slice").applyInArrow(lean_group(_finish), RESULT)
