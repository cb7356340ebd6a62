"""SentencePiece encoding and decoding with a streaming Viterbi pass.

The lattice of a text has a state at every character boundary; a piece that ends there is a step from an
earlier state, and a back pointer names the best one. Only the last ``longest piece`` states can
be extended, so a window of that many suffices. Whenever the paths behind all of them run through
one boundary, everything before it is settled and its ids are committed.

For a unigram model the best step has the highest sum of scores. For a BPE model the score of a
path is whether it is what merging would give: a step is admissible if the piece before it and
its own piece, put together, are merged into just these two. Exactly one path survives at each
boundary, and its ids equal those of merging the whole text.

Some neighbours never meet inside a piece (a letter and the space mark after it, say). There all paths
converge at once, so a window of texts is cut there for all texts together, and each distinct part runs
through the lattice once a worker as long as the bounded cache holds it. A text longer than a window is walked
window by window, and what follows the last such cut is carried into the next one; a part that no window cuts goes through the
lattice as it comes, so beside the text and its ids memory is that of two windows and work grows with the text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded
from .textbytes import slices
from .tokenstore import Pieces, code_points
from .workers import lean

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PARTS, PAIRS = 2_000_000, 150_000  # entries of the caches a worker may hold
WINDOW = 1 << 20  # characters that are laid out at once
_engines: dict[str, "PieceCodec"] = {}


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: numbers, and raw bytes of fixed or counted fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """Vocabulary and settings of a model file: pieces with scores and types, algorithm, normaliser."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.prefix, self.squeeze, self.escape, self.charsmap = UNIGRAM, True, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                self.prefix, self.squeeze, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
                self.charsmap = own.get(2, b"")
        if self.charsmap:
            raise ValueError("models whose normaliser rewrites characters are not supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER)}
        self.longest = max(map(len, self.ids), default=1)
        # Every ending of a piece: its id, or -1 if it is no piece itself.
        self.endings = {p[i:]: -1 for p in self.ids for i in range(1, len(p))} | self.ids


class PieceCodec:
    """Encoder and decoder of one model."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._pairs: dict[tuple[str, str], bool] = {}
        self.penalty = min(model.scores, default=0.0) - 10.0
        # neighbours[x, y]: some piece holds y right after x. The last two rows: the space mark, and all rarer characters.
        self.joined = np.zeros((1026, 1026), bool)
        self.joined[1025, :] = self.joined[:, 1025] = True
        for piece in model.ids:
            own = [self._row(c) for c in piece]
            self.joined[own[:-1], own[1:]] = True
        # The mark never follows anything but itself in most vocabularies, rarer characters included.
        self.joined[1025, 1024] = any(a != MARK and ord(a) > 1023 and b == MARK for p in model.ids for a, b in zip(p, p[1:], strict=False))
        self.cache = Pieces(lambda parts: [self.encode_part(p) for p in parts], PARTS)

    @staticmethod
    def _row(c: str) -> int:
        return ord(c) if ord(c) < 1024 else 1024 if c == MARK else 1025

    # -- lattice ------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Merge neighbours by score, leftmost first, until no pair is a piece."""
        ids, scores = self.model.ids, self.model.scores
        own = list(text)
        while len(own) > 1:
            best = None
            for i in range(len(own) - 1):
                pair = ids.get(own[i] + own[i + 1])
                if pair is not None and (best is None or scores[pair] > best[0]):
                    best = (scores[pair], i)
            if best is None:
                break
            own[best[1] : best[1] + 2] = [own[best[1]] + own[best[1] + 1]]
        return own

    def admissible(self, before: str, piece: str) -> bool:
        key = (before, piece)
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self.merged(before + piece) == [before, piece] if before else self.merged(piece) == [piece]
        return found

    def path(self, text: str, window: int | None = None) -> Iterator[str]:
        """Pieces of the best path, each as soon as it is settled."""
        return self.walk([text], window)

    def walk(self, parts: Iterable[str], window: int | None = None) -> Iterator[str]:
        """Like :meth:`path` for a text that comes in parts; only what is not yet settled is held of it."""
        model, longest = self.model, self.model.longest
        bpe, endings, scores, pairs = model.kind == BPE, model.endings, model.scores, self._pairs
        every = window or longest
        text, back, total = "", {0: 0}, {0: 0.0}
        done = 0

        def trail(end: int) -> list[str]:
            cut = []
            while end > done:
                cut.append(text[back[end] : end])
                end = back[end]
            return cut[::-1]

        for part in parts:
            end, text = len(text), text + part
            while end < len(text):
                end += 1
                best, top = -1, 0.0
                # Walk back as long as some piece ends in what was passed.
                for start in range(end - 1, max(done, end - longest) - 1, -1):
                    piece = text[start:end]
                    known = endings.get(piece)
                    if known is None:
                        if end - start > 1:
                            break
                        known = -1
                    if start not in back or (known == -1 and end - start > 1):
                        continue
                    if bpe:
                        before = text[back[start] : start]
                        fits = pairs.get((before, piece))
                        if fits or (fits is None and self.admissible(before, piece)):
                            best = start
                            break
                    else:
                        score = total[start] + (self.penalty if known == -1 else scores[known])
                        if best < 0 or score >= top:
                            best, top = start, score
                if best >= 0:
                    back[end] = best
                    if not bpe:
                        total[end] = top
                if (end - done) % every:
                    continue
                common = None
                for p in range(max(end - longest + 1, done), end + 1):
                    if p not in back:
                        continue
                    met = set()
                    while p > done:
                        met.add(p)
                        p = back[p]
                    common = met if common is None else common & met
                if common:
                    stop = max(common)
                    yield from trail(stop)
                    # Keep the state behind the settled boundary: BPE asks which piece led to it.
                    keep = back[stop]
                    back = {p - keep: b - keep for p, b in back.items() if p >= stop}
                    total = {p - keep: t for p, t in total.items() if p >= stop}
                    text, end, done = text[keep:], end - keep, stop - keep
        yield from trail(len(text))

    def encode_part(self, part: str) -> list[int]:
        return self.ids_of(self.path(part))

    def ids_of(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            known = self.model.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.model.bytes:
                out += [self.model.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.model.unknown:
                out.append(self.model.unknown)
        return out

    # -- texts --------------------------------------------------------------------------------

    def normal(self, text: str | None) -> str:
        if not text:
            return ""
        if self.model.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if self.model.prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def encode(self, texts: list[str | None], window: int = WINDOW) -> list[np.ndarray]:
        """Ids of whole texts, many short ones at once, long ones window by window."""
        out: list[np.ndarray] = []
        held: list[str] = []
        for text in map(self.normal, texts):
            if len(text) > window:
                out += [*self._laid_out(held)[0], np.concatenate(list(self.stream(text, window)))]
                held = []
            else:
                held.append(text)
        return out + self._laid_out(held)[0]

    def stream(self, text: str, window: int = WINDOW) -> Iterator[np.ndarray]:
        """Ids of a normal text as they are settled.

        What follows the last cut of a window is carried into the next one. A part that spans more than a window is
        walked as it comes, so no character is laid out more than twice and walked more than once.
        """
        at, carried = 0, ""
        while at < len(text):
            part = carried + text[at : at + window]
            at += window
            (ids,), last = self._laid_out([part], open_end=at < len(text))
            carried = part[last:]
            yield ids
            if len(carried) >= window:
                rest: list[str] = []

                def uncut(first: str = carried, rest: list[str] = rest) -> Iterator[str]:
                    nonlocal at
                    yield first
                    before = first[-1]
                    while at < len(text):
                        more = text[at : at + window]
                        at += len(more)
                        cuts = np.flatnonzero(self._starts(code_points([before + more])[1])[1:])
                        if len(cuts):
                            yield more[: cuts[0]]
                            rest.append(more[cuts[0] :])
                            return
                        yield more
                        before = more[-1]

                yield np.array(self.ids_of(self.walk(uncut())), np.int32)
                carried = "".join(rest)
                if at >= len(text) and carried:
                    yield self._laid_out([carried])[0][0]

    def _starts(self, cp: np.ndarray) -> np.ndarray:
        """Where neighbours never meet inside a piece, the first character included."""
        row = np.minimum(cp, 1025).astype(np.int64)
        row[cp == ord(MARK)] = 1024
        row[(cp == 1024)] = 1025
        start = np.ones(len(cp), bool)
        start[1:] = ~self.joined[row[:-1], row[1:]]
        return start

    def _laid_out(self, texts: list[str], open_end: bool = False) -> tuple[list[np.ndarray], int]:
        """Ids of texts that are cut together; with ``open_end`` without what follows the last cut, and where that is."""
        whole, cp, bounds = code_points(texts)
        if not len(cp):
            return [np.zeros(0, np.int32) for _ in texts], 0
        start = self._starts(cp)
        start[bounds[:-1][bounds[:-1] < len(cp)]] = True
        starts, stop = np.flatnonzero(start), len(cp)
        if open_end:
            starts, stop = starts[:-1], int(starts[-1])
            if not stop:
                return [np.zeros(0, np.int32)], 0
            bounds = np.array([0, stop])
        ids, at = self.cache.ids(whole, cp[:stop], starts, stop)
        cut = at[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], stop

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that form no character become replacement characters."""
        if not hasattr(self, "_table"):
            table = []
            for piece, kind in zip(self.model.pieces, self.model.types, strict=True):
                if kind == BYTE:
                    table.append(bytes([int(piece[3:5], 16)]))
                elif kind == UNKNOWN:
                    table.append(" ⁇ ".encode())
                elif kind == CONTROL:
                    table.append(b"")
                else:
                    table.append((piece.replace(MARK, " ") if self.model.escape else piece).encode())
            self._table = table
        text = b"".join(map(self._table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


def codec(path: str) -> PieceCodec:
    """One codec a worker process; its cache outlives tasks."""
    if path not in _engines:
        with open(path, "rb") as f:
            _engines[path] = PieceCodec(PieceModel(f.read()))
    return _engines[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = codec(path)
        for texts in slices(batches):
            own = texts.rows.column(1).to_pylist()
            rows = engine.encode(own)
            same = [engine.decode(r) == (t or "") for r, t in zip(rows, own, strict=True)]
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [texts.rows.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(same), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(rows)))],
                ["doc_id", "n_pieces", "round_trip", "ids"],
            )

    return run


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pieces, round_trip, ids`` of every document's whole text.

    ``round_trip`` tells whether decoding the ids gives the text back. A null text counts as empty and
    has no ids. Ids of rows are passed through, null ones too; repeated rows are encoded alike;
    other columns are ignored; an empty table gives an empty result.
    """
    bounded(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(lean(_encode(model), "pieces"), f"doc_id {kind}, n_pieces long, round_trip boolean, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = codec(path)
        for rows in batches:
            texts = [None if r is None else engine.decode(np.asarray(r, np.int64)) for r in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from stored ids; null ids give a null text."""
    source = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(lean(_decode(model), "pieces"), f"doc_id {kind}, text string")
