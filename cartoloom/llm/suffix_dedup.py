"""Removal of byte passages that already occurred earlier in the corpus.

A byte goes if some ``length``-byte string that covers it also starts earlier: in a document
of smaller id, or earlier in its own. In terms of the longest-previous-factor array of the texts laid end to
end with breaks between them: bytes ``p .. p + LPF[p]`` go for every ``p`` with ``LPF[p] >= length``. The
earlier match of a suffix that is longest is, in suffix order, its previous or its next one of smaller position.

One suffix array over the whole corpus would be one task. Instead every ``length``-byte string
is dealt by its *anchor*, the leftmost minimum among the hashes of its ``gram``-byte pieces.
Equal strings have equal anchors, so all their copies meet. Consecutive strings of one anchor are
handled as a *stretch*:

1. a scan finds the stretches of every document and deals (anchor hash, stretch hash, place) by
   anchor. A stretch that equals an earlier one is covered whole, without looking at its text;
2. where an anchor has several different stretches, the first of each is fetched as text; a suffix array
   of what may repeat in it (by prefix doubling) and its previous and next smaller positions give LPF;
3. the covered ranges of a document are united and cut out.

Cells of packed columns move through the shuffles. Copies of one stretch within a task's slice
are reduced to the earliest before the shuffle, so a passage that a third of all documents share
arrives a few times a task. An anchor with very many different stretches is dealt again, string
by string, on the strings' own hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .packing import CELL, cells_batch, dealt, joined, pack, unpack
from .scratch import bounded, staged
from .textbytes import merged, mix, powers, prefix_hash, slices, span_hash
from .workers import lean, lean_group

LENGTH, GRAM = 100, 24
BUCKET_BYTES = 6 << 20
HOT_STRETCHES = 4096
FLUSH_ROWS = 300_000
ANCHORS, COVERED, WANTED, TEXTS = 0, 1, 2, 3
SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive ``length``-byte strings with one anchor.

    Returns the document index, first start, number of starts, anchor hash and hash of the
    stretch's whole text.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    p = prefix_hash(data)
    _, inverse = powers(n + 1)
    grams = mix((p[gram:] - p[:-gram]) * inverse[: n - gram + 1])
    low = np.uint64(0xFFFFFFFF)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    anchor = (least & low).astype(np.int64)  # of the string at each start
    inside = np.zeros(n + 2, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - length + 1, -1)
    valid = np.cumsum(inside[: len(anchor)]) > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    count = last - first + 1
    whole = mix(span_hash(p, first, last + length) + count.astype(np.uint64))
    doc = np.searchsorted(offsets, first, "right") - 1
    return doc, first - offsets[doc], count, grams[anchor[first]], whole


def united(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of byte ranges per document; touching ranges become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    group = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    lift = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], start[1:] + lift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [len(doc) - 1]])
    return doc[at], start[at], reach[last] - lift[last]


def _spread(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64) + SALT) % np.uint64(buckets)).astype(np.int32)


def _covered_cells(doc: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    doc, start, end = united(doc, start, end)
    return dealt(_spread(doc, buckets), COVERED, [doc, start.astype(np.uint32), end.astype(np.uint32)])


def _earliest(h: np.ndarray, whole: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """Order by (anchor, stretch, place); which rows lead their stretch, and which come later than their leader."""
    order = np.lexsort((start, doc, whole, h))
    h, whole, doc, start = h[order], whole[order], doc[order], start[order]
    leads = np.ones(len(h), bool)
    leads[1:] = (h[1:] != h[:-1]) | (whole[1:] != whole[:-1])
    leader = np.flatnonzero(leads)[np.cumsum(leads) - 1] if len(h) else np.zeros(0, np.int64)
    later = (doc != doc[leader]) | (start != start[leader])
    return order, leads, later


def _scan(length: int, gram: int, buckets: int):
    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, start, count, h, whole = (np.concatenate(c) for c in zip(*held, strict=True))
        order, leads, later = _earliest(h, whole, doc, start)
        doc, start, count, h, whole = (c[order] for c in (doc, start, count, h, whole))
        rows = _covered_cells(doc[later], start[later], start[later] + count[later] + length - 1, buckets)
        doc, start, count, h, whole = (c[leads] for c in (doc, start, count, h, whole))
        order = np.lexsort((start, doc))  # compresses well
        rows += dealt((h[order] % np.uint64(buckets)).astype(np.int32), ANCHORS, [h[order], whole[order], doc[order], start[order].astype(np.uint32), count[order].astype(np.uint8)])
        return cells_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for texts in slices(batches):
            ids = texts.rows.column(0).to_numpy(zero_copy_only=False)
            doc, *rest = stretches(texts.data, texts.offsets, length, gram)
            if len(doc):
                held.append((ids[doc], *rest))
                size += len(doc)
            if size >= FLUSH_ROWS:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _compare(length: int, buckets: int, hot: int):
    kinds = [np.uint64, np.uint64, np.int64, np.uint32, np.uint8]

    def run(table: pa.Table) -> pa.Table:
        cells, of = table.column("cell").to_pylist(), table.column("kind").to_numpy()
        h, whole, doc, start, count = joined([c for c, k in zip(cells, of, strict=True) if k == ANCHORS], kinds)
        order, leads, later = _earliest(h, whole, doc, start)
        h, whole, doc, start, count = (c[order] for c in (h, whole, doc, start, count))
        # Covered cells of the scan pass through: they are dealt by document already.
        rows = [(int(table.column("bucket")[i].as_py()), COVERED, cells[i]) for i in np.flatnonzero(of == COVERED)]
        rows += _covered_cells(doc[later], start[later].astype(np.int64), start[later].astype(np.int64) + count[later] + length - 1, buckets)
        h, doc, start, count = (c[leads] for c in (h, doc, start, count))
        if len(h):
            cut = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            many = np.repeat(np.diff(cut), np.diff(cut))
            ask = many > 1
            rows += dealt(_spread(doc[ask], buckets), WANTED, [h[ask], doc[ask], start[ask], count[ask], many[ask] > hot])
        return pa.Table.from_batches([cells_batch(rows)])

    return run


def _pack_texts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in merged(batches, most=4 << 20):
            ids = texts.rows.column(0)
            known = np.asarray(ids.is_valid())
            own = ids.fill_null(0).to_numpy(zero_copy_only=False)
            bucket = _spread(own, buckets)
            rows = []
            for b in np.unique(bucket):
                at = np.flatnonzero(bucket == b)
                sizes = texts.offsets[at + 1] - texts.offsets[at]
                body = np.concatenate([texts.data[texts.offsets[i] : texts.offsets[i + 1]] for i in at])
                rows.append((int(b), TEXTS, pack(own[at], known[at], sizes, body, _stored(texts.rows.slice(0, 0) if texts.rows.num_columns < 3 else texts.rows.select([2]).take(pa.array(at))))))
            yield cells_batch(rows)

    return run


def _stored(rows: pa.RecordBatch) -> np.ndarray:
    """Carried columns as bytes that keep all Arrow types; nothing if there are none."""
    if not rows.num_rows:
        return np.zeros(0, np.uint8)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return np.frombuffer(sink.getvalue(), np.uint8)


def _texts_of(cells: list[bytes]) -> Iterator[tuple[int | None, np.ndarray]]:
    for cell in cells:
        ids, known, sizes, body, _ = unpack(cell)
        ends = np.cumsum(sizes)
        for i in range(len(ids)):
            yield (int(ids[i]) if known[i] else None), body[ends[i] - sizes[i] : ends[i]]


def _carried(cells: list[bytes]) -> list[pa.Array]:
    """Carried rows of all texts, in the order of :func:`_texts_of`."""
    stored = [unpack(cell)[4] for cell in cells]
    return [chunk for raw in stored if len(raw) for chunk in pa.ipc.open_stream(pa.py_buffer(raw.tobytes())).read_all().column(0).chunks]


def _fetch(length: int, gram: int, buckets: int):
    """Cut the text of wanted stretches out of the documents and deal it by anchor (hot anchors: by string)."""
    kinds = [np.uint64, np.int64, np.uint32, np.uint8, np.bool_]

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        h, doc, start, count, hot = joined(wanted.column("cell").to_pylist(), kinds)
        order = np.argsort(doc, kind="stable")
        h, doc, start, count, hot = (c[order] for c in (h, doc, start.astype(np.int64), count.astype(np.int64), hot))
        bodies, picked = [], []
        for own, body in _texts_of(texts.column("cell").to_pylist() if len(h) else []):
            if own is None:
                continue
            a, b = np.searchsorted(doc, [own, own + 1])
            for i in range(a, b):
                if start[i] + count[i] + length - 1 <= len(body):
                    bodies.append(body[start[i] : start[i] + count[i] + length - 1])
                    picked.append(i)
        rows: list[tuple[int, int, bytes]] = []
        if picked:
            h, doc, start, count, hot = (c[picked] for c in (h, doc, start, count, hot))
            sizes = count + length - 1
            body = np.concatenate(bodies)
            at = np.cumsum(sizes) - sizes
            if hot.any():
                every, left = np.flatnonzero(hot), np.flatnonzero(~hot)
                rank = np.concatenate([np.arange(count[i]) for i in every])
                parent = np.repeat(every, count[every])
                own = at[parent] + rank
                name = mix(span_hash(prefix_hash(body), own, own + length))
                keep = np.lexsort((start[parent] + rank, doc[parent], name))
                first = np.concatenate([[True], name[keep][1:] != name[keep][:-1]])
                lead = keep[np.flatnonzero(first)[np.cumsum(first) - 1]]
                late = keep[(doc[parent][keep] != doc[parent][lead]) | ((start[parent] + rank)[keep] != (start[parent] + rank)[lead])]
                begin = start[parent[late]] + rank[late]
                rows += _covered_cells(doc[parent[late]], begin, begin + length, buckets)
                one = keep[first]
                body = np.concatenate([*(body[at[i] : at[i] + sizes[i]] for i in left), body[own[one][:, None] + np.arange(length)].ravel()])
                h = np.concatenate([h[left], name[one]])
                doc = np.concatenate([doc[left], doc[parent[one]]])
                start = np.concatenate([start[left], start[parent[one]] + rank[one]])
                count = np.concatenate([count[left], np.ones(len(one), np.int64)])
                sizes = count + length - 1
                at = np.cumsum(sizes) - sizes
            bucket = (h % np.uint64(buckets)).astype(np.int32)
            for b in np.unique(bucket):
                mine = np.flatnonzero(bucket == b)
                part = np.concatenate([body[at[i] : at[i] + sizes[i]] for i in mine])
                rows.append((int(b), TEXTS, pack(h[mine], doc[mine], start[mine].astype(np.uint32), count[mine].astype(np.uint8), part)))
        return pa.Table.from_batches([cells_batch(rows)])

    return run


SYMBOLS = 7  # of 9 bits each in the first sorting key


def suffix_ranks(text: np.ndarray, ends: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 7, 14, 28, ... bytes, until these reach the end of every piece.

    ``ends`` gives, for each position, where its piece of the text ends; nothing is read beyond.
    """
    n = len(text)
    at = np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(SYMBOLS):
        key <<= 9
        inside = at + k < ends
        key[inside] += text[at[inside] + k].astype(np.int64) + 1
    levels, width = [], SYMBOLS
    longest = int((ends - at).max())
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
        levels.append((width, rank))
        if width >= longest:
            return levels
        inside = at + width < ends
        key = rank.astype(np.int64) * (n + 1)
        key[inside] += rank[at[inside] + width] + 1
        width *= 2


def common_prefix(text: np.ndarray, ends: np.ndarray, levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at ``i`` and at ``j`` have in common, each within its piece; 0 where ``j`` is negative."""
    a, b, last = i.copy(), np.maximum(j, 0), len(text) - 1
    stop_a, stop_b = ends[i], np.where(j < 0, 0, ends[b])
    for width, rank in reversed(levels):
        same = (a < stop_a) & (b < stop_b) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])
        step = np.where(same, np.minimum(width, stop_a - a), 0)
        a, b = a + step, b + step
    for _ in range(SYMBOLS - 1):
        same = (a < stop_a) & (b < stop_b) & (text[np.minimum(a, last)] == text[np.minimum(b, last)])
        a, b = a + same, b + same
    return a - i


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it that is smaller, or -1: minima of blocks of 1, 2, 4, ... are skipped from large to small."""
    n = len(values)
    minima = [values]
    while 2 ** len(minima) <= n:
        half, last = 2 ** (len(minima) - 1), minima[-1]
        both = last.copy()
        both[half:] = np.minimum(last[half:], last[:-half])
        minima.append(both)
    at = np.arange(n) - 1
    for k in range(len(minima) - 1, -1, -1):
        skip = (at - 2**k + 1 >= 0) & (minima[k][np.maximum(at, 0)] >= values)
        at[skip] -= 2**k
    return at


def longest_previous_factors(text: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
    """LPF: the longest common prefix of each suffix with one of a smaller place.

    In suffix order the best earlier match of a suffix is its previous or its next one of smaller place (PSV, NSV).
    Places may be equal; then neither is earlier.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    levels = suffix_ranks(text, ends)
    order = np.argsort(levels[-1][1], kind="stable")
    sorted_ = place[order]
    before, after = previous_smaller(sorted_), previous_smaller(sorted_[::-1])[::-1]
    after = np.where(after >= 0, n - 1 - after, -1)
    best = np.zeros(n, np.int64)
    for near in (before, after):
        best[order] = np.maximum(best[order], common_prefix(text, ends, levels, order, np.where(near >= 0, order[near], -1)))
    return best


def _decide(length: int, buckets: int, chunk: int = 1 << 19):
    kinds = [np.uint64, np.int64, np.uint32, np.uint8, np.uint8]

    def run(table: pa.Table) -> pa.Table:
        cells, of = table.column("cell").to_pylist(), table.column("kind").to_numpy()
        rows = [(int(table.column("bucket")[i].as_py()), COVERED, cells[i]) for i in np.flatnonzero(of == COVERED)]
        h, doc, start, count, body = joined([c for c, k in zip(cells, of, strict=True) if k == TEXTS], kinds)
        if len(h):
            count, start = count.astype(np.int64), start.astype(np.int64)
            at = np.cumsum(count + length - 1) - (count + length - 1)
            parent = np.repeat(np.arange(len(h)), count)
            rank = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
            own = at[parent] + rank
            # A string that occurs once here has no match, and equal strings have equal hashes: only runs of others need an order.
            name = mix(span_hash(prefix_hash(body), own, own + length))
            order = np.argsort(name, kind="stable")
            twin = np.zeros(len(name) + 1, bool)
            equal = name[order][1:] == name[order][:-1]
            twin[order[1:][equal]] = True
            twin[order[:-1][equal]] = True
            opens = twin[:-1].copy()
            opens[1:] &= ~twin[:-2] | (parent[1:] != parent[:-1])
            closes = twin[:-1].copy()
            closes[:-1] &= ~twin[1:-1] | (parent[1:] != parent[:-1])
            first, last = np.flatnonzero(opens), np.flatnonzero(closes)
            # Runs of one anchor stay together; anchors are taken as far as a chunk goes.
            by = np.argsort(h[parent[first]], kind="stable")
            first, size = first[by], (last - first)[by] + length
            anchor, upto = h[parent[first]], np.cumsum(size)
            edges = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(first)]])
            a, late = 0, []
            while a < len(edges) - 1:
                begin = upto[edges[a]] - size[edges[a]] if len(first) else 0
                b = max(a + 1, int(np.searchsorted(upto[edges[1:] - 1], begin + chunk, "right"))) if len(first) else len(edges) - 1
                lo, hi = edges[a], edges[b]
                a = b
                if hi == lo:
                    continue
                run_size, run_doc, run_start = size[lo:hi], doc[parent[first[lo:hi]]], start[parent[first[lo:hi]]] + rank[first[lo:hi]]
                stop = np.cumsum(run_size)
                which = np.repeat(np.arange(hi - lo), run_size)
                inner = np.arange(stop[-1]) - (stop - run_size)[which]
                place = np.unique(np.unique(run_doc, return_inverse=True)[1][which] * (1 << 33) + run_start[which] + inner, return_inverse=True)[1].astype(np.int32)
                lpf = longest_previous_factors(body[own[first[lo:hi]][which] + inner], stop[which], place)
                hit = np.flatnonzero(lpf >= length)
                late.append((run_doc[which[hit]], run_start[which[hit]] + inner[hit], run_start[which[hit]] + inner[hit] + lpf[hit]))
            if late:
                rows += _covered_cells(*(np.concatenate(c) for c in zip(*late, strict=True)), buckets)
        return pa.Table.from_batches([cells_batch(rows)])

    return run


def _cut(rows: bool, kind: pa.DataType | None):
    def run(texts: pa.Table, ranges: pa.Table) -> pa.Table:
        doc, start, end = united(*joined(ranges.column("cell").to_pylist(), [np.int64, np.uint32, np.uint32]))
        cells = texts.column("cell").to_pylist()
        ids, sizes, removed, spans, digests, kept_texts = [], [], [], [], [], []
        for own, body in _texts_of(cells):
            a, b = np.searchsorted(doc, [own, own + 1]) if own is not None else (0, 0)
            lo, hi = np.minimum(start[a:b], len(body)), np.minimum(end[a:b], len(body))
            some = hi > lo
            lo, hi = lo[some], hi[some]
            edges = np.concatenate([[0], np.stack([lo, hi], 1).ravel(), [len(body)]]).astype(np.int64)
            raw = body.tobytes()
            kept = b"".join(raw[x:y] for x, y in edges.reshape(-1, 2))
            ids.append(own)
            sizes.append(len(raw))
            removed.append(int((hi - lo).sum()))
            spans.append(len(lo))
            digests.append(hashlib.sha256(kept).hexdigest())
            if rows:
                # Whole characters only: one that a cut would split stays out with the removed passage.
                kept_texts.append(kept.decode("utf-8", "ignore"))
        out = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if rows:
            out["kept_text"] = pa.array(kept_texts, pa.string())
            out["row"] = pa.chunked_array([c.cast(kind) for c in _carried(cells)], kind)
        return pa.table(out)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, rows: bool = False, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT_STRETCHES) -> DataFrame:
    """Cut bytes covered by a ``length``-byte string that also starts earlier (smaller id, or same document and earlier start).

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``rows``,
    ``kept_text`` (remaining bytes as text; a character of which only a part remains is dropped) and
    a struct ``row`` of all columns but id and text, unchanged.
    Strings are judged on the input and never cross documents. A null text counts as empty. Texts
    shorter than ``length`` stay whole. Rows with a null id have no place in the order: they stay
    whole and remove nothing. Rows that repeat an id are one document: they do not remove each
    other, and a range removed in one is removed in all. Other columns are ignored; an empty
    table gives an empty result.
    """
    if not 0 < gram <= length <= 255 + gram - 1:
        raise ValueError("gram must be between 1 and length, and length - gram at most 254")
    bounded(docs.sparkSession)
    others = [c for c in docs.columns if c not in (id_col, text_col)] if rows else []
    carried = F.struct(*(F.col(c) for c in others)) if others else F.struct(F.lit(0).alias("none"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([carried.alias("row")] if rows else []))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(max(64, total // bucket_bytes), 1 << 30))

    cells = source.select("doc_id", "text").where("doc_id is not null").mapInArrow(lean(_scan(length, gram, buckets)), CELL)
    compared = staged(cells.groupBy("bucket").applyInArrow(lean_group(_compare(length, buckets, hot)), CELL), "compared")
    texts = source.mapInArrow(lean(_pack_texts(buckets)), CELL)
    wanted = compared.where(F.col("kind") == WANTED)
    fetched = texts.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(lean_group(_fetch(length, gram, buckets)), CELL)
    decided = fetched.groupBy("bucket").applyInArrow(lean_group(_decide(length, buckets)), CELL)
    ranges = compared.where(F.col("kind") == COVERED).unionByName(decided)
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    kind = None
    if rows:
        schema = schema.add("kept_text", T.StringType()).add(source.schema["row"])
        kind = to_arrow_type(source.schema["row"].dataType)
    return texts.groupBy("bucket").cogroup(ranges.groupBy("bucket")).applyInArrow(lean_group(_cut(rows, kind)), schema)
