"""Near-duplicate grouping by SuperMinHash signatures.

A document's elements are its distinct word shingles. SuperMinHash walks, for every element, a
random permutation of the signature's places and offers ``rank + uniform`` to the place met at
that rank; ranks are used up without replacement, so the places of one element are negatively
correlated and the signature varies less than independent minima do. A document stops as soon
as all its places hold values below the next rank, usually after one or two ranks.

Plan: one scan makes signatures; documents with equal shingle sets collapse to one
representative; bands of the representatives' signatures give buckets; every bucket is a star
around its smallest member. A star's members meet, in blocks of bounded size that all contain
the centre, for verification on full shingle sets, and verified links go to union-find. In a star of
several blocks, members that are then not joined to the centre meet the members of the other blocks as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import bounded, staged
from .textbytes import Texts, mix, prefix_hash, slices, span_hash
from .workers import lean, lean_group

WORDS, SIMILAR = 5, (75, 100)
BANDS, ROWS = 24, 4
BLOCK, BLOCK_SHINGLES = 192, 400_000
SALTS = 16
SLOTS = 65536


def shingle_sets(texts: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document, end to end, and their bounds."""
    starts, ends, first = texts.words()
    hashes = mix(span_hash(prefix_hash(texts.data, fold_case=True), starts, ends) + (ends - starts).astype(np.uint64))
    counts = np.diff(first)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    if n >= words:
        full = rolled[: n - words + 1]
        for k in range(words):
            full *= np.uint64(0xD6E8FEB86659FD93)
            full += hashes[k : n - words + 1 + k]
    rolled = mix(rolled)
    sets, bounds = [], np.zeros(len(texts) + 1, np.int64)
    for i in range(len(texts)):
        if counts[i] >= words:
            own = np.sort(rolled[first[i] : first[i + 1] - words + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif counts[i]:
            own = np.full(1, counts[i], np.uint64)
            for h in hashes[first[i] : first[i + 1]]:
                own = mix(own * np.uint64(0xA0761D6478BD642F) + h)
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
        bounds[i + 1] = bounds[i] + len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def superminhash(elements: np.ndarray, bounds: np.ndarray, places: int) -> np.ndarray:
    """Signatures, one row of ``places`` values a set; a value holds rank (high half) and uniform part (low half).

    A row of an empty set keeps the largest value everywhere.
    """
    sets = len(bounds) - 1
    top = np.uint64(2**64 - 1)
    table = np.full(sets * places, top, np.uint64)
    of = np.repeat(np.arange(sets), np.diff(bounds))
    order = None
    for rank in range(places):
        if not len(elements):
            break
        draw = mix(elements ^ mix(np.array([rank + 1], np.uint64))[0])
        chosen = rank + ((draw >> np.uint64(32)) % np.uint64(places - rank)).astype(np.int64)
        value = (np.uint64(rank) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF))
        if order is None:
            place = chosen
        else:
            row = np.arange(len(elements))
            place = order[row, chosen].astype(np.int64)
            order[row, chosen] = order[:, rank]
            order[:, rank] = place
        np.minimum.at(table, of * places + place, value)
        # Early stop: a later offer is at least rank + 1.
        open_ = (table.reshape(sets, places).max(axis=1) >> np.uint64(32)) > np.uint64(rank)
        keep = open_[of]
        if order is None:
            elements, of, chosen = elements[keep], of[keep], chosen[keep]
            order = np.tile(np.arange(places, dtype=np.int16), (len(elements), 1))
            order[np.arange(len(elements)), chosen] = 0
            order[:, 0] = chosen
        elif not keep.all():
            elements, of, order = elements[keep], of[keep], order[keep]
    return table.reshape(sets, places)


def _signatures(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            elements, bounds = shingle_sets(texts, words)
            sizes = np.diff(bounds)
            table = superminhash(elements, bounds, bands * rows).reshape(len(texts), bands, rows)
            keys = np.zeros((len(texts), bands), np.uint64)
            for r in range(rows):
                keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + table[:, :, r])
            keys = mix(keys + np.arange(1, bands + 1, dtype=np.uint64))
            total = np.zeros((2, len(elements) + 1), np.uint64)
            np.cumsum(mix(elements), out=total[0, 1:])
            np.cumsum(mix(elements ^ np.uint64(0x5851F42D4C957F2D)), out=total[1, 1:])
            digest = total[:, bounds[1:]] - total[:, bounds[:-1]]
            flat = pa.array(keys.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [texts.rows.column(0), pa.array(sizes), *(pa.array(d.view(np.int64)) for d in digest), pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), flat)],
                ["doc_id", "n_shingles", "d1", "d2", "bands"],
            )

    return run


def shared_counts(sets: list[np.ndarray], i: int, js: np.ndarray) -> np.ndarray:
    """How many elements set ``i`` has in common with each set of ``js``."""
    joined = np.concatenate([sets[j] for j in js])
    at = np.searchsorted(sets[i], joined)
    at[at == len(sets[i])] = 0
    hit = sets[i][at] == joined
    ends = np.cumsum([len(sets[j]) for j in js])
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def similar_pairs(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links ``(i, j)`` within one block of sorted distinct sets that connect it as all its links would.

    Set 0 is the centre. Every set is compared with it; sets it doesn't link are compared with
    all others. Sizes and counts of shared elements decide exactly.
    """

    sizes = np.array([len(s) for s in sets])
    links: list[tuple[int, int]] = []
    pending = [0]
    done = np.zeros(len(sets), bool)
    first = True
    while pending:
        i = pending.pop()
        done[i] = True
        js = np.flatnonzero(~done if first else (np.arange(len(sets)) != i) & (np.arange(len(sets)) != 0) & ~(done & (np.arange(len(sets)) != 0)))
        low, high = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
        js = js[den * low >= num * high]
        if len(js):
            common = shared_counts(sets, i, js)
            linked = den * common >= num * (sizes[i] + sizes[js] - common)
            links += [(i, int(j)) for j in js[linked]]
        else:
            linked = np.zeros(0, bool)
        if first:
            direct = set(js[linked].tolist())
            pending = [j for j in range(1, len(sets)) if j not in direct]
            first = False
    return links


def _verify(words: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        sets = []
        for texts in slices(table.select(["text"]).combine_chunks().to_batches()):
            elements, bounds = shingle_sets(texts, words)
            sets += [elements[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        order = np.argsort(ids, kind="stable")
        order = np.concatenate([order[ids[order] == table.column("centre")[0].as_py()], order[ids[order] != table.column("centre")[0].as_py()]])
        pairs = similar_pairs([sets[i] for i in order], num, den)
        u = ids[order[[max(p) for p in pairs]]] if pairs else np.zeros(0, np.int64)
        v = ids[order[[min(p) for p in pairs]]] if pairs else np.zeros(0, np.int64)
        return pa.table({"u": np.asarray(u, np.int64), "v": np.asarray(v, np.int64)})

    return run


def joining_pairs(sets: list[np.ndarray], root: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between ``left`` and ``right`` (or within ``left`` if they are the same) that join sets of different ``root``.

    Pairs that roots or earlier links join already are passed over.
    """
    sizes, root = np.array([len(s) for s in sets]), root.copy()
    within = np.array_equal(left, right)
    links: list[tuple[int, int]] = []
    for k, i in enumerate(left):
        js = right[k + 1 :] if within else right
        js = js[root[js] != root[i]]
        js = js[den * np.minimum(sizes[js], sizes[i]) >= num * np.maximum(sizes[js], sizes[i])]
        if len(js):
            common = shared_counts(sets, i, js)
            for j in js[den * common >= num * (sizes[i] + sizes[js] - common)]:
                if root[j] != root[i]:
                    links.append((int(i), int(j)))
                    root[root == root[j]] = root[i]
    return links


def _across(words: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        ids, own = table.column("doc_id").to_numpy(), table.column("own").to_numpy()
        sets = []
        for texts in slices(table.select(["text"]).combine_chunks().to_batches()):
            elements, bounds = shingle_sets(texts, words)
            sets += [elements[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        left, right = (np.flatnonzero(own == table.column(c)[0].as_py()) for c in ("low", "high"))
        pairs = joining_pairs(sets, table.column("component").to_numpy(), left, right, num, den)
        return pa.table({"u": np.array([ids[i] for i, _ in pairs], np.int64), "v": np.array([ids[j] for _, j in pairs], np.int64)})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: tuple[int, int] = SIMILAR, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``similar`` (a fraction) or more.

    Returns ``doc_id, n_shingles, component_id, kept``: the smallest id reachable by links and
    whether it is the document's own. Words are runs of bytes other than ASCII white space, with
    A-Z lowered; a document of fewer words than a shingle has its whole sequence as one element.
    Null or empty texts have no elements and link with nothing. Rows with a null id are returned
    with a null component and are not kept. Repeated rows of one id count as one document if
    their texts agree (each row is returned); if not, all of them share that id's component.
    Other columns are ignored. An empty table gives an empty result.

    A pair at the threshold itself is missed by the bands with probability
    ``(1 - s**rows)**bands`` (1.0e-4 at 0.75, 3e-6 at 0.8); no bucket is capped. Stars of more
    than ``block`` members are verified in blocks that each contain the centre; then members that links have not
    joined to the centre are compared, block against block, with all others of the star.
    """
    num, den = similar
    bounded(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = staged(source.mapInArrow(lean(_signatures(words, bands, rows)), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "signatures")

    live = signed.where("n_shingles > 0 and doc_id is not null")
    # Classes of several documents are repeated for each salt, so a class of any size is spread over tasks.
    several = live.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("n")
    salted = live.select("doc_id", "d1", "d2", "n_shingles", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    member = salted.join(several.hint("merge"), ["d1", "d2", "n_shingles", "salt"], "left")
    member = staged(member.select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    reps = live.join(member.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")

    banded = reps.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    stars = banded.groupBy("band", "key").agg(F.min("doc_id").alias("centre"), F.count("*").alias("n")).where("n > 1")
    spokes = banded.join(stars, ["band", "key"]).where("doc_id <> centre").select("centre", "doc_id", "n_shingles").distinct()
    spokes = staged(spokes, "spokes")
    # Blocks of a star, bounded by members and by shingles: members are dealt by a hash, the centre goes to every block.
    dealt = spokes.groupBy("centre").agg(_blocks(F.lit(True), block).alias("blocks"))
    asked = (
        spokes.join(dealt, "centre")
        .select("doc_id", "centre", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("part"))
        .unionByName(dealt.select(F.col("centre").alias("doc_id"), "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part")))
    )
    # Always by shuffle: what is asked for grows with the input, and one plan holds at every size.
    met = source.join(asked.hint("merge"), "doc_id")
    links = met.groupBy("centre", "part").applyInArrow(lean_group(_verify(words, num, den)), "u long, v long")

    found = components(links.unionByName(member.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))))
    found = _join_blocks(source, spokes, dealt.where("blocks > 1").select("centre"), found, block, _across(words, num, den))
    out = signed.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def _blocks(which, block: int) -> F.Column:
    """Blocks for the rows where ``which`` holds."""
    return F.greatest(F.ceil(F.count_if(which) / block), F.ceil(F.coalesce(F.sum(F.when(which, F.col("n_shingles"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")


def _join_blocks(source: DataFrame, spokes: DataFrame, crowded: DataFrame, found: DataFrame, block: int, across) -> DataFrame:
    """Components after links between different blocks of crowded stars.

    Members in the centre's component are joined already. The loose ones are dealt into blocks anew, and
    each of their blocks meets every block of the star, so a star of n members makes at most ``(n / block + 1)**2`` groups.
    """
    names = found.select(F.col("node").alias("doc_id"), "component")
    hubs = crowded.join(names.withColumnRenamed("doc_id", "centre"), "centre", "left").select("centre", F.coalesce("component", "centre").alias("hub"))
    placed = spokes.join(hubs, "centre").join(names, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = staged(placed.select("centre", "doc_id", "n_shingles", "component", (F.col("component") != F.col("hub")).alias("loose")), "placed")
    if placed.where("loose").isEmpty():
        return found
    sizes = placed.groupBy("centre").agg(_blocks(F.col("loose"), block).alias("loose_parts"), _blocks(~F.col("loose"), block).alias("other_parts")).where("loose_parts > 0")
    # Blocks of loose members have the numbers below loose_parts, those of others the numbers from there on.
    dealt = placed.join(sizes, "centre").withColumn("own", F.when(F.col("loose"), F.pmod(F.xxhash64("doc_id"), F.col("loose_parts"))).otherwise(F.col("loose_parts") + F.pmod(F.xxhash64("doc_id"), F.greatest("other_parts", F.lit(1)))).cast("int"))
    last = F.col("loose_parts") + F.when(F.col("loose"), F.col("other_parts")).otherwise(0) - 1
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    asked = dealt.select("doc_id", "centre", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "own", "component")
    # Texts of ids whose hash slot nobody asks for are not shuffled again; there are at most SLOTS slots.
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    slots = placed.join(sizes, "centre", "left_semi").select(slot.alias("slot")).distinct()
    wanted = source.join(F.broadcast(slots), slot == F.col("slot"), "left_semi")
    met = wanted.join(asked.hint("merge"), "doc_id")
    links = met.groupBy("centre", "low", "high").applyInArrow(lean_group(across), "u long, v long")
    return components(links.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
