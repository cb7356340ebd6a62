"""Size-balanced shards from sampled splitters.

Keys are (hash of the text, id), so equal texts are neighbours. A sample drawn with probability in
proportion to size gives quantile splitters for many small ranges; ranges that turn out overfull are
sampled again and subdivided. Exact sizes of the ranges and running sums inside each then place every
document on one line of bytes, which is cut into equal shards. Only splitters and range totals, whose
number is bounded, visit the driver.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged
from .workers import lean

SHARDS = 16
RANGES, ROWS_PER_RANGE, MOST_RANGES = 256, 100_000, 1 << 16
DRAWS = 32
TOGETHER = 0.005
FIRST = -(2**63)  # before every id; stands for a null one


def _draw(rows: DataFrame, weight: float, draws: float, seed: int) -> list[tuple[int, int, float]]:
    """Sampled ``(hash, id, bytes it stands for)``, each row with probability ``size * draws / weight``."""
    chance = F.col("size") * F.lit(draws / weight)
    unit = F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = rows.where(unit < chance).select("h", F.coalesce("doc_id", F.lit(FIRST)).alias("d"), F.greatest(F.col("size").cast("double"), F.lit(weight / draws)).alias("w"))
    return [tuple(r) for r in picked.collect()]


def quantile_keys(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """Keys that cut the weighted sample into ``parts`` about equal ranges."""
    sample = sorted(sample)
    if not sample or parts < 2:
        return []
    upto = np.cumsum([s[2] for s in sample])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)
    return sorted({sample[i][:2] for i in np.minimum(at, len(sample) - 1)})


def _around(rows: DataFrame, keys: list[tuple[int, int]], least: float) -> list[tuple[int, int]]:
    """Splitters inside a group of equal texts of at most ``least`` bytes move to the group's start, so that it stays whole."""
    inside = sorted({h for h, d in keys if d > FIRST})
    if not inside:
        return keys
    # As many rows as splitters at most.
    asked = rows.sparkSession.createDataFrame([(h,) for h in inside], "h long")
    whole = rows.join(F.broadcast(asked), "h", "left_semi").groupBy("h").agg(F.sum("size").alias("size")).where(F.col("size") <= least)
    small = {r["h"] for r in whole.collect()}
    return sorted({(h, FIRST if h in small else d) for h, d in keys})


def _place(keys: list[tuple[int, int]]):
    hs, ds = np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            h = rows.column(rows.schema.get_field_index("h")).to_numpy()
            doc = rows.column(rows.schema.get_field_index("doc_id")).fill_null(FIRST).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
            for x in np.unique(h[high > low]):  # splitters inside a group of equal texts
                at = np.flatnonzero(h == x)
                low[at] += np.searchsorted(ds[low[at[0]] : high[at[0]]], doc[at], "right")
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(low.astype(np.int32))], [*rows.schema.names, "range"])

    return run


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, ranges: int = RANGES, together: float = TOGETHER, rounds: int = 3) -> DataFrame:
    """Deal all documents to ``shards`` shards of nearly equal bytes (law ``bytes``).

    Size is the text's UTF-8 bytes plus 1; a null text has no bytes and checksum 0. Returns
    ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; slots run from 0 without gaps in each
    shard, in key order. Documents of equal text share a shard unless together they hold more than
    ``together`` of a shard's bytes. A shard misses its equal part by at most one such group or one
    document at each end. Null ids come first within their text; repeated rows get slots of their
    own; other columns are ignored; an empty table gives an empty result.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    rows = staged(rows, "sizes")
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    parts = min(max(ranges, -(-count // ROWS_PER_RANGE)), MOST_RANGES)
    total = total or 1
    least = together * total / shards
    keys = _around(rows, quantile_keys(_draw(rows, total, DRAWS * parts, 1), parts), least)
    for turn in range(rounds + 1):
        placed = rows.mapInArrow(lean(_place(keys)), "doc_id long, size long, text_crc32 long, h long, range int")
        sums = {r[0]: (r[1], r[2]) for r in placed.groupBy("range").agg(F.sum("size"), F.count("*")).collect()}
        full = [k for k, (size, n) in sums.items() if n > 1 and size > 2 * total / parts]
        if not full or turn == rounds or len(keys) >= 2 * MOST_RANGES:
            break
        # Subdivide overfull ranges; one that cannot be cut further (a single huge document) stays.
        weight = sum(sums[k][0] for k in full)
        again = _draw(placed.where(F.col("range").isin(full)), weight, DRAWS * max(4.0, 4.0 * weight * parts / total), turn + 2)
        more = set(keys)
        spots = {k: [] for k in full}
        for s in again:
            spots.setdefault(bisect.bisect_right(keys, s[:2]), []).append(s)
        for k, own in spots.items():
            if k in sums:
                more |= set(quantile_keys(own, int(np.ceil(sums[k][0] * parts / total)) + 1))
        moved = _around(rows, sorted(more), least)
        if moved == keys:
            break
        keys = moved

    order = sorted(sums)
    starts = np.cumsum([0, *(sums[k][0] for k in order)])
    firsts = np.cumsum([0, *(sums[k][1] for k in order)])
    spark = docs.sparkSession
    heads = spark.createDataFrame([(k, int(s), int(f)) for k, s, f in zip(order, starts, firsts, strict=False)] or [(0, 0, 0)], "range int, base long, first long")
    along = Window.partitionBy("range").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    group = Window.partitionBy("range", "h")
    placed = placed.join(F.broadcast(heads), "range")
    placed = placed.withColumn("end", F.col("base") + F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = placed.withColumn("index", F.col("first") + F.row_number().over(along) - 1)
    placed = placed.withColumn("g_size", F.sum("size").over(group)).withColumn("g_end", F.max("end").over(group))
    small = F.col("g_size") <= F.lit(least)
    middle = F.when(small, 2 * F.col("g_end") - F.col("g_size")).otherwise(2 * F.col("end") - F.col("size"))
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / (2 * F.lit(total))), F.lit(shards - 1)).cast("int"))
    placed = staged(placed.select("doc_id", "size", "text_crc32", "shard", "index"), "placed")
    zero = placed.groupBy("shard").agg(F.min("index").alias("zero"))
    return placed.join(F.broadcast(zero), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("zero")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

