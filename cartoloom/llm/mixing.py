"""Mixing sources to target weights with DataFrame functions only.

Capped water-filling: every source asks for a share of the budget in proportion to its weight,
no source may give more than ``epochs`` times its size, and what a capped source cannot take is
shared again by weight among the rest until nobody is above its cap. With the sources in order of
cap / weight the capped ones are a prefix of that order, so the fixed point follows from running
sums instead of a loop.

A source then repeats all its documents ``floor(target / size)`` times. The fractional repetition takes
its documents in seeded order up to the first that does not fit, and fills the room which that one leaves
with the smallest others, as far as they fit. Either end is found by running sums level by level (bins of
the order, pieces of one bin, rows of one piece), so neither a source nor a group of rows alike meets in
one task. What is decided is a row a source; documents are held against it where they lie, and texts are
never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged

WEIGHTS = (3, 1, 2)
BUDGET, EPOCHS, SEED = (3, 2), 2, "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"
DIMENSION = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small(side: DataFrame, rows: int) -> DataFrame:
    """A side of few rows is broadcast; a larger one is left to the shuffle."""
    return F.broadcast(side) if rows <= DIMENSION else side.hint("merge")


def water_fill(totals: DataFrame, weights: tuple[int, ...], budget: tuple[int, int], epochs: int) -> DataFrame:
    """``src, n, source_size, target, whole, part`` from ``src, n, source_size``, one row a source; part is what whole repetitions leave."""
    order = Window.orderBy(F.col("src").asc_nulls_last())
    turn = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    plan = totals.withColumn("weight", turn).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src").asc_nulls_last())
    everything = Window.partitionBy()
    plan = (
        plan.withColumn("asked", F.sum("source_size").over(everything) * F.lit(budget[0]) / F.lit(budget[1]))
        .withColumn("given", F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("asked") - F.col("given")) / F.col("sharing"))
        .withColumn("settled", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("share", F.max(F.when(F.col("settled"), F.struct(-F.col("given"), "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("settled"), F.col("share") * F.col("weight")).otherwise(F.col("cap").cast("double")))
    )
    plan = plan.withColumn("target", F.least(F.col("target"), F.col("cap").cast("double")))
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("long"))
    part = F.when(F.col("whole") < epochs, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0)
    return plan.select("src", "n", "source_size", "target", "whole", F.floor(part).cast("long").alias("part"))


#: From coarse to fine: bins, pieces of a bin (rows alike of one task of the stored table), rows. Each list follows the order of its last level.
SEEDED = (("bin",), ("rank", "task"), ("rank", "spot"))
SMALLEST = (("size",), ("size", "bin"), ("size", "rank", "task"), ("size", "rank", "spot"))


def _fitting(rows: DataFrame, levels: tuple[tuple[str, ...], ...], sources: int) -> DataFrame:
    """``src, room, upto, left``: the last row (as a struct of the last level's keys) up to which all rows of a source fit its room.

    Each level sums its pieces of a source; those that fit whole are taken, and the first that doesn't is looked at on the next level.
    """
    place, part, out, ends = F.struct(*levels[-1]), rows.withColumn("before", F.lit(0).cast("long")), None, []
    own = F.col("src").eqNullSafe(F.col("s"))
    for at, keys in enumerate(levels):
        pieces = part.groupBy("src", *keys, "room", "before").agg(F.sum("size").alias("words"), F.max(place).alias("end"))
        pieces = pieces.withColumn("sum", F.col("before") + F.sum("words").over(Window.partitionBy("src").orderBy(*keys)))
        first = F.struct(*(F.col(k).alias(f"in_{k}") for k in keys), (F.col("sum") - F.col("words")).alias("before"))
        found = pieces.groupBy("src", "room").agg(F.max(F.when(F.col("sum") <= F.col("room"), F.struct("end", "sum"))).alias(f"full{at}"), F.min(F.when(F.col("sum") > F.col("room"), first)).alias("first"))
        state = found.where("first is not null").select(F.col("src").alias("s"), "first.*")
        out = found.drop("first") if out is None else out.join(small(found.select(F.col("src").alias("s"), f"full{at}"), sources), own, "left").drop("s")
        ends.insert(0, f"full{at}")
        same = own
        for k in keys:
            same &= F.col(k) == F.col(f"in_{k}")
        part = rows.join(small(state, sources), same)
    full = F.coalesce(*ends)
    return out.select("src", "room", full["end"].alias("upto"), (F.col("room") - full["sum"]).alias("left"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, epochs: int = EPOCHS, seed: str = SEED, rows: bool = False) -> DataFrame:
    """Decide how many words of each document the mix takes.

    Returns ``doc_id, size, source_size, target, taken, repeats`` and, with ``rows``, a struct ``row`` of all columns.
    Size counts words (a null text has none). Sources are put in code-point order, null last, and get
    ``weights`` in turn; together they take ``budget`` (a fraction) of all words. A source of no words has
    target 0 and its documents are taken 0 words. ``repeats`` is the whole number of times a document
    enters the mix, at most ``epochs``; a document of no words is repeated as often as its source
    repeats whole. Documents enter whole, so a source's taken words never exceed its target, and no document that
    could be repeated once more fits into what stays open.

    Order within a source is by md5 of seed, id and text; rows alike in all of these are told apart by
    their place in a stored table, so each counts for itself. A null id has a hash of its own. Reruns agree
    in the rows they return. An empty table gives an empty result; other columns are ignored.

    Sources are a dimension: their totals (one row each) are ordered in one task.
    """
    if epochs < 1 or min(weights) <= 0:
        raise ValueError("weights and epochs must be positive")
    ident, text = F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text_col)), F.lit("null"))
    rank = F.md5(F.concat(F.lit(seed + ":"), ident, F.lit(":"), text))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), rank.alias("rank"), F.monotonically_increasing_id().alias("spot"), *([F.struct(*docs.columns).alias("row")] if rows else []))
    sized = staged(sized, "sized")
    totals = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = staged(water_fill(totals, weights, budget, epochs), "plan")
    sources, count = plan.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # As many bins as a bin has rows, about, so neither a source's bins nor a bin's rows are too many for a task.
    digits = max(3, math.ceil(math.log(count + 1, 16) / 2))
    narrow = sized.select("src", "size", "rank", "spot", F.substring("rank", 1, digits).alias("bin"), F.shiftright("spot", 33).alias("task")).where("size > 0")
    # A document up to the room always fits, so each source with such documents gets an end.
    asked = plan.where("part > 0").select(F.col("src").alias("s"), F.col("part").alias("room"))
    own = F.col("src").eqNullSafe(F.col("s"))
    seeded = staged(_fitting(narrow.join(small(asked, sources), own).where("size <= room").drop("s"), SEEDED, sources), "seeded")
    ends = seeded.select(F.col("src").alias("s"), F.col("room").alias("part_room"), "upto", F.col("left").alias("room"))
    in_order = (F.col("size") <= F.col("part_room")) & (F.struct("rank", "spot") <= F.col("upto"))
    open_ = narrow.join(small(ends.where("room > 0"), sources), own).where((F.col("size") <= F.col("room")) & ~in_order).drop("s", "upto")
    filled = staged(_fitting(open_, SMALLEST, sources), "filled").select(F.col("src").alias("f"), F.col("upto").alias("fill_upto"))
    for side, key in ((ends.drop("room").withColumnRenamed("s", "e"), "e"), (filled, "f")):
        plan = plan.join(small(side, sources), F.col("src").eqNullSafe(F.col(key)), "left").drop(key)
    placed = sized.join(small(plan.withColumnRenamed("src", "s"), sources), own)
    extra = F.coalesce(in_order, F.lit(False)) | F.coalesce(F.struct("size", "rank", "spot") <= F.col("fill_upto"), F.lit(False))
    repeats = F.col("whole") + F.when((F.col("size") > 0) & extra, 1).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", (repeats * F.col("size")).alias("taken"), repeats.cast("long").alias("repeats"), *(["row"] if rows else []))


ORACLE_MIX = """
WITH sized AS (
  SELECT doc_id, source AS src, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS rank
  FROM documents),
totals AS (SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src),
turns AS (SELECT src, source_size, 2 * source_size AS cap, row_number() OVER (ORDER BY src NULLS LAST) AS k,
                 CASE (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
          FROM totals),
needs AS (SELECT *, CAST((sum(source_size) OVER () * 3) AS DOUBLE) / 2 AS asked,
                 coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
                 sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, src NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
          FROM turns),
levels AS (SELECT *, (asked - CAST(given AS DOUBLE)) / CAST(sharing AS DOUBLE) AS level FROM needs),
settled AS (SELECT *, level * weight <= cap AS fits FROM levels),
shares AS (SELECT *, first_value(level) OVER (ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, given ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS share FROM settled),
plan AS (SELECT k, src, source_size, least(CASE WHEN fits THEN share * weight ELSE CAST(cap AS DOUBLE) END, CAST(cap AS DOUBLE)) AS target FROM shares),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM plan),
rows_ AS (SELECT s.doc_id, s.size, p.k, p.source_size, p.target, p.whole, CASE WHEN p.whole < 2 THEN floor(p.target - p.whole * p.source_size)::BIGINT ELSE 0 END AS part,
                 row_number() OVER (PARTITION BY p.k ORDER BY s.rank) AS n
          FROM sized s JOIN parts p ON s.src IS NOT DISTINCT FROM p.src),
seeded AS (SELECT *, size BETWEEN 1 AND part AND sum(CASE WHEN size <= part THEN size ELSE 0 END) OVER (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING) <= part AS chosen FROM rows_),
rooms AS (SELECT *, part - sum(CASE WHEN chosen THEN size ELSE 0 END) OVER (PARTITION BY k) AS room FROM seeded),
filled AS (SELECT *, NOT chosen AND size BETWEEN 1 AND room AND sum(CASE WHEN NOT chosen AND size <= room THEN size ELSE 0 END) OVER (PARTITION BY k ORDER BY size, n ROWS UNBOUNDED PRECEDING) <= room AS more FROM rooms)
SELECT doc_id, size, source_size, target, ((whole + (chosen OR more)::INT) * size)::BIGINT AS taken, (whole + (chosen OR more)::INT)::BIGINT AS repeats FROM filled
"""
