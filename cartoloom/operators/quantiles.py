"""Exact percentiles of a whole table without gathering its values in one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Span = tuple[float, float, int, int]  # least and greatest value, how many values come before, how many lie in it


def percentiles(table: DataFrame, value: str, shares: list[float], bins: int = 4096, small: int = 1 << 20) -> list[float | None]:
    """Interpolated percentiles, the same numbers as the ``percentile`` aggregate; nulls and NaN are left out.

    A histogram of at most ``bins`` rows tells which bins hold the ranks asked for, and the least and greatest value of each; bins of more than
    ``small`` values are parted again between those, so a few far-off values cost a pass more. The distinct values of the bins left are
    then counted and ordered. Infinite values are counted apart. Without values every percentile is None.
    """
    v = table.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    limit = F.lit(float("inf"))
    finite = F.when(F.abs("v") < limit, F.col("v"))
    low, high, n, under, over = v.agg(F.min(finite), F.max(finite), F.count("*"), F.count_if(F.col("v") == -limit), F.count_if(F.col("v") == limit)).first()
    if not n:
        return [None] * len(shares)
    asked = {k for s in shares for k in (math.floor((n - 1) * s), math.ceil((n - 1) * s))}
    known: dict[int, float] = {k: -math.inf if k < under else math.inf for k in asked if k < under or k >= n - over}
    open_ = sorted(asked - set(known))
    spans = _narrowed(v, open_, [(low, high, under, n - under - over)], bins, small) if open_ else []
    for k in list(open_):
        held = next(s for s in spans if s[2] <= k < s[2] + s[3])
        if held[0] == held[1]:
            known[k] = held[0]
    rest = [k for k in open_ if k not in known]
    if rest:
        wide = [s for s in spans if s[0] < s[1]]
        inner = v.withColumn("span", _span_of(wide)).where("span IS NOT NULL").groupBy("span", "v").count()
        offset = F.element_at(F.array(*(F.lit(s[2]) for s in wide)), F.col("span") + 1)
        inner = inner.withColumn("upto", offset + F.sum("count").over(Window.partitionBy("span").orderBy("v")))
        found = inner.agg(*(F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("count") <= k), F.col("v"))).alias(f"k{k}") for k in rest)).first()
        known |= {k: found[f"k{k}"] for k in rest}
    out = []
    for s in shares:
        at = (n - 1) * s
        a, b = math.floor(at), math.ceil(at)
        out.append(known[a] if a == b else (b - at) * known[a] + (at - a) * known[b])
    return out


def _span_of(spans: list[Span]) -> Column:
    """Place of the span that holds ``v``, or null."""
    return reduce(lambda c, i: c.when(F.col("v").between(spans[i][0], spans[i][1]), i), range(1, len(spans)), F.when(F.col("v").between(spans[0][0], spans[0][1]), 0)).cast("int")


def _narrowed(v: DataFrame, ranks: list[int], spans: list[Span], bins: int, small: int) -> list[Span]:
    """Spans that hold the ranks, each of ``small`` values at most or of a single value."""
    while wide := [s for s in spans if s[3] > small and s[0] < s[1]]:
        pick = lambda i: F.element_at(F.array(*(F.lit(s[i]) for s in wide)), F.col("span") + 1) / 2  # noqa: B023, E731
        # Halves, because the width of a span may be more than the largest number.
        place = F.least(F.floor((F.col("v") / 2 - pick(0)) / (pick(1) - pick(0)) * bins), F.lit(bins - 1))
        rows = v.withColumn("span", _span_of(wide)).where("span IS NOT NULL").groupBy("span", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        spans = [s for s in spans if s not in wide]
        for i, own in enumerate(wide):
            before = own[2]
            for r in sorted((r for r in rows if r["span"] == i), key=lambda r: r["bin"]):
                if any(before <= k < before + r["n"] for k in ranks):
                    spans.append((r["low"], r["high"], before, r["n"]))
                before += r["n"]
    return spans
