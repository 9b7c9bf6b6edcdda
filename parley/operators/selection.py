"""Order statistics of whole-number columns by counting in ever narrower ranges."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

BINS = 4096  # ranges told apart in one pass, for each rank asked for


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int]) -> list[int]:
    """The values at some ranks (from 0) of a column of whole numbers without nulls.

    A pass counts, for each rank, the rows in ``BINS`` equal parts of the range where its value lies, as partial aggregates;
    the part that holds the rank is the next range.  So a column of b bits takes about b / 12 passes however many rows or
    distinct values it has, no task sees more than counts, and at most ``BINS`` numbers a rank come to the driver.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    at = {r: (int(low), int(high), int(r)) for r in ranks}
    while any(lo < hi for lo, hi, _ in at.values()):
        spans = sorted({(lo, hi) for lo, hi, _ in at.values() if lo < hi})
        x, bins = F.col(column).cast("decimal(20,0)"), []  # no overflow at either end of the long range
        for i, (lo, hi) in enumerate(spans):
            off, width = x - F.lit(Decimal(lo)), Decimal((hi - lo) // BINS + 1)
            bins.append(F.when(x.between(Decimal(lo), Decimal(hi)), F.struct(F.lit(i).alias("span"), ((off - off % F.lit(width)) / F.lit(width)).cast("int").alias("bin"))))
        rows = df.select(F.explode(F.filter(F.array(*bins), lambda b: b.isNotNull())).alias("b"))
        counts: dict[int, list[tuple[int, int]]] = {}
        for span, place, n in rows.groupBy("b.span", "b.bin").count().collect():
            counts.setdefault(span, []).append((place, n))
        for r, (lo, hi, left) in at.items():
            if lo == hi:
                continue
            width = (hi - lo) // BINS + 1
            for place, n in sorted(counts[spans.index((lo, hi))]):
                if left < n:
                    at[r] = (lo + place * width, min(hi, lo + (place + 1) * width - 1), left)
                    break
                left -= n
    return [at[r][0] for r in ranks]


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles of a column of whole numbers, interpolated between neighbours; none for an empty table."""
    there = df.filter(F.col(column).isNotNull()).select(column)
    n = there.count()
    if not n:
        return []
    spots = [s * (n - 1) for s in shares]
    ranks = sorted({k for s in spots for k in (int(s), min(int(s) + 1, n - 1))})
    value = dict(zip(ranks, order_statistics(there, column, ranks), strict=True))
    return [value[int(s)] + (s - int(s)) * (value[min(int(s) + 1, n - 1)] - value[int(s)]) for s in spots]


def bucket_of(column: Column, edges: Sequence[float]) -> Column:
    """How many of the edges lie below the value, 1 at least."""
    below = sum((F.when(F.lit(float(e)) < column, 1).otherwise(0) for e in edges), F.lit(0))
    return F.greatest(below, F.lit(1))
