"""Overlap of labelled intervals with query intervals.

How long a label covers [t0, t1] is how long it covers everything up to t1, less everything up
to t0.  Starts, ends and query times are put on one time line, and running sums give the covered
time at each.  The work is a sort of the points; pairs of intervals are never formed, so a session
with a third of all intervals costs no more than its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parley.operators.ordered import OrderedScan

MICROS = 1_000_000


def micros(seconds: Column) -> Column:
    return F.round(seconds * MICROS).cast("long")


def interval_overlap(
    queries: DataFrame, intervals: DataFrame, labels: Sequence[str], session: str = "session", query: str = "query_id",
    start: str = "start", end: str = "end", label: str = "label", splits: int | None = None,
) -> DataFrame:
    """Seconds of each label inside each query interval: (session, query, one column per label).

    Queries are (session, query_id, start, end), intervals (session, label, start, end), times in
    seconds with microsecond resolution.  Intervals that end before they start are ignored.
    """
    zero = F.lit(0).cast("long")
    kept = intervals.filter(F.col(label).isin(*labels) & (F.col(end) > F.col(start)))

    def point(df: DataFrame, t: str, step: int, side: int) -> DataFrame:
        opened = [
            (F.when(F.col(label) == lb, F.lit(step)).otherwise(0) if step else F.lit(0)).cast("long").alias(f"_d{i}")
            for i, lb in enumerate(labels)
        ]
        q = F.col(query) if side else F.lit(None).cast(queries.schema[query].dataType)
        return df.select(session, micros(F.col(t)).alias("_t"), q.alias("_q"), F.lit(side).alias("_side"), *opened)

    line = (
        point(kept, start, 1, 0).unionByName(point(kept, end, -1, 0))
        .unionByName(point(queries, start, 0, -1)).unionByName(point(queries, end, 0, 1))
    )
    # (a query column of side -1 subtracts the cover up to its start, side 1 adds the cover up to its end)
    first = OrderedScan(line, [session], ["_t"], splits)
    scan = first.lag("_before", F.col("_t"))
    for i in range(len(labels)):
        scan = scan.running_sum(f"_open{i}", F.col(f"_d{i}"))
    opened = scan.result(keep_slab=True)
    gap = F.coalesce(F.col("_t") - F.col("_before"), zero)
    # what was open between the point before and this one: the running sum without this point
    scan = first.again(opened)
    for i in range(len(labels)):
        scan = scan.running_sum(f"_cover{i}", gap * (F.col(f"_open{i}") - F.col(f"_d{i}")))
    cover = scan.result().filter(F.col("_side") != 0)
    return cover.groupBy(session, F.col("_q").alias(query)).agg(*[
        (F.sum(F.col("_side") * F.col(f"_cover{i}")) / MICROS).alias(lb) for i, lb in enumerate(labels)
    ])


def majority_label(overlaps: DataFrame, first: str = "male", second: str = "female", name: str = "label") -> DataFrame:
    """The label with more overlap; ``first`` on a tie, ``unknown`` without any."""
    a, b = F.col(first), F.col(second)
    return overlaps.withColumn(name, F.when((a <= 0) & (b <= 0), "unknown").when(a >= b, first).otherwise(second))
