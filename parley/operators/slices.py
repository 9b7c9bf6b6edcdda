"""Counts, shares and imbalance of slices, and numeric profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions import labels as L
from parley.operators.beside import beside
from parley.operators.joins import expected_left_join


def slice_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n, ratio of all rows, number of slices).

    The counts combine before the shuffle; the total is one more aggregate over the counts.
    """
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("slices"))
    return beside(counts, total).withColumn("ratio", F.col("n") / F.col("total"))


def label_imbalance(df: DataFrame, col: str = "emotion", max_ratio: float = 0.80, min_ratio: float = 0.05, min_total: int = 20) -> DataFrame:
    """Labels above the highest share, or below the lowest once there are enough rows.

    A table of nothing but ``unknown`` is allowed.
    """
    s = slice_counts(df, col)
    only_unknown = (F.col("slices") == 1) & (F.col("value") == "unknown")
    too_big = F.col("ratio") > max_ratio
    too_small = (F.col("total") >= min_total) & (F.col("ratio") < min_ratio)
    reason = F.when(too_big, "max").when(too_small, "min")
    return s.withColumn("reason", reason).filter(F.col("reason").isNotNull() & ~only_unknown).select("value", "n", "ratio", "reason")


def source_balance(df: DataFrame, col: str = "dataset", min_ratio: float = 0.01, max_ratio: float = 0.95) -> DataFrame:
    """Data sets outside [min, max] of all rows; nothing when there is only one."""
    s = slice_counts(df, col)
    reason = F.when(F.col("ratio") < min_ratio, "min").when(F.col("ratio") > max_ratio, "max")
    return s.withColumn("reason", reason).filter((F.col("slices") > 1) & F.col("reason").isNotNull()).select("value", "n", "ratio", "reason")


def disparity_from_uniform(count: Column, total: Column, slices: Column, threshold: float) -> tuple[Column, Column]:
    expected = total / slices
    return expected, F.when(expected > 0, F.abs(count - expected) / expected > threshold).otherwise(F.lit(False))


def slice_disparity(df: DataFrame, col: str, threshold: float = 0.5) -> DataFrame:
    """Each slice with the count expected under equal shares, flagged when it is off by more than the threshold."""
    s = slice_counts(df, col)
    expected, flag = disparity_from_uniform(F.col("n"), F.col("total"), F.col("slices"), threshold)
    return s.select("value", "n", expected.alias("expected"), flag.alias("flagged"))


def duration_slices(df: DataFrame, seconds: str = "duration_sec", threshold: float = 0.5) -> DataFrame:
    """The three duration buckets, empty ones included, with their disparity."""
    counts = df.groupBy(L.duration_bucket(F.col(seconds)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    full = expected_left_join(df.sparkSession, L.DURATION_BUCKETS, "value", counts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    expected, flag = disparity_from_uniform(F.col("n"), F.col("total"), F.lit(len(L.DURATION_BUCKETS)), threshold)
    return beside(full, total).select("value", "n", expected.alias("expected"), flag.alias("flagged"))


def distinct_speakers(df: DataFrame, col: str = "speaker_id", show: int | None = None) -> DataFrame:
    """All speakers, or the first ``show``, with their counts, next to the number of all speakers."""
    counts = df.groupBy(F.coalesce(F.col(col), F.lit("unknown")).alias("speaker")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.count(F.lit(1)).alias("speakers"))
    return beside(counts.orderBy("speaker").limit(show) if show else counts, total)


def overall_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row counts per combination of the slice columns, and over everything (all columns null)."""
    groups = df.groupingSets([[], [F.col(c) for c in cols]], *[F.col(c) for c in cols])
    return groups.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")).select(
        (F.col("_g") > 0).alias("overall"), *cols, "n"
    )


def split_presence(df: DataFrame, expected: Sequence[str] = L.SPLITS, min_files: int = 1) -> DataFrame:
    """Files per expected split; flagged when missing or under the minimum."""
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    full = expected_left_join(df.sparkSession, expected, "split", counts)
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") < min_files, "few").otherwise("ok")
    return full.withColumn("status", status)


def out_of_range_ratio(df: DataFrame, col: str = "duration_sec", low: float = 0.5, high: float = 30.0, max_ratio: float = 0.2) -> DataFrame:
    """Share of rows that are unreadable or outside [low, high], flagged above the allowed share."""
    bad = F.col(col).isNull() | (F.col(col) < low) | (F.col(col) > high)
    agg = df.agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("total"))
    share = F.when(F.col("total") > 0, F.col("bad") / F.col("total")).otherwise(F.lit(0.0))
    return agg.withColumn("ratio", share).withColumn("flagged", F.col("ratio") > max_ratio)


def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min and max of each column: one pass over the table, then one row per column."""
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [F.struct(
            F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"),
        ).alias(c)]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in cols]))
    return one.select(rows.alias("r")).select("r.column", "r.s.*")


def expectations(df: DataFrame, exist: Sequence[str] = (), between: Sequence[tuple] = (), within: Sequence[tuple] = ()) -> DataFrame:
    """Rule results (rule, evaluated, unexpected, pct, success) in one pass; nulls are not evaluated.

    ``between`` is (column, low, high), ``within`` is (column, values).
    """
    rules: list[tuple[str, Column, Column]] = []
    for c in exist:
        bad = F.lit(0 if c in df.columns else 1).cast("long")
        rules.append((f"{c} exists", F.lit(1).cast("long"), bad))
    for c, low, high in between:
        v = F.col(c)
        rules.append((f"{c} between {low} and {high}", F.count(v), F.count_if(v.isNotNull() & ~v.between(low, high))))
    for c, values in within:
        v = F.col(c)
        name = f"{c} in " + ",".join(str(x) for x in values)
        rules.append((name, F.count(v), F.count_if(v.isNotNull() & ~v.isin(*values))))
    one = df.agg(F.array(*[
        F.struct(F.lit(n).alias("rule"), e.alias("evaluated"), u.alias("unexpected")) for n, e, u in rules
    ]).alias("r"))
    pct = F.when(F.col("evaluated") > 0, F.lit(100.0) * F.col("unexpected") / F.col("evaluated")).otherwise(F.lit(0.0))
    return one.select(F.explode("r").alias("r")).select("r.*").withColumn("pct", pct).withColumn(
        "success", F.col("unexpected") == 0
    )
