"""Metrics per group, gaps to the overall value, and what they add up to."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from parley.functions import metrics as M
from parley.operators.joins import value_grid
from parley.operators.rows import ERROR_MARK


def group_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Slice columns as text, missing values as ``unknown``."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in cols})


def group_metrics(
    df: DataFrame, cols: Sequence[str], metrics: dict[str, Column] | None = None,
    ref: str = "ref", hyp: str = "hyp", include_empty: bool = False,
) -> DataFrame:
    """Overall and per-group values: (overall, slice columns, n, one column per metric).

    ``metrics`` are aggregates over the table; exact match and mean sentence BLEU are the default.
    Both levels come out of one grouping-sets aggregate over one scan.  ``include_empty`` adds the
    slice combinations that have no row, with null metrics.
    """
    base = group_columns(df, cols)
    if metrics is None:
        base = M.with_bleu_stats(base, ref, hyp).withColumn("_sb", M.bleu_score(effective_order=True)).drop(*M.BLEU_STATS)
        ok = ~F.contains(F.coalesce(F.col(hyp), F.lit("")), F.lit(ERROR_MARK))
        metrics = {
            "exact_match": F.round(F.avg(M.is_exact_match(F.col(ref), F.col(hyp)).cast("double")), 4),
            "mean_sentence_bleu": F.round(F.coalesce(F.avg(F.when(ok, F.col("_sb"))), F.lit(0.0)), 4),
        }
    sets = base.groupingSets([[], [F.col(c) for c in cols]], *[F.col(c) for c in cols])
    out = sets.agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in metrics.items()]
    ).select((F.col("_g") > 0).alias("overall"), *cols, "n", *metrics)
    if not include_empty:
        return out
    grid = value_grid(base, cols)
    groups = grid.join(out.filter(~F.col("overall")).drop("overall"), list(cols), "left").fillna(0, ["n"])
    return out.filter("overall").unionByName(groups.withColumn("overall", F.lit(False)))


def group_grid(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row count of every combination of slice values, 0 where there is none."""
    base = group_columns(df, cols)
    counts = base.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return value_grid(base, cols).join(counts, list(cols), "left").fillna(0, ["n"])


def _beside_overall(groups: DataFrame, metric: str) -> DataFrame:
    """Every row of a group table next to the overall value (``_o``) and its distance from it (``_gap``): the table is computed once.

    Group tables have one row for each slice combination, so the window over all of them is one over a report.
    """
    overall = F.max(F.when(F.col("overall"), F.col(metric))).over(Window.partitionBy())
    return groups.withColumn("_o", overall).withColumn("_gap", F.when(~F.col("overall"), F.abs(F.col("_o") - F.col(metric))))


def disparities(groups: DataFrame, metric: str = "exact_match", threshold: float = 0.15) -> DataFrame:
    """Groups whose metric is more than ``threshold`` away from the overall value."""
    far = _beside_overall(groups, metric).filter(F.col("_gap") > threshold)
    return far.withColumn("absolute_gap", F.round("_gap", 4)).withColumnsRenamed({metric: "group_metric", "_o": "overall_metric"}).drop("overall", "_gap")


def disparity_summary(groups: DataFrame, metric: str = "exact_match", threshold: float = 0.15) -> DataFrame:
    """One row: disparities, the widest gap, and the lowest and highest group."""
    group = F.when(~F.col("overall"), F.col(metric))
    return _beside_overall(groups, metric).agg(
        F.count_if(F.col("_gap") > threshold).alias("disparities"),
        F.max(F.when(F.col("_gap") > threshold, F.round("_gap", 4))).alias("max_gap"),
        F.min(group).alias("min_group"), F.max(group).alias("max_group"),
        F.max(F.when(~F.col("overall"), F.col("_o"))).alias("overall"),
    )


def mean_of_groups(groups: DataFrame, by: str, metric: str = "exact_match") -> DataFrame:
    """Unweighted mean of the group values per slice value."""
    return groups.filter(~F.col("overall")).groupBy(by).agg(F.avg(metric).alias(metric))


def model_bias_report(df: DataFrame, cols: Sequence[str], threshold: float = 0.15, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Long form (section, key, value): overall metrics, groups, disparities, and what they add up to, from one pass over ``df``.

    ``widest`` names the group with the largest gap (ties: the first by name) where there is a disparity.
    """
    metric, everything = "exact_match", Window.partitionBy()
    name = F.concat_ws("|", *[F.col(c) for c in cols])
    groups = _beside_overall(group_metrics(df, cols, ref=ref, hyp=hyp), metric).withColumn("_key", name)
    far = F.coalesce(F.col("_gap") > threshold, F.lit(False))
    groups = groups.withColumns({
        "_far": far, "_count": F.count_if(far).over(everything), "_max": F.max(F.when(far, F.round("_gap", 4))).over(everything),
        "_widest": F.min(F.when(far, F.struct((-F.col("_gap")).alias("gap"), F.col("_key").alias("key")))).over(everything),
    })

    def row(section: str, key: Column | str, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), (F.lit(key) if isinstance(key, str) else key).alias("key"), value.cast("double").alias("value"))

    totals = F.array(
        row("overall", "n", F.col("n")), row("overall", metric, F.col(metric)), row("summary", "disparities", F.col("_count")), row("summary", "max_gap", F.col("_max")),
        F.when(F.col("_count") > 0, row("widest", F.col("_widest")["key"], F.round(-F.col("_widest")["gap"], 4))))
    of_group = F.array(row("group", F.col("_key"), F.col(metric)), F.when(F.col("_far"), row("disparity", F.col("_key"), F.round("_gap", 4))))
    return groups.select(F.explode(F.array_compact(F.when(F.col("overall"), totals).otherwise(of_group))).alias("r")).select("r.*")


def custom_metric(
    df: DataFrame, cols: Sequence[str], partial: Callable[[pd.Series, pd.Series], Sequence[float]],
    stats: Sequence[str], final: Column, true: str, pred: str,
) -> DataFrame:
    """A user metric per group, as mergeable statistics.

    ``partial(y_true, y_pred)`` turns the rows of one group in one Arrow batch into numbers named
    ``stats``; Spark adds them up per group, and ``final`` is the metric over the sums.  A group is
    never collected in one place, however large it is.
    """
    keys = list(cols)
    fields = [f for f in df.select(*keys).schema.fields] + [T.StructField(s, T.DoubleType()) for s in stats]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (*(k if isinstance(k, tuple) else (k,)), *map(float, partial(g[true], g[pred])))
                for k, g in batch.groupby(keys, dropna=False)
            ]
            yield pd.DataFrame(rows, columns=[*keys, *stats])

    parts = df.select(*dict.fromkeys([*keys, true, pred])).mapInPandas(pieces, T.StructType(fields))
    return parts.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in stats]).select(*keys, final.alias("metric"))
