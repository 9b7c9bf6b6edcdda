"""Class metrics of true and predicted labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from parley.functions.text import norm_text


def class_f1(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Per class: true positives, false positives, false negatives and F1 (0 without any).

    Each row is counted once on its true side and once on its predicted side by one explode; the
    counts per class combine before the shuffle.
    """
    t, p = norm_text(F.col(true).cast("string")), norm_text(F.col(pred).cast("string"))
    sides = F.array(
        F.struct(t.alias("cls"), F.lit(1).alias("is_true"), (t == p).cast("int").alias("hit")),
        F.struct(p.alias("cls"), F.lit(0).alias("is_true"), (t == p).cast("int").alias("hit")),
    )
    s = df.select(F.explode(sides).alias("s")).select("s.*")
    counts = s.groupBy("cls").agg(
        F.count_if((F.col("is_true") == 1) & (F.col("hit") == 1)).alias("tp"),
        F.count_if((F.col("is_true") == 0) & (F.col("hit") == 0)).alias("fp"),
        F.count_if((F.col("is_true") == 1) & (F.col("hit") == 0)).alias("fn"),
    )
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return counts.withColumn("f1", F.when(denom > 0, 2 * F.col("tp") / denom).otherwise(F.lit(0.0)))


def macro_f1(df: DataFrame, true: str, pred: str, target: float = 0.70) -> DataFrame:
    """Unweighted mean of the F1 of every class that occurs on either side."""
    return class_f1(df, true, pred).agg(
        F.count(F.lit(1)).alias("classes"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1")
    ).withColumn("meets_target", F.col("macro_f1") >= target)


def confusion_matrix(df: DataFrame, true: str, pred: str, labels: Sequence) -> DataFrame:
    """Square over ``labels``: one row per true label, rows or not, and one count column per predicted label; one aggregate."""
    cells = [F.count_if((F.col(true) == t) & (F.col(pred) == p)).alias(f"c{i}_{j}") for i, t in enumerate(labels) for j, p in enumerate(labels)]
    grid = F.array(*[F.struct(F.lit(t).alias("true_label"), *[F.col(f"c{i}_{j}").alias(f"pred_{p}") for j, p in enumerate(labels)]) for i, t in enumerate(labels)])
    return df.agg(*cells).select(F.inline(grid))
