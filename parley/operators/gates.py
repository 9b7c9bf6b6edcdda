"""Release gates: small tables of metrics against limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.operators.beside import beside

# The enforced minima and the number of disparities that is still let through.
QUALITY_MINIMA = {"bleu": 1.0, "chrf": 5.0, "exact_match_accuracy": 0.0}
MAX_DISPARITIES = 2
GLOSSARY_TARGET = 0.95


def long_metrics(metrics: DataFrame, names=tuple(QUALITY_MINIMA)) -> DataFrame:
    """(metric, value) rows of a one-row metrics table; a metric it does not have is 0."""
    cols = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in metrics.columns else F.lit(0.0) for n in names]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in zip(names, cols)]))
    return metrics.select(pairs.alias("p")).select("p.*")


def quality_gate(metrics: DataFrame, minima: dict[str, float] | None = None) -> DataFrame:
    """(metric, value, minimum, ok) for the first row of metrics."""
    minima = minima or QUALITY_MINIMA
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in minima.items() for x in kv]), F.col("metric"))
    return long_metrics(metrics, tuple(minima)).withColumn("minimum", limit).withColumn("ok", F.col("value") >= F.col("minimum"))


def first_metrics(report: DataFrame, order: str = "ord") -> DataFrame:
    """The metrics to judge: the first of a table of configs."""
    return report.orderBy(order).limit(1)


def report_metrics(report: DataFrame) -> DataFrame:
    """The metrics of report documents: their ``metrics``, else the first of their ``configs``, else their own fields."""
    if "metrics" in report.columns:
        return report.select("metrics.*")
    if "configs" in report.columns:
        return report.select(F.get("configs", F.lit(0)).alias("c")).select("c.*")
    return report


def bias_gate(disparities: DataFrame, allowed: int = MAX_DISPARITIES) -> DataFrame:
    """pass without disparities, warn up to ``allowed``, fail beyond."""
    n = F.col("disparities")
    return disparities.agg(F.count(F.lit(1)).alias("disparities")).withColumn(
        "verdict", F.when(n == 0, "pass").when(n <= allowed, "warn").otherwise("fail"))


def search_gate(best: DataFrame, glossary_target: float = GLOSSARY_TARGET) -> DataFrame:
    """Fails only when the target flag is false (null passes) or the glossary share is under its target."""
    below = F.coalesce(~F.col("meets_target"), F.lit(False))
    lost = F.coalesce(F.col("glossary") < glossary_target, F.lit(False))
    return best.withColumns({"fails_score": below, "fails_glossary": lost, "ok": ~(below | lost)})


def baseline_diff(current: DataFrame, baseline: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(metric, value, baseline, regressed) by metric name."""
    base = baseline.select("metric", F.col("value").alias("baseline"))
    return current.join(base, "metric").withColumn("regressed", F.col("value") + tolerance < F.col("baseline"))


def rollback_gate(current: DataFrame, baseline: DataFrame | None, tolerance: float = 0.0) -> DataFrame:
    """One row: regressed metrics and whether to keep the release; no baseline lets it through."""
    if baseline is None:
        return current.agg(F.lit(0).cast("long").alias("regressed")).withColumn("ok", F.lit(True))
    return baseline_diff(current, baseline, tolerance).agg(F.count_if("regressed").alias("regressed")).withColumn(
        "ok", F.col("regressed") == 0)


def stage_status(results: DataFrame, failed: str = "failed", total: str = "total") -> DataFrame:
    """A stage under both rules: failed when anything failed, and failed only when everything did."""
    sums = results.agg(F.sum(failed).alias("failed"), F.sum(total).alias("total"))
    return sums.withColumns({
        "strict_ok": F.col("failed") == 0,
        "lenient_ok": ~((F.col("total") > 0) & (F.col("failed") == F.col("total"))),
    })
