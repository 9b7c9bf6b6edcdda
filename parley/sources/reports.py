"""Reports and run logs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_report(df: DataFrame, path: str) -> str:
    """A report table as JSON lines, one document per row."""
    df.write.json(path)
    return path


def to_report_json(df: DataFrame, name: str = "report") -> DataFrame:
    """Every row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def latest_report(reports: DataFrame, precedence: Sequence[str], root: str = "root", name: str = "name") -> DataFrame:
    """The first report: roots in the given order, names in alphabetical order; an aggregate to one row."""
    rank = F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col(root))
    known = reports.withColumn("_rank", rank).filter(F.col("_rank") > 0)
    row = F.min_by(F.struct(*reports.columns), F.struct(F.col("_rank"), F.col(name))).alias("r")
    return known.agg(row).select("r.*").filter(F.col(name).isNotNull())


def log_metrics(df: DataFrame, run: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Metrics of runs as (run columns, key, value) rows; a metric that has no value is logged without one."""
    return df.select(*run, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(run), list(columns), "key", "value")


def log_run(df: DataFrame, run: Sequence[str], params: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """What a run was given and what came of it, as one log: (run columns, kind, key, text, value).

    Parameters keep their text, metrics their number; nulls of both stay as rows, so that a log tells "not set" from "not logged".
    """
    entries = [F.struct(F.lit("param").alias("kind"), F.lit(c).alias("key"), F.col(c).cast("string").alias("text"), F.lit(None).cast("double").alias("value")) for c in params]
    entries += [F.struct(F.lit("metric").alias("kind"), F.lit(c).alias("key"), F.lit(None).cast("string").alias("text"), F.col(c).cast("double").alias("value")) for c in metrics]
    return df.select(*run, F.explode(F.array(*entries)).alias("_e")).select(*run, "_e.*")


def append_metrics(rows: DataFrame, path: str) -> str:
    rows.write.mode("append").parquet(path)
    return path


def write_schema(df: DataFrame, path: str, **bounds: float) -> str:
    """The schema of a table and its configured bounds as one JSON document."""
    spark: SparkSession = df.sparkSession
    doc = json.dumps({"schema": json.loads(df.schema.json()), "bounds": bounds}, sort_keys=True)
    spark.createDataFrame([(doc,)], "value string").write.text(path)
    return path
