"""Evaluation tables in and out."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parley.operators.beside import beside
from parley.operators.rows import require_columns

# Texts may hold quotes, commas, line ends and outer blanks; all survive a round trip.
CSV_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_eval_table(spark: SparkSession, path: str, required: Iterable[str] = (), schema: str | None = None) -> DataFrame:
    """Parquet, CSV or JSON lines by suffix; ``ValueError`` names a missing required column.

    A CSV with line ends inside fields cannot be split, one file is one task: write big tables as
    Parquet.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        df = reader.options(**CSV_OPTIONS).csv(path)
    elif kind in ("json", "jsonl"):
        df = reader.json(path)
    else:
        df = reader.parquet(path)
    return require_columns(df, required)


def first_existing(spark: SparkSession, roots: Sequence[str], base: str, suffixes: Sequence[str]) -> str | None:
    """The first of ``root/base + suffix`` that exists: roots in order, suffixes in order inside a root."""
    for root in roots:
        for suffix in suffixes:
            path = f"{root.rstrip('/')}/{base}{suffix}"
            if path_exists(spark, path):
                return path
    return None


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists") -> str:
    """Write a table; the suffix of the path should name the format, so that it reads back."""
    w = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end: only then it has the marker that a committed job leaves."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def publish(df: DataFrame, path: str) -> str:
    """Write ``df`` to ``path`` so that readers find the old table or the new one, never half of one.

    The rows go to a staging folder beside it, which takes the place of the table when the job is committed.  ``df`` may be read from ``path``
    itself.  If the writing fails the old table stays.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    staging = f"{path}-staging-{uuid.uuid4().hex[:8]}"
    df.write.parquet(staging)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(hadoop(path), True)
    if not files.rename(hadoop(staging), hadoop(path)):
        raise OSError(f"cannot put {staging} in the place of {path}")
    return path


def write_if_absent(df: DataFrame, path: str, refresh: bool = False) -> str:
    """Write unless the whole output is already there; ``refresh`` replaces it.  What an interrupted job left counts as absent."""
    return path if not refresh and is_whole(df.sparkSession, path) else publish(df, path)


def replace_in_place(spark: SparkSession, path: str, new: DataFrame, prefix: str, column: str = "file") -> str:
    """The table at ``path`` with the rows of a prefix replaced by new ones."""
    return publish(replace_by_prefix(spark.read.parquet(path), new, prefix, column), path)


def replace_by_prefix(base: DataFrame, new: DataFrame, prefix: str, column: str = "file") -> DataFrame:
    """The base without the rows whose file starts with the prefix, and the new rows behind."""
    kept = base.filter(~F.coalesce(F.startswith(F.col(column), F.lit(prefix)), F.lit(False)))
    return kept.unionByName(new, allowMissingColumns=True)


def lookup_prediction(preds: DataFrame, file: str | None = None, config: str | None = None, best: DataFrame | None = None) -> DataFrame:
    """The prediction of each file (or one) under the named config, else under the best one.

    ``preds`` is (root_rank, config_id, file, translated_text_model, pos); the lower root rank
    wins, then the first row.  The pick is an aggregate by file, so it combines before the shuffle.
    """
    p = preds if file is None else preds.filter(F.col("file") == file)
    if best is not None:
        p = beside(p, best.select(F.col("config_id").alias("_best")))
    else:
        p = p.withColumn("_best", F.lit(None).cast("string"))
    rank = F.when(F.col("config_id") == F.lit(config), 0).when(F.col("config_id") == F.col("_best"), 1)
    ranked = p.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    first = F.min_by(F.struct("config_id", F.trim("translated_text_model").alias("translated_text_model")),
                     F.struct("_rank", "root_rank", "pos")).alias("r")
    return ranked.groupBy("file").agg(first).select("file", "r.*")
