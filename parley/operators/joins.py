"""Joins that prepare and complete evaluation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.functions import labels as L
from parley.functions.text import blank_to_null, strip
from parley.operators.beside import beside
from parley.operators.rows import EXEMPT_DATASET, is_exempt

# What the two coded statements say.
STATEMENT_TEXTS = {"01": "Kids are talking by the door.", "02": "Dogs are sitting by the door."}


def manifest_file_diff(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per split: manifest entries without a file, and files without an entry.

    Both sides are reduced to their distinct (split, file) pairs by the full join key, so a split
    that holds a third of all rows is still spread by file.
    """
    m = manifest.filter(blank_to_null(F.col("file")).isNotNull()).select("split", "file").distinct()
    f = files.select("split", "file").distinct()
    both = m.withColumn("in_manifest", F.lit(1)).join(f.withColumn("on_disk", F.lit(1)), ["split", "file"], "full")
    return both.groupBy("split").agg(
        F.count_if(F.col("on_disk").isNull()).alias("missing_files"),
        F.count_if(F.col("in_manifest").isNull()).alias("not_in_manifest"),
    )


def map_reference(df: DataFrame, dim: DataFrame, file: str = "file", dataset: str = "dataset", coded: str = L.CODED_DATASET) -> DataFrame:
    """Attach the text of the statement coded in the file name; only for the coded data set.

    ``dim`` is (statement, text).  No join hint: Spark broadcasts it while it is under the
    broadcast threshold.
    """
    code = F.when(F.upper(strip(F.col(dataset))) == coded, L.statement_code(F.col(file)))
    return df.withColumn("_code", code).join(
        dim.select(F.col("statement").alias("_code"), F.col("text").alias("reference_text")), "_code", "left"
    ).drop("_code")


def fallback_text(
    df: DataFrame, sidecar: DataFrame, script: DataFrame, key: str = "file", transcript: str = "transcript",
    dataset: str = "dataset", exempt: str = EXEMPT_DATASET, coded: str = L.CODED_DATASET,
) -> DataFrame:
    """Source text: the transcript, else the side file (exempt data set), else the script (coded data set)."""
    side = sidecar.select(F.col(key), F.col("text").alias("_side"))
    scr = script.select(F.col(key), F.col("text").alias("_script"))
    joined = df.join(side, key, "left").join(scr, key, "left")
    ds = F.col(dataset)

    def text(c: str) -> Column:
        return blank_to_null(strip(F.coalesce(F.col(c), F.lit(""))))

    return joined.withColumn("source_text", F.coalesce(
        text(transcript),
        F.when(is_exempt(ds, exempt), text("_side")),
        F.when(F.upper(strip(ds)) == coded, text("_script")),
        F.lit(""),
    )).drop("_side", "_script")


def attach_emotion(df: DataFrame, manifest: DataFrame, key: str = "file", emotion: str = "emotion") -> DataFrame:
    """The table's own emotion column when any row has one, else the manifest's by file, else ``unknown``."""
    own = F.col(emotion) if emotion in df.columns else F.lit(None).cast("string")
    base = df.withColumn("_own", blank_to_null(strip(own)))
    any_own = base.agg(F.bool_or(F.col("_own").isNotNull()).alias("_any_own"))
    looked_up = manifest.select(F.col(key), F.col("emotion").alias("_manifest"))
    joined = beside(base.drop(emotion).join(looked_up, key, "left"), any_own)
    value = F.when(F.col("_any_own"), F.col("_own")).otherwise(blank_to_null(strip(F.col("_manifest"))))
    return joined.withColumn(emotion, F.coalesce(value, F.lit("unknown"))).drop("_own", "_manifest", "_any_own")


def with_grid(df: DataFrame, **values: Sequence) -> DataFrame:
    """Every row under every combination of the given settings.

    The settings are a handful of literals, so the grid is an explode of arrays and no join.
    """
    out = df
    for name, vals in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in vals])))
    return out


def config_grid(df: DataFrame, configs: Sequence[Mapping]) -> DataFrame:
    """Every row under every config; ``ord`` keeps the order of the list."""
    structs = [
        F.struct(F.lit(i).alias("ord"), *[F.lit(v).alias(k) for k, v in c.items()]) for i, c in enumerate(configs)
    ]
    return df.withColumn("_cfg", F.explode(F.array(*structs))).select(*df.columns, "_cfg.*")


def value_grid(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All combinations of the values that occur in the slice columns.

    Each column is reduced to its set of values by an aggregate; the combinations, which are the
    result itself, come from exploding the sets.  Slice columns are label domains: their value
    sets are small or the result could not be read.
    """
    sets = df.agg(*[F.collect_set(c).alias(c) for c in cols])
    for c in cols:
        sets = sets.withColumn(c, F.explode(c))
    return sets


def expected_left_join(spark: SparkSession, expected: Sequence[str], column: str, facts: DataFrame) -> DataFrame:
    """Every expected value, with 0 for the counts of those without facts."""
    base = spark.createDataFrame([(v,) for v in expected], f"{column} string")
    counts = [c for c in facts.columns if c != column]
    return base.join(facts, column, "left").fillna(0, counts)
