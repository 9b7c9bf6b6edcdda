"""Speaker-disjoint splits, names and combined input tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions.labels import file_name
from parley.functions.text import safe_name
from parley.operators.beside import beside
from parley.operators.ordered import OrderedScan, keep_first
from parley.operators.rows import TRANSLATION_COLUMNS, require_columns, shuffle_key


def split_sizes(n: Column, dev_ratio: float, holdout_ratio: float) -> tuple[Column, Column]:
    """Speakers in dev and in holdout; test gets the rest, and at least one speaker if there is any."""
    dev = F.greatest(F.lit(1), F.floor(n * dev_ratio))
    hold = F.greatest(F.lit(1), F.floor(n * holdout_ratio))
    too_few = n - dev - hold < 1
    small_dev = F.greatest(F.lit(0), n - 2)
    return (
        F.when(too_few, small_dev).otherwise(dev),
        F.when(too_few, n - small_dev - 1).otherwise(hold),
    )


def speaker_split(meta: DataFrame, dev_ratio: float = 0.20, holdout_ratio: float = 0.10, seed: int = 42, speaker: str = "speaker_id") -> DataFrame:
    """(speaker, split): the distinct speakers in a seeded random order, cut into dev, holdout and test.

    The order is that of an MD5 over seed and speaker, so it does not depend on partitions or on
    the other columns.  Ranks come from an ordered scan, not from a window over one partition.
    """
    speakers = meta.select(speaker).distinct()
    number, digest = shuffle_key(F.col(speaker), seed)
    ranked = OrderedScan(speakers.withColumns({"_num": number, "_dig": digest}), [], ["_num", "_dig"]).row_number("_rank").result()
    dev, hold = split_sizes(F.col("_speakers"), dev_ratio, holdout_ratio)
    total = speakers.agg(F.count(F.lit(1)).alias("_speakers"))
    return beside(ranked, total).select(
        speaker,
        F.when(F.col("_rank") <= dev, "dev").when(F.col("_rank") <= dev + hold, "holdout").otherwise("test").alias("split"),
    )


def assign_split(meta: DataFrame, split_of: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """Rows take the split of their speaker.

    The speaker table is broadcast by Spark while it is small; beyond that the join shuffles, and
    the runtime skew join splits a speaker that holds a large share of the rows.
    """
    return meta.join(split_of, speaker)


def split_disjoint(assigned: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """Speakers seen in more than one split; none after :func:`assign_split`."""
    pairs = assigned.select(speaker, "split").distinct()
    return pairs.groupBy(speaker).agg(F.count(F.lit(1)).alias("splits")).filter(F.col("splits") > 1)


def unique_names(df: DataFrame, path: str = "path", dataset: str = "dataset", order: str = "pos", ext: str = ".wav") -> DataFrame:
    """Add ``name``: ``<dataset>_<stem>.wav``; the second and later of a name in a split get ``_1``, ``_2``, ..."""
    base = F.concat(safe_name(F.col(dataset)), F.lit("_"), F.regexp_replace(file_name(F.col(path)), r"(?<=.)\.[^.]*$", ""))
    ranked = OrderedScan(df.withColumn("_base", base), ["split", "_base"], [order]).row_number("_k").result()
    suffix = F.when(F.col("_k") > 1, F.concat(F.lit("_"), (F.col("_k") - 1).cast("string"))).otherwise(F.lit(""))
    return ranked.withColumn("name", F.concat("_base", suffix, F.lit(ext))).drop("_base", "_k")


def combine_inputs(tables: Sequence[DataFrame], order: str) -> DataFrame:
    """Concatenate translation tables in the given order, drop rows with nothing in them, keep first duplicates.

    ``order`` is a column of every table that fixes the row order inside it.
    """
    parts = None
    for i, t in enumerate(tables):
        require_columns(t, [*TRANSLATION_COLUMNS, order])
        part = t.select(*TRANSLATION_COLUMNS, F.lit(i).alias("_src"), F.col(order).alias("_pos"))
        part = part.dropna("all", subset=list(TRANSLATION_COLUMNS))
        parts = part if parts is None else parts.unionByName(part)
    return keep_first(parts, TRANSLATION_COLUMNS, ["_src", "_pos"])


def pick_files(files: DataFrame, n: int, prefer: str | None = None, path: str = "path", split: str = "split") -> DataFrame:
    """The first ``n`` files by path in the preferred split; from everywhere when it has none."""
    if prefer is None:
        return files.orderBy(path).limit(n)
    here = files.agg(F.bool_or(F.col(split) == prefer).alias("_any"))
    wanted = beside(files, here).filter(~F.coalesce("_any", F.lit(False)) | (F.col(split) == prefer)).drop("_any")
    return wanted.orderBy(path).limit(n)
