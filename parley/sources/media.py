"""Media files: listing, inventory, checksums and source selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.functions.labels import file_name

# What counts as sound, film, archive, and what a folder may hold and still be empty.
AUDIO = ("wav", "mp3", "flac", "ogg", "m4a")
VIDEO = ("mp4", "m4v", "mkv", "avi", "mov")
TEXT = ("txt",)
ARCHIVE_PATTERN = r"(?i)\.(zip|tar\.gz|tgz|tar|gz)$"
IGNORED = (".gitkeep", ".DS_Store")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def scan_media(spark: SparkSession, root: str, exts: Sequence[str] = AUDIO) -> DataFrame:
    """(path, length) of the media files under a folder, any letter case, shadow files left out.

    Only path and length are read; the content column is pruned from the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    keep = extension(F.col("path")).isin(*exts) & ~file_name(F.col("path")).startswith("._")
    return files.filter(keep).select("path", "length").distinct()


def inventory(files: DataFrame, expected: DataFrame, dataset: str = "dataset", path: str = "path", include_video: bool = False) -> DataFrame:
    """Status per expected data set: empty, media, archives (not unpacked) or other.

    The expected list is on the left, because an empty folder has no rows of its own.
    """
    name, ext = file_name(F.col(path)), extension(F.col(path))
    media = ext.isin(*AUDIO, *TEXT, *(VIDEO if include_video else ()))
    ignored = name.isin(*IGNORED) | name.startswith("._")
    seen = files.groupBy(dataset).agg(
        F.count_if(~ignored).alias("files"), F.count_if(media).alias("media"),
        F.count_if(name.rlike(ARCHIVE_PATTERN) & ~name.startswith("._")).alias("archives"),
    )
    status = (
        F.when(F.coalesce("files", F.lit(0)) == 0, "empty").when(F.col("media") > 0, "media")
        .when(F.col("archives") > 0, "archives").otherwise("other")
    )
    return expected.select(dataset).distinct().join(seen, dataset, "left").select(
        dataset, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "media", "archives")], status.alias("status"))


def verify_checksums(files: DataFrame, expected: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """SHA-256 of every file next to the expected one: ok, mismatch, or unchecked where none is known."""
    hashed = files.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    want = expected.select(key, F.lower("sha256").alias("expected"))
    status = F.when(F.col("expected").isNull(), "unchecked").when(F.col("expected") == F.col("sha256"), "ok").otherwise("mismatch")
    return hashed.join(want, key, "left").withColumn("status", status)


def count_by_top_dir(files: DataFrame, path: str = "path") -> DataFrame:
    """Files per first part of a relative path."""
    top = F.element_at(F.split(F.col(path), "/"), 1)
    return files.groupBy(top.alias("top")).agg(F.count(F.lit(1)).alias("n")).orderBy("top")


def select_sources(groups: Sequence[DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    """Sources of all groups, or the named ones; ``available`` is false where there is no URL."""
    out = groups[0].select("name", "url")
    for g in groups[1:]:
        out = out.unionByName(g.select("name", "url"))
    if names:
        out = out.filter(F.col("name").isin(*names))
    return out.withColumn("available", F.col("url").isNotNull())
