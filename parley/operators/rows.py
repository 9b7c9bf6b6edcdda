"""Projections and filters over evaluation tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions import labels as L
from parley.functions.text import is_blank, strip
from parley.operators.beside import beside
from parley.operators.ordered import OrderedScan

SOURCE_COLUMNS = ("source_text", "source_language", "target_language")
REFERENCE = "reference_translation"
PREDICTION = "translated_text_model"
TRANSLATION_COLUMNS = (*SOURCE_COLUMNS, REFERENCE)

# The data set whose rows need no reference, and the mark of a failed model call.
EXEMPT_DATASET = "EXPO"
ERROR_MARK = "(error:"


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The table itself, or ``ValueError`` naming the first missing column."""
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"Table must include column {c!r}")
    return df


def split_features_labels(
    df: DataFrame, label: str = REFERENCE, features: Sequence[str] = SOURCE_COLUMNS
) -> tuple[DataFrame, DataFrame]:
    """Feature columns (with every extra column) and the label column."""
    require_columns(df, [*features, label])
    extras = [c for c in df.columns if c not in (*features, label)]
    return df.select(*features, *extras), df.select(label)


def task_view(df: DataFrame, task: str) -> DataFrame:
    """(feature, label) of a task: translation, asr or emotion."""
    if task == "asr":
        feature, label = "file", "reference_transcript"
    elif task == "emotion":
        feature, label = ("file" if "file" in df.columns else "source_text"), "emotion"
    else:
        feature, label = "source_text", REFERENCE
    require_columns(df, [feature, label])
    return df.select(F.col(feature).alias("feature"), F.col(label).alias("label"))


def has_text(c: Column) -> Column:
    return ~is_blank(c)


def is_exempt(dataset: Column, exempt: str = EXEMPT_DATASET) -> Column:
    return F.upper(strip(F.coalesce(dataset, F.lit("")))) == exempt.upper()


def keep_scorable(df: DataFrame, reference: str = REFERENCE, dataset: str = "dataset", exempt: str = EXEMPT_DATASET) -> DataFrame:
    """Rows with a reference, and rows of the exempt data set."""
    return df.filter(has_text(F.col(reference)) | is_exempt(F.col(dataset), exempt))


def exempt_without_reference(df: DataFrame, reference: str = REFERENCE, dataset: str = "dataset", exempt: str = EXEMPT_DATASET) -> DataFrame:
    """How many rows are kept only because their data set is exempt."""
    return df.agg(F.count_if(is_exempt(F.col(dataset), exempt) & ~has_text(F.col(reference))).alias("n_exempt_no_ref"))


def nonempty_reference(df: DataFrame, reference: str = REFERENCE, hypothesis: str = PREDICTION) -> DataFrame:
    """Rows with a reference; a missing hypothesis becomes an empty text."""
    return df.filter(has_text(F.col(reference))).withColumn(hypothesis, F.coalesce(F.col(hypothesis), F.lit("")))


def as_reference(preds: DataFrame, source_language: str = "en", target_language: str = "es") -> DataFrame:
    """Predictions turned into a labelled table, the four translation columns in front."""
    source = "source_text" if "source_text" in preds.columns else "source_phrase"
    require_columns(preds, [source, PREDICTION])
    front = [
        F.col(source).alias("source_text"), F.lit(source_language).alias("source_language"),
        F.lit(target_language).alias("target_language"), F.col(PREDICTION).alias(REFERENCE),
    ]
    rest = [c for c in preds.columns if c not in (*TRANSLATION_COLUMNS, source, PREDICTION)]
    return preds.select(*front, *rest)


def drop_error_rows(df: DataFrame, hypothesis: str = PREDICTION) -> DataFrame:
    return df.filter(~F.contains(F.coalesce(F.col(hypothesis), F.lit("")), F.lit(ERROR_MARK)))


def shuffle_key(key: Column, seed: int) -> tuple[Column, Column]:
    """A repeatable random order: (number to cut along, text to break ties)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), digest


def slice_rows(
    df: DataFrame, order: str, offset: int = 0, limit: int | None = None,
    tail: int | None = None, shuffle_seed: int | None = None,
) -> DataFrame:
    """Rows by rank: offset and limit, the last ``tail`` (which wins over the rest), or after a seeded shuffle.

    Ranks come from an ordered scan over the whole table, so a large limit never passes through
    one task or the driver.
    """
    if shuffle_seed is not None and tail is None:
        number, digest = shuffle_key(F.col(order), shuffle_seed)
        keyed, cut = df.withColumns({"_num": number, "_dig": digest}), ["_num", "_dig"]
    else:
        keyed, cut = df.withColumn("_num", F.col(order).cast("long")), ["_num"]
    ranked = OrderedScan(keyed, [], cut).row_number("_rank").result()
    if tail is not None:
        total = df.agg(F.count(F.lit(1)).alias("_total"))
        ranked = beside(ranked, total).filter(F.col("_rank") > F.col("_total") - tail).drop("_total")
    else:
        ranked = ranked.filter(F.col("_rank") > offset)
        if limit is not None:
            ranked = ranked.filter(F.col("_rank") <= offset + limit)
    return ranked.drop("_rank", *cut)


def file_checks(df: DataFrame, expected_sr: int = 16000, min_duration: float = 0.5, max_duration: float = 30.0) -> DataFrame:
    """Add ``errors`` and ``passed`` to file metadata; a row without metadata is an unreadable file.

    Seconds in messages have two digits, decimal halves rounded up.
    """
    sr, ch, dur = F.col("sample_rate"), F.col("channels"), F.col("duration_sec")
    unreadable = sr.isNull() | ch.isNull() | dur.isNull()
    seconds = F.format_string("%.2f", dur)
    rules = F.array(
        F.when(sr != expected_sr, F.concat(F.lit("sample_rate "), sr.cast("string"), F.lit(f" != expected {expected_sr}"))),
        F.when(ch != 1, F.concat(F.lit("channels "), ch.cast("string"), F.lit(" != 1 (mono)"))),
        F.when(dur < min_duration, F.concat(F.lit("duration "), seconds, F.lit(f"s < min {min_duration}s"))),
        F.when(dur > max_duration, F.concat(F.lit("duration "), seconds, F.lit(f"s > max {max_duration}s"))),
    )
    errors = F.when(unreadable, F.array(F.lit("unreadable file"))).otherwise(F.array_compact(rules))
    return df.withColumn("errors", errors).withColumn("passed", F.size("errors") == 0)


def label_error(label: Column, allowed: Sequence[str]) -> Column:
    """What is wrong with a label outside the allowed set; null for a good one and for none."""
    msg = F.concat(F.lit("invalid label '"), label, F.lit("' (allowed: " + ", ".join(allowed) + ")"))
    return F.when((label != "") & ~label.isin(*allowed), msg)


def label_domain_check(df: DataFrame, allowed: Sequence[str] | None, label: Column | None = None) -> DataFrame:
    """Rows whose label is outside the allowed set; blanks pass, and without a set everything does."""
    if label is None:
        cands = [F.nullif(F.col(c), F.lit("")) for c in ("emotion", "label") if c in df.columns]
        label = F.coalesce(*cands, F.lit(None).cast("string"))
    if allowed is None:
        return df.filter(F.lit(False)).withColumn("error", F.lit(""))
    return df.withColumn("error", label_error(label, allowed)).filter(F.col("error").isNotNull())
