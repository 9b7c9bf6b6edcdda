"""Quality summaries and the anomaly and representation reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from parley.functions import labels as L
from parley.functions.labels import SPLITS
from parley.functions.text import blank_to_null
from parley.operators import joins, slices
from parley.operators.beside import beside
from parley.operators.rows import label_error


def quality_summary(reports: DataFrame, label_errors: DataFrame | None = None) -> DataFrame:
    """Checked, passed and failed files, the number of label errors and a sample of them (the first by text)."""
    out = reports.agg(
        F.count(F.lit(1)).alias("files_checked"),
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
    )
    if label_errors is None:
        return out.withColumn("label_errors", F.lit(0).cast("long")).withColumn("sample_error", F.lit(None).cast("string"))
    errs = label_errors.agg(F.count(F.lit(1)).alias("label_errors"), F.min("error").alias("sample_error"))
    return beside(out, errs)


def quality_summary_of(reports: DataFrame, label: str, allowed: Sequence[str]) -> DataFrame:
    """The same summary from file reports that still have their label: counts and label errors in one pass."""
    error = label_error(F.col(label), allowed)
    return reports.agg(
        F.count(F.lit(1)).alias("files_checked"), F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.count(error).alias("label_errors"), F.min(error).alias("sample_error"),
    )


def quality_report(reports: DataFrame, label_errors: DataFrame) -> DataFrame:
    """Long form (section, key, n): the counts of the summary, and every label error with its path."""
    counts = reports.agg(*[F.count_if(c).alias(n) for n, c in (
        ("files_checked", F.lit(True)), ("passed", F.col("passed")), ("failed", ~F.col("passed")))])
    rows = counts.unpivot([], ["files_checked", "passed", "failed"], "key", "n").select(F.lit("files").alias("section"), "key", "n")
    errors = label_errors.select(F.lit("label error").alias("section"), F.concat_ws(": ", "path", "error").alias("key"), F.lit(1).cast("long").alias("n"))
    return rows.unionByName(errors)


def schema_failures(summary: DataFrame, enabled: bool = True) -> DataFrame:
    """Findings of the validation step: no summary at all, failed files, or files checked and none passed."""
    if not enabled:
        return summary.filter(F.lit(False)).select(F.lit("").alias("check"), F.lit("").alias("finding"))
    summary = summary.agg(F.count(F.lit(1)).alias("_rows"), *[F.max(c).alias(c) for c in ("files_checked", "passed", "failed", "sample_error")])
    sample = F.col("sample_error")
    cut = F.when(F.length(sample) > 80, F.concat(F.substring(sample, 1, 80), F.lit("..."))).otherwise(sample)
    failed = F.concat(
        F.lit("Validation reported "), F.col("failed").cast("string"), F.lit(" failed files"),
        F.coalesce(F.concat(F.lit("; sample: "), cut), F.lit("")),
    )
    finding = F.when(F.col("_rows") == 0, "Validation gave no summary").when(F.col("failed") > 0, failed).when(
        (F.col("files_checked") > 0) & (F.col("passed") == 0), F.lit("Validation reported 0 passed files")
    )
    return summary.select(F.lit("schema").alias("check"), finding.alias("finding")).filter(F.col("finding").isNotNull())


def _pct(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def finding(df: DataFrame, check: str, text: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), text.alias("finding"))


def label_findings(df: DataFrame, **limits) -> DataFrame:
    text = F.concat(F.lit("Label '"), F.col("value"), F.lit("' is "), _pct(F.col("ratio")), F.lit(" of total ("), F.col("reason"), F.lit(")"))
    return finding(slices.label_imbalance(df, **limits), "label", text)


def source_findings(df: DataFrame, **limits) -> DataFrame:
    text = F.concat(F.lit("Dataset '"), F.col("value"), F.lit("' is "), _pct(F.col("ratio")), F.lit(" of total ("), F.col("reason"), F.lit(")"))
    return finding(slices.source_balance(df, **limits), "dataset", text)


def split_findings(df: DataFrame, **limits) -> DataFrame:
    p = slices.split_presence(df, **limits).filter(F.col("status") != "ok")
    return finding(p, "split", F.concat(F.lit("Split "), F.col("split"), F.lit(" has "), F.col("n").cast("string"), F.lit(" files")))


def duration_findings(df: DataFrame, **limits) -> DataFrame:
    r = slices.out_of_range_ratio(df, **limits).filter(F.col("flagged"))
    return finding(r, "duration", F.concat(
        F.lit("Files outside the duration range: "), F.col("bad").cast("string"), F.lit("/"), F.col("total").cast("string")))


def consistency_findings(manifest: DataFrame, files: DataFrame) -> DataFrame:
    def said(count: str, what: str) -> Column:
        return F.when(F.col(count) > 0, F.concat(F.lit("Split "), F.col("split"), F.lit(": "), F.col(count).cast("string"), F.lit(what)))

    both = F.array(said("missing_files", " manifest entries point to missing files"), said("not_in_manifest", " files not in manifest"))
    return finding(joins.manifest_file_diff(manifest, files), "consistency", F.explode(F.array_compact(both)))


def inventory_findings(inventory: DataFrame) -> DataFrame:
    empty = inventory.filter(F.col("status") == "empty")
    return finding(empty, "inventory", F.concat(F.lit("Empty raw folder: "), F.col("dataset")))


def all_anomalies(findings: Sequence[DataFrame]) -> DataFrame:
    """The findings of all checks in one table."""
    return reduce(DataFrame.unionByName, findings)


def verdict(findings: DataFrame) -> DataFrame:
    """One row: how many findings, and whether there are none."""
    return findings.agg(F.count(F.lit(1)).alias("anomalies")).withColumn("passed", F.col("anomalies") == 0)


def manifest_facts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """All counts of the checks from one pass over both tables: (kind, value, n, bad, missing, extra, total, values).

    Kinds are ``total``, ``split``, ``emotion``, ``dataset`` (n rows of a value, bad ones by duration) and ``files`` (per split, distinct entries without a
    file and files without an entry).  ``total`` and ``values`` are the rows and values of a kind.  Every row is counted under its kinds
    before the shuffle; only pairs of split and file move as they are.  Expected splits, and the total, are there with 0.
    """
    none, text = F.lit(None).cast("string"), F.col("file")
    bad = (F.col("duration_sec").isNull() | (F.col("duration_sec") < 0.5) | (F.col("duration_sec") > 30.0)).cast("long")

    def fact(kind: str, value: Column, file: Column, n: Column | int, bad: Column | int, side: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), file.alias("file"), F.lit(n).cast("long").alias("n"),
                        F.lit(bad).cast("long").alias("bad"), F.lit(side).alias("side"))

    entry = F.when(blank_to_null(text).isNotNull(), fact("files", F.col("split"), text, 0, 0, 1))
    seen = F.array_compact(F.array(
        fact("total", none, none, 1, bad, 0), *(fact(k, F.col(k), none, 1, 0, 0) for k in ("split", "emotion", "dataset")), entry))
    of_files = files.select(fact("files", F.col("split"), text, 0, 0, 2).alias("f"))
    given = manifest.sparkSession.createDataFrame([("total", None), *(("split", s) for s in SPLITS)], "kind string, value string")
    rows = manifest.select(F.explode(seen).alias("f")).unionByName(of_files).select("f.*").unionByName(
        given.select("kind", "value", none.alias("file"), *(F.lit(0).cast("long").alias(c) for c in ("n", "bad")), F.lit(0).alias("side")))
    pairs = rows.groupBy("kind", "value", "file").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.bit_or("side").alias("side"))
    facts = pairs.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count_if(F.col("side") == 1).alias("missing"),
                                               F.count_if(F.col("side") == 2).alias("extra"))
    same = Window.partitionBy("kind")
    return facts.withColumns({"total": F.sum("n").over(same), "values": F.count(F.lit(1)).over(same)})


def anomaly_report(manifest: DataFrame, files: DataFrame, summary: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Every anomaly check over a manifest, the known files and the quality summary, with the limits the single checks have.

    One pass over the manifest and one over the files give one row for each thing counted; its findings are exploded from it.
    """
    kind, value, n, total = (F.col(c) for c in ("kind", "value", "n", "total"))
    ratio = F.try_divide(n, total)

    def said(check: str, when: Column, *parts: Column | str) -> Column:
        return F.when(when, F.struct(F.lit(check).alias("check"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("finding")))

    def share(check: str, what: str, low: Column, high: Column, on: Column) -> Column:
        return said(check, on & (low | high), f"{what} '", value, "' is ", _pct(ratio), " of total (", F.when(high, "max").otherwise("min"), ")")

    count = lambda c: F.col(c).cast("string")
    only_unknown = (F.col("values") == 1) & (value == "unknown")
    checks = F.array_compact(F.array(
        said("split", (kind == "split") & value.isin(*SPLITS) & (n < 1), "Split ", value, " has ", count("n"), " files"),
        said("duration", (kind == "total") & (F.try_divide("bad", n) > 0.2), "Files outside the duration range: ", count("bad"), "/", count("n")),
        share("label", "Label", (total >= 20) & (ratio < 0.05), ratio > 0.80, (kind == "emotion") & ~F.coalesce(only_unknown, F.lit(False))),
        said("consistency", (kind == "files") & (F.col("missing") > 0), "Split ", value, ": ", count("missing"), " manifest entries point to missing files"),
        said("consistency", (kind == "files") & (F.col("extra") > 0), "Split ", value, ": ", count("extra"), " files not in manifest"),
        share("dataset", "Dataset", ratio < 0.01, ratio > 0.95, (kind == "dataset") & (F.col("values") > 1)),
    ))
    parts = [manifest_facts(manifest, files).select(F.explode(checks).alias("c")).select("c.*"), schema_failures(summary)]
    if inventory is not None:
        parts.insert(0, inventory_findings(inventory))
    return all_anomalies(parts)


# Advice that comes with a representation report.
BIAS_ADVICE = (
    "Score each emotion on its own.",
    "Trust rare classes less.",
    "Compare durations with those met in use.",
)


def bias_report(manifest: DataFrame, emotion: str = "emotion", threshold: float = 0.5) -> DataFrame:
    """Long form (section, key, n, expected, flagged): totals, slices, speakers and groups, all counts from one aggregate; then advice, in order.

    A manifest without entries gets no advice.
    """
    null = F.lit(None).cast("string")
    base = manifest.select(F.col(emotion).cast("string").alias("emotion"), F.col("speaker_id").cast("string").alias("who"), L.duration_bucket(F.col("duration_sec")).alias("bucket"))
    e, w, b = F.col("emotion"), F.coalesce("who", F.lit("unknown")), F.col("bucket")
    facts = F.array(*(F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in (
        ("entries", null), ("emotion", e), ("duration", b), ("speaker", w), ("group", F.concat_ws("|", e, F.col("who"))))))
    given = manifest.sparkSession.createDataFrame([("entries", None), *(("duration", v) for v in L.DURATION_BUCKETS)], "section string, key string")
    counted = base.select(F.explode(facts).alias("f")).select("f.*", F.lit(1).cast("long").alias("n")).unionByName(given.withColumn("n", F.lit(0).cast("long")))
    rows = counted.groupBy("section", "key").agg(F.sum("n").alias("n"))
    # totals of the two sliced columns and the number of speakers, next to every row
    one = rows.agg(F.struct(*[f(s).alias(f"{name}_{s}") for s in ("emotion", "duration") for name, f in (
        ("total", lambda s: F.sum(F.when(F.col("section") == s, F.col("n")))), ("values", lambda s: F.count_if(F.col("section") == s)))],
        F.count_if(F.col("section") == "speaker").alias("speakers")).alias("_t"))
    pick = lambda name: F.when(F.col("section") == "emotion", F.col(f"_t.{name}_emotion")).when(F.col("section") == "duration", F.col(f"_t.{name}_duration"))
    expected, flag = slices.disparity_from_uniform(F.col("n"), pick("total"), pick("values"), threshold)
    rows = beside(rows, one).withColumns({"expected": F.round(expected, 1), "flagged": F.coalesce(flag, F.lit(False))})

    def row(section: Column, key: Column, n: Column, expected: Column, flagged: Column) -> Column:
        return F.struct(section.alias("section"), key.alias("key"), n.cast("long").alias("n"), expected.cast("double").alias("expected"), flagged.alias("flagged"))

    of_total = F.array(row(F.lit("total"), F.lit("entries"), F.col("n"), F.lit(None), F.lit(False)), row(F.lit("total"), F.lit("speakers"), F.col("_t.speakers"), F.lit(None), F.lit(False)))
    advice = F.array(*(row(F.lit("advice"), F.lit(a), F.lit(i), F.lit(None), F.lit(False)) for i, a in enumerate(BIAS_ADVICE)))
    of_total = F.when(F.col("n") > 0, F.concat(of_total, advice)).otherwise(of_total)
    itself = F.array(row(F.col("section"), F.col("key"), F.col("n"), F.col("expected"), F.col("flagged")))
    return rows.select(F.explode(F.when(F.col("section") == "entries", of_total).otherwise(itself)).alias("r")).select("r.*")
