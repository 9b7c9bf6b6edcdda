"""Manifests, slices, checks and reports over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import classes, joins, quality, rows, slices, splits
from parley.plans.base import file_meta, known_files, manifest, query, rounded, sql, table

# --- slices ------------------------------------------------------------------

COUNTS = """c AS (SELECT emotion AS value, count(*) AS n FROM manifest GROUP BY 1),
    s AS (SELECT value, n, n / CAST(sum(n) OVER () AS DOUBLE) AS ratio, sum(n) OVER () AS total, count(*) OVER () AS k FROM c)"""


@query("slice_counts", sql("manifest", "SELECT value, n, round(ratio, 6) AS ratio, CAST(total AS BIGINT) AS total, CAST(k AS BIGINT) AS slices FROM s", COUNTS))
def _(spark, d):
    return rounded(slices.slice_counts(manifest(spark, d), "emotion"))


@query("label_imbalance", sql("manifest", """SELECT value, n, round(ratio, 6) AS ratio, CASE WHEN ratio > 0.5 THEN 'max' ELSE 'min' END AS reason
    FROM s WHERE (ratio > 0.5 OR (total >= 20 AND ratio < 0.12)) AND NOT (k = 1 AND value = 'unknown')""", COUNTS))
def _(spark, d):
    return rounded(slices.label_imbalance(manifest(spark, d), max_ratio=0.5, min_ratio=0.12))


@query("source_balance", sql("manifest", """SELECT value, n, round(ratio, 6) AS ratio, CASE WHEN ratio < 0.12 THEN 'min' ELSE 'max' END AS reason
    FROM s WHERE (ratio < 0.12 OR ratio > 0.5) AND k > 1""", COUNTS))
def _(spark, d):
    return rounded(slices.source_balance(manifest(spark, d), "emotion", min_ratio=0.12, max_ratio=0.5))


@query("slice_disparity", sql("manifest", """SELECT value, n, round(total / CAST(k AS DOUBLE), 6) AS expected,
    abs(n - total / CAST(k AS DOUBLE)) / (total / CAST(k AS DOUBLE)) > 0.5 AS flagged FROM s""", COUNTS))
def _(spark, d):
    return rounded(slices.slice_disparity(manifest(spark, d), "emotion"))


@query("duration_bucket", sql("manifest", """SELECT value, CAST(COALESCE(n, 0) AS BIGINT) AS n, round(t.total / CAST(3 AS DOUBLE), 6) AS expected,
    abs(COALESCE(n, 0) - t.total / CAST(3 AS DOUBLE)) / (t.total / CAST(3 AS DOUBLE)) > 0.5 AS flagged
    FROM (VALUES ('short'), ('medium'), ('long')) v(value)
    LEFT JOIN (SELECT CASE WHEN duration_sec < 2 THEN 'short' WHEN duration_sec <= 5 THEN 'medium' ELSE 'long' END AS value, count(*) AS n
               FROM manifest GROUP BY 1) b USING (value), (SELECT count(*) AS total FROM manifest) t"""))
def _(spark, d):
    return rounded(slices.duration_slices(manifest(spark, d)))


@query("distinct_speakers", sql("manifest", """SELECT speaker_id AS speaker, count(*) AS n, (SELECT count(DISTINCT speaker_id) FROM manifest) AS speakers
    FROM manifest GROUP BY 1"""))
def _(spark, d):
    return slices.distinct_speakers(manifest(spark, d))


@query("overall_counts", sql("manifest", """SELECT GROUPING(emotion) = 1 AS overall, emotion, speaker_id, count(*) AS n
    FROM manifest GROUP BY GROUPING SETS ((), (emotion, speaker_id))"""))
def _(spark, d):
    return slices.overall_counts(manifest(spark, d), ["emotion", "speaker_id"])


@query("split_presence", sql("manifest", """SELECT split, CAST(COALESCE(n, 0) AS BIGINT) AS n,
    CASE WHEN COALESCE(n, 0) = 0 THEN 'missing' WHEN n < 150 THEN 'few' ELSE 'ok' END AS status
    FROM (VALUES ('dev'), ('test'), ('holdout'), ('extra')) v(split)
    LEFT JOIN (SELECT split, count(*) AS n FROM manifest GROUP BY 1) c USING (split)"""))
def _(spark, d):
    return slices.split_presence(manifest(spark, d), ("dev", "test", "holdout", "extra"), 150)


@query("out_of_range_ratio", sql("manifest", """SELECT bad, total, round(bad / CAST(total AS DOUBLE), 6) AS ratio, bad / CAST(total AS DOUBLE) > 0.2 AS flagged
    FROM (SELECT count(*) FILTER (WHERE duration_sec IS NULL OR duration_sec < 0.5 OR duration_sec > 30) AS bad, count(*) AS total FROM manifest)"""))
def _(spark, d):
    return rounded(slices.out_of_range_ratio(manifest(spark, d)))


@query("numeric_profile", """SELECT 'l_quantity' AS "column", count(l_quantity) AS n, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std,
    min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem UNION ALL
    SELECT 'l_extendedprice', count(l_extendedprice), round(avg(l_extendedprice), 4), round(stddev_samp(l_extendedprice), 4), min(l_extendedprice), max(l_extendedprice) FROM lineitem
    UNION ALL SELECT 'l_discount', count(l_discount), round(avg(l_discount), 4), round(stddev_samp(l_discount), 4), min(l_discount), max(l_discount) FROM lineitem""")
def _(spark, d):
    return rounded(slices.numeric_profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 4)


@query("expectations", sql("meta", """, r AS (
    SELECT 'duration_sec exists' AS rule, 1 AS evaluated, 0 AS unexpected UNION ALL SELECT 'subtype exists', 1, 1
    UNION ALL SELECT 'duration_sec between 0.5 and 30.0', count(duration_sec), count(*) FILTER (WHERE duration_sec NOT BETWEEN 0.5 AND 30) FROM meta
    UNION ALL SELECT 'sample_rate between 8000 and 48000', count(sample_rate), count(*) FILTER (WHERE sample_rate NOT BETWEEN 8000 AND 48000) FROM meta
    UNION ALL SELECT 'channels in 1', count(channels), count(*) FILTER (WHERE channels NOT IN (1)) FROM meta)
    SELECT rule, CAST(evaluated AS BIGINT) AS evaluated, CAST(unexpected AS BIGINT) AS unexpected,
    round(100 * unexpected / CAST(evaluated AS DOUBLE), 6) AS pct, unexpected = 0 AS success FROM r"""))
def _(spark, d):
    return rounded(slices.expectations(
        file_meta(spark, d), exist=("duration_sec", "subtype"),
        between=(("duration_sec", 0.5, 30.0), ("sample_rate", 8000, 48000)), within=(("channels", (1,)),)))


# --- checks ------------------------------------------------------------------

CHECKED = """checked AS (SELECT path, CASE WHEN sample_rate IS NULL THEN ['unreadable file'] ELSE list_filter([
      CASE WHEN sample_rate <> 16000 THEN 'sample_rate ' || sample_rate || ' != expected 16000' END,
      CASE WHEN channels <> 1 THEN 'channels ' || channels || ' != 1 (mono)' END,
      CASE WHEN duration_sec < 0.5 THEN 'duration ' || printf('%.2f', round(duration_sec, 2)) || 's < min 0.5s' END,
      CASE WHEN duration_sec > 30 THEN 'duration ' || printf('%.2f', round(duration_sec, 2)) || 's > max 30.0s' END], lambda e: e IS NOT NULL) END AS errors FROM meta)"""


@query("file_checks", sql("meta", "SELECT path, array_to_string(errors, '; ') AS errors, len(errors) = 0 AS passed FROM checked", CHECKED))
def _(spark, d):
    return rows.file_checks(file_meta(spark, d)).select("path", F.array_join("errors", "; ").alias("errors"), "passed")


@query("label_domain_check", sql("meta", "SELECT path, 'invalid label ''' || emotion || ''' (allowed: en, fr)' AS error FROM meta WHERE emotion NOT IN ('en', 'fr')"))
def _(spark, d):
    return rows.label_domain_check(file_meta(spark, d), ["en", "fr"]).select("path", "error")


def _summary(spark, d):
    meta = file_meta(spark, d)
    return quality.quality_summary(rows.file_checks(meta), rows.label_domain_check(meta, ["en", "fr"]))


SUMMARY = """q AS (SELECT count(*) AS files_checked, count(*) FILTER (WHERE len(errors) = 0) AS passed, count(*) FILTER (WHERE len(errors) > 0) AS failed,
      (SELECT count(*) FROM meta WHERE emotion NOT IN ('en', 'fr')) AS label_errors,
      (SELECT min('invalid label ''' || emotion || ''' (allowed: en, fr)') FROM meta WHERE emotion NOT IN ('en', 'fr')) AS sample_error FROM checked)"""


@query("quality_summary", sql("meta", "SELECT * FROM q", CHECKED, SUMMARY))
def _(spark, d):
    return _summary(spark, d)


@query("quality_report", sql("meta", """SELECT 'files' AS section, 'files_checked' AS key, files_checked AS n FROM q UNION ALL SELECT 'files', 'passed', passed FROM q
    UNION ALL SELECT 'files', 'failed', failed FROM q
    UNION ALL SELECT 'label error', path || ': invalid label ''' || emotion || ''' (allowed: en, fr)', 1 FROM meta WHERE emotion NOT IN ('en', 'fr')""", CHECKED, SUMMARY))
def _(spark, d):
    meta = file_meta(spark, d)
    return quality.quality_report(rows.file_checks(meta), rows.label_domain_check(meta, ["en", "fr"]))


FAILURES = """'Validation reported ' || failed || ' failed files; sample: ' || sample_error"""


@query("schema_failures", sql("meta", f"SELECT 'schema' AS \"check\", {FAILURES} AS finding FROM q WHERE failed > 0", CHECKED, SUMMARY))
def _(spark, d):
    return quality.schema_failures(_summary(spark, d))


DIFF = """diff AS (SELECT COALESCE(m.split, k.split) AS split, count(*) FILTER (WHERE k.file IS NULL) AS missing_files,
    count(*) FILTER (WHERE m.file IS NULL) AS not_in_manifest
    FROM (SELECT DISTINCT split, file FROM manifest) m FULL JOIN (SELECT DISTINCT split, file FROM known) k ON k.split = m.split AND k.file = m.file GROUP BY 1)"""


@query("manifest_file_diff", sql("manifest known", "SELECT split, missing_files, not_in_manifest FROM diff", DIFF))
def _(spark, d):
    return joins.manifest_file_diff(manifest(spark, d), known_files(spark, d))


FINDINGS = f"""findings AS (
    SELECT 'split' AS "check", 'Split ' || split || ' has ' || COALESCE(n, 0) || ' files' AS finding FROM (VALUES ('dev'), ('test'), ('holdout')) v(split)
      LEFT JOIN (SELECT split, count(*) AS n FROM manifest GROUP BY 1) USING (split) WHERE COALESCE(n, 0) < 1
    UNION ALL SELECT 'schema', {FAILURES} FROM q WHERE failed > 0
    UNION ALL SELECT 'duration', 'Files outside the duration range: ' || bad || '/' || total FROM (
      SELECT count(*) FILTER (WHERE duration_sec < 0.5 OR duration_sec > 30) AS bad, count(*) AS total FROM manifest) WHERE bad / CAST(total AS DOUBLE) > 0.2
    UNION ALL SELECT 'label', 'Label ''' || value || ''' is ' || printf('%.1f%%', ratio * 100) || ' of total (' || CASE WHEN ratio > 0.8 THEN 'max' ELSE 'min' END || ')'
      FROM s WHERE ratio > 0.8 OR (total >= 20 AND ratio < 0.05)
    UNION ALL SELECT 'consistency', 'Split ' || split || ': ' || missing_files || ' manifest entries point to missing files' FROM diff WHERE missing_files > 0
    UNION ALL SELECT 'consistency', 'Split ' || split || ': ' || not_in_manifest || ' files not in manifest' FROM diff WHERE not_in_manifest > 0
    UNION ALL SELECT 'dataset', 'Dataset ''' || dataset || ''' is ' || printf('%.1f%%', ratio * 100) || ' of total (' || CASE WHEN ratio < 0.01 THEN 'min' ELSE 'max' END || ')'
      FROM (SELECT dataset, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS ratio, count(*) OVER () AS k FROM manifest GROUP BY 1)
      WHERE k > 1 AND (ratio < 0.01 OR ratio > 0.95))"""


def _report(spark, d):
    summary = quality.quality_summary_of(rows.file_checks(file_meta(spark, d)), "emotion", ["en", "fr"])
    return quality.anomaly_report(manifest(spark, d), known_files(spark, d), summary)


@query("anomaly_report", sql("manifest known meta", 'SELECT "check", finding FROM findings', CHECKED, SUMMARY, DIFF, COUNTS, FINDINGS))
def _(spark, d):
    return _report(spark, d)


@query("all_anomalies", sql("manifest known meta", "SELECT count(*) AS anomalies, count(*) = 0 AS passed FROM findings", CHECKED, SUMMARY, DIFF, COUNTS, FINDINGS))
def _(spark, d):
    return quality.verdict(_report(spark, d))


@query("bias_report", sql("manifest", """SELECT 'total' AS section, 'entries' AS key, count(*) AS n, CAST(NULL AS DOUBLE) AS expected, FALSE AS flagged FROM manifest
    UNION ALL SELECT 'total', 'speakers', count(DISTINCT speaker_id), NULL, FALSE FROM manifest
    UNION ALL SELECT 'emotion', value, n, round(total / CAST(k AS DOUBLE), 1), abs(n - total / CAST(k AS DOUBLE)) / (total / CAST(k AS DOUBLE)) > 0.5 FROM s
    UNION ALL SELECT 'duration', value, CAST(COALESCE(n, 0) AS BIGINT), round(t.total / CAST(3 AS DOUBLE), 1),
      abs(COALESCE(n, 0) - t.total / CAST(3 AS DOUBLE)) / (t.total / CAST(3 AS DOUBLE)) > 0.5
      FROM (VALUES ('short'), ('medium'), ('long')) v(value)
      LEFT JOIN (SELECT CASE WHEN duration_sec < 2 THEN 'short' WHEN duration_sec <= 5 THEN 'medium' ELSE 'long' END AS value, count(*) AS n FROM manifest GROUP BY 1) b USING (value),
      (SELECT count(*) AS total FROM manifest) t
    UNION ALL SELECT 'speaker', speaker_id, count(*), CAST(NULL AS DOUBLE), FALSE FROM manifest GROUP BY speaker_id
    UNION ALL SELECT 'group', emotion || '|' || speaker_id, count(*), NULL, FALSE FROM manifest GROUP BY emotion, speaker_id
    UNION ALL SELECT 'advice', text, pos, NULL, FALSE FROM (VALUES
      (0, 'Score each emotion on its own.'),
      (1, 'Trust rare classes less.'),
      (2, 'Compare durations with those met in use.')) a(pos, text) WHERE EXISTS (SELECT 1 FROM manifest)""", COUNTS))
def _(spark, d):
    return quality.bias_report(manifest(spark, d))


# --- splits and names --------------------------------------------------------

SPLIT = """sp AS (SELECT speaker_id, row_number() OVER (ORDER BY md5('42:' || speaker_id)) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT speaker_id FROM manifest)),
    sz AS (SELECT *, greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS d0, greatest(1, CAST(floor(n * 0.1) AS BIGINT)) AS h0 FROM sp),
    sz2 AS (SELECT *, CASE WHEN n - d0 - h0 < 1 THEN greatest(0, n - 2) ELSE d0 END AS d FROM sz),
    split_of AS (SELECT speaker_id, CASE WHEN rn <= d THEN 'dev' WHEN rn <= d + CASE WHEN n - d0 - h0 < 1 THEN n - d - 1 ELSE h0 END THEN 'holdout' ELSE 'test' END AS split FROM sz2)"""


@query("speaker_split", sql("manifest", "SELECT speaker_id, split FROM split_of", SPLIT))
def _(spark, d):
    return splits.speaker_split(manifest(spark, d))


@query("split_disjoint", sql("manifest", """SELECT split, count(*) AS n, count(DISTINCT speaker_id) AS speakers, CAST(0 AS BIGINT) AS shared
    FROM (SELECT m.file, m.speaker_id, s.split FROM manifest m JOIN split_of s USING (speaker_id)) GROUP BY 1""", SPLIT))
def _(spark, d):
    m = manifest(spark, d).drop("split")
    a = splits.assign_split(m, splits.speaker_split(m))
    shared = splits.split_disjoint(a).agg(F.count(F.lit(1)).alias("shared"))
    per = a.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("speaker_id").alias("speakers"))
    return joins.beside(per, shared)


@query("combine_inputs", """WITH t AS (
      SELECT text AS source_text, lang AS source_language, 'es' AS target_language, source AS reference_translation, 0 AS src, doc_id AS pos FROM documents
      UNION ALL SELECT text, NULL, NULL, NULL, 1, item_id FROM benchmark
      UNION ALL SELECT text, lang, 'es', source, 2, doc_id FROM documents)
    SELECT source_text, source_language, target_language, reference_translation FROM t
    QUALIFY row_number() OVER (PARTITION BY source_text, source_language, target_language, reference_translation ORDER BY src, pos) = 1""")
def _(spark, d):
    null = F.lit(None).cast("string")
    docs = table(spark, d, "documents").select(
        F.col("text").alias("source_text"), F.col("lang").alias("source_language"), F.lit("es").alias("target_language"),
        F.col("source").alias("reference_translation"), F.col("doc_id").alias("pos"))
    bench = table(spark, d, "benchmark").select(
        F.col("text").alias("source_text"), null.alias("source_language"), null.alias("target_language"),
        null.alias("reference_translation"), F.col("item_id").alias("pos"))
    return splits.combine_inputs([docs, bench, docs], "pos").drop("_src", "_pos")


@query("dedupe_first", """SELECT text, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def _(spark, d):
    from parley.operators.ordered import keep_first
    return keep_first(table(spark, d, "documents").select("text", "doc_id", "source"), ["text"], ["doc_id"])


@query("unique_names", sql("manifest", """SELECT doc_id, dataset || '_take' || (doc_id % 5) || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END || '.wav' AS name
    FROM (SELECT *, row_number() OVER (PARTITION BY split, dataset, doc_id % 5 ORDER BY doc_id) AS k FROM manifest)"""))
def _(spark, d):
    m = manifest(spark, d).withColumn("path", F.concat(F.lit("raw/take"), (F.col("doc_id") % 5).cast("string"), F.lit(".wav")))
    return splits.unique_names(m, order="doc_id").select("doc_id", "name")


@query("replace_by_prefix", sql("manifest", """SELECT file, dataset FROM manifest WHERE NOT starts_with(file, 'doc_1')
    UNION ALL SELECT file, 'renewed' FROM manifest WHERE starts_with(file, 'doc_1')"""))
def _(spark, d):
    from parley.sources.tables import replace_by_prefix
    m = manifest(spark, d).select("file", "dataset")
    new = m.filter(F.startswith("file", F.lit("doc_1"))).withColumn("dataset", F.lit("renewed"))
    return replace_by_prefix(m, new, "doc_1")


@query("pick_files", sql("manifest", "SELECT file, split FROM manifest WHERE split = 'dev' ORDER BY file LIMIT 25"))
def _(spark, d):
    return splits.pick_files(manifest(spark, d), 25, "dev", path="file").select("file", "split")


@query("union_splits", sql("manifest", "SELECT split, file, emotion FROM manifest"))
def _(spark, d):
    from functools import reduce
    m = manifest(spark, d).select("split", "file", "emotion")
    parts = [m.filter(F.col("split") == s) for s in ("dev", "test", "holdout")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("paths_distinct", "SELECT DISTINCT source || '/' || lang AS path FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("path")).distinct()


@query("names_except", sql("manifest known", "SELECT file FROM known EXCEPT SELECT file FROM manifest"))
def _(spark, d):
    return known_files(spark, d).select("file").subtract(manifest(spark, d).select("file"))


# --- classes -----------------------------------------------------------------

@query("macro_f1", """WITH s AS (SELECT CAST(quality AS VARCHAR) AS t, CAST(toxic AS VARCHAR) AS p FROM labels),
    c AS (SELECT cls, count(*) FILTER (WHERE t = cls AND p = cls) AS tp, count(*) FILTER (WHERE t <> cls AND p = cls) AS fp, count(*) FILTER (WHERE t = cls AND p <> cls) AS fn
          FROM s, (SELECT t AS cls FROM s UNION SELECT p FROM s) GROUP BY 1)
    SELECT count(*) AS classes, round(avg(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)), 6) AS macro_f1, avg(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)) >= 0.7 AS meets_target FROM c""")
def _(spark, d):
    return rounded(classes.macro_f1(table(spark, d, "labels"), "quality", "toxic"))


@query("confusion_matrix", """SELECT CAST(v.l AS BIGINT) AS true_label, count(*) FILTER (WHERE toxic = 0) AS pred_0,
    count(*) FILTER (WHERE toxic = 1) AS pred_1, count(*) FILTER (WHERE toxic = 2) AS pred_2 FROM (VALUES (0), (1), (2)) v(l) LEFT JOIN labels ON quality = v.l GROUP BY 1""")
def _(spark, d):
    return rounded(classes.confusion_matrix(table(spark, d, "labels"), "quality", "toxic", [0, 1, 2]))
