"""Text functions and row filters over the document, conversation and page tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import labels as L, prompts as P, text as X

from parley.operators import joins, rows
from parley.plans.base import manifest, micros_of, pairs, query, rounded, sql, sql_norm, sql_words, table

# --- names and paths ---------------------------------------------------------

# Four kinds of path, chosen by document number.
PATHS = """paths AS (SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN 'raw/RAVDESS/Actor_' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || '/03-01-' || lpad(CAST(doc_id % 10 AS VARCHAR), 2, '0') || '-01-' || lpad(CAST(doc_id % 3 AS VARCHAR), 2, '0') || '-01-07.wav'
    WHEN 1 THEN 'raw/meld/subject_' || (100 + doc_id % 50) || '/test/sample.wav'
    WHEN 2 THEN 'data/' || source || '/' || ['happy', 'Sad', 'plain', 'angry'][1 + doc_id % 4] || '_clip' || (doc_id % 300) || '.wav'
    ELSE 'wav/' || source || '/dev/bare.x.wav' END AS path FROM documents)"""


def _paths(spark, d):
    i, two = F.col("doc_id"), lambda c: F.lpad(c.cast("string"), 2, "0")
    k = i % 4
    return table(spark, d, "documents").select(
        "doc_id",
        F.when(k == 0, F.concat(F.lit("raw/RAVDESS/Actor_"), two(i % 24), F.lit("/03-01-"), two(i % 10), F.lit("-01-"), two(i % 3), F.lit("-01-07.wav")))
        .when(k == 1, F.concat(F.lit("raw/meld/subject_"), (i % 50 + 100).cast("string"), F.lit("/test/sample.wav")))
        .when(k == 2, F.concat(F.lit("data/"), "source", F.lit("/"), F.element_at(F.array(*map(F.lit, ("happy", "Sad", "plain", "angry"))), (i % 4 + 1).cast("int")),
                               F.lit("_clip"), (i % 300).cast("string"), F.lit(".wav")))
        .otherwise(F.concat(F.lit("wav/"), "source", F.lit("/dev/bare.x.wav"))).alias("path"),
    )


NAMES = r"""nm AS (SELECT doc_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem FROM paths),
    up AS (SELECT *, list_reverse(parts[1:len(parts) - 1]) AS up, list_transform(parts, lambda x: lower(x)) AS low FROM nm)"""
EMOTIONS = "['neutral', 'calm', 'happy', 'sad', 'angry', 'fearful', 'disgust', 'surprised']"


@query("infer_fields", sql("", rf"""SELECT doc_id,
    COALESCE(list_filter(list_transform(list_filter(up, lambda p: p NOT IN ('staged', 'processed', 'extracted', 'wav', 'data', 'raw')),
        lambda p: regexp_extract(lower(p), '(?:actor_?|speaker_?|subject_?)_?(\d{{2,3}})$', 1)), lambda n: n <> '')[1],
      NULLIF(regexp_extract(stem, '(\d{{2,3}})$', 1), ''), NULLIF(regexp_extract(lower(stem), '(?:actor_?|speaker_?|subject_?)_?(\d{{2,3}})', 1), ''),
      list_filter(up, lambda p: p NOT IN ('staged', 'processed', 'extracted', 'wav'))[1], left(stem, 32)) AS speaker,
    COALESCE(CASE WHEN list_contains(low, 'ravdess') OR regexp_matches(stem, '^\d{{2}}-\d{{2}}-\d{{2}}-\d{{2}}-\d{{2}}-\d{{2}}-\d{{2}}$') THEN
        ['neutral', 'calm', 'happy', 'sad', 'angry', 'fearful', 'surprised', 'disgust'][NULLIF(TRY_CAST(string_split(stem, '-')[3] AS INT), 0)] END,
      list_filter({EMOTIONS}, lambda w: contains(lower(stem), w) OR list_contains(low, w))[1], 'unknown') AS emotion,
    CASE WHEN starts_with('RAVDESS_' || stem || '.wav', 'RAVDESS_') THEN string_split(stem, '-')[5] END AS statement,
    CASE WHEN doc_id % 2 = 0 THEN stem ELSE '' END AS stamp FROM up""", PATHS, NAMES))
def _(spark, d):
    p = F.col("path")
    name = F.concat(F.lit("RAVDESS_"), L.stem(p), F.lit(".wav"))
    rec = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("EXPO_"), L.stem(p), F.lit(".WAV"))).otherwise(name)
    return _paths(spark, d).select(
        "doc_id", L.infer_speaker(p).alias("speaker"), L.infer_label(p).alias("emotion"),
        L.statement_code(name).alias("statement"), L.timestamp_in_name(rec).alias("stamp"))


@query("split_from_path", sql("", """SELECT doc_id, CASE WHEN list_contains(string_split(path, '/'), 'dev') THEN 'dev'
    WHEN list_contains(string_split(path, '/'), 'test') THEN 'test' WHEN list_contains(string_split(path, '/'), 'holdout') THEN 'holdout' ELSE 'unknown' END AS split FROM paths""", PATHS))
def _(spark, d):
    return _paths(spark, d).select("doc_id", L.split_from_path(F.col("path")).alias("split"))


@query("safe_names", r"""SELECT doc_id, regexp_replace(text, '[\s/\\]+', '_', 'g') AS name,
    CASE WHEN length(s) > 80 THEN left(s, 60) || '_' || left(sha1(raw), 8) ELSE s END AS suffix FROM (
      SELECT doc_id, text, raw, regexp_replace(raw, '[^A-Za-z0-9_.-]+', '_', 'g') AS s FROM (
        SELECT doc_id, text, regexp_replace(source, '^\s+|\s+$', '', 'g') || '_' || regexp_replace(text, '^\s+|\s+$', '', 'g') AS raw FROM documents))""")
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.safe_name(F.col("text")).alias("name"), X.safe_suffix(F.col("source"), F.col("text")).alias("suffix"))


# --- prompts and answers -----------------------------------------------------

TEMPLATE = "Translate from {source_language} to {target_language}.\nText: {source_text}"


@query("render_prompt", """SELECT doc_id, 'Be exact.' || chr(10) || chr(10) || 'Translate from ' || lang || ' to es.' || chr(10) || 'Text: ' || text AS prompt FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", P.render_prompt(
        F.lit(TEMPLATE), F.col("text"), F.col("lang"), F.lit("es"), F.lit("Be exact.")).alias("prompt"))


# An answer per turn: both tags, no tag, or two source lines.
ANSWERS = r"""ans AS (SELECT conv_id, turn, CASE turn % 3
    WHEN 0 THEN 'EN: ' || text || chr(10) || ' es:  hola ' || conv_id || '  ' WHEN 1 THEN text ELSE 'en: first' || chr(10) || 'EN:  second ' || turn || chr(10) || text END AS answer FROM conversations),
    ln AS (SELECT *, list_transform(string_split_regex(regexp_replace(answer, '^\s+|\s+$', '', 'g'), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'),
        lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')) AS lines FROM ans),
    pt AS (SELECT *, COALESCE(regexp_replace(regexp_extract(list_filter(lines, lambda s: regexp_matches(s, '(?i)^EN:'))[-1], '(?i)^EN:\s*(.*)$', 1), '^\s+|\s+$', '', 'g'), '') AS src,
        COALESCE(regexp_replace(regexp_extract(list_filter(lines, lambda s: regexp_matches(s, '(?i)^ES:'))[-1], '(?i)^ES:\s*(.*)$', 1), '^\s+|\s+$', '', 'g'), '') AS dst FROM ln)"""


def _answers(spark, d):
    t, k = F.col("text"), F.col("turn") % 3
    return table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.when(k == 0, F.concat(F.lit("EN: "), t, F.lit("\n es:  hola "), F.col("conv_id").cast("string"), F.lit("  ")))
        .when(k == 1, t).otherwise(F.concat(F.lit("en: first\nEN:  second "), F.col("turn").cast("string"), F.lit("\n"), t)).alias("answer"))


@query("parse_tagged_lines", sql("", """SELECT conv_id, turn, CASE WHEN src = '' AND dst = '' THEN left(answer, 200) WHEN src = '' THEN answer ELSE src END AS source_phrase,
    CASE WHEN src = '' AND dst = '' THEN '(parse failed)' ELSE dst END AS translated FROM pt""", ANSWERS))
def _(spark, d):
    return _answers(spark, d).withColumn("p", P.parse_tagged_lines(F.col("answer"), "ES")).select("conv_id", "turn", "p.*")


@query("prediction_shape", sql("", """SELECT event_id, CASE event_id % 6 WHEN 5 THEN 'unknown' ELSE event_type END AS label,
    CASE event_id % 6 WHEN 4 THEN 1.0 WHEN 5 THEN 0.0 ELSE value END AS score FROM events"""))
def _(spark, d):
    e, kind = table(spark, d, "events"), F.upper("event_type")
    v = F.col("value")
    k = F.col("event_id") % 6
    q = lambda fmt, *a: F.format_string(fmt, *a)
    s = v.cast("string")
    js = (
        F.when(k == 0, q('{"labels": [["%s", %s], ["other", 0.1]]}', kind, s))
        .when(k == 1, q('[{"labels": ["%s", "x"], "scores": [%s, 0.1]}]', kind, s))
        .when(k == 2, q('{"emotion": "%s", "score": %s}', kind, s))
        .when(k == 3, q('{"pred": "%s", "confidence": %s}', kind, s))
        .when(k == 4, q('{"text": "%s"}', kind)).otherwise(F.lit('{"nothing": 1}'))
    )
    return e.withColumn("p", P.prediction_shape(js)).select("event_id", "p.*")


# --- text --------------------------------------------------------------------

@query("norm_text", rf"SELECT conv_id, turn, {sql_norm('text')} AS text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS squeezed FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.norm_text(F.col("text")).alias("text"), X.squeeze_spaces(F.col("text")).alias("squeezed"))


@query("word_count", f"SELECT doc_id, CAST(greatest(len({sql_words('text')}), 1) AS BIGINT) AS words FROM documents")
def _(spark, d):
    return rounded(table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("words")))


@query("preview", "SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '…' ELSE text END AS preview FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("transcript_noise_filter", rf"""WITH t AS (SELECT conv_id, turn, CASE turn WHEN 0 THEN ' Thank you. ' WHEN 1 THEN '12 345 word' ELSE text END AS text FROM conversations)
    SELECT conv_id, turn, text FROM t WHERE {sql_norm('text')} NOT IN ('thank you', 'thank you.', 'thank you for watching', 'thank you for watching.', 'bye', 'bye.', 'thanks', 'thanks.')
    AND len(list_filter({sql_words('text')}, lambda w: regexp_matches(w, '[A-Za-z]'))) >= 2""")
def _(spark, d):
    turn = F.col("turn")
    t = table(spark, d, "conversations").withColumn(
        "text", F.when(turn == 0, " Thank you. ").when(turn == 1, "12 345 word").otherwise(F.col("text")))
    return t.filter(X.is_speech_text(F.col("text"))).select("conv_id", "turn", "text")


@query("language_names", """WITH m(three, name, two) AS (VALUES ('eng','English','en'), ('spa','Spanish','es'), ('fra','French','fr'), ('deu','German','de')),
    c AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || ' ' WHEN 2 THEN CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'deutsch' ELSE lang || 'x' END ELSE '' END AS code FROM documents),
    n AS (SELECT *, lower(trim(code)) AS k FROM c)
    SELECT doc_id, CASE WHEN k = '' THEN 'Unknown' WHEN length(k) = 2 THEN COALESCE(b.name || ' (' || b.two || ')', 'Unknown (' || k || ')')
        ELSE COALESCE(a.name || ' (' || a.two || ')', 'Unknown (' || left(k, 3) || ')') END AS name,
      CASE WHEN k = '' THEN 'en' WHEN length(k) = 2 THEN k ELSE COALESCE(a.two, 'en') END AS short,
      CASE WHEN doc_id % 3 = 0 THEN 'pt' WHEN k = '' THEN 'en' WHEN length(k) = 2 THEN k ELSE COALESCE(a.two, 'en') END AS chosen,
      CASE k WHEN 'english' THEN 'en' ELSE k END AS label_code
    FROM n LEFT JOIN m a ON a.three = left(k, 3) LEFT JOIN m b ON b.two = k""")
def _(spark, d):
    i, lang = F.col("doc_id"), F.col("lang")
    code = (
        F.when(i % 4 == 0, lang).when(i % 4 == 1, F.concat(F.upper(lang), F.lit(" ")))
        .when(i % 4 == 2, F.when(lang == "en", "english").when(lang == "de", "deutsch").otherwise(F.concat(lang, F.lit("x")))).otherwise(F.lit(""))
    )
    override = F.when(i % 3 == 0, "pt").otherwise("auto")
    return table(spark, d, "documents").withColumn("code", code).select(
        "doc_id", L.language_name(F.col("code")).alias("name"), L.language_short(F.col("code")).alias("short"),
        L.language_short(F.col("code"), override).alias("chosen"), L.language_code(F.col("code")).alias("label_code"))


@query("fingerspell", rf"""SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS words, array_to_string(list_transform(w, lambda x: upper(replace(x, 'ß', 'ss')) || ':' ||
    array_to_string(list_filter(string_split(upper(replace(x, 'ß', 'ss')), ''), lambda c: regexp_matches(c, '[\p{{L}}\p{{N}}]')), '-')), ' ') AS spelled
    FROM (SELECT conv_id, turn, {sql_words('text')} AS w FROM conversations)""")
def _(spark, d):
    spelled = F.transform(X.fingerspell(F.col("text")), lambda s: F.concat(s["word"], F.lit(":"), F.array_join(s["letters"], "-")))
    c = table(spark, d, "conversations").withColumn("_f", spelled)
    return rounded(c.select("conv_id", "turn", F.size("_f").alias("words"), F.array_join("_f", " ").alias("spelled")))


@query("gloss_clean", rf"""WITH a AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN '"ASL gloss: ' || text || '"' WHEN 1 THEN '""' ELSE '  ' || text || ' ''' END AS answer FROM conversations),
    b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(answer, '^\s+|\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g'), '(?i)^asl\s+gloss\s*:\s*', '') AS body FROM a)
    SELECT conv_id, turn, COALESCE(NULLIF(upper(regexp_replace(regexp_replace(string_split_regex(regexp_replace(replace(body, 'ß', 'ss'), '^\s+|\s+$', '', 'g'), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')[1], '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), ''),
        upper(regexp_replace(replace(text, 'ß', 'ss'), '\s+', ' ', 'g'))) AS gloss FROM b""")
def _(spark, d):
    k, t = F.col("turn") % 3, F.col("text")
    answer = (F.when(k == 0, F.concat(F.lit('"ASL gloss: '), t, F.lit('"'))).when(k == 1, F.lit('""')).otherwise(F.concat(F.lit("  "), t, F.lit(" '"))))
    return table(spark, d, "conversations").select("conv_id", "turn", X.gloss_clean(answer, t).alias("gloss"))


@query("last_line_url", r"""SELECT page_id, replace(replace(url_encode(left(l[-1], 80)), '+', '%20'), '*', '%2A') AS encoded FROM (
    SELECT page_id, list_filter(list_transform(string_split(url || chr(10) || '  ' || url || ' ~é ' || chr(10) || ' ', chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM pages)""")
def _(spark, d):
    u = F.col("url")
    text = F.concat(u, F.lit("\n  "), u, F.lit(" ~é \n "))
    return table(spark, d, "pages").select("page_id", X.last_line_url(text).alias("encoded"))


@query("join_history", r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(url, '/'), lambda s: trim(s)), lambda s: s <> ''), chr(10)) AS lines FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.join_lines(F.split("url", "/")).alias("lines"))


@query("json_fields", r"""SELECT event_id, CAST(regexp_extract(props, '\d+') AS BIGINT) AS k, '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS report FROM events""")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.from_json("props", "k BIGINT")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("report"))


@query("math_exprs", """SELECT event_id, round(value, 4) AS r4, round(abs(value - 50), 6) AS gap, round(value / (user_id + CAST(0.7 AS DOUBLE)), 6) AS ratio,
    round(20 * log10(value + 1e-10), 6) AS db FROM events""")
def _(spark, d):
    from parley.functions.signal import decibel
    v, u = F.col("value"), F.col("user_id")
    return rounded(table(spark, d, "events").select(
        "event_id", X.round4(v).alias("r4"), X.gap(v, F.lit(50.0)).alias("gap"), X.ratio(v, u + 0.7).alias("ratio"), decibel(v).alias("db")))


@query("utc_stamp", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, strftime(ts, '%H:%M:%S') AS clock FROM events")
def _(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", X.utc_stamp(ts).alias("stamp"), X.clock(ts).alias("clock"))


@query("token_sets", sql("pairs", rf"""SELECT conv_id, turn, CAST(len(list_intersect(r, h)) AS BIGINT) AS both, CAST(len(r) - len(list_intersect(r, h)) AS BIGINT) AS ref_only,
    CAST(len(h) - len(list_intersect(r, h)) AS BIGINT) AS hyp_only, CAST(len(r) + len(h) - len(list_intersect(r, h)) AS BIGINT) AS either
    FROM (SELECT conv_id, turn, list_distinct({sql_words('lower(ref)')}) AS r, list_distinct({sql_words('lower(hyp)')}) AS h FROM pairs)"""))
def _(spark, d):
    p = pairs(spark, d).select("conv_id", "turn", X.words(F.lower("ref")).alias("r"), X.words(F.lower("hyp")).alias("h"))
    size = lambda c: F.size(c).cast("long")
    return p.select("conv_id", "turn", size(F.array_intersect("r", "h")).alias("both"), size(F.array_except("r", "h")).alias("ref_only"),
                    size(F.array_except("h", "r")).alias("hyp_only"), size(F.array_union("r", "h")).alias("either"))


# --- projections and filters -------------------------------------------------

INPUTS = """inputs AS (SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE text END AS source_text, lang AS source_language, 'es' AS target_language,
    CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '  ' ELSE upper(replace(text, 'ß', 'ss')) END AS reference_translation,
    CASE WHEN doc_id % 3 = 0 THEN ' expo' ELSE source END AS dataset, NULLIF(lang, 'de') AS emotion,
    CASE WHEN doc_id % 7 = 0 THEN '(error: quota)' WHEN doc_id % 7 = 1 THEN NULL ELSE lower(text) END AS translated_text_model FROM documents)"""


def _inputs(spark, d):
    i, t, lang = F.col("doc_id"), F.col("text"), F.col("lang")
    null = F.lit(None).cast("string")
    return table(spark, d, "documents").select(
        "doc_id", F.when(lang == "de", "").otherwise(t).alias("source_text"), lang.alias("source_language"), F.lit("es").alias("target_language"),
        F.when(i % 5 == 0, null).when(i % 5 == 1, "  ").otherwise(F.upper(t)).alias("reference_translation"),
        F.when(i % 3 == 0, " expo").otherwise(F.col("source")).alias("dataset"), F.nullif(lang, F.lit("de")).alias("emotion"),
        F.when(i % 7 == 0, "(error: quota)").when(i % 7 == 1, null).otherwise(F.lower(t)).alias("translated_text_model"))


@query("features_labels", sql("", """SELECT 'features' AS part, source_text AS text, doc_id, dataset FROM inputs UNION ALL SELECT 'labels', reference_translation, NULL, NULL FROM inputs""", INPUTS))
def _(spark, d):
    features, labels = rows.split_features_labels(_inputs(spark, d))
    given = features.select(F.lit("features").alias("part"), F.col("source_text").alias("text"), "doc_id", "dataset")
    return given.unionByName(labels.select(F.lit("labels").alias("part"), F.col("reference_translation").alias("text")), allowMissingColumns=True)


@query("task_view", sql("manifest", "SELECT 'emotion' AS task, file AS feature, emotion AS label FROM manifest UNION ALL SELECT 'asr', file, dataset FROM manifest UNION ALL SELECT 'translation', source_text, reference_translation FROM inputs", INPUTS))
def _(spark, d):
    m = manifest(spark, d).withColumnRenamed("dataset", "reference_transcript")
    out = None
    for task, t in (("emotion", m), ("asr", m), ("translation", _inputs(spark, d))):
        v = rows.task_view(t, task).select(F.lit(task).alias("task"), "feature", "label")
        out = v if out is None else out.unionByName(v)
    return out


@query("label_or_unknown", """SELECT COALESCE(NULLIF(NULLIF(lang, 'de'), ''), NULLIF(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), 'unknown') AS label, count(*) AS n FROM documents GROUP BY 1""")
def _(spark, d):
    t = table(spark, d, "documents")
    other = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source"))
    return t.groupBy(L.label_or_unknown(F.nullif(F.col("lang"), F.lit("de")), other).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("drop_empty", sql("", "SELECT doc_id FROM inputs WHERE reference_translation IS NOT NULL OR translated_text_model IS NOT NULL", INPUTS))
def _(spark, d):
    return _inputs(spark, d).dropna("all", subset=["reference_translation", "translated_text_model"]).select("doc_id")


@query("keep_scorable", sql("", """SELECT doc_id, dataset, (SELECT count(*) FROM inputs WHERE upper(trim(dataset)) = 'EXPO' AND trim(COALESCE(reference_translation, '')) = '') AS n_exempt_no_ref
    FROM inputs WHERE trim(COALESCE(reference_translation, '')) <> '' OR upper(trim(dataset)) = 'EXPO'""", INPUTS))
def _(spark, d):
    t = _inputs(spark, d)
    return joins.beside(rows.keep_scorable(t).select("doc_id", "dataset"), rows.exempt_without_reference(t))


@query("nonempty_reference", sql("", "SELECT doc_id, COALESCE(translated_text_model, '') AS translated_text_model FROM inputs WHERE trim(COALESCE(reference_translation, '')) <> ''", INPUTS))
def _(spark, d):
    return rows.nonempty_reference(_inputs(spark, d)).select("doc_id", "translated_text_model")


@query("has_source", rf"""WITH t AS (SELECT conv_id, turn, CASE turn WHEN 0 THEN ' NaN ' WHEN 1 THEN '(No Speech)' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE text END AS s FROM conversations)
    SELECT {sql_norm('s')} NOT IN ('', '(no speech)', 'nan', 'none', '<na>', 'nat') AS has_source, count(*) AS n FROM t GROUP BY 1""")
def _(spark, d):
    turn = F.col("turn")
    s = F.when(turn == 0, " NaN ").when(turn == 1, "(No Speech)").when(turn == 2, "").when(turn == 3, F.lit(None).cast("string")).otherwise(F.col("text"))
    return table(spark, d, "conversations").groupBy(X.has_source(s).alias("has_source")).agg(F.count(F.lit(1)).alias("n"))


@query("as_reference", sql("", "SELECT source_text, 'en' AS source_language, 'fr' AS target_language, translated_text_model AS reference_translation, doc_id, dataset, emotion FROM inputs", INPUTS))
def _(spark, d):
    return rows.as_reference(_inputs(spark, d), "en", "fr")


@query("drop_error_rows", sql("", "SELECT doc_id FROM inputs WHERE NOT contains(COALESCE(translated_text_model, ''), '(error:')", INPUTS))
def _(spark, d):
    return rows.drop_error_rows(_inputs(spark, d)).select("doc_id")


@query("slice_rows", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('7:' || doc_id)) AS s FROM documents)
    SELECT 'middle' AS part, doc_id FROM r WHERE k > 40 AND k <= 140 UNION ALL SELECT 'tail', doc_id FROM r WHERE k > n - 60 UNION ALL SELECT 'shuffled', doc_id FROM r WHERE s > 10 AND s <= 90""")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id")
    part = lambda name, df: df.select(F.lit(name).alias("part"), "doc_id")
    return (
        part("middle", rows.slice_rows(t, "doc_id", 40, 100))
        .unionByName(part("tail", rows.slice_rows(t, "doc_id", tail=60)))
        .unionByName(part("shuffled", rows.slice_rows(t, "doc_id", 10, 80, shuffle_seed=7)))
    )


@query("sample_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20")
def _(spark, d):
    return table(spark, d, "documents").orderBy("doc_id").limit(20).select("doc_id", "lang")


# --- joins -------------------------------------------------------------------

CODED = """coded AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE 'ravdess ' END AS dataset, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '  ' ELSE text END AS transcript,
    'RAVDESS_03-01-05-01-0' || (doc_id % 3) || '-01-12.wav' AS file FROM documents)"""


def _coded(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id", F.when(i % 3 == 0, "other").otherwise("ravdess ").alias("dataset"),
        F.when(i % 4 == 0, F.lit(None).cast("string")).when(i % 4 == 1, "  ").otherwise(F.col("text")).alias("transcript"),
        F.concat(F.lit("RAVDESS_03-01-05-01-0"), (i % 3).cast("string"), F.lit("-01-12.wav")).alias("file"))


@query("map_reference", sql("", """SELECT doc_id, CASE WHEN dataset <> 'other' THEN CASE doc_id % 3 WHEN 1 THEN 'Kids are talking by the door.' WHEN 2 THEN 'Dogs are sitting by the door.' END END AS reference_text FROM coded""", CODED))
def _(spark, d):
    dim = spark.createDataFrame(list(joins.STATEMENT_TEXTS.items()), "statement string, text string")
    return joins.map_reference(_coded(spark, d), dim).select("doc_id", "reference_text")


@query("fallback_text", """WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'expo' WHEN 1 THEN 'RAVDESS' ELSE source END AS dataset, CASE WHEN doc_id % 4 < 2 THEN ' ' ELSE text END AS transcript FROM documents)
    SELECT f.doc_id, COALESCE(NULLIF(regexp_replace(transcript, '^\\s+|\\s+$', '', 'g'), ''), CASE WHEN dataset = 'expo' AND l.doc_id IS NOT NULL THEN 'side ' || l.quality WHEN dataset = 'RAVDESS' THEN 'script ' || (f.doc_id % 10) END, '') AS source_text
    FROM f LEFT JOIN labels l ON l.doc_id = f.doc_id""".replace("\\\\", "\\"))
def _(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents")
    t = docs.select("doc_id", F.when(i % 3 == 0, "expo").when(i % 3 == 1, "RAVDESS").otherwise(F.col("source")).alias("dataset"),
                    F.when(i % 4 < 2, " ").otherwise(F.col("text")).alias("transcript"))
    side = table(spark, d, "labels").select("doc_id", F.concat(F.lit("side "), F.col("quality").cast("string")).alias("text"))
    script = docs.select("doc_id", F.concat(F.lit("script "), (i % 10).cast("string")).alias("text"))
    return joins.fallback_text(t, side, script, key="doc_id").select("doc_id", "source_text")


@query("attach_emotion", sql("manifest", """SELECT d.doc_id, COALESCE(CASE WHEN l.doc_id IS NOT NULL THEN NULLIF(m.emotion, 'de') END, 'unknown') AS emotion
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN manifest m ON m.doc_id = d.doc_id"""))
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.lit(" ").alias("emotion"))
    m = manifest(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    m = m.select("doc_id", F.nullif(F.col("emotion"), F.lit("de")).alias("emotion"))
    return joins.attach_emotion(t, m, key="doc_id").select("doc_id", "emotion")
