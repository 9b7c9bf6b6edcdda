"""Turns, intervals, utterances and streams over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from parley.functions import prompts as P
from parley.operators import intervals, turns, utterances
from parley.operators.glossary import glossary_guard
from parley.operators.utterances import Gate
from parley.plans.base import chunks, micros_of, query, rounded, sql, table, terms, words
from parley.session import work_dir
from parley.streaming import live
from parley.streaming.state import Order

# --- turns -------------------------------------------------------------------

TURNS = """k AS (SELECT *, COALESCE(speaker_id, '__none__') AS who FROM words),
    l AS (SELECT *, lag(who) OVER w AS pw, lag(is_event) OVER w AS pe FROM k WINDOW w AS (PARTITION BY session ORDER BY pos)),
    b AS (SELECT *, sum(CASE WHEN pw IS NULL OR is_event OR pe OR pw <> who THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY pos) AS isle FROM l),
    t AS (SELECT session, isle, min(pos) AS first_pos, count(*) AS words, COALESCE(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE text <> ''), '') AS text,
        bool_or(is_event) AS is_audio_event, min(speaker_id) AS speaker_id, arg_min(start, pos) AS start, arg_max("end", pos) AS "end" FROM b GROUP BY 1, 2),
    turns AS (SELECT session, first_pos, words, text, is_audio_event, CASE WHEN NOT is_audio_event THEN speaker_id END AS speaker_id, start, "end" FROM t WHERE is_audio_event OR text <> '')"""


@query("turns", sql("words", 'SELECT session, first_pos, words, text, is_audio_event, speaker_id, round(start, 3) AS start, round("end", 3) AS "end" FROM turns', TURNS))
def _(spark, d):
    return rounded(turns.turns(words(spark, d)), 3)


LABELS = """so AS (SELECT session, COALESCE(speaker_id, '__none__') AS speaker, min(pos) AS first_pos FROM words WHERE NOT is_event GROUP BY 1, 2),
    labels_of AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY first_pos) AS rank FROM so)"""


@query("speaker_order", sql("words", "SELECT session, speaker, first_pos, rank, 'Speaker ' || rank AS speaker_label FROM labels_of", LABELS))
def _(spark, d):
    return turns.speaker_order(words(spark, d))


def _told(spark, d) -> DataFrame:
    """All turns with the label of their speaker and what was found about the voice; events have no label."""
    w = words(spark, d)
    order = turns.speaker_order(w).select("session", F.col("speaker").alias("_who"), "speaker_label")
    t = turns.turns(w).withColumn("_who", F.when(~F.col("is_audio_event"), F.coalesce("speaker_id", F.lit(turns.NO_SPEAKER))))
    at = F.col("first_pos")
    return t.join(order, ["session", "_who"], "left").select(
        "session", "speaker_label", "first_pos", "start", "end", "text", "is_audio_event",
        F.when(at % 3 == 0, "male").when(at % 3 == 1, "female").alias("estimated_gender"),
        F.when(at % 5 < 2, "happy").when(at % 5 < 4, "sad").otherwise("calm").alias("emotion"))


def _segments(spark, d) -> DataFrame:
    return _told(spark, d).filter(~F.col("is_audio_event")).drop("is_audio_event")


SUMMARY = """seg AS (SELECT t.session, 'Speaker ' || rank AS speaker_label, t.first_pos, start, "end", text,
        CASE t.first_pos % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS estimated_gender,
        CASE WHEN t.first_pos % 5 < 2 THEN 'happy' WHEN t.first_pos % 5 < 4 THEN 'sad' ELSE 'calm' END AS emotion
      FROM turns t JOIN labels_of o ON o.session = t.session AND o.speaker = COALESCE(t.speaker_id, '__none__') WHERE NOT is_audio_event),
    tot AS (SELECT session, speaker_label, sum(greatest("end" - start, 0)) AS total_seconds FROM seg GROUP BY 1, 2),
    g AS (SELECT session, speaker_label, estimated_gender FROM seg WHERE estimated_gender IS NOT NULL GROUP BY session, speaker_label, estimated_gender
          QUALIFY row_number() OVER (PARTITION BY session, speaker_label ORDER BY count(*) DESC, min(first_pos)) = 1),
    e AS (SELECT session, speaker_label, emotion FROM seg GROUP BY session, speaker_label, emotion
          QUALIFY row_number() OVER (PARTITION BY session, speaker_label ORDER BY count(*) DESC, min(first_pos)) = 1),
    summary AS (SELECT session, speaker_label, COALESCE(estimated_gender, 'unknown') AS estimated_gender, emotion AS dominant_emotion, total_seconds
          FROM tot LEFT JOIN g USING (session, speaker_label) LEFT JOIN e USING (session, speaker_label))"""


@query("speaker_summary", sql("words", "SELECT session, speaker_label, estimated_gender, dominant_emotion, round(total_seconds, 3) AS total_seconds FROM summary", TURNS, LABELS, SUMMARY))
def _(spark, d):
    return rounded(turns.speaker_summary(_segments(spark, d)), 3)


@query("top_speakers", sql("words", "SELECT session, speaker_label, estimated_gender, dominant_emotion, round(total_seconds, 3) AS total_seconds FROM summary", TURNS, LABELS, SUMMARY))
def _(spark, d):
    return rounded(turns.top_speakers(turns.speaker_summary(_segments(spark, d))), 3)


@query("spoken_summary", sql("words", """SELECT session, speaker_label, speaker_label || ', estimated ' || estimated_gender || ', spoke for about ' || CAST(round_even(total_seconds, 0) AS BIGINT) || ' seconds and appeared mostly ' || dominant_emotion || '.' AS sentence,
    'The conversation was in English (en). ' || count(*) OVER (PARTITION BY session) || ' speaker' || CASE WHEN count(*) OVER (PARTITION BY session) = 1 THEN ' was' ELSE 's were' END || ' detected.' AS opening FROM summary""", TURNS, LABELS, SUMMARY))
def _(spark, d):
    s = turns.speaker_summary(_segments(spark, d))
    speakers = F.count(F.lit(1)).over(Window.partitionBy("session"))  # a row for each speaker of the session
    return s.withColumn("_n", speakers).select(
        "session", "speaker_label",
        P.speaker_sentence(F.col("speaker_label"), F.col("estimated_gender"), F.col("dominant_emotion"), F.col("total_seconds")).alias("sentence"),
        P.summary_opening(F.lit("English (en)"), F.col("_n")).alias("opening"))


@query("rich_line", sql("words", """SELECT session, first_pos, '[' || speaker_label || ' — estimated ' || COALESCE(estimated_gender, 'unknown') || ', ' || emotion || ']: ' || text AS line FROM seg
    UNION ALL SELECT session, first_pos, '[' || COALESCE(NULLIF(text, ''), 'event') || ']' FROM turns WHERE is_audio_event""", TURNS, LABELS, SUMMARY))
def _(spark, d):
    return _told(spark, d).select("session", "first_pos", P.rich_line(
        F.col("speaker_label"), F.coalesce("estimated_gender", F.lit("unknown")), F.col("emotion"), F.col("text"), F.col("is_audio_event")).alias("line"))


ROLE = "['Judge', 'Witness', 'Attorney', 'Defendant'][1 + CAST((n - 1) % 4 AS INT)]"
NUMBERED = "num AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos) AS n, row_number() OVER (PARTITION BY session ORDER BY pos DESC) AS back FROM words)"


@query("rotate_role", sql("words", f"SELECT session, pos, n AS utterance, {ROLE} AS role FROM num", NUMBERED))
def _(spark, d):
    return turns.rotate_role(words(spark, d).select("session", "pos"))


@query("keep_last", sql("words", f"SELECT session, pos, n AS utterance, {ROLE} AS role FROM num WHERE back <= 10", NUMBERED))
def _(spark, d):
    return turns.history(words(spark, d).select("session", "pos"))


CHANGED = """said AS (SELECT session, pos, CASE event_type WHEN 'error' THEN '  ' WHEN 'view' THEN NULL ELSE event_type END AS value FROM words),
    ch AS (SELECT *, lag(value) OVER (PARTITION BY session ORDER BY pos) AS before FROM said WHERE trim(COALESCE(value, '')) <> '')"""


def _said(df):
    kind = F.col("event_type")
    return F.when(kind == "error", "  ").when(kind != "view", kind)


@query("emit_on_change", sql("words", "SELECT session, pos, value FROM ch WHERE before IS DISTINCT FROM value", CHANGED))
def _(spark, d):
    w = words(spark, d)
    return turns.emit_on_change(w.select("session", "pos", _said(w).alias("value")), "value")


@query("active_config", sql("words", """SELECT session, pos, last_value(CASE WHEN event_type = 'signup' THEN 'c' || event_id END IGNORE NULLS) OVER (PARTITION BY session ORDER BY pos) AS active FROM words"""))
def _(spark, d):
    w = words(spark, d)
    setting = F.when(F.col("event_type") == "signup", F.concat(F.lit("c"), F.col("event_id").cast("string")))
    return turns.active_config(w, setting).select("session", "pos", "active")


SEEN = """s AS (SELECT session, pos, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY session ORDER BY pos) AS seen FROM words)"""


@query("new_only", sql("words", """SELECT session, pos, seen, new FROM (SELECT *, seen - COALESCE(lag(seen) OVER (PARTITION BY session ORDER BY pos), 0) AS new FROM s) WHERE new > 0""", SEEN))
def _(spark, d):
    from parley.operators.ordered import OrderedScan
    w = words(spark, d).select("session", "pos", "event_type")
    s = OrderedScan(w, ["session"], ["pos"]).running_sum("seen", (F.col("event_type") == "click").cast("int")).result()
    return turns.new_only(s.drop("event_type"), "seen")


# --- intervals ---------------------------------------------------------------

SPANS = """spans AS (SELECT session, CASE event_type WHEN 'click' THEN 'male' WHEN 'view' THEN 'female' ELSE 'other' END AS label, pos AS s0, CAST(round((start + value * 600) * 1000000) AS BIGINT) AS s1 FROM words WHERE event_type <> 'purchase'),
    asks AS (SELECT session, event_id AS query_id, pos AS q0, CAST(round((start + 18000) * 1000000) AS BIGINT) AS q1 FROM words WHERE event_type = 'purchase'),
    ov AS (SELECT a.session, query_id, COALESCE(sum(least(s1, q1) - greatest(s0, q0)) FILTER (WHERE label = 'male'), 0) / 1e6 AS male,
      COALESCE(sum(least(s1, q1) - greatest(s0, q0)) FILTER (WHERE label = 'female'), 0) / 1e6 AS female
      FROM asks a LEFT JOIN spans s ON s.session = a.session AND s0 < q1 AND q0 < s1 AND s1 > s0 AND label <> 'other' GROUP BY 1, 2)"""


def _overlap(spark, d):
    w = words(spark, d)
    kind, start = F.col("event_type"), F.col("start")
    label = F.when(kind == "click", "male").when(kind == "view", "female").otherwise("other")
    spans = w.filter(kind != "purchase").select("session", label.alias("label"), "start", (start + F.col("value") * 600).alias("end"))
    asks = w.filter(kind == "purchase").select("session", F.col("event_id").alias("query_id"), "start", (start + 18000).alias("end"))
    return intervals.interval_overlap(asks, spans, ["male", "female"])


@query("interval_overlap", sql("words", "SELECT session, query_id, CAST(round(male, 6) AS DOUBLE) AS male, CAST(round(female, 6) AS DOUBLE) AS female FROM ov", SPANS))
def _(spark, d):
    return rounded(_overlap(spark, d))


@query("majority_label", sql("words", "SELECT session, query_id, CASE WHEN male <= 0 AND female <= 0 THEN 'unknown' WHEN male >= female THEN 'male' ELSE 'female' END AS label FROM ov", SPANS))
def _(spark, d):
    return intervals.majority_label(_overlap(spark, d)).select("session", "query_id", "label")


# --- utterances --------------------------------------------------------------

LIVE = Gate(60.0, 20.0, 6, 0.5, 0.4, False)
SIGN = Gate(30.0, 30.0, None, 2.0, 0.3, True)
FRAMES = Gate(40.0, 40.0, 3, None, 0.4, True)


def gate_sql(g: Gate) -> str:
    """The state machine as a recursive query over the chunks of each session."""
    ends = " OR ".join(filter(None, [
        f"frames2 >= {g.end_frames}" if g.end_frames is not None else "",
        f"silence2 >= {g.end_seconds}" if g.end_seconds is not None else ""]))
    return sql("chunks", f"""SELECT session, d_first AS first_seq, d_last AS last_seq, CAST(d_n AS BIGINT) AS chunks, CAST(d_speech AS BIGINT) AS speech, round(d_secs, 6) AS seconds FROM st WHERE d_last IS NOT NULL""",
        "c AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM chunks)",
        f"""st(session, i, open, frames, silence, duration, n, speech, first_seq, d_first, d_last, d_n, d_speech, d_secs) AS (
        SELECT DISTINCT session, CAST(0 AS BIGINT), FALSE, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 0, 0, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 0, 0, CAST(0 AS DOUBLE) FROM c
        UNION ALL
        SELECT session, i, live AND NOT over, CASE WHEN live AND NOT over THEN frames2 ELSE 0 END, CASE WHEN live AND NOT over THEN silence2 ELSE 0 END,
          CASE WHEN live AND NOT over THEN duration2 ELSE 0 END, CASE WHEN live AND NOT over THEN n2 ELSE 0 END, CASE WHEN live AND NOT over THEN speech2 ELSE 0 END,
          CASE WHEN live AND NOT over THEN first2 END,
          CASE WHEN done THEN first2 END, CASE WHEN done THEN seq END, CASE WHEN done THEN n2 ELSE 0 END, CASE WHEN done THEN speech2 ELSE 0 END, CASE WHEN done THEN duration2 ELSE 0 END
        FROM (SELECT *, over AND duration2 >= {g.min_seconds} AS done FROM (SELECT *, live AND NOT talking AND ({ends}) AS over FROM (
          SELECT session, i, seq, talking, open OR talking AS live, CASE WHEN open THEN first_seq ELSE seq END AS first2, n + 1 AS n2, duration + seconds AS duration2,
            speech + CASE WHEN talking THEN 1 ELSE 0 END AS speech2, CASE WHEN talking THEN 0 ELSE frames + 1 END AS frames2,
            CASE WHEN talking THEN {'0' if g.reset_seconds else 'silence'} ELSE silence + seconds END AS silence2
          FROM (SELECT st.session, c.i, c.seq, c.seconds, st.open, st.frames, st.silence, st.duration, st.n, st.speech, st.first_seq,
                  c.level > CASE WHEN st.open THEN {g.keep_level} ELSE {g.start_level} END AS talking
                FROM st JOIN c ON c.session = st.session AND c.i = st.i + 1)))))""")


@query("utterances", gate_sql(LIVE))
def _(spark, d):
    return rounded(utterances.utterances(chunks(spark, d), LIVE))


@query("utterances_by_seconds", gate_sql(SIGN))
def _(spark, d):
    return rounded(utterances.utterances(chunks(spark, d), SIGN))


@query("utterances_by_frames", gate_sql(FRAMES))
def _(spark, d):
    return rounded(utterances.utterances(chunks(spark, d), FRAMES))


# --- streams -----------------------------------------------------------------

# Every session waits for its rows in slots of ten days; one that has none for 60 days is forgotten.
ORDER = Order(slot="10 days", idle="60 days")


def _stream(spark, d) -> DataFrame:
    return live.chunk_stream(spark, f"{d.rstrip('/')}/events.parquet", table(spark, d, "events").schema)


def _stream_chunks(spark, d) -> DataFrame:
    k = F.regexp_extract("props", r"\d+", 0).cast("int")
    return _stream(spark, d).select(
        F.col("user_id").alias("session"), micros_of(F.col("ts")).alias("seq"), F.col("value").alias("level"), ((k % 5 + 1) * F.lit(0.1)).alias("seconds"), "event_id")


@query("chunk_stream", "SELECT event_id, props AS payload FROM events")
def _(spark, d):
    s = _stream(spark, d)
    frame = F.base64(F.col("props").cast("binary"))
    return live.drain(s.select("event_id", live.payload_bytes(frame, F.lit(True)).cast("string").alias("payload")), work_dir(spark))


@query("utterance_stream", gate_sql(LIVE))
def _(spark, d):
    return rounded(live.drain(live.utterance_stream(_stream_chunks(spark, d), LIVE, row="event_id", order=ORDER), work_dir(spark)))


@query("stream_sink", gate_sql(SIGN))
def _(spark, d):
    folder = work_dir(spark)
    out = live.utterance_stream(_stream_chunks(spark, d), SIGN, row="event_id", order=ORDER)
    for _ in range(2):  # a second run finds nothing new and adds nothing
        live.stream_sink(out, f"{folder}/out", f"{folder}/checkpoint")
    return rounded(spark.read.schema(out.schema).parquet(f"{folder}/out"))


@query("history_stream", sql("words", f"""SELECT session, pos, event_type, n AS utterance, {ROLE} AS role, array_to_string(list(event_type) OVER (
    PARTITION BY session ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ',') AS recent FROM num""", NUMBERED))
def _(spark, d):
    s = _stream(spark, d).select(F.col("user_id").alias("session"), micros_of(F.col("ts")).alias("pos"), "event_type", "event_id")
    out = live.drain(live.history_stream(s, "event_type", seq="pos", row="event_id", order=ORDER), work_dir(spark))
    return out.withColumn("recent", F.array_join("recent", ","))


# The live session: PCM samples whose size is the event's value; the first chunk is the calibration, an error over 100 the stop.
AUDIO = Gate(0.002, 0.001, 6, 0.5, 0.0, False)


def audio_sql(g: Gate, columns: str) -> str:
    """The session as a recursive query: the noise level is that of the first chunk, the open flag is carried along."""
    return sql("words", f"""SELECT {columns} FROM st WHERE i > 1""",
        f"""heard AS (SELECT w.session, w.pos AS seq, round(value * 50) / 32768 AS level, row_number() OVER (PARTITION BY w.session ORDER BY pos) AS i
          FROM words w LEFT JOIN (SELECT session, min(pos) AS stop FROM words WHERE event_type = 'error' AND value > 100 GROUP BY 1) s ON s.session = w.session
          WHERE stop IS NULL OR pos < stop)""",
        f"""st(session, i, seq, level, noise, was, talking, open, frames, silence) AS (
          SELECT session, i, seq, level, level, FALSE, FALSE, FALSE, 0, CAST(0 AS DOUBLE) FROM heard WHERE i = 1
          UNION ALL
          SELECT session, i, seq, level, noise, was, talking, live AND NOT over, CASE WHEN live AND NOT over THEN frames2 ELSE 0 END, CASE WHEN live AND NOT over THEN silence2 ELSE 0 END
          FROM (SELECT *, live AND NOT talking AND (frames2 >= {g.end_frames} OR silence2 >= {g.end_seconds}) AS over FROM (
            SELECT *, was OR talking AS live, CASE WHEN talking THEN 0 ELSE frames + 1 END AS frames2, CASE WHEN talking THEN silence ELSE silence + 0.01 END AS silence2
            FROM (SELECT h.session, h.i, h.seq, h.level, st.noise, st.open AS was, st.frames, st.silence,
                    h.level - st.noise > CASE WHEN st.open THEN {g.keep_level} ELSE {g.start_level} END AS talking
                  FROM st JOIN heard h ON h.session = st.session AND h.i = st.i + 1))))""")


def _session_audio(spark, d) -> DataFrame:
    loud = F.round(F.col("value") * 50)
    s = _stream(spark, d).select(
        F.col("user_id").alias("session"), micros_of(F.col("ts")).alias("seq"), "event_id",
        F.array_repeat(loud, 160).alias("samples"), ((F.col("event_type") == "error") & (F.col("value") > 100)).alias("stops"))
    return rounded(live.drain(live.session_audio_stream(s, gate=AUDIO, row="event_id", order=ORDER), work_dir(spark)))


@query("session_audio_stream", audio_sql(AUDIO, "session, seq, round(level, 6) AS level, round(noise, 6) AS noise, was AS was_open, talking AS speech"))
def _(spark, d):
    return _session_audio(spark, d)


@query("voice_state", audio_sql(AUDIO, "session, seq, was AS was_open, talking AS speech"))
def _(spark, d):
    return _session_audio(spark, d).select("session", "seq", "was_open", "speech")


@query("change_stream", sql("words", "SELECT session, pos, value FROM ch WHERE before IS DISTINCT FROM value", CHANGED))
def _(spark, d):
    s = _stream(spark, d)
    s = s.select(F.col("user_id").alias("session"), micros_of(F.col("ts")).alias("pos"), _said(s).alias("value"), "event_id")
    return live.drain(live.change_stream(s, "value", seq="pos", row="event_id", order=ORDER), work_dir(spark))


MESSAGES = """stops AS (SELECT session, min(pos) AS stop FROM words WHERE event_type = 'error' AND value > 100 GROUP BY 1),
    msg AS (SELECT w.*, last_value(CASE WHEN event_type = 'signup' THEN 'c' || event_id END IGNORE NULLS) OVER (PARTITION BY w.session ORDER BY pos) AS active FROM words w)"""


@query("control_stream", sql("words", "SELECT m.session, pos, active FROM msg m LEFT JOIN stops s ON s.session = m.session WHERE event_type IN ('click', 'view') AND (stop IS NULL OR pos < stop)", MESSAGES))
def _(spark, d):
    kind, i = F.col("event_type"), F.col("event_id").cast("string")
    text = (
        F.when(kind == "signup", F.concat(F.lit('{"type": "config", "value": "c'), i, F.lit('"}')))
        .when(kind.isin("click", "view"), '{"type": "audio"}')
        .when((kind == "error") & (F.col("value") > 100), '{"type": "stop"}')
        .when(kind == "purchase", '{"type": "ping"}').otherwise("{broken")
    )
    s = _stream(spark, d).select(F.col("user_id").alias("session"), micros_of(F.col("ts")).alias("pos"), text.alias("message"), "event_id")
    return live.drain(live.control_stream(s, "message", seq="pos", row="event_id", order=ORDER), work_dir(spark))


@query("session_isolation", sql("words", "SELECT num.session, pos, n FROM num LEFT JOIN stops s ON s.session = num.session WHERE stop IS NULL OR pos <= stop", MESSAGES, NUMBERED))
def _(spark, d):
    s = _stream(spark, d).select(
        F.col("user_id").alias("session"), micros_of(F.col("ts")).alias("pos"),
        ((F.col("event_type") == "error") & (F.col("value") > 100)).alias("closes"), "event_id")
    return live.drain(live.isolated_stream(s, "closes", seq="pos", row="event_id", order=ORDER), work_dir(spark))


GAPS = """o AS (SELECT session, pos, sum(CASE WHEN before IS NULL OR pos - before >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY pos) AS w FROM (
      SELECT session, pos, lag(pos) OVER (PARTITION BY session ORDER BY pos) AS before FROM words)),
    gapped AS (SELECT session, min(pos) AS first, max(pos) AS last, count(*) AS n FROM o GROUP BY session, w)"""


@query("session_windows", sql("words", "SELECT session, first, last, n FROM gapped", GAPS))
def _(spark, d):
    return turns.session_gaps(words(spark, d).select("session", "pos"), 43_200_000_000)


@query("session_window_stream", sql("words", "SELECT session, first, last, n FROM gapped", GAPS))
def _(spark, d):
    s = _stream(spark, d).select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"))
    w = live.drain(live.session_windows(s, "ts", "12 hours"), work_dir(spark))
    return w.select("session", F.unix_micros("first_ts").alias("first"), F.unix_micros("last_ts").alias("last"), "n")


@query("review_flags", "SELECT event_id, round(value / 500, 6) AS confidence FROM events WHERE value / 500 < 0.05")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") / 500).alias("confidence"))
    return rounded(live.review_flags(e, threshold=0.05))


@query("glossary_guard_stream", sql("terms", """SELECT conv_id, turn, term FROM conversations JOIN terms ON contains(lower(text), term) AND NOT contains(replace(lower(text), 'e', 'i'), term)"""))
def _(spark, d):
    s = live.chunk_stream(spark, f"{d.rstrip('/')}/conversations.parquet", table(spark, d, "conversations").schema)
    s = s.select("conv_id", "turn", F.col("text").alias("ref"), F.regexp_replace(F.lower("text"), "e", "i").alias("hyp"))
    return live.drain(glossary_guard(s, terms(spark, d), ["conv_id", "turn"]), work_dir(spark))
