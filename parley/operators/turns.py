"""Word streams into speaker turns, and per-session history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions.labels import role_in_turn
from parley.functions.text import blank_to_null, strip
from parley.operators.ordered import SLAB, OrderedScan, keep_last

NO_SPEAKER = "__none__"


def _speaker_key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NO_SPEAKER))


def speaker_order(words: DataFrame, session: str = "session", pos: str = "pos", speaker: str = "speaker_id", is_event: str = "is_event") -> DataFrame:
    """(session, speaker, label): speakers numbered by first appearance, audio events left out.

    First positions are an aggregate that combines before the shuffle; only one row per speaker is
    ranked.
    """
    first = words.filter(~F.col(is_event)).groupBy(session, _speaker_key(F.col(speaker)).alias("speaker")).agg(F.min(pos).alias("first_pos"))
    ranked = OrderedScan(first, [session], ["first_pos"]).row_number("rank").result()
    return ranked.withColumn("speaker_label", F.concat(F.lit("Speaker "), F.col("rank").cast("string")))


def turns(
    words: DataFrame, session: str = "session", pos: str = "pos", speaker: str = "speaker_id", text: str = "text",
    start: str = "start", end: str = "end", is_event: str = "is_event", splits: int | None = None,
) -> DataFrame:
    """Merge neighbouring words of one speaker; an audio event breaks a turn and stands alone.

    Turns without text are dropped.  Words of a turn are joined inside each slab first, so what
    moves in the second step is one partial text per turn and slab, not the words.
    """
    key = _speaker_key(F.col(speaker))
    words = words.withColumn("_who", F.struct(F.col(is_event).alias("e"), key.alias("s")))
    first = OrderedScan(words, [session], [pos], splits)
    scan = first.lag("_prev", F.col("_who")).result(keep_slab=True)
    breaks = F.col("_prev").isNull() | F.col(is_event) | F.col("_prev")["e"] | (F.col("_prev")["s"] != key)
    numbered = first.again(scan.withColumn("_break", breaks.cast("int"))).running_sum(
        "_turn", F.col("_break")).result(keep_slab=True)

    word = blank_to_null(strip(F.coalesce(F.col(text), F.lit(""))))
    s, e = F.coalesce(F.col(start), F.lit(0.0)), F.nullif(F.col(end), F.lit(0.0))

    def joined(pieces: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(pieces)), lambda x: x["t"]), " ")

    numbered = numbered.withColumn("_piece", F.when(word.isNotNull(), F.struct(F.col(pos).alias("p"), word.alias("t"))))
    partial = numbered.groupBy(session, SLAB, "_turn").agg(
        F.min(pos).alias("_first"), joined("_piece").alias("_text"), F.count(F.lit(1)).alias("_n"),
        F.min_by(F.struct(F.col("_who"), s.alias("start")), F.col(pos)).alias("_head"),
        F.max_by(e, F.when(e.isNotNull(), F.col(pos))).alias("_end"),
    )
    partial = partial.withColumn("_piece", F.when(F.col("_text") != "", F.struct(F.col("_first").alias("p"), F.col("_text").alias("t"))))
    whole = partial.groupBy(session, "_turn").agg(
        F.min("_first").alias("first_pos"), F.sum("_n").alias("words"), joined("_piece").alias("text"),
        F.min_by("_head", "_first").alias("_head"),
        F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col("_first"))).alias("_end"),
    )
    event = F.col("_head")["_who"]["e"]
    return whole.filter(event | (F.col("text") != "")).select(
        session, "first_pos", "words", "text", event.alias("is_audio_event"),
        F.when(~event, F.nullif(F.col("_head")["_who"]["s"], F.lit(NO_SPEAKER))).alias("speaker_id"),
        F.col("_head")["start"].alias("start"), F.coalesce("_end", F.col("_head")["start"]).alias("end"),
    )


def mode_first_seen(df: DataFrame, keys: Sequence[str], value: str, pos: str) -> DataFrame:
    """The most frequent value per key; of equally frequent ones the one seen first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_at"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("_n"), (-F.col("_at")))).alias(value))


def speaker_summary(
    segments: DataFrame, session: str = "session", speaker: str = "speaker_label", gender: str = "estimated_gender",
    emotion: str = "emotion", pos: str = "first_pos", start: str = "start", end: str = "end",
) -> DataFrame:
    """Per speaker: seconds spoken, majority gender of the segments, dominant emotion.

    Three aggregates in a row and no join: segments shrink to counts per (speaker, gender, emotion),
    each count is read once as a gender and once as an emotion, and the majorities are taken over
    those.  Of equally frequent values the one seen first wins.
    """
    keys = [session, speaker]
    small = segments.groupBy(*keys, gender, emotion).agg(
        F.sum(F.greatest(F.col(end) - F.col(start), F.lit(0.0))).alias("_secs"),
        F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_at"),
    )
    kinds = F.explode(F.array(F.struct(F.lit("g").alias("kind"), F.col(gender).alias("v")),
                              F.struct(F.lit("e").alias("kind"), F.col(emotion).alias("v")))).alias("_k")
    per_value = small.select(*keys, "_secs", "_n", "_at", kinds).groupBy(*keys, "_k").agg(
        F.sum("_secs").alias("_secs"), F.sum("_n").alias("_n"), F.min("_at").alias("_at"))
    value = F.col("_k")["v"]

    def majority(kind: str) -> Column:
        rank = F.when((F.col("_k")["kind"] == kind) & value.isNotNull(), F.struct(F.col("_n"), -F.col("_at")))
        return F.coalesce(F.max_by(value, rank), F.lit("unknown"))

    return per_value.groupBy(*keys).agg(
        majority("g").alias("estimated_gender"), majority("e").alias("dominant_emotion"),
        F.sum(F.when(F.col("_k")["kind"] == "g", F.col("_secs"))).alias("total_seconds"),
    )


def top_speakers(summary: DataFrame, speaker: str = "speaker_label") -> DataFrame:
    """Speakers by time spoken, longest first."""
    return summary.orderBy(F.col("total_seconds").desc(), F.col(speaker))


def rotate_role(df: DataFrame, session: str = "session", order: str = "pos") -> DataFrame:
    """Add the running number of an utterance and its role."""
    numbered = OrderedScan(df, [session], [order]).row_number("utterance").result()
    return numbered.withColumn("role", role_in_turn(F.col("utterance")))


def history(df: DataFrame, session: str = "session", order: str = "pos", k: int = 10) -> DataFrame:
    """The last ``k`` utterances per session with their running number and role."""
    return keep_last(rotate_role(df, session, order), [session], F.col(order).desc(), k)


def emit_on_change(df: DataFrame, value: str, session: str = "session", order: str = "pos") -> DataFrame:
    """Rows whose value is not blank and differs from the last one sent in the session."""
    said = df.withColumn("_v", blank_to_null(strip(F.coalesce(F.col(value), F.lit(""))))).filter(F.col("_v").isNotNull())
    prev = OrderedScan(said, [session], [order]).lag("_before", F.col("_v")).result()
    return prev.filter(~F.col("_before").eqNullSafe(F.col("_v"))).drop("_v", "_before")


def active_config(df: DataFrame, setting: Column, name: str = "active", session: str = "session", order: str = "pos") -> DataFrame:
    """The setting in force at each message: the latest one sent so far in the session."""
    return OrderedScan(df, [session], [order]).last_known(name, setting).result()


def new_only(df: DataFrame, count: str, session: str = "session", order: str = "pos") -> DataFrame:
    """Snapshots that bring more entries than the one before, with the number of new entries."""
    prev = OrderedScan(df, [session], [order]).lag("_before", F.col(count)).result()
    fresh = F.col(count) - F.coalesce(F.col("_before"), F.lit(0))
    return prev.withColumn("new", fresh).filter(F.col("new") > 0).drop("_before")


def session_gaps(df: DataFrame, gap_us: int, session: str = "session", at: str = "pos") -> DataFrame:
    """Rows, first and last time per stretch of a session without a gap of ``gap_us`` or more (batch form of session windows)."""
    scan = OrderedScan(df, [session], [at])
    prev = scan.lag("_before", F.col(at)).result(keep_slab=True)
    opens = F.col("_before").isNull() | (F.col(at) - F.col("_before") >= gap_us)
    numbered = scan.again(prev.withColumn("_opens", opens.cast("int"))).running_sum("_w", F.col("_opens")).result()
    return numbered.groupBy(session, "_w").agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).drop("_w")
