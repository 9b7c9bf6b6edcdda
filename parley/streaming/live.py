"""The live path on streams: chunks, utterances, messages, history."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from parley.functions.labels import SPEAKER_ROLES
from parley.operators.audio import denoise
from parley.operators.utterances import Gate, GateState
from parley.streaming.state import PROVIDER, ROCKS, Clock, Order, clocked, micros, run_state


def _fields(ddl: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in ddl])


def _also(row: str | None) -> list[str]:
    """The column that tells rows of one session apart, where ``seq`` does not."""
    return [row] if row else []


LONG, DOUBLE, TEXT, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
TEXTS = T.ArrayType(TEXT)


def chunk_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A file stream of a table, which may be one file or a folder of part files; ``max_files`` bounds a micro-batch.

    Sessions put their rows in order themselves, so neither the bound nor the order of the files changes what comes out.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = path.rstrip("/")
    return reader.load(f"{path[:-1]}[{path[-1]}]")  # as a pattern the path may be a file, too, which a stream refuses otherwise


def payload_bytes(payload: Column, is_base64: Column) -> Column:
    """Binary payload of a frame that may come as base64 text."""
    return F.when(is_base64, F.unbase64(payload.cast("string"))).otherwise(payload.cast("binary"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def float_samples(payload: pd.Series) -> pd.Series:
    """32-bit little-endian floats of a binary payload; a cut-off tail is dropped."""
    return pd.Series([
        None if p is None else np.frombuffer(bytes(p)[: len(p) // 4 * 4], dtype="<f4") for p in payload
    ])


def utterance_stream(
    chunks: DataFrame, gate: Gate = Gate(), session: str = "session", seq: str = "seq", level: str = "level",
    seconds: str = "seconds", row: str | None = None, order: Order = Order(),
) -> DataFrame:
    """Ended utterances, one row each, as soon as the watermark has passed their end.

    The same machine as the batch form; ``tests`` hold the two to the same rows.
    """
    out = _fields([(session, chunks.schema[session].dataType), ("first_seq", LONG), ("last_seq", LONG),
                   ("chunks", LONG), ("speech", LONG), ("seconds", DOUBLE)])
    state = _fields([("open", BOOL), ("frames", LONG), ("silence", DOUBLE), ("duration", DOUBLE),
                     ("chunks", LONG), ("speech", LONG), ("first_seq", LONG)])

    def step(values: tuple, r: dict) -> tuple[tuple, list[tuple]]:
        s = GateState(values)
        done = s.push(gate, int(r[seq]), float(r[level]), float(r[seconds]))
        return s.values(), [done] if done else []

    keep = [session, seq, level, seconds, *_also(row)]
    return run_state(chunks.select(*keep), session, seq, out, state, GateState().values(), step, row, order)


def history_stream(
    stream: DataFrame, text: str, session: str = "session", seq: str = "seq", row: str | None = None, last: int = 10, order: Order = Order(),
) -> DataFrame:
    """Every utterance with its running number and role, and the texts of the ``last`` utterances up to it, oldest first.

    The ring of texts and the count are the session's state; both go when the session is idle (``order.idle``).
    """
    out = _fields([(session, stream.schema[session].dataType), (seq, LONG), (text, TEXT), ("utterance", LONG), ("role", TEXT), ("recent", TEXTS)])

    def step(values: tuple, r: dict) -> tuple[tuple, list[tuple]]:
        n, ring = values[0] + 1, [*values[1], r[text]][-last:]
        return (n, ring), [(int(r[seq]), r[text], n, SPEAKER_ROLES[(n - 1) % len(SPEAKER_ROLES)], ring)]

    return run_state(stream.select(session, seq, text, *_also(row)), session, seq, out, _fields([("count", LONG), ("ring", TEXTS)]), (0, []), step, row, order)


def session_audio_stream(
    stream: DataFrame, samples: str = "samples", stops: str = "stops", calibration: int = 1, gate: Gate = Gate(), session: str = "session",
    seq: str = "seq", row: str | None = None, order: Order = Order(),
) -> DataFrame:
    """The live session: calibrated on its first chunks, then a verdict for each chunk until it is stopped.

    A chunk with samples beyond -1 and 1 is 16-bit PCM and divided by 32,768.  The noise level is the root mean square of all samples of the
    first ``calibration`` chunks; what a chunk has above it goes to the gate, whose open flag is the session's own.  Rows: the
    chunk's level, the noise level, whether an utterance was open before it, and whether it is speech.  A row with ``stops`` set closes the session;
    what follows is dropped.  Empty chunks are skipped.
    """
    out = _fields([(session, stream.schema[session].dataType), (seq, LONG), ("level", DOUBLE), ("noise", DOUBLE), ("was_open", BOOL), ("speech", BOOL)])
    state = _fields([("chunks", LONG), ("squares", DOUBLE), ("samples", LONG), ("closed", BOOL), ("open", BOOL), ("frames", LONG), ("silence", DOUBLE),
                     ("duration", DOUBLE), ("in_it", LONG), ("speech", LONG), ("first_seq", LONG)])

    def step(values: tuple, r: dict) -> tuple[tuple, list[tuple]]:
        chunks, squares, n, closed, *gated = values
        if closed:
            return values, []
        if r[stops]:
            return (chunks, squares, n, True, *gated), []
        if r[samples] is None or not len(r[samples]):
            return values, []
        wave = np.asarray(r[samples], np.float64)
        if wave.max() > 1 or wave.min() < -1:
            wave = wave / 32768.0
        power = float(np.sum(wave * wave))
        if chunks < calibration:
            return (chunks + 1, squares + power, n + len(wave), False, *gated), []
        g = GateState(tuple(gated))
        level, noise, was = (power / len(wave)) ** 0.5, (squares / n) ** 0.5, g.open
        spoken = level - noise > (gate.keep_level if was else gate.start_level)
        g.push(gate, int(r[seq]), level - noise, len(wave) / 16000.0)
        return (chunks + 1, squares, n, False, *g.values()), [(int(r[seq]), level, noise, was, spoken)]

    start = (0, 0.0, 0, False, *GateState().values())
    return run_state(stream.select(session, seq, samples, stops, *_also(row)), session, seq, out, state, start, step, row, order)


def change_stream(
    stream: DataFrame, value: str, session: str = "session", seq: str = "seq", row: str | None = None, order: Order = Order(),
) -> DataFrame:
    """A value passes when it is not blank and differs from the last one sent."""
    out = _fields([(session, stream.schema[session].dataType), (seq, LONG), (value, TEXT)])

    def step(values: tuple, r: dict) -> tuple[tuple, list[tuple]]:
        v = (r[value] or "").strip()
        if not v or v == values[0]:
            return values, []
        return (v,), [(int(r[seq]), v)]

    return run_state(stream.select(session, seq, value, *_also(row)), session, seq, out, _fields([("last", TEXT)]), (None,), step, row, order)


def control_stream(
    stream: DataFrame, message: str, session: str = "session", seq: str = "seq", row: str | None = None, order: Order = Order(),
) -> DataFrame:
    """Audio messages with the config in force; ``stop`` closes the session, and what follows is dropped.

    Messages are JSON with ``type`` config (``value``), audio, stop or ping; other text is skipped.
    Parsing is a column expression; only type and value reach the state.
    """
    parsed = stream.withColumn("_m", F.from_json(message, "type STRING, value STRING", {"mode": "PERMISSIVE"}))
    slim = parsed.filter(F.col("_m")["type"].isin("config", "audio", "stop")).select(
        session, seq, F.col("_m")["type"].alias("type"), F.col("_m")["value"].alias("value"), *_also(row))
    out = _fields([(session, stream.schema[session].dataType), (seq, LONG), ("active", TEXT)])

    def step(values: tuple, r: dict) -> tuple[tuple, list[tuple]]:
        config, closed = values
        if closed:
            return values, []
        if r["type"] == "config":
            return (r["value"], False), []
        if r["type"] == "stop":
            return (config, True), []
        return values, [(int(r[seq]), config)]

    return run_state(slim, session, seq, out, _fields([("config", TEXT), ("closed", BOOL)]), (None, False), step, row, order)


def isolated_stream(
    stream: DataFrame, closes: str, session: str = "session", seq: str = "seq", row: str | None = None, order: Order = Order(),
) -> DataFrame:
    """Chunks of open sessions with their number in the session; ``closes`` marks the chunk after which it is shut."""
    out = _fields([(session, stream.schema[session].dataType), (seq, LONG), ("n", LONG)])

    def step(values: tuple, r: dict) -> tuple[tuple, list[tuple]]:
        n, closed = values
        if closed:
            return values, []
        return (n + 1, bool(r[closes])), [(int(r[seq]), n + 1)]

    return run_state(stream.select(session, seq, closes, *_also(row)), session, seq, out, _fields([("n", LONG), ("closed", BOOL)]), (0, False), step, row, order)


def calibrated_stream(chunks: DataFrame, profiles: DataFrame, session: str = "session", samples: str = "samples", frame: int = 512) -> DataFrame:
    """Chunks cleaned with the noise profile of their session: a stream-static join."""
    return denoise(chunks, profiles, session, samples, frame)


def session_windows(stream: DataFrame, ts: str, gap: str, session: str = "session", delay: str = "1 hour") -> DataFrame:
    """Event-time form of "silence closes an utterance": rows, first and last time per session window.

    A window comes out once the watermark has passed its end; at the end of a bounded run ``drain`` and ``stream_sink`` let the open ones out.
    """
    timed, clock = clocked(stream.select(session, ts), F.col(ts), delay, micros(gap) + micros(delay) + 1_000_000)
    out = (
        timed.groupBy(F.session_window("_tick", gap).alias("w"), session)
        .agg(F.count(F.lit(1)).alias("n"), F.max("_tick").alias("last_ts"))
        .select(session, F.col("w.start").alias("first_ts"), "last_ts", "n")
    )
    out.clock = clock
    return out


def review_flags(df: DataFrame, confidence: str = "confidence", threshold: float = 0.7) -> DataFrame:
    """Rows a person should look at; works on streams and tables alike."""
    return df.filter(F.col(confidence) < threshold)


def stream_sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", clock: Clock | None = None):
    """Run what there is to run and write it to Parquet exactly once; then, where sessions still hold rows back, let them go.

    ``clock`` is that of ``run_state``; it is found on the stream it made and must be given for one derived from it.
    """
    spark, clock = stream.sparkSession, clock or getattr(stream, "clock", None)

    def run():
        before = spark.conf.get(PROVIDER)
        spark.conf.set(PROVIDER, ROCKS)
        try:
            query = (
                stream.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
                .option("checkpointLocation", checkpoint).option("path", path).start()
            )
        finally:
            spark.conf.set(PROVIDER, before)
        query.awaitTermination()
        return query

    query = run()
    newest = [p.eventTime["max"] for p in query.recentProgress if p.eventTime and "max" in p.eventTime]
    if clock and newest:
        clock.tick(spark, max(newest))
        run()
    return query


def drain(stream: DataFrame, folder: str, clock: Clock | None = None) -> DataFrame:
    """Everything the stream has now, written under ``folder`` and read back as a table."""
    path = f"{folder}/out"
    stream_sink(stream, path, f"{folder}/checkpoint", clock=clock)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
