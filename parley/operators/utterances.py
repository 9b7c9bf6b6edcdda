"""Audio chunks into utterances.

The gate is a small state machine per session: speech starts an utterance, silent chunks stay in
it and are counted, enough silence ends it.  A chunk below both thresholds is silent in every
state, so a long enough run of such chunks leaves the gate idle whatever came before.  These runs
cut a session into stretches that do not depend on each other: the stretches are found with
ordered scans, spread over the cluster, and only inside a stretch the machine runs row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from parley.operators.ordered import OrderedScan


@dataclass(frozen=True)
class Gate:
    """Parameters of the gate; the defaults are the live translation ones (fixed values)."""

    start_level: float = 0.0006
    keep_level: float = 0.0005
    end_frames: int | None = 6
    end_seconds: float | None = 0.5
    min_seconds: float = 0.4
    reset_seconds: bool = False  # does speech set the counted silent seconds back to 0


# The second variant has one level, ends on seconds of silence and forgets them on speech.
SIGN_GATE = Gate(0.008, 0.008, None, 2.0, 0.3, True)


class GateState:
    """Where one session is: an open utterance or none."""

    __slots__ = ("open", "frames", "silence", "duration", "chunks", "speech", "first_seq")

    def __init__(self, values=None):
        self.load(values or (False, 0, 0.0, 0.0, 0, 0, None))

    def load(self, values):
        self.open, self.frames, self.silence, self.duration, self.chunks, self.speech, self.first_seq = values

    def values(self):
        return (self.open, self.frames, self.silence, self.duration, self.chunks, self.speech, self.first_seq)

    def push(self, gate: Gate, seq: int, level: float, seconds: float):
        """Take one chunk; give back (first_seq, last_seq, chunks, speech chunks, seconds) when it ends an utterance."""
        talking = level > (gate.keep_level if self.open else gate.start_level)
        if not talking and not self.open:
            return None
        if not self.open:
            self.open, self.first_seq = True, seq
        self.chunks += 1
        self.duration += seconds
        if talking:
            self.speech += 1
            self.frames = 0
            if gate.reset_seconds:
                self.silence = 0.0
            return None
        self.frames += 1
        self.silence += seconds
        over = (gate.end_frames is not None and self.frames >= gate.end_frames) or (
            gate.end_seconds is not None and self.silence >= gate.end_seconds
        )
        if not over:
            return None
        done = (self.first_seq, seq, self.chunks, self.speech, self.duration)
        self.load((False, 0, 0.0, 0.0, 0, 0, None))
        return done if done[-1] >= gate.min_seconds else None


def voice_state(level: Column, in_utterance: Column, gate: Gate = Gate()) -> Column:
    """Is a chunk speech, given whether an utterance is open."""
    return level > F.when(in_utterance, gate.keep_level).otherwise(gate.start_level)


def _stretches(chunks: DataFrame, gate: Gate, session: str, seq: str, level: str, seconds: str, splits: int | None) -> DataFrame:
    """Add ``_stretch``: a number that grows wherever the gate is surely idle."""
    quiet = F.col(level) <= min(gate.keep_level, gate.start_level)
    quiet_us = F.when(quiet, F.floor(F.col(seconds) * 1_000_000)).otherwise(0)
    first = OrderedScan(chunks, [session], [seq], splits)
    counted = (
        first.running_sum("_quiet_n", quiet.cast("int")).running_sum("_quiet_us", quiet_us)
        .result(keep_slab=True)
    )
    mark = F.when(~quiet, F.struct(F.col("_quiet_n").alias("n"), F.col("_quiet_us").alias("us")))
    marked = first.again(counted).last_known("_mark", mark, before=True).result(keep_slab=True)
    run_n, run_us = F.col("_quiet_n") - F.col("_mark")["n"], F.col("_quiet_us") - F.col("_mark")["us"]
    enough = F.lit(False)
    if gate.end_frames is not None:
        enough = enough | (run_n >= gate.end_frames)
    if gate.end_seconds is not None:
        # floor per chunk and a margin: never call a run long enough that the gate would not
        enough = enough | (run_us > int(gate.end_seconds * 1_000_000) + 1)
    cut = ~quiet & (F.col("_mark").isNull() | enough)
    return (
        first.again(marked.withColumn("_cut", cut.cast("int")))
        .running_sum("_stretch", F.col("_cut")).result()
        .drop("_quiet_n", "_quiet_us", "_mark", "_cut")
    )


def utterances(
    chunks: DataFrame, gate: Gate = Gate(), session: str = "session", seq: str = "seq",
    level: str = "level", seconds: str = "seconds", splits: int | None = None,
) -> DataFrame:
    """Ended utterances of a bounded chunk table: (session, first_seq, last_seq, chunks, speech, seconds).

    Only (session, seq, level, seconds) takes part; samples are joined back by sequence number
    where they are needed.  Rows reach the state machine sorted and in Arrow batches; state is
    carried from batch to batch, so no stretch has to fit in memory.
    """
    slim = chunks.select(session, F.col(seq).cast("long").alias(seq), F.col(level).cast("double").alias(level), F.col(seconds).cast("double").alias(seconds))
    cut = _stretches(slim, gate, session, seq, level, seconds, splits)
    out = T.StructType([
        chunks.schema[session], T.StructField("first_seq", T.LongType()), T.StructField("last_seq", T.LongType()),
        T.StructField("chunks", T.LongType()), T.StructField("speech", T.LongType()), T.StructField("seconds", T.DoubleType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, GateState()
        for b in batches:
            rows = []
            for s, k, q, lv, sec in zip(b[session], b["_stretch"], b[seq], b[level], b[seconds]):
                if (s, k) != key:
                    key, state = (s, k), GateState()
                done = state.push(gate, q, lv, sec)
                if done:
                    rows.append((s, *done))
            yield pd.DataFrame(rows, columns=out.fieldNames())

    spread = cut.repartition(session, "_stretch").sortWithinPartitions(session, "_stretch", seq)
    return spread.mapInPandas(run, out)
