"""Per-session state on a stream: rows in event-time order, one small state, rows out.

Rows wait in the state store in slots of event time.  A timer opens a slot once the watermark has passed it; its rows are sorted
and folded into the session's state.  What a task holds is one slot of one session, never a session or a micro-batch.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.session import work_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_TICK = T.StructType([T.StructField("_tick", T.TimestampType())])
NEAR_ROWS = 1000  # rows, and row numbers, of a session that lie beside its state
OUT_ROWS = 10_000  # output rows of a session that wait for each other
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def micros(span: str) -> int:
    """Microseconds of a length such as ``10 minutes``."""
    n, unit = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", span).groups()
    return int(n) * _UNITS[unit] * 1_000_000


@dataclass(frozen=True)
class Order:
    """How rows of a session are put in order; ``seq`` counts microseconds of event time.

    delay   how far a row may be behind the newest one and still take its place; later ones are folded in when they come.
            The default waits for everything, so that a bounded run gives the same rows however the files lie.
    slot    rows of one session within a slot are sorted together: what one task holds
    idle    a session without rows for this long after its last slot is forgotten, with the row numbers that tell replays;
            None keeps them
    """

    delay: str = "36500 days"
    slot: str = "1 hour"
    idle: str | None = None


@dataclass
class _Book:
    """What a session holds beside its state: a few rows and row numbers, and where the others lie."""

    parts: dict[int, int]  # of waiting slots, how many parts of their rows are in the store
    rows: dict[int, list[tuple]]  # of waiting slots, rows that are not
    seen: dict[int, set]  # of opened slots, row numbers that are not
    known: set[int]  # opened slots whose row numbers are to be forgotten

    def first(self) -> int | None:
        return min((*self.parts, *self.rows), default=None)

    def oldest(self) -> int | None:
        return min(self.known, default=None)


class _Fold(StatefulProcessor):
    """Rows into slots, slots in order through ``step``."""

    def __init__(self, names: list[str], key: str, seq: str, unique: str, out: list[str], state: T.StructType, start: tuple, step, order: Order):
        self.names, self.key, self.seq, self.unique, self.out = names, key, seq, unique, out
        self.state, self.start, self.step = state, start, step
        self.slot, self.idle = micros(order.slot), micros(order.idle) if order.idle else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # opened: newest slot whose turn is over; book: see _Book.  A call to the store takes about a millisecond, so what is small
        # lies together and a key has one timer for its first slot.
        self.machine = handle.getValueState("machine", T.StructType([*self.state.fields, T.StructField("opened", T.LongType()), T.StructField("book", T.BinaryType())]))
        # rows of a slot that waits, in parts; of an opened one the row numbers, as part 0
        self.held = handle.getMapState("held", "slot long, part int", "rows binary")

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=self.out)

    def _fold(self, rows: list[tuple], seen: set, values: tuple) -> tuple[tuple, list[tuple]]:
        """One slot's rows, sorted, without those whose number was there before."""
        at, number = self.names.index(self.seq), self.names.index(self.unique)
        made: list[tuple] = []
        for r in sorted(rows, key=lambda r: (r[at], r[number])):
            if r[number] in seen:
                continue
            seen.add(r[number])
            values, new = self.step(values, dict(zip(self.names, r, strict=True)))
            made += new
        return values, made

    def _now(self) -> tuple[tuple, int | None, _Book]:
        values = self.machine.get()
        return (tuple(values[:-2]), values[-2], _Book(*pickle.loads(values[-1]))) if values else (self.start, None, _Book({}, {}, {}, set()))

    def _keep(self, values: tuple, opened: int | None, book: _Book) -> None:
        self.machine.update((*values, opened, pickle.dumps((book.parts, book.rows, book.seen, book.known))))

    def _remember(self, book: _Book, slot: int, seen: set, far: bool) -> None:
        """The row numbers of an opened slot: in the book as long as it is small."""
        book.seen.pop(slot, None)
        if far or len(seen) + sum(map(len, book.seen.values())) > NEAR_ROWS:
            self.held.updateValue((slot, 0), (pickle.dumps(seen),))
        else:
            book.seen[slot] = seen
        if self.idle:
            book.known.add(slot)

    def _end(self, slot: int) -> int:
        return (slot + 1) * self.slot

    def _timers(self, first: int | None, oldest: int | None, book: _Book) -> None:
        """Timers for the first slot that waits and the oldest to be forgotten, where these are no longer ``first`` and ``oldest``."""
        if book.first() not in (None, first):
            self.handle.registerTimer(self._end(book.first()) // 1000)
        if book.oldest() not in (None, oldest):
            self.handle.registerTimer((self._end(book.oldest()) + self.idle) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        values, opened, book = self._now()
        first, oldest = book.first(), book.oldest()
        made: list[tuple] = []
        at = self.names.index(self.seq)
        for chunk in rows:
            records = list(zip(*(chunk[c].tolist() for c in self.names), strict=True))
            by_slot: dict[int, list[tuple]] = {}
            for r in records:
                by_slot.setdefault(int(r[at]) // self.slot, []).append(r)
            for slot, some in sorted(by_slot.items()):
                if opened is not None and slot <= opened:  # its turn is over: folded in now
                    far = None if slot in book.seen else self.held.getValue((slot, 0))
                    seen = pickle.loads(far[0]) if far else book.seen.get(slot, set())
                    values, new = self._fold(some, seen, values)
                    self._remember(book, slot, seen, bool(far))
                    made += new
                else:
                    book.rows.setdefault(slot, []).extend(some)
            if sum(map(len, book.rows.values())) > NEAR_ROWS:
                for slot, some in book.rows.items():
                    n = book.parts.get(slot, 0)
                    self.held.updateValue((slot, n), (pickle.dumps(some),))
                    book.parts[slot] = n + 1
                book.rows.clear()
        self._timers(first, oldest, book)
        self._keep(values, opened, book)
        if made:
            yield self._frame(key, made)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        values, opened, book = self._now()
        first, oldest = book.first(), book.oldest()
        past = [s for s in sorted(book.known) if self._end(s) + self.idle <= now]
        for slot in past:
            if book.seen.pop(slot, None) is None:
                self.held.removeKey((slot, 0))
            book.known.discard(slot)
        if opened in past and first is None:
            self.machine.clear()
            return
        ready = [s for s in sorted({*book.parts, *book.rows}) if self._end(s) <= now]
        if not ready and not past:
            return
        made: list[tuple] = []
        for slot in ready:  # one slot's rows at a time
            rows: list[tuple] = []
            parts = book.parts.pop(slot, 0)
            for part in range(parts):
                rows += pickle.loads(self.held.getValue((slot, part))[0])
                if part:
                    self.held.removeKey((slot, part))
            rows += book.rows.pop(slot, [])
            seen: set = set()
            values, new = self._fold(rows, seen, values)
            self._remember(book, slot, seen, parts > 0)
            opened = slot
            made += new
            if len(made) >= OUT_ROWS:
                yield self._frame(key, made)
                made = []
        self._timers(first, oldest, book)
        self._keep(values, opened, book)
        if made:
            yield self._frame(key, made)

    def close(self) -> None:
        pass


@dataclass
class Clock:
    """A second source of a stream whose rows only move its watermark, so that a bounded run can open what still waits."""

    path: str
    past: int  # microseconds beyond the newest row after which every slot is open

    @classmethod
    def under(cls, spark: SparkSession, past: int) -> Clock:
        clock = cls(f"{work_dir(spark)}-clock", past)
        spark.createDataFrame([], _TICK).write.parquet(clock.path)
        return clock

    def stream(self, spark: SparkSession) -> DataFrame:
        return spark.readStream.schema(_TICK).parquet(self.path)

    def tick(self, spark: SparkSession, newest: str) -> None:
        """Move the watermark past everything up to the newest time seen."""
        at = int(datetime.fromisoformat(newest.replace("Z", "+00:00")).timestamp() * 1e6) + self.past
        spark.range(1).select(F.timestamp_micros(F.lit(at)).alias("_tick")).write.mode("append").parquet(self.path)


def clocked(stream: DataFrame, time: Column, delay: str, past: int) -> tuple[DataFrame, Clock]:
    """The stream with ``time`` as watermarked column ``_tick``, and the clock that can move its watermark ``past`` microseconds on.

    Rows without a time are dropped.
    """
    spark = stream.sparkSession
    clock = Clock.under(spark, past)
    timed = stream.withColumns({"_tick": time, "_live": F.lit(True)})
    marked = timed.unionByName(clock.stream(spark).withColumn("_live", F.lit(False)), allowMissingColumns=True).withWatermark("_tick", delay)
    # the condition uses the time, so that it stays above the watermark
    return marked.filter(F.col("_live") == (F.unix_micros("_tick") > F.lit(-(1 << 62)))).drop("_live"), clock


def run_state(
    stream: DataFrame, key: str, seq: str, out: T.StructType, state: T.StructType, start: tuple,
    step: Callable[[tuple, dict], tuple[tuple, list[tuple]]], row: str | None = None, order: Order = Order(),
) -> DataFrame:
    """Fold ``step(state, row) -> (state, output rows)`` over the rows of each key in ``seq`` order.

    ``seq`` is a whole number, microseconds of event time (rows without it are dropped); ``row`` is a whole number that tells the rows of a key apart, where several
    may have one ``seq``, and orders these.  Without it ``seq`` itself is that number.

    Rows wait in slots of event time until the watermark (newest ``seq`` less ``order.delay``) has passed, whatever file
    or micro-batch brings them; a row that comes after its slot was opened is folded in when it comes.  A row whose number was
    there before in its slot is a replay and has no effect.  A null key is a session of its own.  ``drain`` and ``stream_sink`` move the watermark past the
    newest row at the end of a bounded run.
    """
    unique = row or seq
    timed, clock = clocked(stream, F.timestamp_micros(F.col(seq)), order.delay, micros(order.delay) + micros(order.slot) + 1_000_000)
    rows = timed.select(*stream.columns)  # without the time column late rows are not dropped
    names = [c for c in stream.columns if c != key]
    fold = _Fold(names, key, seq, unique, out.fieldNames(), state, start, step, order)
    done = rows.groupBy(key).transformWithStateInPandas(fold, out, "append", "eventTime")
    done.clock = clock
    return done
