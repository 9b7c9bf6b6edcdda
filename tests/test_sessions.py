"""Sessions on streams: order across files and micro-batches, late rows, replays, idle sessions, the live session."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators.utterances import Gate, GateState
from parley.streaming import live
from parley.streaming.state import Order, micros

MINUTE = 60_000_000


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a state store each
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _files(spark, path, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(9)
    rows = [("abc"[rng.randrange(3)] if i % 50 else None, i * MINUTE, rng.choice([0.0, 0.0, 0.001]), 0.2, i) for i in range(240)]
    rows += [(*r[:2], 0.001, 0.2, 1000 + r[4]) for r in rows[::20]]  # two rows of one time
    return rows


@pytest.mark.parametrize("files, slot", [(1, "1 hour"), (6, "10 minutes"), (6, "10 hours")])
def test_rows_do_not_depend_on_files_and_batches(spark, tmp_path, talk, files, slot):
    rng = random.Random(files)
    rows = talk + talk[10:40]  # replays
    rng.shuffle(rows)
    schema = "session string, seq long, level double, seconds double, row long"
    _files(spark, str(tmp_path / "in"), [rows[k::files] for k in range(files)], schema)
    s = live.chunk_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    order = Order(slot=slot)
    got = live.drain(live.utterance_stream(s, row="row", order=order), str(tmp_path / "u"))
    want = []
    for name in {r[0] for r in talk}:
        state = GateState()
        for _, seq, level, seconds, _ in sorted((r for r in talk if r[0] == name), key=lambda r: (r[1], r[4])):
            done = state.push(Gate(), seq, level, seconds)
            if done:
                want.append((name, *done))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    said = live.drain(live.history_stream(s.withColumn("text", F.col("row").cast("string")), "text", row="row", last=3, order=order), str(tmp_path / "h")).collect()
    for name in {r[0] for r in talk}:
        texts = [str(r[4]) for r in sorted((r for r in talk if r[0] == name), key=lambda r: (r[1], r[4]))]
        mine = sorted((r for r in said if r.session == name), key=lambda r: r.utterance)
        assert [r.text for r in mine] == texts and [r.recent for r in mine] == [texts[max(0, i - 2):i + 1] for i in range(len(texts))]


def test_what_waits_comes_out_while_the_stream_runs(spark, tmp_path):
    """With a short delay slots open as the watermark goes; a late row is folded in when it comes, an idle session starts anew."""
    schema = "session string, seq long, text string"
    parts = [[("a", 1 * MINUTE, "one"), ("a", 0, "zero"), ("b", 2 * MINUTE, "two")], [("b", 90 * MINUTE, "ninety")], [("a", 5 * MINUTE, "late"), ("a", 0, "zero")],
             [("b", 6000 * MINUTE, "far")], [("a", 6001 * MINUTE, "again")]]
    _files(spark, str(tmp_path / "in"), parts, schema)
    s = live.chunk_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    order = Order(delay="10 minutes", slot="10 minutes", idle="60 minutes")
    got = sorted(tuple(r)[:4] for r in live.drain(live.history_stream(s, "text", order=order), str(tmp_path / "w")).collect())
    assert [(r[2], r[3]) for r in got if r[0] == "a"] == [("zero", 1), ("one", 2), ("late", 3), ("again", 1)]
    assert [r[2] for r in got if r[0] == "b"] == ["two", "ninety", "far"]


def test_live_session_calibrates_scales_gates_and_closes(spark, tmp_path):
    schema = "session string, seq long, samples array<double>, stops boolean"
    rows = [("a", 3, [0.5, -0.5], False), ("a", 1, [0.1, -0.1], False), ("a", 2, [16384.0, -16384.0], False), ("a", 4, [0.15], False), ("a", 5, None, False),
            ("a", 6, [], False), ("a", 7, None, True), ("a", 8, [0.9], False), ("b", 1, [0.2], False), ("b", 2, [0.31], False)]
    _files(spark, str(tmp_path / "in"), [rows[5:], rows[:5]], schema)
    s = live.chunk_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    gate = Gate(0.2, 0.02, 6, None, 0.0)
    got = live.drain(live.session_audio_stream(s, gate=gate), str(tmp_path / "w")).collect()
    rows = sorted((r.session, r.seq, round(r.level, 6), round(r.noise, 6), r.was_open, r.speech) for r in got)
    assert rows == [("a", 2, 0.5, 0.1, False, True), ("a", 3, 0.5, 0.1, True, True), ("a", 4, 0.15, 0.1, True, True), ("b", 2, 0.31, 0.2, False, False)]


def test_lengths():
    assert micros("10 minutes") == 600_000_000 and micros("1 day") == 86_400_000_000
