"""Faults found by the third review: each test failed before its mend."""

import random
import tracemalloc

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from parley.functions import metrics as M
from parley.operators import glossary, quality
from parley.streaming import state

WORDS = ["a", "b", "c", "a.", "1,0", "x-\ny", "<skipped>", "", "&amp;quot;", "-", "\n", ",", "..", "é", "10-3", " ", "[`{~", "5- 6", ".5,"]


def _plain(hyp: list[str], ref: list[str]) -> list[int]:
    return [*(M._clipped(hyp, ref, n) for n in range(1, 5)), len(hyp), len(ref)]


def test_tokens_are_those_of_the_column(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(12))) for _ in range(400)] + ["", " ", " . ", "\n-\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.tokens_13a(F.col("t"))).collect()
    for t, tokens in got:
        assert M.tokens_of(t) == tokens.split(), t


def test_overlaps_move_from_text_to_text():
    rng = random.Random(1)
    count, ref, hyp = M.Overlaps(), "", ""
    for k in range(6000):
        if k % 30 == 0:
            ref = " ".join(rng.choices(WORDS, k=rng.randrange(30)))
        if k % 30 == 0 or rng.random() < 0.1:
            hyp = " ".join(rng.choices(WORDS, k=rng.randrange(40)))
        else:
            some = hyp.split(" ")
            i = rng.randrange(len(some) + 1)
            some[i:i + rng.randrange(3)] = rng.choices(WORDS, k=rng.randrange(3))
            hyp = " ".join(some)
        assert count(hyp, ref) == _plain(M.tokens_of(hyp), M.tokens_of(ref)), (hyp, ref)


def test_an_ablation_counts_only_what_changes(monkeypatch):
    """A text of n words left out one by one is counted whole once, not n times."""
    words = [f"w{i % 50}" for i in range(300)]
    texts = [" ".join(words[:i] + words[i + 1:]) for i in range(len(words))]
    whole = []
    monkeypatch.setattr(M.Overlaps, "_whole", lambda self, tokens, plain=M.Overlaps._whole: (whole.append(1), plain(self, tokens)))
    count = M.Overlaps()
    for t in texts:
        assert count(t, " ".join(words)) == _plain(t.split(), words)
    assert len(whole) == 1


def _peak(work) -> int:
    """Bytes of Python objects that a call holds at most."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_left_out_statistics_are_held_as_numbers():
    words = [[f"w{i % 40}"] for i in range(400)]
    text = " ".join(w[0] for w in words)
    batch = pa.array([[w[0] for w in words]] * 100), pa.array([text] * 100)
    got = []
    assert _peak(lambda: got.extend(M._left_out.func(iter([batch])))) < 16 << 20  # 40,000 words
    assert sum(len(a) for a in got) == 100
    for i, row in enumerate(got[0][99].as_py()):
        assert row["removed_index"] == i
        assert row["stats"] == _plain([w[0] for w in words[:i] + words[i + 1:]], text.split())


def test_hits_are_held_as_numbers(monkeypatch):
    terms = [f"t{i:04d}" for i in range(1000)]
    shards = []
    for some in (terms[:600], terms[600:]):
        found = ahocorasick.Automaton()
        for t in some:
            found.add_word(t, t)
        found.make_automaton()
        shards.append(found)
    monkeypatch.setattr(glossary, "_automata", lambda files, shard: iter(shards))
    g = glossary.Glossary.__new__(glossary.Glossary)
    g.files, g.shard = (), 0
    ref, hyp = pa.array([" ".join(terms), "", "t0001 t0999"] * 100), pa.array([" ".join(terms[::2]), "x", "t0001"] * 100)
    got = []
    assert _peak(lambda: got.append(g._hits(ref, hyp))) < 8 << 20  # 100,200 hits
    rows = got[0].to_pylist()
    assert {h["term"]: h["kept"] for h in rows[297]} == {t: i % 2 == 0 for i, t in enumerate(terms)} and len(rows[297]) == 1000
    assert rows[298] == [] and sorted((h["term"], h["kept"]) for h in rows[299]) == [("t0001", True), ("t0999", False)]
    assert g._hits(ref.slice(0, 0), hyp.slice(0, 0)).to_pylist() == []


def test_bias_report_ends_with_advice(spark):
    m = spark.createDataFrame([("happy", "1", 1.0), ("sad", None, 9.0)], "emotion string, speaker_id string, duration_sec double")
    rows = [r for r in quality.bias_report(m).collect() if r.section == "advice"]
    assert sorted((r.n, r.key, r.expected, r.flagged) for r in rows) == [(i, a, None, False) for i, a in enumerate(quality.BIAS_ADVICE)] and len(rows) == 3


class _Store:
    """What a session's state machine keeps, and how often it is asked."""

    def __init__(self):
        self.calls, self.timers, self.maps, self.value = 0, set(), {}, None

    def getValueState(self, name, *schema):
        return self

    getMapState = getValueState

    def __getattr__(self, name):
        def call(*a):
            self.calls += 1
            match name:
                case "get": return self.value
                case "update": self.value = a[0]
                case "clear": self.value = None
                case "getValue": return self.maps.get(a[0])
                case "updateValue": self.maps[a[0]] = a[1]
                case "removeKey": self.maps.pop(a[0], None)
                case "registerTimer": self.timers.add(a[0])
                case _: raise AttributeError(name)
        return call

    def getCurrentWatermarkInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentWatermarkInMs


def _session(batches, idle=None, step=lambda v, r: ((v[0] + 1,), [(r["seq"], v[0] + 1)])):
    """Rows (seq, row) in batches, after each the watermark (seconds): rows out, the store."""
    out = T.StructType([T.StructField(n, T.LongType()) for n in ("k", "seq", "n")])
    store = _Store()
    fold = state._Fold(["seq", "row"], "k", "seq", "row", out.fieldNames(), T.StructType([T.StructField("n", T.LongType())]), (0,), step, state.Order(slot="10 seconds", idle=idle))
    fold.init(store)
    got = []
    for rows, mark in batches:
        store.now = mark * 1000
        if rows:
            got += [f for f in fold.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["seq", "row"])]), store)]
        while due := sorted(t for t in store.timers if t <= store.now):
            store.timers.discard(due[0])
            got += [f for f in fold.handleExpiredTimer((1,), store, store)]
    return [tuple(r) for f in got for r in f[["seq", "n"]].itertuples(index=False)], store


def test_a_session_asks_its_store_a_few_times():
    S = 1_000_000
    rows = [(i * S, i) for i in range(100)]  # ten slots
    got, store = _session([(rows[50:], 0), (rows[:50], 0), ([], 1000)])
    assert got == [(i * S, i + 1) for i in range(100)]
    assert store.calls < 15  # about eighty with five or more calls a slot


def test_large_sessions_late_rows_and_replays():
    S = 1_000_000
    rows = [(i * 10_000, i) for i in range(6000)]  # six slots of 1,000 rows
    late = [(5 * S + 1, 9001), *rows[:10], (55 * S, 5500)]
    got, store = _session([(rows[3000:], 0), (rows[:3000], 30), (late, 30), ([], 1000), (rows[7:9], 1000)])
    want = [*rows[:3000], late[0], *rows[3000:]]
    assert got == [(seq, n) for n, (seq, _) in enumerate(want, 1)]
    assert not store.timers


def test_idle_sessions_are_forgotten_with_their_row_numbers():
    S = 1_000_000
    rows = [(i * 10_000, i) for i in range(3000)]
    got, store = _session([(rows, 0), ([], 35), (rows[:3], 35), ([], 200)], idle="30 seconds")
    assert got == [(seq, n) for n, (seq, _) in enumerate(rows, 1)]
    assert store.value is None and not store.maps and not store.timers
    got, _ = _session([(rows[:5], 0), ([], 200), ([(300 * S, 1)], 200), ([], 400)], idle="30 seconds")
    assert got[-1] == (300 * S, 1)  # a new session
    got, _ = _session([(rows[:5] + [(300 * S, 9)], 0), ([], 400)], idle="30 seconds")
    assert got[-1] == (300 * S, 6)  # rows that wait keep it alive
