"""Checks, splits, ordered scans and the live path on small fixtures and against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import labels as L, signal as S, text as X
from parley.operators import audio, gates, intervals, quality, rows, slices, splits, turns
from parley.operators.ordered import OrderedScan
from parley.operators.utterances import SIGN_GATE, Gate, GateState, utterances
from parley.sources import manifests, media
from parley.streaming import live


# --- ordered scans: one key holds most rows ----------------------------------

@pytest.mark.parametrize("splits_n", [1, 3, 64])
def test_ordered_scan_equals_a_loop(spark, splits_n):
    rng = random.Random(splits_n)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([None, "x", "y"]), rng.randint(-3, 3)) for i in range(400)]
    df = spark.createDataFrame(rng.sample(data, len(data)), "k string, pos long, v string, w int")
    scan = OrderedScan(df, ["k"], ["pos"], splits_n)
    got = scan.row_number("rn").running_sum("s", F.col("w")).lag("before", F.col("v")).last_known(
        "known", F.col("v")).last_known("earlier", F.col("v"), before=True).result()
    assert set(got.columns) == {"k", "pos", "v", "w", "rn", "s", "before", "known", "earlier"}
    state, want = {}, set()
    for k, pos, v, w in data:
        n, total, prev, known = state.get(k, (0, 0, None, None))
        want.add((k, pos, n + 1, total + w, prev, v if v is not None else known, known))
        state[k] = (n + 1, total + w, v, v if v is not None else known)
    assert {tuple(r) for r in got.select("k", "pos", "rn", "s", "before", "known", "earlier").collect()} == want


def test_hot_key_is_spread(spark):
    df = spark.createDataFrame([("hot", i) for i in range(1000)] + [(f"c{i}", i) for i in range(100)], "k string, pos long")
    slabs = OrderedScan(df, ["k"], ["pos"], 16).df.groupBy("k", "_slab").count().collect()
    hot = [r["count"] for r in slabs if r["k"] == "hot"]
    assert len(hot) > 16 and max(hot) <= 1100 / 16
    assert all(r["_slab"] is None for r in slabs if r["k"] != "hot")


# --- manifests and slices ----------------------------------------------------

def test_manifest_shapes_and_missing_split(spark, tmp_path):
    for split, doc in (("dev", [{"file": "a.wav", "emotion": "happy"}, {"file": "b.wav", "emotion": "sad"}]),
                       ("test", {"items": [{"file": "x.wav", "label": "neutral"}]})):
        (tmp_path / split).mkdir()
        (tmp_path / split / "manifest.json").write_text(json.dumps(doc))
    got = {tuple(r) for r in manifests.read_manifests(spark, str(tmp_path)).select("split", "file", "emotion", "label").collect()}
    assert got == {("dev", "a.wav", "happy", None), ("dev", "b.wav", "sad", None), ("test", "x.wav", None, "neutral")}


def test_phrases_rejoin_overflow(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text('source_text,source_language,target_language,reference_translation\nhi,en,es,hola\n"one, two",en,es,uno, dos\na,en,es,x,y,z\n,,,\n')
    got = {(r["source_text"], r["reference_translation"], r["overflow"]) for r in manifests.read_phrases(spark, str(f)).collect()}
    assert got == {("hi", "hola", 0), ("one, two", "uno, dos", 1), ("a", "x,y,z", 2)}


def test_label_fallback_and_durations(spark):
    df = spark.createDataFrame([("happy", None), ("sad", None), (None, "happy"), (None, None)], "emotion string, label string")
    counts = df.groupBy(L.label_or_unknown(F.col("emotion"), F.col("label")).alias("v")).count()
    assert {tuple(r) for r in counts.collect()} == {("happy", 2), ("sad", 1), ("unknown", 1)}
    d = spark.createDataFrame([(1.0,), (3.0,), (6.0,), (None,)], "duration_sec double")
    assert {(r["value"], r["n"]) for r in slices.duration_slices(d).collect()} == {("short", 2), ("medium", 1), ("long", 1)}


def test_imbalance_rules(spark):
    frame = lambda vals: spark.createDataFrame([(v,) for v in vals], "emotion string")
    assert [r["value"] for r in slices.label_imbalance(frame(["happy"] * 18 + ["sad"] * 2)).collect()] == ["happy"]
    assert slices.label_imbalance(frame(["unknown"] * 5)).count() == 0
    assert slices.label_imbalance(frame(["a"] * 9 + ["b"] * 9 + ["c"])).count() == 0  # under 20 rows: no lower bound
    ds = spark.createDataFrame([("A",)] * 98 + [("B",)] * 2, "dataset string")
    assert [r["value"] for r in slices.source_balance(ds).collect()] == ["A"]
    assert slices.source_balance(ds.filter("dataset = 'A'")).count() == 0


def test_split_presence(spark):
    df = spark.createDataFrame([("dev",)], "split string")
    assert {(r["split"], r["status"]) for r in slices.split_presence(df, min_files=2).collect()} == {("dev", "few"), ("test", "missing"), ("holdout", "missing")}


def test_schema_failures(spark):
    one = lambda *v: spark.createDataFrame([v], "files_checked long, passed long, failed long, label_errors long, sample_error string")
    assert quality.schema_failures(one(13, 10, 3, 1, "e" * 90)).first()["finding"] == "Validation reported 3 failed files; sample: " + "e" * 80 + "..."
    assert quality.schema_failures(one(1, 0, 0, 0, None)).count() == 1
    assert quality.schema_failures(one(1, 0, 1, 0, None), enabled=False).count() == 0


def test_file_checks(spark):
    df = spark.createDataFrame([(16000, 1, 1.0), (8000, 2, 40.0), (None, None, None)], "sample_rate int, channels int, duration_sec double")
    got = [(len(r["errors"]), r["passed"]) for r in rows.file_checks(df).collect()]
    assert got == [(0, True), (3, False), (1, False)]
    assert rows.file_checks(df, expected_sr=8000).first()["errors"][0].startswith("sample_rate")


def test_label_domain(spark):
    df = spark.createDataFrame([("happy",), ("invalid_label",), (None,), ("",)], "emotion string")
    assert rows.label_domain_check(df, None).count() == 0
    assert [r["emotion"] for r in rows.label_domain_check(df, ["happy", "sad"]).collect()] == ["invalid_label"]


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="source_language"):
        rows.split_features_labels(spark.createDataFrame([("a",)], "source_text string"))


# --- splits ------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 10, 23, 50])
def test_speakers_stay_in_one_split(spark, n):
    meta = spark.createDataFrame([(f"s{i % max(n, 1)}", i) for i in range(3 * n)], "speaker_id string, i int")
    assigned = splits.assign_split(meta, splits.speaker_split(meta))
    assert assigned.count() == 3 * n and splits.split_disjoint(assigned).count() == 0
    dev, hold = max(1, int(n * 0.2)), max(1, int(n * 0.1))
    if n - dev - hold < 1:
        dev = max(0, n - 2)
        hold = n - dev - 1
    got = {r["split"]: r["count"] for r in assigned.select("speaker_id", "split").distinct().groupBy("split").count().collect()}
    want = {"dev": dev, "holdout": hold, "test": n - dev - hold} if n else {}
    assert got == {k: v for k, v in want.items() if v > 0}


def test_speakers_and_labels_from_paths(spark):
    paths = ["Actor_01/03-01-05-01-01-01-01.wav", "subject_42/sample.wav", "03-01-05-01-01-01-01.wav", "wav/real/plain.wav", "x/RAVDESS/a-b-99.wav", "x/Happy/clip.wav"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string").orderBy("i")
    got = [tuple(r) for r in df.select(L.infer_speaker(F.col("path")), L.infer_label(F.col("path"))).collect()]
    assert got == [("01", "angry"), ("42", "unknown"), ("01", "angry"), ("real", "unknown"), ("99", "unknown"), ("Happy", "happy")]


def test_safe_suffix_is_capped(spark):
    df = spark.createDataFrame([("a b", "c"), ("x" * 100, "y"), (" ", "")], "p string, q string")
    got = [r[0] for r in df.select(X.safe_suffix(F.col("p"), F.col("q"))).collect()]
    assert got[0] == "a_b_c" and len(got[1]) == 69 and got[1][:60] == "x" * 60 and got[2] == "nogroups"


# --- media -------------------------------------------------------------------

def test_media_scan_inventory_and_checksums(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.wav", b"hello world"), ("b.txt", b"x"), ("sub/c.WAV", b"hello world"), ("._d.wav", b"")):
        (tmp_path / name).write_bytes(data)
    found = media.scan_media(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in found.collect()) == ["a.wav", "c.WAV"]
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).filter("length = 11")
    sums = media.verify_checksums(content, content.limit(0).selectExpr("path", "'' AS sha256")).collect()
    assert len({r["sha256"] for r in sums}) == 1 and all(len(r["sha256"]) == 64 and r["status"] == "unchecked" for r in sums)
    files = spark.createDataFrame([("b", ".gitkeep"), ("c", "x.wav"), ("d", "p.zip")], "dataset string, path string")
    want = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "dataset string")
    assert {r["dataset"]: r["status"] for r in media.inventory(files, want).collect()} == {"a": "empty", "b": "empty", "c": "media", "d": "archives"}


def test_source_selection(spark):
    s = spark.createDataFrame([("A", "u"), ("B", None), ("C", "u")], "name string, url string")
    assert {tuple(r) for r in media.select_sources([s], ["A", "C"]).collect()} == {("A", "u", True), ("C", "u", True)}


# --- turns and intervals -----------------------------------------------------

def test_turns_by_hand(spark):
    ws = [(1, "s1", False, "hello", 0.0, 1.0), (2, "s1", False, " there ", 1.0, 2.0), (3, None, True, "(noise)", 2.0, None), (4, "s1", False, "again", 3.0, 4.0),
          (5, "s2", False, " ", 4.0, 5.0), (6, None, False, "who", 5.0, None)]
    df = spark.createDataFrame([("x", *w) for w in ws], "session string, pos long, speaker_id string, is_event boolean, text string, start double, end double")
    for n in (None, 100):
        got = [(r["text"], r["is_audio_event"], r["speaker_id"], r["start"], r["end"]) for r in turns.turns(df, splits=n).orderBy("first_pos").collect()]
        assert got == [("hello there", False, "s1", 0.0, 2.0), ("(noise)", True, None, 2.0, 2.0), ("again", False, "s1", 3.0, 4.0), ("who", False, None, 5.0, 5.0)]
    order = {r["speaker"]: r["speaker_label"] for r in turns.speaker_order(df).collect()}
    assert order == {"s1": "Speaker 1", "s2": "Speaker 2", turns.NO_SPEAKER: "Speaker 3"}


def test_overlap_against_brute_force(spark):
    rng = random.Random(5)
    spans = [(rng.choice("pq"), rng.choice(["male", "female", "noise"]), s, s + rng.choice([0, 1, 5])) for s in [rng.randint(0, 40) / 2 for _ in range(60)]]
    asks = [(rng.choice("pqr"), i, s, s + rng.randint(0, 8)) for i, s in enumerate(rng.randint(0, 40) / 2 for _ in range(40))]
    a = spark.createDataFrame([(k, i, float(s), float(e)) for k, i, s, e in asks], "session string, query_id long, start double, end double")
    b = spark.createDataFrame([(k, lb, float(s), float(e)) for k, lb, s, e in spans], "session string, label string, start double, end double")
    want = {i: tuple(sum(max(0.0, min(e, e2) - max(s, s2)) for k2, lb2, s2, e2 in spans if k2 == k and lb2 == lb) for lb in ("male", "female")) for k, i, s, e in asks}
    for n in (None, 64):
        got = intervals.majority_label(intervals.interval_overlap(a, b, ["male", "female"], splits=n)).collect()
        assert {r["query_id"]: (r["male"], r["female"]) for r in got} == want  # halves of seconds are exact
        assert all(r["label"] == ("unknown" if max(want[r["query_id"]]) == 0 else "male" if want[r["query_id"]][0] >= want[r["query_id"]][1] else "female") for r in got)


# --- utterances --------------------------------------------------------------

def _loop(data, gate):
    out, states = [], {}
    for s, q, lv, sec in sorted(data):
        done = states.setdefault(s, GateState()).push(gate, q, lv, sec)
        if done:
            out.append((s, *done))
    return sorted(out)


@pytest.mark.parametrize("gate", [Gate(), SIGN_GATE, Gate(end_seconds=None), Gate(end_frames=None, reset_seconds=True)])
def test_utterances_equal_the_plain_loop(spark, gate):
    rng = random.Random(11)
    lo, hi = gate.keep_level, gate.start_level
    data, level = [], 0.0
    for i in range(1500):
        if rng.random() < 0.15:
            level = rng.choice([0.0, 0.0, lo * 0.9, (lo + hi) / 2, hi * 1.5])
        data.append(("hot" if i % 4 else "cold", i, level, rng.choice([0.1, 0.25])))
    df = spark.createDataFrame(data, "session string, seq long, level double, seconds double")
    want = _loop(data, gate)
    assert len(want) > 5
    for n in (None, 50):
        assert sorted(tuple(r) for r in utterances(df, gate, splits=n).collect()) == want


def test_stream_equals_batch_over_many_micro_batches(spark, tmp_path):
    rng = random.Random(3)
    data = [(rng.choice("ab"), i, rng.choice([0.0, 0.0, 0.001]), 0.2) for i in range(300)]
    schema = "session string, seq long, level double, seconds double"
    for k in range(3):  # later files hold later chunks; the last one repeats old rows, which must not count twice
        part = data[k * 100:(k + 1) * 100] + (data[:50] if k == 2 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = live.chunk_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    got = live.drain(live.utterance_stream(s), str(tmp_path / "work"))
    assert sorted(tuple(r) for r in got.collect()) == _loop(data, Gate())


def test_stream_keeps_rows_that_come_late(spark, tmp_path):
    schema = "session string, seq long, text string"
    for part in ([7, 8], [1, 2, 3], [4, 5, 6]):  # files out of order, one a micro-batch
        spark.createDataFrame([("s", i, f"t{i}") for i in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = live.chunk_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    got = live.drain(live.history_stream(s, "text"), str(tmp_path / "work")).collect()
    assert sorted(r["seq"] for r in got) == list(range(1, 9)) and sorted(r["utterance"] for r in got) == list(range(1, 9))


def test_payload_decoding(spark):
    samples = np.array([0.5, -0.25], dtype="<f4")
    df = spark.createDataFrame([(bytearray(samples.tobytes() + b"\x00"),)], "p binary")
    assert list(df.select(live.float_samples("p")).first()[0]) == [0.5, -0.25]
    text = df.select(F.base64("p").alias("p"))
    assert bytes(text.select(live.payload_bytes(F.col("p"), F.lit(True))).first()[0]) == samples.tobytes() + b"\x00"


# --- signals -----------------------------------------------------------------

def test_levels_of_a_sine(spark):
    t = np.arange(1600) / 16000
    wave = (0.5 * np.sin(2 * np.pi * 440 * t)).tolist()
    df = spark.createDataFrame([(1, wave), (2, []), (3, [0.0] * 8), (4, [0.1, -0.2, 0.15])], "i int, s array<double>").orderBy("i")
    got = df.select(S.rms(F.col("s")).alias("r"), S.normalize_loudness(F.col("s")).alias("n"), S.voice_gate(F.col("s")).alias("v"),
                    S.peak_limit(F.col("s"), -20.0).alias("p"), S.trim_silence(F.col("s"), 16000).alias("t")).collect()
    assert got[0]["r"] == pytest.approx(0.5 / np.sqrt(2), rel=1e-2)
    assert np.sqrt(np.mean(np.square(got[0]["n"]))) == pytest.approx(0.1)
    assert got[1]["n"] == [] and not got[1]["v"] and got[2]["n"] == [0.0] * 8 and got[1]["t"] == []
    assert max(map(abs, got[3]["p"])) == pytest.approx(0.1)


def test_trim_bounds_equal_convolution():
    rng = np.random.default_rng(2)
    for n in (5, 40, 333):
        x = rng.normal(size=n) * np.exp(-np.square(np.linspace(-4, 4, n)))
        win = min(int(0.02 * 1000), max(1, n // 4))
        energy = np.convolve(x**2, np.ones(win) / win, mode="same")
        loud = np.flatnonzero(energy >= energy.max() * 10 ** (-2.5) * (1 - 1e-12))
        assert S.trim_bounds(x, 1000, 25.0) == (loud[0], loud[-1] + 1)


def test_denoise_removes_the_profile(spark):
    rng = np.random.default_rng(1)
    hum = (0.1 * np.sin(2 * np.pi * 0.05 * np.arange(4096)) + 0.001 * rng.normal(size=4096)).tolist()
    clips = spark.createDataFrame([("a", hum), ("b", hum)], "session string, samples array<double>")
    prof = audio.profile_arrays(audio.noise_profile(clips.filter("session = 'a'")))
    assert len(prof.first()["profile"]) == 257
    out = {r["session"]: np.asarray(r["samples"]) for r in audio.denoise(clips, prof).collect()}
    assert np.abs(out["a"][512:3500]).max() < 0.02 and out["b"].tolist() == hum
    short = audio.noise_profile(spark.createDataFrame([("c", [0.1] * 10)], "session string, samples array<double>"))
    assert short.count() == 257 and short.agg(F.sum("magnitude")).first()[0] == 0.0


# --- gates -------------------------------------------------------------------

def test_gates(spark):
    m = spark.createDataFrame([(0.5, 9.0)], "bleu double, chrf double")
    assert {r["metric"]: r["ok"] for r in gates.quality_gate(m).collect()} == {"bleu": False, "chrf": True, "exact_match_accuracy": True}
    for n, verdict in ((0, "pass"), (2, "warn"), (3, "fail")):
        assert gates.bias_gate(spark.range(n)).first()["verdict"] == verdict
    best = spark.createDataFrame([(None, None), (True, 0.9), (False, 0.99), (True, 0.95)], "meets_target boolean, glossary double")
    assert [r["ok"] for r in gates.search_gate(best).collect()] == [True, False, False, True]
    assert gates.rollback_gate(gates.long_metrics(m), None).first()["ok"]
    base = spark.createDataFrame([("bleu", 1.0), ("chrf", 9.0)], "metric string, value double")
    assert gates.rollback_gate(gates.long_metrics(m), base).first().asDict() == {"regressed": 1, "ok": False}
    assert gates.rollback_gate(gates.long_metrics(m), base, 0.5).first()["ok"]
