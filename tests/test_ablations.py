"""Ablations: a left-out word costs what changes, whatever the model answers."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.functions import metrics as M
from parley.operators import predict, scoring

WORDS = ["a", "b", "a.", "b,c", "<skipped>", "&quot;x", "d-1", "3-4", "e", "ÉÈ", "ß", "a.b.c.d.e.f", ".", "ΑΣ"]


def _plain(hyp: list[str], ref: list[str]) -> list[int]:
    grams = lambda t, n: Counter(zip(*(t[i:] for i in range(n))))
    return [sum((grams(hyp, n) & grams(ref, n)).values()) for n in range(1, 5)] + [len(hyp), len(ref)]


@pytest.mark.parametrize("at_once", [5, 60, M.WORDS])
def test_left_out_words_of_many_texts(monkeypatch, at_once):
    rng = random.Random(at_once)
    monkeypatch.setattr(M, "WORDS", at_once)
    some = lambda k: rng.choices(WORDS[:rng.choice([2, 5, len(WORDS)])], k=rng.randrange(k))
    texts = [None if i % 17 == 0 else some(14) for i in range(300)]
    refs = [None if i % 13 == 0 else " ".join(some(14)) for i in range(300)]
    batch = pa.array([["x"], *texts], pa.list_(pa.string())).slice(1), pa.array(["x", *refs]).slice(1)
    got = [r for a in M._left_out.func(iter([batch])) for r in a.to_pylist()]
    for t, r, row in zip(texts, refs, got, strict=True):
        assert row == [{"removed_index": i, "stats": _plain(M.tokens_of(" ".join(t[:i] + t[i + 1:])), M.tokens_of(r or ""))} for i in range(len(t or []))]


def test_left_out_words_are_counted_together(monkeypatch):
    """Sorts of whole arrays, some for each order: not some for each word."""
    calls = []
    monkeypatch.setattr(np, "unique", lambda *a, plain=np.unique, **k: (calls.append(1), plain(*a, **k))[1])
    texts = [[f"w{(i * k) % 40}" for i in range(50)] for k in range(1, 101)]
    got = [r for a in M._left_out.func(iter([(pa.array(texts), pa.array([" ".join(t) for t in texts]))])) for r in a]
    assert len(got) == 100 and 0 < len(calls) <= 8


SOURCES = [
    "a B a B c", "  A b \n c  ", "one", "", None, "É ß ΑΣ a.b, é", "ΑΣ ΑΣ", "x" * 300 + " y " + "z" * 300, "a " * 40 + "b", "3-4 , 5 . <skipped> -",
]
MODELS = {
    "word by word": lambda c: F.lower(c),
    "other spaces": lambda c: F.concat(F.lit(" "), F.lower(c), F.lit("\n ")),
    "turned round": lambda c: F.array_join(F.reverse(F.split(c, " ")), " "),
    "by length": lambda c: F.concat_ws(" ", F.length(c).cast("string"), F.upper(c)),
    "one word more or less": lambda c: F.when(F.length(c) % 2 == 0, F.concat(c, F.lit(" and"))).otherwise(F.regexp_replace(c, r"\S+$", "")),
    "nothing": lambda c: F.when(F.length(c) % 3 > 0, c),
}


@pytest.mark.parametrize(("metric", "most"), [("bleu", None), ("chrf", 2)])
def test_an_ablation_scores_what_the_model_answers(spark, metric, most):
    """Every answer has the score of that answer, whether or not it is the full one without a word."""
    rows = [(m, i, s, r) for m in range(len(MODELS)) for i, s in enumerate(SOURCES) for r in ("a b a b c", s, None)]
    answers = F.coalesce(*[F.when(F.col("m") == m, model(F.col("_s"))) for m, model in enumerate(MODELS.values())])
    answer = lambda d, src, out: d.withColumn("_s", F.col(src)).withColumn(out, answers).drop("_s")
    df = spark.createDataFrame(rows, "m int, id int, src string, ref string").coalesce(1)
    got = predict.ablation_delta(df, ["m", "id", "ref"], answer, "src", "ref", most, metric).collect()
    texts = [(m, i, r, s, k, w, " ".join(ws[:k] + ws[k + 1:]))
             for m, i, s, r in rows for ws in [(s or "").split()] if len(ws) > 1 for k, w in enumerate(ws[:most])]
    made = spark.createDataFrame(texts, "m int, id int, ref string, src string, k int, w string, ablated string").coalesce(1)
    score, name = (scoring.sentence_bleu, "sentence_bleu") if metric == "bleu" else (scoring.sentence_chrf, "sentence_chrf")
    full = score(answer(made, "src", "_h"), "ref", "_h").withColumnRenamed(name, "full").drop("_h")
    want = score(answer(full, "ablated", "_h"), "ref", "_h").select("m", "id", "ref", "k", "w", "full", F.col("full") - F.col(name)).collect()
    order = lambda r: (r[0], r[1], r[2] is None, r[2] or "", r[3])
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, want), key=order)


def test_answers_of_a_word_by_word_model_are_not_sent_to_be_counted(spark, monkeypatch):
    """The answers are seen whole but only those that are not the full one without a word are counted one by one."""
    df = spark.createDataFrame([(1, "A b C d"), (2, "ΑΣ x ΑΣ")], "id int, src string").coalesce(1).withColumn("ref", F.lower("src"))
    sent = []
    plain = M._some_overlaps
    monkeypatch.setattr(M, "_some_overlaps", lambda hyp, ref: (sent.append(hyp), plain(hyp, ref))[1])
    each = {}
    kept = predict.sentence_bleu
    monkeypatch.setattr(predict, "sentence_bleu", lambda df, *a: (each.update(df=df, known=a[2]) if len(a) > 2 else None, kept(df, *a))[1])
    lower = lambda d, src, out: d.withColumn(out, F.lower(src))
    assert predict.ablation_delta(df, ["id"], lower, "src", "ref").count() == 7
    assert len(sent) == 1
    assert each["df"].filter(each["known"].isNull()).count() == 0


def test_texts_without_a_word_are_cut_by_bytes(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SOURCES)], "id int, src string").coalesce(1)
    for most in (None, 3):
        got = {(r.id, r.removed_index): (r.removed_word, r.ablated) for r in predict.leave_one_out(df, "src", most).collect()}
        assert got == {(i, k): (w, " ".join(ws[:k] + ws[k + 1:])) for i, s in enumerate(SOURCES) for ws in [(s or "").split()] if len(ws) > 1 for k, w in enumerate(ws[:most])}
