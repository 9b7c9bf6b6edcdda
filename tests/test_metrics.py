"""Text metrics on cases worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parley.functions import metrics as M
from parley.operators import classes, fairness, glossary, predict, scoring


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, ref string, hyp string")


def test_bleu_by_hand(spark):
    # 5 hypothesis tokens, 6 reference tokens; matches 4, 2, 1, 0 of 5, 4, 3, 2
    df = frame(spark, [("the cat sat on the mat", "the cat the cat sat")])
    got = scoring.corpus_bleu(df).first()
    assert [got[f"bleu_m{n}"] for n in range(1, 5)] == [4, 2, 1, 0]
    assert [got[f"bleu_t{n}"] for n in range(1, 5)] == [5, 4, 3, 2]
    p = [100 * 4 / 5, 100 * 2 / 4, 100 / 3, 100 / (2 * 2)]
    want = math.exp(1 - 6 / 5) * math.exp(sum(map(math.log, p)) / 4)
    assert got["bleu"] == pytest.approx(want)


def test_bleu_is_not_a_mean_of_rows(spark):
    df = frame(spark, [("a b c d e", "a b c d e"), ("v w x y z", "p q r s t")])
    corpus = scoring.corpus_bleu(df).first()["bleu"]
    p = [50.0, 50.0, 50.0, 50.0]
    assert corpus == pytest.approx(math.exp(sum(map(math.log, p)) / 4))


def test_sentence_bleu_uses_the_orders_there_are(spark):
    df = frame(spark, [("yes sir", "yes sir"), ("yes", "no"), ("", "no"), ("yes", "")])
    got = [r["sentence_bleu"] for r in scoring.sentence_bleu(df).orderBy("id").collect()]
    assert got == pytest.approx([100.0, 0.0, 0.0, 0.0])


def test_corpus_bleu_of_nothing(spark):
    assert scoring.corpus_bleu(frame(spark, [("x", "x")]).filter("false")).first()["bleu"] == 0.0


def test_tokens_13a(spark):
    df = spark.createDataFrame([('He said: "1,000 &amp; 2.5-3" end.',)], "t string")
    assert df.select(M.tokens_13a(F.col("t"))).first()[0] == 'He said : " 1,000 & 2.5 - 3 " end .'


def test_chrf_by_hand(spark):
    # one pair of two characters: order 1 matches 1 of 2, order 2 matches none
    got = scoring.corpus_chrf(frame(spark, [("a b", "a c")])).first()["chrf"]
    p = r = (0.5 + 0.0) / 2
    assert got == pytest.approx(100 * 5 * p * r / (4 * p + r))
    same = scoring.sentence_chrf(frame(spark, [("abc def", "abcdef"), (" ", "x")])).orderBy("id").collect()
    assert [s["sentence_chrf"] for s in same] == pytest.approx([100.0, 0.0])


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            before, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, before + (x != y))
    return line[-1]


def test_word_edits_against_brute_force(spark):
    long = " ".join(f"w{i % 700}é" for i in range(1500))
    cases = [("the cat sat", "the dog sat down"), ("a b c", "c b"), ("x", "y"), ("", "a b"), ("a a a", "a"), (long, long.replace("w3", "v3"))]
    got = [r[0] for r in frame(spark, cases).orderBy("id").select(M.word_edits(F.col("ref"), F.col("hyp"))).collect()]
    assert got == [edits(r.split(), h.split()) for r, h in cases]


def test_wer_and_its_order_blind_form(spark):
    df = frame(spark, [("a b c", "c b a"), ("", "x y"), ("p q", "p")])
    assert scoring.wer(df).first().asDict() == {"edits": 2 + 2 + 1, "ref_words": 5, "wer": 1.0, "meets_target": False}
    assert scoring.wer_setdiff(df).first()["errors"] == 0 + 2 + 1


def test_exact_match_and_token_f1(spark):
    df = frame(spark, [("a", "A "), ("b", "c")])
    assert scoring.exact_match(df).first()["exact_match"] == 0.5
    assert scoring.exact_match(df.filter("false")).first()["exact_match"] == 0.0
    f1 = [r[0] for r in frame(spark, [("a b", "B c"), ("", ""), ("x", "y")]).orderBy("id").select(M.token_f1(F.col("ref"), F.col("hyp"))).collect()]
    assert f1 == pytest.approx([0.5, 1.0, 0.0])


def test_glossary_shards_agree(spark):
    df = frame(spark, [("The Court is in session", "the court is"), ("start", "art"), ("none here", ""), (None, "court"), ("東京 a", "a 東京")])
    terms = spark.createDataFrame([(t,) for t in ("court", "art", "in", "is in", "", None, "missing term that is long", "in", "東京", "京")], "term string")
    want = {(0, "court", True), (0, "in", False), (0, "is in", False), (1, "art", True), (4, "東京", True), (4, "京", True)}
    for shard in (1 << 20, 6, 1):
        got = glossary.glossary_hits(df, terms, ["id"], shard=shard)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        counts = glossary.glossary_counts(df, terms, shard=shard)
        assert {r.id: (r.terms, r.kept) for r in counts.collect()} == {0: (3, 1), 1: (1, 1), 2: (0, 0), 3: (0, 0), 4: (2, 2)}
        assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert [r.has_term for r in glossary.with_glossary_flag(df, terms).orderBy("id").collect()] == [True, True, False, False, True]
    assert glossary.glossary_enforcement(df, terms).first()["enforcement"] == 0.6667
    assert glossary.glossary_enforcement(df, terms.filter("term = ''")).first()["enforcement"] is None
    assert glossary.glossary_enforcement(df.limit(0), terms).first()["enforcement"] is None


def test_glossary_equals_plain_search(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abé ", k=rng.randint(0, 60))) for _ in range(200)]
    terms = {"".join(rng.choices("abé ", k=rng.randint(1, 8))) for _ in range(300)}
    df = spark.createDataFrame([(i, t, texts[-i]) for i, t in enumerate(texts)], "id long, ref string, hyp string")
    got = glossary.glossary_hits(df, spark.createDataFrame([(t,) for t in terms], "term string"), ["id"], shard=100)
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, t, t in texts[-i]) for i, x in enumerate(texts) for t in terms if t in x)


def test_macro_f1(spark):
    df = spark.createDataFrame([("a", "A "), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    by = {r["cls"]: r["f1"] for r in classes.class_f1(df, "t", "p").collect()}
    assert by == pytest.approx({"a": 0.5, "b": 2 / 3, "c": 0.0})
    assert classes.macro_f1(df, "t", "p").first()["macro_f1"] == pytest.approx((0.5 + 2 / 3) / 3)


def test_group_metrics_and_gaps(spark):
    rows = [("A", "n", "x", "x"), ("A", "h", "x", "wrong"), ("B", "n", "y", "y"), ("B", "h", "y", "y")]
    df = spark.createDataFrame(rows, "dataset string, emotion string, ref string, hyp string")
    groups = fairness.group_metrics(df, ["dataset", "emotion"])
    got = {(r["dataset"], r["emotion"]): r["exact_match"] for r in groups.collect()}
    assert got == {(None, None): 0.75, ("A", "n"): 1.0, ("A", "h"): 0.0, ("B", "n"): 1.0, ("B", "h"): 1.0}
    assert fairness.disparities(groups, threshold=0.01).count() == 4
    assert fairness.disparities(groups, threshold=0.25).count() == 1
    mean = {r["dataset"]: r["exact_match"] for r in fairness.mean_of_groups(groups, "dataset").collect()}
    assert mean == {"A": 0.5, "B": 1.0}
    full = fairness.group_metrics(df.filter("hyp != 'wrong'"), ["dataset", "emotion"], include_empty=True)
    empty = full.filter("not overall and n = 0").collect()
    assert [(r["dataset"], r["emotion"], r["exact_match"]) for r in empty] == [("A", "h", None)]


def test_quartile_edges(spark):
    df = spark.createDataFrame([(v,) for v in (1, 1, 1, 1, 2, 5, 9)], "wc int")
    got = {(r["wc"], r["bucket"]) for r in scoring.quartile_bucket(df, "wc").collect()}
    # quartiles 1, 1, 1, 3.5, 9 merge to the bins [1, 3.5] and (3.5, 9]
    assert got == {(1, "q1"), (2, "q1"), (5, "q2"), (9, "q2")}
    one = spark.createDataFrame([(3,), (3,)], "wc int")
    assert {r["bucket"] for r in scoring.quartile_bucket(one, "wc").collect()} == {"all"}


def test_predictions(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "ok")], "id int, t string")

    def model(batch):
        if (batch["t"] == "bad").any():
            raise RuntimeError("limit")
        return [f" {v}! " for v in batch["t"]]

    got = {r["id"]: r["out"] for r in predict.predict_column(df, model, ["t"], "out").collect()}
    assert got == {1: "ok!", 2: "(error: limit)", 3: "ok!"}
    short = predict.predict_column(df.coalesce(1), lambda b: ["only"], ["t"], "out").collect()
    assert sorted(r["out"] for r in short) == ["", "", "only"]


def test_best_config_takes_the_first_of_a_tie(spark):
    df = spark.createDataFrame([(0, "a", 10.0), (1, "b", 50.0), (2, "c", 50.0)], "ord int, config_id string, score double")
    assert predict.best_config(df).first().asDict() == {"config_id": "b", "score": 50.0, "meets_target": True}


def test_repeats(spark):
    df = spark.createDataFrame([("t1", 1.0), ("t1", 3.0), ("t2", 5.0)], "t string, s double")
    got = {r["t"]: (r["mean"], r["std"]) for r in predict.repeat_stats(df, ["t"], "s").collect()}
    assert got["t1"] == pytest.approx((2.0, math.sqrt(2.0))) and got["t2"] == (5.0, 0.0)


def test_packed_and_plain_character_counts_agree():
    import random
    rng = random.Random(4)
    for size in (0, 1, 3, 7, 200):
        for letters in ("ab", "abcdefgé😀", [chr(200 + i) for i in range(3000)]):
            h, r = ("".join(rng.choice(letters) for _ in range(rng.randint(0, size))) for _ in range(2))
            assert M._clipped_chars(h, r) == [M._clipped(h, r, n) for n in range(1, 7)]
    wide = "".join(chr(200 + i) for i in range(2000))
    assert M._clipped_chars(wide, wide) == [2000 - n for n in range(6)]
