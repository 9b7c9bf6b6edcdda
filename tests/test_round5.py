"""Faults found by the review after the third: each test failed before its mend."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from parley.functions import metrics as M
from parley.llm import pitman_yor
from parley.llm.store import dropped, parted

WORDS = ["a", "b", "c", "a.", "1,0", "x-\ny", "<skipped>", "", "&amp;quot;", "-", "\n", ",", "..", "é", "10-3", " ", "[`{~", "5- 6", "٣", "½", "a\u00a0b"]


def _plain(hyp, ref, orders) -> list[int]:
    return [*(M._clipped(hyp, ref, n) for n in range(1, orders + 1)), len(hyp), len(ref)]


def _grid(words: list[str], join: str, rng: random.Random) -> tuple[list[str], list[str]]:
    """Texts of several answers to one reference: other texts, the reference itself, none, and texts with a change."""
    hyp, ref = [], []
    for _ in range(60):
        r = [rng.choice(words) for _ in range(rng.randrange(30))]
        for h in ([rng.choice(words) for _ in range(rng.randrange(40))], r, [], [w.upper() for w in r], r[1:], r + r, r):
            hyp.append(join.join(h))
            ref.append(join.join(r))
    return hyp, ref


def test_rows_are_counted_as_arrays(monkeypatch):
    """the n-grams of answers that differ are counted for many rows at once, with no counter of a text."""
    rng = random.Random(5)
    plain = M._clipped
    for name in ("_clipped", "_clipped_chars"):
        monkeypatch.setattr(M, name, lambda *a: pytest.fail("a row by itself"))
    monkeypatch.setattr(M.Overlaps, "_whole", lambda *a: pytest.fail("a row by itself"))
    monkeypatch.setattr(M, "CHUNK", 2000)
    hyp, ref = _grid(WORDS, " ", rng)
    got = M._token_overlaps.func(pa.array(hyp), pa.array(ref)).to_pylist()
    letters = ["a", "b", "c", "é", "😀", "ß"]
    hyp_c, ref_c = _grid(letters, "", rng)
    got_c = M._char_overlaps.func(pa.array(hyp_c), pa.array(ref_c)).to_pylist()
    monkeypatch.setattr(M, "_clipped", plain)
    assert got == [_plain(M.tokens_of(h), M.tokens_of(r), 4) for h, r in zip(hyp, ref, strict=True)]
    assert got_c == [_plain(h, r, 6) for h, r in zip(hyp_c, ref_c, strict=True)]
    assert M._token_overlaps.func(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []


def test_any_number_of_different_tokens_is_exact():
    """Numbers of more than 63 bits: rows are halved, a single one goes the plain way."""
    rng = random.Random(6)
    many = [chr(200 + i) for i in range(3000)]
    hyp = ["".join(rng.choices(many, k=n)) for n in (2500, 0, 4000, 30, 1)]
    ref = [h[5:1200] + h[:300] for h in hyp]
    assert M._char_overlaps.func(pa.array(hyp), pa.array(ref)).to_pylist() == [_plain(h, r, 6) for h, r in zip(hyp, ref, strict=True)]


def test_left_out_texts_are_still_counted_by_their_changes(monkeypatch):
    words = [f"w{i % 50}" for i in range(300)]
    texts = [" ".join(words[:i] + words[i + 1:]) for i in range(len(words))]
    monkeypatch.setattr(M, "CHUNK", 1000)  # a chunk holds one text
    whole = []
    monkeypatch.setattr(M.Overlaps, "_whole", lambda self, tokens, plain=M.Overlaps._whole: (whole.append(1), plain(self, tokens)))
    got = M._token_overlaps.func(pa.array(texts), pa.array([" ".join(words)] * len(texts))).to_pylist()
    assert got == [_plain(t.split(), words, 4) for t in texts] and len(whole) == 1


def test_questions_do_not_grow_with_the_square_of_the_buckets():
    """op2_pitman_yor: a bucket asks as many shards whatever the number of buckets, and nothing is lost on the way."""
    rng = np.random.default_rng(1)
    contexts = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    own = np.stack([rng.integers(1, 9, len(contexts)), np.ones(len(contexts), np.int64)])
    for buckets in (1, 36, 633, 2048):
        asked = pitman_yor._questions(7, contexts, own, buckets)
        assert len(asked) <= 64 and {a["bucket"] for a in asked} == {7} and [a["shard"] for a in asked] == sorted({a["shard"] for a in asked})
        assert (np.concatenate([pitman_yor._unrising(a["contexts"]) for a in asked]) == contexts).all()
        assert (pitman_yor._rejoined([a["values"] for a in asked], 2) == own).all()


def test_pairs_are_put_in_order_as_numbers():
    rng = np.random.default_rng(2)
    few = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 2, 5000):
        word, context = few[rng.integers(0, 40, n)], few[rng.integers(0, 40, n)]
        order, new = pitman_yor._in_order(word, context)
        assert (order == np.lexsort((context, word))).all()
        assert list(zip(word[order[new]], context[order[new]], strict=True)) == sorted(set(zip(word, context, strict=True)))


def test_one_pass_makes_a_table_of_each_value(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "x int, k int")
    one, none, two = parted(df, "parts", "k", (0, 7, 2))
    assert sorted(r.x for r in one.collect()) == [0, 3, 6, 9] and none.collect() == [] and two.columns == ["x"]
    both = one.union(two)
    folders = {f.rsplit("/", 1)[0].removeprefix("file://") for f in both.inputFiles()}
    dropped(both, none)
    assert len(folders) == 2 and not any(map(os.path.exists, folders))
