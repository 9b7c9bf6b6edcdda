"""Sharding, run detection and ranked search against plain versions, with nulls, ties, repeats and empty tables."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute_new as plain
from parley.llm import dom_content, periodic, queries, ranked, sharding

SCHEMA = "doc_id long, text string, shard string, slot string, runs string, score string, rank string, _row long"
WORDS = ["a", "B", "über", "x1", "don't", "東京", "end.", "-", "Ab_cd"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 90))) for _ in range(120)]
    texts += [" ".join(rng.choices(WORDS, k=rng.randint(2, 6)) * rng.randint(3, 30)) for _ in range(30)]
    texts += [None, "", " \n\t ", "a", "a " * 4000, " ", "a\x0bb\x0cc\r\nd", " ".join(rng.choices(WORDS, k=3000))]
    out = [(i * 7 - 40, t) for i, t in enumerate(texts)]
    return out + [out[0], out[0], out[1], (None, texts[2]), (None, None), (0, "twice under one id"), (0, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "s", "r", "x", "y", 1) for i, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 300])
def test_jump_is_the_published_one(spark, shards):
    rng = random.Random(shards)
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *(rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(200))]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump(F.col("k"), shards).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: plain.jump(k, shards) for k in keys}


def test_shards(docs, rows):
    got = sharding.sharded(docs, 16).collect()
    data = [(i, (t or "").encode()) for i, t in rows]
    want = Counter((i, len(d) + 1, zlib.crc32(d), plain.jump(i or 0, 16), plain.jump(i or 0, 17)) for i, d in data)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for s in range(16):
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in mine]
        assert order == sorted(order)
    assert all(r.law == "key" and r.grown_shard in (r.shard, 16) for r in got)
    assert not sharding.sharded(docs.limit(0)).count()


def test_one_frequent_key_is_numbered_in_runs(spark):
    many = spark.range(20000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    got = sharding.sharded(many.union(spark.createDataFrame([(1, "x")], "doc_id long, text string")))
    assert got.filter("doc_id = 5").agg(F.countDistinct("slot"), F.max("slot") - F.min("slot")).first() == (20000, 19999)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_shards_as_files_and_moves(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 4, files=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.shard) for r in back.collect()) == Counter((r.doc_id, r.text, plain.jump(r.doc_id or 0, 4)) for r in docs.collect())
    moved = sharding.moved(docs, 4, 6).collect()
    assert moved and all(r.to_shard in (4, 5) and r.from_shard == plain.jump(r.doc_id or 0, 4) for r in moved)


def test_runs_of_the_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in queries.op12(spark, str(tmp_path)).collect())
    assert got == Counter((i, *plain.run_row(plain.with_periods(i, t))) for i, t in rows)


def test_runs_and_what_is_left(docs, rows):
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(docs).collect())
    want = Counter()
    for i, t in rows:
        w = plain.words(t)
        found = plain.runs(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        want[i, len(w), tuple(found), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert got == want
    assert not periodic.periodic_runs(docs.limit(0)).count()


@pytest.mark.parametrize("collide", [False, True])
def test_runs_in_many_small_alphabets(monkeypatch, collide):
    if collide:  # every prefix hash the same: only the comparison word by word is left
        monkeypatch.setattr(periodic, "prefix_hash", lambda x: np.zeros(len(x) + 1, np.uint64))
    rng = random.Random(8)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(0, 60))]
            texts.append(w + w[-rng.randint(1, 30):] * rng.randint(0, 4))
        first = np.r_[0, np.cumsum([len(w) for w in texts])]
        code = np.array([i * 100 + x for i, w in enumerate(texts) for x in w], np.int64)
        least = rng.choice([2, 5, 12])
        got = periodic.runs(np.unique(code, return_inverse=True)[1].astype(np.int64), first, least).T.tolist()
        want = [[s + first[i], s + n + first[i], q] for i, w in enumerate(texts) for s, n, q in plain.runs(w, least)]
        assert got == sorted(want, key=lambda r: (r[0], r[2]))


def test_grammar_gives_the_text_back():
    rng = random.Random(2)
    w = np.array([rng.randrange(6) for _ in range(3000)], np.int64)
    place, left, size, rule, use, rest = periodic.repair(w, np.array([0, 3000]))
    assert len(place) > 100 and len(rest) < 1500
    for r, at in zip(rule, use, strict=True):
        assert (w[at:at + size[r]] == w[place[r]:place[r] + size[r]]).all() and 0 < left[r] < size[r]


@pytest.mark.parametrize("block, most", [(1 << 22, 4096), (300, 7)])
def test_ranked_search(spark, docs, rows, monkeypatch, block, most):
    monkeypatch.setattr(ranked, "BLOCK", block)
    items = [(1, "ab über, x1! x1"), (2, "東京 end don"), (3, None), (4, "nothing-known"), (5, "a b t cd"), (5, "a"), (None, "B")]
    table = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, rank string")
    got = Counter(tuple(r) for r in ranked.ranked(docs, table, top=9, most=most).select("item_id", "rank", "doc_id", "score").collect())
    assert got == Counter(plain.ranked(rows, items, 9))
    assert not ranked.ranked(docs.limit(0), table).count() and not ranked.ranked(docs, table.limit(0)).count()


def test_few_slices_are_scored_when_the_floor_is_high(spark):
    """Bounds leave out slices that cannot reach the floor, and the rows stay those of the plain version."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["common", "often", "some"], k=rng.randint(5, 400)))) for i in range(2000)]
    rows += [(5000 + i, "rare common word") for i in range(80)]
    items = [(0, "rare"), (1, "common rare"), (2, "often some")]
    got = ranked.ranked(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), top=10, most=64)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain.ranked(rows, items, 10))


@pytest.mark.parametrize("page", ['<a "' * 100_000, "<div>x" * 3_000, "<b>" * 50_000 + "<li>" * 3_000, "<div>" * 3_000 + "</b>" * 100_000, "</" * 200_000, "<textarea>" * 50_000,
                                  "<a '\">" * 30_000, "<!--" * 100_000, "<" * 500_000])
def test_hostile_pages_are_read_in_linear_time(page):
    start = time.process_time()
    dom_content.Page(page)
    assert time.process_time() - start < 2


def test_pages_with_nulls_repeats_and_broken_quotes(spark):
    rows = [(1, "u", "<article><p>One two three.</p></article>", "x"), (1, "u", "<article><p>One two three.</p></article>", "x"), (None, None, None, None), (2, None, "", "y"),
            (3, "v", '<article><p>kept</p><a href="never ends><p>after</p></article>', "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text) for r in dom_content.extracted(df).collect()))
    assert got == [(0, ""), (1, "One two three."), (1, "One two three."), (2, ""), (3, "kept after")]
