"""Every operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from parley.llm import bpe, dom_content, mil, near_dup, nn_descent, packing, pitman_yor, repeats, rules, warc

FILE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rest string, score string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = [" ".join(rng.choices(words, k=rng.randint(30, 160))) for _ in range(30)]
    near = [p + " " + rng.choice(words) for p in prose[:8]]
    odd = [None, "", " \n\t ", "A b", "x " * 3000, "<|endoftext|> aaaa 'll  b", " ".join(rng.choices(words, k=9000))]
    return prose + near + odd + prose[:3]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None, "r", "s") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def crc(i, n):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == n


def test_bpe_equals_library(docs):
    tok = Tokenizer.from_file(FILE)
    v = bpe.Vocabulary.read(FILE)
    rows = {(r.doc_id, r.text): tuple(r.ids) for r in bpe.decode(bpe.encode(docs, v), v).collect()}
    assert rows == {(r.doc_id, r.text): tuple(r.ids) for r in bpe.round_trip(docs, v).collect()}
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert rows[r.doc_id, tok.decode(ids, skip_special_tokens=False)] == tuple(ids)


def test_packing_is_gapless_and_near_the_bound(docs):
    tok = Tokenizer.from_file(FILE)
    want = sorted(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    rows = packing.packed(docs, FILE).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sum(r.length for r in rows) == sum(want)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= -(-sum(want) // 1024) + 1
    ids = np.array([*tok.encode(docs.filter("doc_id = 1").first().text, add_special_tokens=False).ids, 2], "<u4")
    one = sorted(by_doc[1], key=lambda r: r.piece)
    assert [r.ids_crc32 for r in one] == [zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in one]


def one_by_one(lengths, capacity):
    """Number of sequences of best fit decreasing, piece by piece."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        room = min(fits) if fits else capacity
        if fits:
            rooms.remove(room)
        rooms.append(room - length)
    return len(rooms)


def taken(configs, size):
    out = np.zeros(size, np.int64)
    for config, n in configs:
        assert n > 0 and sum(k * often for k, often in config.items()) < size
        for length, often in config.items():
            out[length] += often * n
    return out


def test_best_fit_by_groups_equals_piece_by_piece():
    for seed in range(30):
        rng = random.Random(seed)
        counts = np.zeros(65, np.int64)
        for _ in range(rng.randrange(1, 20)):
            counts[rng.randrange(1, 65)] = rng.choice([1, 2, 7, 40])
        got = packing.best_fit(counts, 64)
        assert (taken(got, 65) == counts).all()
        assert sum(n for _, n in got) == one_by_one(np.repeat(np.arange(65), counts).tolist(), 64)


def test_program_covers_a_broad_histogram():
    """Half a million pieces of log-normal length: the program places nearly all, and the plan does not grow with the pieces."""
    lengths = np.random.default_rng(1).lognormal(np.log(200), 1, 530_000).round().astype(int)
    counts = np.bincount(lengths[(lengths > 0) & (lengths < 1024)], minlength=1025)
    got = packing.plan(counts, 1024)
    assert (taken(got, 1025) == counts).all() and len(got) < 4 * 1024
    assert sum(n for _, n in got) <= -(-int((counts * np.arange(1025)).sum()) // 1024) + 5
    assert not packing.plan(np.zeros(1025, np.int64), 1024)


def test_repeats_equal_brute_force(docs):
    rows = docs.collect()
    want = sorted(map(str, zip([r.doc_id for r in rows], brute.without_repeats([r.text for r in rows], 60))))
    got = repeats.without_repeats(docs, 60, 20).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("rest", 256)).collect()
    assert sorted(str((r[0], tuple(r[1:]))) for r in got) == want


def test_near_duplicates_equal_brute_force(docs):
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    sets = {}
    for r in rows:
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    got = near_dup.near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(i, len(s), label[i], label[i] == i) for i, s in sets.items()}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert near_dup.one_of_each(docs).columns == docs.columns


def test_blocks_of_a_cluster_lose_no_link(docs):
    whole = near_dup.near_duplicates(docs)
    cut = near_dup.near_duplicates(docs, near_dup.Join(block=2, leaf=2, levels=2))
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0


def test_rules_keep_and_reject(docs):
    rows = rules.judged(docs).collect()
    assert len(rows) == docs.count() and not any(r.kept for r in rows if r.n_words < 10)
    assert rules.accepted(docs).count() == sum(r.kept for r in rows)


def test_host_of_failures_is_rejected(spark):
    rows = [(i, "a b", "bad") for i in range(40)] + [(99, " ".join(f"w{k}" for k in range(50)), "bad")] + [(100 + i, " ".join(f"v{i}x{k}" for k in range(50)), "good") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in rules.judged(d).filter("kept").collect()} == {100 + i for i in range(40)}


def test_half_bad_host_stands_out_and_noise_does_not(spark):
    """A host with three of ten texts full of symbols falls; small hosts with one such text by chance stay."""
    good, odd = (lambda i: " ".join(f"v{i}x{k}" for k in range(50))), (lambda i: good(i).replace(" ", "# "))
    rows = [(i, odd(i) if i % 25 == 0 else good(i), f"h{i % 50}") for i in range(500)]
    rows += [(1000 + i, odd(i) if i % 10 < 3 else good(i), "spam") for i in range(100)] + [(2000, good(0), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rules.judged(d).collect()
    assert not any(r.base_failed for r in got)
    assert {r.host for r in got if not r.kept} == {"spam", "h0", "h25"}
    even = d.filter("source <> 'spam'").withColumn("source", F.concat(F.lit("h"), F.floor(F.col("doc_id") / 10).cast("string")))
    assert rules.judged(even).filter("kept").count() == 500  # one of ten at most, spread no wider than noise
    rates = {r.host: r for r in rules.host_rates(rules.measures(d).withColumn("base_failed", F.lit(False))).filter("rule = 'symbols'").collect()}
    assert rates["spam"].failed == 30 and 0.2 < rates["spam"].rate < 0.31 and rates["h0"].failed == 10


def test_pitman_yor_counts_and_gain(docs):
    rows = docs.select("doc_id", "text").collect()
    words = lambda t: [*split(t or ""), "\n"]
    count = {}
    for r in rows:
        if not crc(r.doc_id, 1):
            for w in words(r.text):
                if w.isascii():
                    w = w.lower()
                count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    got = pitman_yor.scored(docs).collect()
    assert {r.train_tokens for r in got} == {total} and all(r.held_out == crc(r.doc_id, 1) for r in got)
    one = next(r for r in got if r.doc_id == 2)
    text = words(next(r.text for r in rows if r.doc_id == 2))
    base = sum(np.log10((count.get(w, 0) + 0.5) / (total + 0.5 * (len(count) + 1))) for w in text)
    assert one.n_tokens == len(text) and abs(one.base_score - base) < 1e-6
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)


def test_pitman_yor_tells_whole_words_apart(spark):
    # 'cat' and 'hat', and the two Greek words, end alike; only the word itself tells what follows
    rows = [(i, t) for i in range(0, 400, 4) if not crc(i, 1) for t in ("cat red", "hat blue", "\u03b1\u03c1\u03b1 red", "\u03b2\u03c1\u03b1 blue")]
    asked = [i for i in range(1000, 1100) if crc(i, 1)][:4]
    rows += list(zip(asked, ("cat red", "cat blue", "\u03b1\u03c1\u03b1 red", "\u03b1\u03c1\u03b1 blue"), strict=True))
    got = {r.doc_id: r.score for r in pitman_yor.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[asked[0]] > got[asked[1]] + 0.5 and got[asked[2]] > got[asked[3]] + 0.5


def test_quality_learns_from_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = mil.scored(d, labels).join(labels, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_page_text():
    page = """<html><body><nav><a href=x>Home</a></nav><div class="cookie-notice"><p>We use cookies. Accept all.</p></div><article><h1>T</h1>
      <p>Long &amp; good text. It has<br>two sentences.<p>More <b>bo</b>ld text is here.</p><div class=comments><p>I like it. Really.</p></div></article><form>Mail</form></body></html>"""
    trees = [dom_content.Page(page), dom_content.Page("")]
    forest = dom_content.Forest(trees)
    p, _ = forest.marginals(dom_content.Weights())
    texts = [dom_content.main_text(t, p[a:b]) for t, a, b in zip(trees, forest.first[:-1], forest.first[1:])]
    assert texts == ["T Long & good text. It has two sentences. More bold text is here.", ""]


def test_marginals_equal_enumeration():
    tree = dom_content.Page("<div><p>a text. b</p><div class=ad>x</div></div>")
    forest, w = dom_content.Forest([tree]), dom_content.Weights()
    n = len(tree.parent)
    total = np.zeros(n)
    z = 0.0
    for code in range(2**n):
        y = np.array([code >> i & 1 for i in range(n)])
        e = np.exp((forest.x @ w.unary * y).sum() + sum(w.edge[forest.edge[i]] * (y[i] == y[forest.parent[i]]) for i in range(1, n)))
        z, total = z + e, total + e * y
    assert np.allclose(forest.marginals(w)[0], total / z)


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(120, 8)).astype(np.float32)
    m[50:60] = m[40]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] * 8), (7, m[7].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nn_descent.neighbours(d, lambda i: i % 20 == 0, 10).collect()
    s = m.astype(float) @ m.T.astype(float)
    for q in range(0, 120, 20):
        want = sorted((j for j in range(120) if j != q), key=lambda j: (-s[q, j], j))[:10]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want
    assert len(got) == 60


def test_warc_round_trip_and_salvage(spark):
    rows = [(1, "u\n1", "<p>é"), (2, None, "<p>é"), (3, "u3", None), (4, "u4", ""), (None, "u5", "<p>é"), (9, "u9", "z" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records, gaps = warc.read_archives(warc.write_archives(warc.verdicts(pages)))
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_records(records).collect()}
    assert got == {(1, 5, "revisit", 2), (2, 5, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 5, "revisit", 2), (9, 200_000, "response", None)}
    assert gaps.count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, pos):
        return self.data[pos:pos + n]


def test_salvage_goes_on_after_damage():
    import gzip
    plain = [warc.record(i, None, b"payload %d" % i, warc._digest(b"payload %d" % i), "response", None) for i in range(6)]
    for wrap in (gzip.compress, bytes):
        parts = [wrap(p) for p in plain]
        bad = bytearray(parts[2])
        bad[len(bad) // 2] ^= 0xFF
        data = b"".join(parts[:2]) + bytes(bad) + parts[3] + b"junk" + parts[4] + parts[5][:-9]
        found = list(warc.salvage(Bytes(data), len(data)))
        assert [f[4] for f in found if f[0] == "record"] == [b"payload %d" % i for i in (0, 1, 3, 4)]
        spans = [(f[1], f[2]) for f in found]
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    v = bpe.Vocabulary.read(FILE)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (packing.packed(none, FILE), pitman_yor.scored(none), rules.judged(none), bpe.decode(bpe.encode(none, v), v), mil.scored(none, labels),
               dom_content.extracted(pages), warc.page_records(warc.read_archives(warc.write_archives(warc.verdicts(pages)))[0]),
               repeats.without_repeats(none), near_dup.near_duplicates(none),
               nn_descent.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 20 == 0)):
        assert df.count() == 0


def test_pipeline_stages_keep_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.kept(stage(spark, kept, folder))
        assert after.columns == docs.columns and 0 < after.count() <= kept.count()
        kept = after
    good = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1")
    first = corpus_pipeline.quality(spark, docs, folder)
    assert docs.join(good, "doc_id").join(first, "doc_id", "left_anti").count() <= 1
