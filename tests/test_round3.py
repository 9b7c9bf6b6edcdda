"""Edit distance, selection, publishing, digest keys and the ledger of model calls."""

import glob
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import metrics as M
from parley.operators import predict, scoring
from parley.operators.ledger import Ledger
from parley.operators.ordered import keep_first
from parley.operators.selection import order_statistics, quantiles
from parley.sources import tables
from test_metrics import edits


def test_edit_counts_and_kinds():
    rng = random.Random(1)
    for _ in range(2000):
        r, h = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        changed, gone, new = M.split_edits(r, h)
        assert changed + gone + new == edits(r, h) == M._columns(*M._inner(r, h), False)[0]
        assert gone - new == len(r) - len(h)
    assert M.split_edits("the cat sat".split(), "the dog sat down".split()) == (1, 0, 1)


def test_any_number_of_different_words(spark):
    word = lambda a, b: f"array_join(transform(sequence({a}, {b}), i -> 'w' || i), ' ')"
    df = spark.range(1).selectExpr(f"inline(array(struct(1 AS id, {word(0, 1_199_999)} AS ref, 'w5 w7 x w9' AS hyp), struct(2 AS id, {word(0, 1_199_999)} AS ref, "
                                   f"concat_ws(' ', {word(0, 599_999)}, 'new', {word(600_002, 1_199_999)}) AS hyp), struct(3 AS id, null AS ref, 'a b' AS hyp), struct(4 AS id, '' AS ref, null AS hyp)))")
    got = [tuple(r.e) for r in df.select("id", M.word_edit_parts(F.col("ref"), F.col("hyp")).alias("e")).orderBy("id").collect()]
    assert got == [(1, 1_199_996, 0), (1, 1, 0), (0, 0, 2), (0, 0, 0)]
    assert [r.e for r in df.select("id", M.word_edits(F.col("ref"), F.col("hyp")).alias("e")).orderBy("id").collect()] == [1_199_997, 2, 2, 0]


def test_quantiles_by_counting(spark):
    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 50, 1000), rng.integers(-(1 << 62), 1 << 62, 500), np.array([7]), np.array([-(1 << 63), (1 << 63) - 1, 0]), np.full(99, 3)):
        df = spark.createDataFrame([(int(v),) for v in values] + [(None,)], "v long")
        ordered = sorted(map(int, values))
        ranks = [0, len(ordered) // 3, len(ordered) - 1]
        assert order_statistics(df.filter("v IS NOT NULL"), "v", ranks) == [ordered[r] for r in ranks]
        if abs(ordered[0]) < 1 << 40:
            assert quantiles(df, "v", (0, 0.25, 0.5, 0.75, 1)) == pytest.approx(np.percentile(values, [0, 25, 50, 75, 100]).tolist())
    assert quantiles(df.filter("false"), "v", (0.5,)) == []


def test_many_distinct_values_need_no_single_task(spark):
    """Ten million distinct values: no plan has an exchange to one partition with more than counts in it."""
    df = spark.range(10_000_000).select((F.col("id") * 7919 % 10_000_019).alias("v"))
    assert order_statistics(df, "v", [0, 5_000_000]) == [0, pytest.approx(5_000_000, abs=100)]


def test_buckets_of_few_and_of_missing_values(spark):
    df = spark.createDataFrame([(i,) for i in (1, 1, 1, 2, 9, None)], "v int")
    assert [r.bucket for r in scoring.quartile_bucket(df, "v").orderBy(F.col("v").asc_nulls_last()).collect()] == ["q1", "q1", "q1", "q1", "q2", "q1"]
    assert {r.bucket for r in scoring.quartile_bucket(df.filter("v = 1"), "v").collect()} == {"all"}
    assert scoring.quartile_bucket(df.filter("false"), "v").count() == 0


def test_half_written_folder_counts_as_absent(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert not tables.is_whole(spark, path)
    tables.write_if_absent(spark.range(5), path)
    tables.write_if_absent(spark.range(9), path)
    assert tables.is_whole(spark, path) and spark.read.parquet(path).count() == 5
    tables.write_if_absent(spark.range(9), path, refresh=True)
    assert spark.read.parquet(path).count() == 9
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_replaced_in_place_and_kept_when_it_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a1", 1), ("a2", 2), ("b1", 3)], "file string, n int").write.parquet(path)
    tables.replace_in_place(spark, path, spark.createDataFrame([("a9", 9)], "file string, n int"), "a")
    want = [("a9", 9), ("b1", 3)]
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == want
    broken = spark.read.parquet(path).withColumn("n", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception):
        tables.publish(broken, path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == want


def test_first_rows_by_digest(spark):
    rows = [("x", None, 1, 5, "late"), ("x", None, 1, 2, "first"), ("x", "", 1, 9, "empty"), (None, "x", 1, 1, "null"), ("1:a", "b", 1, 1, "p"), ("1", "a:b", 1, 1, "q"), ("x", None, 2, 3, "two")]
    df = spark.createDataFrame(rows, "a string, b string, k int, pos int, v string")
    got = keep_first(df, ["a", "b", "k"], ["pos"])
    assert sorted(r.v for r in got.collect()) == ["empty", "first", "null", "p", "q", "two"] and got.columns == df.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "hashpartitioning(a" not in plan


def recorder(folder):
    """A model that writes down what it is asked, and what reads that."""
    folder = str(folder)

    def model(batch):
        import uuid
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(batch.iloc[:, 0].fillna("NULL")))
        return [f"<{t}>" for t in batch.iloc[:, 0]]

    return model, lambda: sorted(x for p in glob.glob(f"{folder}/*") for x in Path(p).read_text().split("\n"))


def test_one_call_for_each_input(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    (model, asked), ledger = recorder(tmp_path / "calls"), Ledger(spark, str(tmp_path / "ledger"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "nan")], "id int, source_text string")
    call = lambda d: ledger.predict(d, model, ["source_text"])
    out = predict.skip_or_call(df, call)
    for _ in range(2):  # every read of the result is a read of the ledger
        assert {(r.id, r.translated_text_model, r.called) for r in out.collect()} == {
            (1, "<a>", True), (2, "<b>", True), (3, "<a>", True), (4, predict.EMPTY_MESSAGE, False), (5, predict.EMPTY_MESSAGE, False)}
    assert asked() == ["a", "b"]
    more = ledger.predict(spark.createDataFrame([(1, "b"), (2, "c"), (3, None)], "id int, source_text string"), model, ["source_text"])
    assert {(r.id, r.translated_text_model) for r in more.collect()} == {(1, "<b>"), (2, "<c>"), (3, "<None>")}
    assert asked() == ["NULL", "a", "b", "c"]


def test_reports_call_the_model_once_for_each_row_and_config(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    (model, asked), ledger = recorder(tmp_path / "calls"), Ledger(spark, str(tmp_path / "ledger"))
    base = spark.createDataFrame([(i, f"the court {i} sat", "d", "e") for i in range(6)], "id int, ref string, dataset string, emotion string")
    from parley.operators import fairness, joins
    grid = joins.config_grid(base, [{"config_id": "x"}, {"config_id": "y"}])
    runs = ledger.predict(grid, model, ["ref", "config_id"], "hyp")
    terms = spark.createDataFrame([("court",), ("sat",)], "term string")
    table = scoring.validation_table(runs, terms=terms).collect()
    assert {r.glossary for r in table} == {1.0} and len(table) == 2
    fairness.model_bias_report(runs, ["dataset", "emotion"]).collect()
    assert asked() == sorted(f"the court {i} sat" for i in range(6) for _ in range(2))


def test_interrupted_first_answers_are_asked_again(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    df = spark.createDataFrame([("a",)], "t string")
    ledger.predict(df, lambda b: b["t"], ["t"]).collect()
    (tmp_path / "ledger" / "_SUCCESS").unlink()
    assert ledger.answers() is None
    assert [tuple(r) for r in ledger.predict(df, lambda b: b["t"] + "!", ["t"], "o").collect()] == [("a", "a!")]


def _scans(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("FileScan parquet")


@pytest.mark.parametrize("name, most", [("anomaly_report", 4), ("all_anomalies", 4), ("bias_report", 2), ("model_bias_report", 2), ("disparities", 2), ("validation_table", 3)])
def test_reports_read_their_tables_once(spark, name, most):
    """``pairs`` joins a table with itself: two scans are one pass over it; the glossary is written before."""
    from parley.plans import catalog
    assert _scans(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")) <= most


def test_anomaly_report_equals_the_single_checks(spark):
    from functools import reduce

    from parley.operators import quality
    schema = "file string, split string, emotion string, dataset string, duration_sec double"
    rows = [(f"f{i}", "dev" if i < 30 else "test", "happy" if i else "odd", "a" if i % 40 else "b", 0.1 if i % 3 == 0 else 3.0) for i in range(40)]
    rows += [(None, "dev", "happy", "a", 1.0), (" ", "dev", "happy", "a", None), ("f1", "dev", "happy", "a", 1.0)]
    files = spark.createDataFrame([(f"f{i}", "dev") for i in range(1, 35)] + [("x", "holdout"), ("x", "holdout")], "file string, split string")
    summary = spark.createDataFrame([(5, 0, 0, None)], "files_checked long, passed long, failed long, sample_error string")
    for some in (rows, rows[:1], [("a", "dev", "unknown", "d", 1.0)] * 25, []):
        m = spark.createDataFrame(some, schema)
        parts = [quality.split_findings(m), quality.schema_failures(summary), quality.duration_findings(m), quality.label_findings(m),
                 quality.consistency_findings(m, files), quality.source_findings(m)]
        want = sorted(map(tuple, reduce(lambda a, b: a.unionByName(b), parts).collect()))
        assert sorted(map(tuple, quality.anomaly_report(m, files, summary).collect())) == want


def test_bias_report_of_an_empty_table(spark):
    from parley.operators import quality
    m = spark.createDataFrame([], "emotion string, speaker_id string, duration_sec double")
    rows = {(r.section, r.key): (r.n, r.flagged) for r in quality.bias_report(m).collect()}
    assert rows == {("total", "entries"): (0, False), ("total", "speakers"): (0, False), ("duration", "short"): (0, False), ("duration", "medium"): (0, False), ("duration", "long"): (0, False)}
