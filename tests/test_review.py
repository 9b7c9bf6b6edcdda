"""Cases that the test tables do not hold: uneven, tied and null orders of hot keys, and reports that are missing."""

import pytest
from pyspark.sql import functions as F

from parley.operators import quality
from parley.operators.ordered import OrderedScan
from parley.streaming import live


def _ranks(spark, rows, keys):
    df = spark.createDataFrame(rows, "k string, pos long, tie long")
    scan = OrderedScan(df, keys, ["pos", "tie"], 8)
    slabs = [r["count"] for r in scan.df.groupBy("_slab").count().collect()]
    return scan.has_hot, slabs, scan.row_number("rank").result().collect()


@pytest.mark.parametrize("keys", [["k"], []])
def test_one_outlier_does_not_fill_one_slab(spark, keys):
    hot, slabs, out = _ranks(spark, [("a", i, 0) for i in range(4000)] + [("a", 10**12, 0)], keys)
    assert hot and max(slabs) < 2 * 4001 / 8
    assert sorted(r["rank"] for r in out) == list(range(1, 4002))
    assert all(r["rank"] == r["pos"] + 1 for r in out if r["pos"] < 4000)


def test_nulls_come_first_and_ties_stay_together(spark):
    rows = [("a", None, i) for i in range(30)] + [("a", i // 3, i) for i in range(900)] + [("b", 1, 1)]
    hot, _, out = _ranks(spark, rows, ["k"])
    a = [r for r in out if r["k"] == "a"]
    assert hot and sorted(r["rank"] for r in a) == list(range(1, 931))
    assert sorted(r["rank"] for r in a if r["pos"] is None) == list(range(1, 31))
    assert all(r["rank"] == 31 + r["tie"] for r in a if r["pos"] is not None)


def test_order_of_nulls_only_and_empty_table(spark):
    _, _, out = _ranks(spark, [("a", None, i) for i in range(20)], ["k"])
    assert sorted(r["rank"] for r in out) == list(range(1, 21))
    assert _ranks(spark, [], ["k"])[2] == []


def test_missing_summary_is_a_finding(spark):
    none = spark.createDataFrame([], "files_checked long, passed long, failed long, label_errors long, sample_error string")
    assert quality.schema_failures(none).count() == 1
    assert quality.schema_failures(none, enabled=False).count() == 0


def test_every_label_error_is_in_the_report(spark):
    reports = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "path string, passed boolean")
    errors = spark.createDataFrame([("b", "bad"), ("c", "bad")], "path string, error string")
    out = {(r["section"], r["key"]): r["n"] for r in quality.quality_report(reports, errors).collect()}
    assert out == {("files", "files_checked"): 3, ("files", "passed"): 1, ("files", "failed"): 2,
                   ("label error", "b: bad"): 1, ("label error", "c: bad"): 1}
    assert quality.quality_report(reports, errors.filter(F.lit(False))).count() == 3


def test_stream_keeps_rows_of_one_time(spark, tmp_path):
    schema = "session string, seq long, text string, row long"
    first = [("a", 5, "x", 8), ("a", 5, "y", 7), ("a", 5, "y", 7), ("a", 9, "z", 3)]
    for part in (first, [("a", 9, "u", 4), ("a", 5, "x", 8)]):  # one more of the same time, and a replay
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = live.drain(live.history_stream(live.chunk_stream(spark, str(tmp_path / "in"), schema), "text", row="row"), str(tmp_path / "work")).collect()
    assert sorted((r.utterance, r.seq, r.text) for r in got) == [(1, 5, "y"), (2, 5, "x"), (3, 9, "z"), (4, 9, "u")]


def test_stream_queries_keep_events_of_one_microsecond(spark, tmp_path):
    from parley.plans.base import QUERIES
    from parley.plans import live_queries  # noqa: F401
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id").limit(20)
    ts = e.first()["ts"]
    e.withColumns({"user_id": F.lit(1).cast(e.schema["user_id"].dataType), "ts": F.lit(ts).cast(e.schema["ts"].dataType)}).coalesce(1).write.parquet(
        str(tmp_path / "events.parquet"))
    out = QUERIES["history_stream"](spark, str(tmp_path)).collect()
    assert sorted(r["utterance"] for r in out) == list(range(1, 21))
