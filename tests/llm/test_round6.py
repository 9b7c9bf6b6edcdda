"""Memory of text pieces, tasks of the neighbour search, exchanges of a round of components."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import blocks, components, mil, nn_descent
from parley.llm.store import fewer


def test_texts_of_a_batch_take_little_memory():
    rng = random.Random(1)
    words = ["alpha", "be", "Gamma,", "delta.", "x1", "epsilon-zeta"]
    text = [" ".join(rng.choices(words, k=350)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(text)], ["text"])
    assert batch.nbytes > 6 << 20
    tracemalloc.start()
    n = sum(len(mil.passages(*blocks.raw(part.column("text")), 64)[1]) for part in blocks.pieces(batch, "text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 * 6
    assert peak < 60 << 20  # a few times the piece's words and bytes, not the batch's


@pytest.fixture
def many_shares(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_a_small_graph_takes_few_tasks(many_shares):
    spark, rng = many_shares, np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tobytes()) for i in range(300)]
    nodes = spark.createDataFrame([(i, bytearray(v)) for i, v in rows], "id long, vec binary")
    short = nodes.mapInArrow(nn_descent._short, "id long, vec binary")
    g = nn_descent.graph(nodes, short, nn_descent.Graph(rounds=1))
    assert len(g.inputFiles()) <= spark.sparkContext.defaultParallelism
    assert g.count() == 300


def test_large_inputs_keep_their_tasks(many_shares):
    df = many_shares.range(1000).repartition(60, "id")
    assert fewer(df, 60 * 512, 512).rdd.getNumPartitions() == 60
    assert fewer(df, 20 * 512, 512).rdd.getNumPartitions() == 20
    assert fewer(df, 0, 512).rdd.getNumPartitions() == many_shares.sparkContext.defaultParallelism


def _reach(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {x: top(x) for x in up}


@pytest.mark.parametrize("edges", [
    [], [(1, 1), (None, 2), (3, None)], [(5, 4)], [(4, 5)], [(4, 5), (4, 5), (5, 4)], [(2, 1), (3, 1), (9, 9)], [(1, 9), (2, 9), (3, 9)],
    [(i, i + 1) for i in range(60)], [(-i, 7 - i) for i in range(40)],
    [tuple(random.Random(k).choices(range(-60, 90), k=2)) for k in range(110)]])
def test_components_equal_union_find(spark, edges):
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({r.id for r in found})
    assert {r.id: r.component for r in found} == _reach(edges)


def test_a_round_of_components_has_two_exchanges(spark):
    e = spark.createDataFrame([(2, 1), (3, 2)], "a long, b long")
    done = components._small_star(components._large_star(e))._jdf.queryExecution().executedPlan().toString()
    assert done.count("Exchange") == 2
