"""Nearest neighbours by inner product: a neighbour graph built by NN-descent, searched greedily.

Equal vectors are one node.  A first graph comes from windows of vectors that random hyperplanes put side by side.
In every round each node introduces its neighbours, and the nodes that list it, to each other; they keep whom they
find nearer.  Queries start at their own node and walk on to the neighbours of the nearest found so far, and to nodes
that list these.  Graph and walk compare vectors of 8-bit steps; what the walk holds is measured again on the vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.blocks import raw
from parley.llm.store import fewer, kept, partitions

NEAR = "array<struct<score:double,id:bigint>>"
_NEAR = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())]))


@dataclass(frozen=True)
class Graph:
    """Neighbours of a node; windows: how many orders and their length; rounds at most, and the relative gain that ends them;
    who may introduce itself by listing a node, on average; search: nodes held, nodes opened per step, steps, nodes measured."""

    near: int = 24
    orders: int = 16
    window: int = 1024
    rounds: int = 4
    gain: float = 1e-3
    listed: int = 24
    held: int = 256
    opened: int = 40
    steps: int = 7
    sure: int = 64


def usable(vectors: DataFrame) -> DataFrame:
    """(id, vec): vectors as packed 32-bit floats; null, empty, zero ones, those with null or non-finite parts, and rows without id are left out.

    Vectors of another length than most take no part (of equally frequent lengths the shortest counts).
    """
    e = F.col("embedding").cast("array<float>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), e.alias("e")).filter(
        F.col("id").isNotNull() & e.isNotNull()).filter(~bad & F.exists("e", lambda x: x != 0))
    sizes = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                e = part.column("e")
                flat = np.ascontiguousarray(e.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(e), -1)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([r.tobytes() for r in flat], pa.binary())], ["id", "vec"])

    return rows.filter(F.size("e") == (sizes["d"] if sizes else 0)).mapInArrow(run, "id long, vec binary")


def _matrix(column: pa.Array, dtype: type = np.float32) -> np.ndarray:
    data, offsets = raw(column)
    return data.view(np.float32).reshape(len(column), -1).astype(dtype) if len(column) else np.zeros((0, 0), dtype)


def _short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors in 8-bit steps of their largest part, the step behind them."""
    for batch in batches:
        m = _matrix(batch.column("vec"))
        if len(m):
            step = (np.abs(m).max(axis=1, keepdims=True) / 127).astype(np.float32)
            step[step == 0] = np.finfo(np.float32).tiny
            data = np.c_[np.rint(m / step).astype(np.int8).view(np.uint8), step.view(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in data], pa.binary())], ["id", "vec"])


def _long(column: pa.Array) -> np.ndarray:
    data, _ = raw(column)
    if not len(column):
        return np.zeros((0, 0), np.float32)
    data = data.reshape(len(column), -1)
    return data[:, :-4].view(np.int8) * np.ascontiguousarray(data[:, -4:]).view(np.float32)


def _lists(ids: np.ndarray, others: np.ndarray, scores: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    near = pa.StructArray.from_arrays([pa.array(scores.astype(np.float64)), pa.array(others)], ["score", "id"])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), near)], ["id", "near"])


def _best(ids: np.ndarray, m: np.ndarray, most: int) -> pa.RecordBatch:
    """For each vector of a small set its ``most`` nearest in the set."""
    score = m @ m.T
    np.fill_diagonal(score, -np.inf)
    k = min(most, len(ids) - 1)
    top = np.argpartition(-score, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), np.int64)
    return _lists(ids, ids[top].ravel(), np.take_along_axis(score, top, 1).ravel(), np.full(len(ids), k))


def _codes(turns: int, bits: int = 24):
    """Each vector once for each turn, with the sides of that turn's hyperplanes on which it lies."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("vec"))
            for turn in range(turns if len(m) else 0):
                planes = np.random.default_rng(turn + 1).normal(size=(m.shape[1], bits))
                code = ((m @ planes) > 0) @ (1 << np.arange(bits)[::-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(m), turn, np.int32)), pa.array(code.astype(np.int64))], ["id", "vec", "turn", "code"])

    return run


def _window_lists(size: int, most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m, turn = batch.column("id").to_numpy(), _matrix(batch.column("vec")), batch.column("turn").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(turn)) + 1), len(ids)]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                for lo in range(a, b, size):
                    lo = max(a, min(lo, b - size))  # the last window is full, too
                    hi = min(lo + size, b)
                    yield _best(ids[lo:hi], m[lo:hi], most)

    return run


def _nearest(near: Column, most: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(near), asc=False), 1, most)


def _merged(most: int):
    """Of gathered lists the ``most`` nearest different nodes, nearest first."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            row = np.repeat(np.arange(len(near)), np.diff(near.offsets.to_numpy()))
            flat = near.flatten()
            score, other = flat.field("score").to_numpy(), flat.field("id").to_numpy()
            order = np.lexsort((other, row))
            order = order[np.r_[True, (np.diff(row[order]) != 0) | (np.diff(other[order]) != 0)]] if len(order) else order
            order = order[np.lexsort((other[order], -score[order], row[order]))]
            size = np.bincount(row[order], minlength=len(near))
            rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
            order = order[rank < most]
            yield _lists(batch.column("id").to_numpy(), other[order], score[order], np.minimum(size, most))

    return run


def _introduce(most: int):
    """Among the nodes that a node knows, for each the nearest others, if nearer than the last in its own full list (``bar``)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("known")
            edge, flat = known.offsets.to_numpy(), known.flatten()
            edge = edge - edge[0]
            ids, m, bar, parts = flat.field("id").to_numpy(), _long(flat.field("vec")), flat.field("bar").to_numpy(), flat.field("parts").to_numpy()
            to, who, scores, size, part = [], [], [], [], []
            for node, a, b in zip(batch.column("id").to_numpy(), edge[:-1], edge[1:], strict=True):
                score = m[a:b] @ m[a:b].T
                np.fill_diagonal(score, -np.inf)
                if b - a > most:
                    bars = np.maximum(bar[a:b], -np.partition(-score, most - 1, axis=1)[:, most - 1])
                else:
                    bars = bar[a:b]
                row, col = np.nonzero((score >= bars[:, None]) & (score > bar[a:b, None]))
                to.append(ids[a:b])
                who.append(ids[a:b][col])
                scores.append(score[row, col])
                size.append(np.bincount(row, minlength=b - a))
                part.append(node % parts[a:b])
            if to:
                size, to = np.concatenate(size), np.concatenate(to)
                lists = _lists(to, np.concatenate(who), np.concatenate(scores), size)
                out = pa.RecordBatch.from_arrays([lists.column("id"), pa.array(np.concatenate(part)), lists.column("near")], ["id", "part", "near"])
                yield out.filter(pa.array(size > 0))

    return run


def _linked(g: DataFrame, listed: int, seed: int) -> DataFrame:
    """(id, other): whom a node lists, and of those that list it a random share, about ``listed``."""
    out = g.select("id", F.explode("near.id").alias("other"))
    often = out.groupBy("other").agg(F.count("*").alias("n"))
    back = out.join(often, "other").filter(F.pmod(F.xxhash64("id", "other", F.lit(seed)), F.ceil(F.col("n") / listed)) == 0)
    return out.union(back.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()


def graph(nodes: DataFrame, short: DataFrame, how: Graph) -> DataFrame:
    """(id, near): for each node of (id, vec) the nearest nodes found, nearest first; ``short`` has the nodes in 8-bit steps."""
    shares = partitions(nodes.sparkSession)
    schema = f"id long, near {NEAR}"
    turns = nodes.mapInArrow(_codes(how.orders), "id long, vec binary, turn int, code long")
    first = turns.repartitionByRange(shares, "turn", "code", "id").sortWithinPartitions("turn", "code", "id").mapInArrow(_window_lists(how.window, how.near), schema)
    gathered = lambda rows, *by: rows.groupBy(*by).agg(F.flatten(F.collect_list("near")).alias("near"))
    best, many = _merged(how.near), nodes.count()
    g = kept(fewer(gathered(first, "id"), many, 512).mapInArrow(best, schema), "graph")
    before = None
    for turn in range(how.rounds):
        total = g.agg(F.sum(F.aggregate("near", F.lit(0.0), lambda a, x: a + x["score"]))).first()[0]
        if total is None or before is not None and total - before <= how.gain * abs(before):
            break
        before = total
        # a node that many list is told much: it is gathered in parts of about 256 tellers
        often = g.select(F.explode("near.id").alias("id")).groupBy("id").agg(F.ceil(F.count("*") / 256).alias("parts"))
        bar = F.when(F.size("near") >= how.near, F.element_at("near", -1)["score"]).otherwise(F.lit(float("-inf")))
        cards = short.join(g.select("id", bar.alias("bar")), "id").join(often, "id", "left").select(
            F.col("id").alias("other"), "vec", "bar", F.coalesce("parts", F.lit(1)).alias("parts"))
        known = _linked(g, how.listed, turn).join(cards, "other").groupBy("id").agg(
            F.collect_list(F.struct(F.col("other").alias("id"), "vec", "bar", "parts")).alias("known"))
        told = fewer(known, many, 256).mapInArrow(_introduce(how.near), f"id long, part long, near {NEAR}")
        told = fewer(gathered(told, "id", "part"), many, 512).select("id", "near").mapInArrow(best, schema)
        g = kept(fewer(gathered(g.union(told), "id"), many, 512).mapInArrow(best, schema), "graph")
    return g


def _scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inner products in double precision."""
    for batch in batches:
        if batch.num_rows:
            s = np.einsum("ij,ij->i", _matrix(batch.column("own"), np.float64), _matrix(batch.column("vec"), np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(s)], ["query", "id", "score"])


def _look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The neighbours of opened nodes with their inner products with the query."""
    for batch in batches:
        own, around = _matrix(batch.column("own")), batch.column("around")
        size = np.diff(around.offsets.to_numpy())
        flat = around.flatten()
        m, row = _long(flat.field("vec")), np.repeat(np.arange(len(size)), size)
        score = np.concatenate([np.einsum("ij,ij->i", own[row[lo:lo + 65536]], m[lo:lo + 65536]) for lo in range(0, len(row), 65536)] or [np.zeros(0)])
        found = _lists(batch.column("query").to_numpy(), flat.field("id").to_numpy(), score, size)
        yield pa.RecordBatch.from_arrays(found.columns, ["query", "near"])


def _advance(held: int, opened: int):
    """The nearest different nodes met so far, and those of them to open next."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best = next(_merged(held)([batch.select(["query", "beam"]).rename_columns(["id", "near"])]))
            beam, done = best.column("near"), batch.column("done")
            b, d = beam.offsets.to_numpy(), done.offsets.to_numpy() - done.offsets[0].as_py()
            ids, past = beam.flatten().field("id").to_numpy(), done.flatten().to_numpy()
            go = [ids[b[i]:b[i + 1]][~np.isin(ids[b[i]:b[i + 1]], past[d[i]:d[i + 1]])][:opened] for i in range(len(beam))]
            done = [np.r_[past[d[i]:d[i + 1]], x] for i, x in enumerate(go)]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("own"), beam, pa.array(done, longs), pa.array(go, longs)],
                                             ["query", "own", "beam", "done", "go"])

    return run


def search(queries: DataFrame, nodes: DataFrame, short: DataFrame, g: DataFrame, how: Graph) -> DataFrame:
    """(query, id, score): for each query (query, node, own) the nearest nodes met on a greedy walk from its own node."""
    around = _linked(g, how.listed, -1).join(short.select(F.col("id").alias("other"), "vec"), "other").groupBy("id").agg(
        F.collect_list(F.struct(F.col("other").alias("id"), "vec")).alias("around"))
    around = kept(around, "around")
    own = F.array(F.struct(F.lit(float("inf")).alias("score"), F.col("node").alias("id")))  # the own node stays in the beam
    many = queries.count()
    walk = queries.select("query", "own", own.cast(NEAR).alias("beam"), F.array("node").alias("done"), F.array("node").alias("go"))
    for _ in range(how.steps):
        opened = walk.select("query", "own", F.explode("go").alias("id")).join(around, "id").select("query", "own", "around")
        met = fewer(opened, many, 32).mapInArrow(_look, f"query long, near {NEAR}").groupBy("query").agg(F.flatten(F.collect_list("near")).alias("met"))
        on = walk.join(met, "query", "left").select("query", "own", F.concat("beam", F.coalesce("met", F.array().cast(NEAR))).alias("beam"), "done")
        walk = kept(fewer(on, many, 32).mapInArrow(_advance(how.held, how.opened), f"query long, own binary, beam {NEAR}, done array<bigint>, go array<bigint>"), "walk")
    sure = walk.select("query", "own", F.explode(F.slice("beam", 1, how.sure)).alias("b")).select("query", "own", F.col("b.id").alias("id"))
    return fewer(sure.join(nodes, "id").select("query", "own", "id", "vec"), many, 32).mapInArrow(_scores, "query long, id long, score double")


def neighbours(vectors: DataFrame, is_query: Column, most: int = 20, how: Graph | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row (vec_id, embedding) that ``is_query`` holds for, its ``most`` nearest other rows.

    Nearest means the largest inner product in double precision, ties to the smaller vec_id.  Repeated rows of one
    vec_id count once.  A query has fewer neighbours only where fewer rows exist.  An empty table gives no rows.
    """
    how = how or Graph()
    rows = kept(usable(vectors), "vectors")
    # equal vectors are one node, named by their smallest id; no list needs more of its rows than ``most`` and the query itself
    named = rows.groupBy("vec").agg(F.min("id").alias("node"))
    nodes = kept(named.select(F.col("node").alias("id"), "vec"), "nodes")
    owner = kept(rows.join(named, "vec").select("id", "node").distinct(), "owners")
    queries = kept(rows.filter(is_query(F.col("id"))).join(named, "vec").select(F.col("id").alias("query"), "node", F.col("vec").alias("own")).dropDuplicates(["query"]), "queries")
    short = kept(nodes.mapInArrow(_short, "id long, vec binary"), "short")
    found = search(queries, nodes, short, graph(nodes, short, how), replace(how, sure=max(how.sure, 2 * most + 2)))
    best = found.groupBy("query").agg(_nearest(F.collect_list(F.struct("score", "id")), most + 1).alias("near"))
    best = best.select("query", F.explode("near").alias("b")).select("query", F.col("b.score").alias("score"), F.col("b.id").alias("node"))
    members = _first_members(owner, most + 1)
    rows_ = best.join(members, "node").select("query", "score", F.explode("members").alias("id")).filter("id != query")
    ordered = rows_.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, most).alias("l"))
    return ordered.select(F.col("query").alias("query_id"), F.posexplode("l").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _first_members(owner: DataFrame, most: int) -> DataFrame:
    """(node, members): the smallest ids of each node, gathered in two steps so that no group is whole in one place."""
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    few = lambda c: F.slice(F.array_sort(c), 1, most)
    part = owner.groupBy("node", salt.alias("salt")).agg(few(F.collect_list("id")).alias("m"))
    return part.groupBy("node").agg(few(F.flatten(F.collect_list("m"))).alias("members"))
